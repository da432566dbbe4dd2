"""Near copies by the Jaccard similarity of word shingles: MinHash tables propose pairs, whole shingle sets decide.

A text's set holds its distinct runs of WIDTH = 5 words in lower case (the whole text where it has fewer), as 64-bit hashes. Its
least values under BANDS x DEPTH = 24 x 5 multipliers make 24 keys; texts that share a key meet. A pair of similarity s shares
none with probability (1 - s^5)^24: 7 in 100,000 pairs at 0.8, none to speak of above 0.85. Texts that meet anyone get a
sketch, four bits of the least value under each of 256 other multipliers, and pairs whose sketches agree in fewer than
``AGREE`` places are discarded where they meet; a pair of similarity 0.8 has 208 agreements on average and falls below with
probability 3 in 1,000,000. What is left is held against each other by whole sets, so every link is exact.

All texts of a key are first held against one hub among them, the same for many keys. Texts that are in one component by then
need no more links among them: of a key whose texts are in several components, all are held against another hub outside of
its largest one, and then those outside of the largest meet all others across components. There the join itself discards, by
sizes, sketches and short forms of the sets (``short``), all that can't be alike. Near copies share many keys, so two texts are
held against each other only where they first meet: at the first band that they have in common (``_first``). So a large group
of copies costs a few rows for each text, no key is left out however many texts it has, and what comes out of the join are
pairs that are almost surely links between components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import Scratch
from tidewake.llm.components import star_components

WIDTH, BANDS, DEPTH = 5, 24, 5
#: Places of a sketch, as WORDS numbers of 16 places each, and how many must agree (4.5 deviations below the mean at 0.8).
WORDS, AGREE = 16, 180
#: Texts of a key that all its others are held against before pairs are made.
HUBS = 2
_PLACE = np.array([xxhash.xxh64_intdigest(f"place{k}") | 1 for k in range(WIDTH)], np.uint64)
_TIMES = np.array([xxhash.xxh64_intdigest(f"times{k}") | 1 for k in range(BANDS * DEPTH)], np.uint64)
_SKETCH = np.array([xxhash.xxh64_intdigest(f"sketch{k}") | 1 for k in range(16 * WORDS)], np.uint64)
_PLACES = 0x1111111111111111


def shingles(text: bytes | None) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted; empty without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)
    n = max(1, len(w) - WIDTH + 1)
    h = np.full(n, len(w) if len(w) < WIDTH else WIDTH, np.uint64)
    for k in range(min(WIDTH, len(w))):
        h += w[k : k + n] * _PLACE[k]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def _least(held: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The least value of a set under each multiplier."""
    least = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), 1024):
        np.minimum(least, np.multiply.outer(times, held[at : at + 1024]).min(axis=1), out=least)
    return least


def bands(held: np.ndarray) -> list[int]:
    """The keys of a set, none for an empty one."""
    if not len(held):
        return []
    return [int.from_bytes(xxhash.xxh64_digest(row.tobytes(), k), "little", signed=True) for k, row in enumerate(_least(held, _TIMES).reshape(BANDS, DEPTH))]


def sketch(held: np.ndarray) -> np.ndarray:
    """Four bits of the least value under each multiplier of the sketch, sixteen to a number."""
    four = (_least(held, _SKETCH) >> np.uint64(20)) & np.uint64(15)
    return (four.reshape(WORDS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def same_words(text: bytes | None) -> int:
    """A number of a text's words in order."""
    return int.from_bytes(xxhash.xxh64_digest(b" ".join((text or b"").lower().split())), "little", signed=True)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def short(held: np.ndarray) -> np.ndarray:
    """A set by sixteen bits of its hashes."""
    return np.unique(held.astype("<u2")).view("<i2")


def most_alike(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> float:
    """An upper bound of the similarity of two sets, from their short forms: what they share falls on what those share, and no more than the members that fell together are lost."""
    both = min(len(np.intersect1d(a, b, assume_unique=True)) + min(size_a - len(a), size_b - len(b)), size_a, size_b)
    return both / max(1, size_a + size_b - both)


def _sets(wanted: DataFrame) -> DataFrame:
    """(wid, fp, size, held, short, s0...) of texts: their sets, whole and by fewer bits, and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column("text")]
            cells = np.array([sketch(s) for s in sets], np.int64).reshape(len(sets), WORDS)
            cols = [b.column("wid"), b.column("fp"), pa.array(map(len, sets), pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([short(s) for s in sets], pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(cells[:, k]) for k in range(WORDS)]], ["wid", "fp", "size", "held", "short", *_CELLS])

    return wanted.select("wid", "fp", "text").mapInArrow(run, "wid long, fp long, size int, held binary, short array<short>, " + ", ".join(f"{c} long" for c in _CELLS))


_CELLS = [f"s{k}" for k in range(WORDS)]
_LANES = [f"lane{k}" for k in range(BANDS // 2)]


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) those whose sets are alike, with their fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(s.as_py(), np.uint64) for s in b.column(c)] for c in ("held_a", "held_b"))
            good = pa.array([similarity(p, q) >= least for p, q in zip(x, y, strict=True)], pa.bool_())
            yield b.select(["a", "b", "fp_a", "fp_b"]).filter(good)

    of = lambda c: sets.select(F.col("wid").alias(c), F.col("fp").alias(f"fp_{c}"), F.col("held").alias(f"held_{c}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "fp_a", "fp_b", "held_a", "held_b")
    return met.mapInArrow(run, "a long, b long, fp_a long, fp_b long")


def _plausible(x: str, y: str, least: float) -> Column:
    """Sizes that can be that alike, and sketches that agree in AGREE places or more; columns are named {column}{suffix}."""
    differ = F.lit(0)
    for c in _CELLS:
        d = F.col(f"{c}{x}").bitwiseXOR(F.col(f"{c}{y}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        differ = differ + F.bit_count(d.bitwiseAND(F.lit(_PLACES)))
    a, b = f"size{x}", f"size{y}"
    return (F.least(a, b) >= F.greatest(a, b) * F.lit(least - 1e-9)) & (differ <= 16 * WORDS - AGREE)


def _fitting(x: str, y: str, least: float) -> Column:
    """Whether ``most_alike`` of the short forms reaches ``least``."""
    a, b = F.col(f"size{x}"), F.col(f"size{y}")
    lost = F.least(a - F.size(f"short{x}"), b - F.size(f"short{y}"))
    both = F.least(F.size(F.array_intersect(f"short{x}", f"short{y}")) + lost, a, b)
    return both >= (a + b) * F.lit(least / (1 + least)) - 1e-6


def _lanes(bands: Column) -> list[Column]:
    """32 bits of each band's key, two to a number."""
    low = lambda k: bands[k].bitwiseAND(F.lit(0xFFFFFFFF))
    return [low(k).bitwiseOR(F.shiftleft(low(k + 1), 32)).alias(c) for k, c in zip(range(0, BANDS, 2), _LANES, strict=True)]


def _first(x: str, y: str) -> Column:
    """Whether no band before the one that two texts meet at (``at``) has equal lanes; so each pair is held at one key, but for 1 in 100 million that have equal lanes of unequal keys and are missed."""
    earlier = F.lit(False)
    for k in range(BANDS - 1):
        differ = F.shiftrightunsigned(F.col(f"{_LANES[k // 2]}{x}").bitwiseXOR(F.col(f"{_LANES[k // 2]}{y}")), 32 * (k % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
        earlier = earlier | ((F.col(f"at{x}") > k) & (differ == 0))
    return ~earlier


def _named(df: DataFrame, suffix: str, *more: str) -> DataFrame:
    return df.select("key", *[F.col(c).alias(f"{c}{suffix}") for c in ("wid", "size", *_CELLS, *more)])


def links(rows: DataFrame, texts: DataFrame, scratch: Scratch, least: float = 0.8) -> DataFrame:
    """rows (rid, fp, wid, size, bands) and texts (rid, text binary) -> (a, b): fingerprints of texts that are alike, enough of them for the components."""
    one = rows.where("size > 0").groupBy("wid").agg(F.min(F.struct("rid", "fp", "bands")).alias("r")).select("wid", "r.*")
    one = scratch.save(one, "texts")
    keys = one.select("wid", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    meet = scratch.save(keys.join(shared, "key").select("key", "wid"), "meet")
    wanted = one.select("wid", "rid", "fp").join(meet.select("wid").distinct(), "wid")
    sets = scratch.save(_sets(wanted.join(texts, "rid").dropDuplicates(["rid"])), "sets")  # a repeated row has the same set
    held = scratch.save(meet.join(sets.select("wid", "size", *_CELLS), "wid"), "sketches")
    left, found = held, None
    for k in range(HUBS):
        hub = F.min(F.struct(F.xxhash64(F.lit(k), "wid").alias("order"), "wid", "size", *_CELLS)).alias("h")
        if k:
            left = split.where(F.col("group") != F.col("top"))
        hubs = left.groupBy("key").agg(hub).select("key", *[F.col(f"h.{c}").alias(f"{c}_b") for c in ("wid", "size", *_CELLS)])
        asked = _named(split if k else held, "_a").join(hubs, "key").where((F.col("wid_a") != F.col("wid_b")) & _plausible("_a", "_b", least))
        asked = asked.select(F.least("wid_a", "wid_b").alias("a"), F.greatest("wid_a", "wid_b").alias("b")).distinct()
        direct = scratch.save(_alike(asked, sets, least), f"alike-hubs{k}")
        found = direct if found is None else found.union(direct)
        roots = star_components(found.select("a", "b"), Scratch(scratch.spark, "shingles"))
        # keys whose texts are in several components, with the largest of these
        named = (split.drop("group", "top") if k else held).join(roots.withColumnRenamed("node", "wid"), "wid", "left").withColumn("group", F.coalesce("root", "wid")).drop("root")
        named = scratch.save(named, f"named{k}")
        parts = named.groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("group", F.struct("n", "group")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
        split = scratch.save(named.join(parts.select("key", "top"), "key"), f"split{k}")
    held = split.join(sets.select("wid", "short"), "wid").join(one.select("wid", "bands"), "wid")
    held = held.withColumn("at", F.array_position("bands", F.col("key")).cast("int") - 1).select(*[c for c in held.columns if c != "bands"], "at", *_lanes(F.col("bands")))
    held = scratch.save(held, "across")
    rest = _named(held.where(F.col("group") != F.col("top")), "_a", "group", "short", "at", *_LANES)
    across = (F.col("group_a") != F.col("group_b")) & ((F.col("group_b") == F.col("top_b")) | (F.col("wid_a") < F.col("wid_b")))
    pairs = rest.join(_named(held, "_b", "group", "short", "top", *_LANES), "key").where(across & _first("_a", "_b") & _plausible("_a", "_b", least) & _fitting("_a", "_b", least))
    pairs = pairs.select(F.least("wid_a", "wid_b").alias("a"), F.greatest("wid_a", "wid_b").alias("b"))
    found = found.union(scratch.save(_alike(pairs, sets, least), "alike"))
    return found.where("fp_a <> fp_b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()
