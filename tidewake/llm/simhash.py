"""SimHash near-duplicates: fingerprints, pivot distance tables, links and components.

Two fingerprints link when they differ in ``radius`` = 2 bits or fewer. Distances to a pivot obey |d(x,p) - d(y,p)| <=
d(x,y), and this holds for each part of a fingerprint alone. So the tables hold, for each of four parts of 16 bits, the
distances to eight reference parts; the sum over parts of the largest coordinate difference is at most d(x,y). A linked pair
can thus differ in the coordinates of two parts at most, and the coordinates of the other two are equal: pairs come from an
equi-join on the coordinates of any two parts, those whose sum of largest differences is over the radius are discarded, and
the exact distance is computed for the rest. (One coordinate of a whole fingerprint keeps a third of all pairs: whole
fingerprints lie too evenly around any pivot to be parted by it.)

A key with over ``crowd`` distinct fingerprints isn't paired, as pivots can't part what is close together. All its
fingerprints send themselves to the 65 points within one bit of them: two of them link exactly if they meet at a point, and
a point is met by 65 at most. So no pair is lost and rows grow with the number of fingerprints, however large a group of
near copies is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import shingles
from tidewake.llm.common import Scratch, keep_rows, row_id, table
from tidewake.llm.components import star_components

#: Parts of a fingerprint, and the reference parts of each: bits of XXH64 of their number.
PARTS, PIVOTS = 4, 8
REFERENCE = tuple(tuple(xxhash.xxh64_intdigest(str(i), 7) >> 16 * a & 0xFFFF for i in range(PIVOTS)) for a in range(PARTS))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text's shingles of ``width`` words, repeats included; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        pieces = [whole]
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        pieces = [whole[i:j] for i, j in zip((ends - lens)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(pieces), 8192):
        raw = np.frombuffer(b"".join([digest(p, seed) for p in pieces[at : at + 8192]]), np.uint8)
        counts += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(pieces)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, bands: bool = False) -> DataFrame:
    """(doc_id, rid, fp) of every row, and with ``bands`` (wid, size, bands) of its shingles: one pass over whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), width, seed) for t in b.column("text")]
            cols, names = [b.column("doc_id"), b.column("rid"), pa.array(fp, pa.int64())], ["doc_id", "rid", "fp"]
            if bands:
                wid = pa.array([shingles.same_words(t.as_py()) for t in b.column("text")], pa.int64())
                sets = [shingles.shingles(t.as_py()) for t in b.column("text")]
                cols += [wid, pa.array(map(len, sets), pa.int32()), pa.array(map(shingles.bands, sets), pa.list_(pa.int64()))]
                names += ["wid", "size", "bands"]
            yield pa.RecordBatch.from_arrays(cols, names)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_id(id_col, text_col).alias("rid"), F.col(text_col).cast("binary").alias("text"))
    return base.mapInArrow(run, "doc_id long, rid struct<hi:long,lo:long>, fp long" + (", wid long, size int, bands array<long>" if bands else ""))


def coordinates(fp: Column, part: int) -> Column:
    """The distances of a fingerprint's part to its pivots, a byte each."""
    own = F.shiftrightunsigned(fp, 16 * part).bitwiseAND(F.lit(0xFFFF))
    out = F.lit(0).cast("long")
    for i, p in enumerate(REFERENCE[part]):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(own.bitwiseXOR(F.lit(p))).cast("long"), 8 * i))
    return out


def _widest(a: Column, b: Column) -> Column:
    """The largest difference of two parts' coordinates."""
    at = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
    return F.when(a == b, F.lit(0).cast("long")).otherwise(F.greatest(*[F.abs(at(a, i) - at(b, i)) for i in range(PIVOTS)]))


def near(pairs: DataFrame, radius: int) -> tuple[Column, Column]:
    """Of pairs (a, b, a0..., b0...): whether the coordinates allow a link, and whether there is one."""
    apart = sum((_widest(F.col(f"a{k}"), F.col(f"b{k}")) for k in range(PARTS)), F.lit(0))
    return apart <= radius, F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius


def tables(prints: DataFrame) -> DataFrame:
    """(key, fp): a row for each two parts, whose coordinates make the key."""
    held = prints.select("fp", *[coordinates(F.col("fp"), k).alias(f"c{k}") for k in range(PARTS)])
    keys = [F.xxhash64(F.lit(PARTS * a + b), F.col(f"c{a}"), F.col(f"c{b}")) for a in range(PARTS) for b in range(a + 1, PARTS)]
    return held.select(F.explode(F.array(*keys)).alias("key"), "fp")


def candidates(met: DataFrame) -> DataFrame:
    """(a, b, a0..., b0...): pairs of fingerprints that share a key, with the coordinates of both, before any is discarded."""
    side = lambda c: met.select("key", F.col("fp").alias(c), *[coordinates(F.col("fp"), k).alias(f"{c}{k}") for k in range(PARTS)])
    return side("a").join(side("b"), "key").where(F.col("a") < F.col("b")).drop("key")


def links(prints: DataFrame, scratch: Scratch, radius: int = 2, crowd: int = 64) -> DataFrame:
    """prints (fp, distinct) -> (a, b): links enough to join every two fingerprints within 2 bits, directly or by a hub that both are within 2 bits of."""
    if radius != 2:
        raise ValueError("the pivot tables hold for a radius of 2")
    rows = tables(prints)
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.save(rows.join(shared, "key"), "met")
    pairs = candidates(met.where(F.col("n") <= crowd))
    possible, linked = near(pairs, radius)
    pairs = pairs.where(possible).where(linked).select("a", "b")
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    meet = met.where(F.col("n") > crowd).select("fp").distinct().select("fp", F.explode(points).alias("at")).groupBy("at").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    hubs = meet.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b")
    return pairs.union(hubs).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, crowd: int = 64, jaccard: float | None = None) -> DataFrame:
    """(doc_id, rid, fp, component_id, keep_key) of every row.

    jaccard: texts whose sets of 5-word shingles are that similar link too, however far apart their fingerprints are (``shingles``).

    component_id: the least doc_id reachable over links; keep_key: the rid of one row that has it. Nulls: a null text has no
    words; a null doc_id counts after every number, and a component of nulls only has a null id. Repeated rows and ties get
    equal results. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, id_col, text_col, width, bands=jaccard is not None), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    prints = scratch.save(rows.groupBy("fp").agg(first), "distinct")
    linked = links(prints.select("fp"), scratch, crowd=crowd)
    if jaccard is not None:
        texts = docs.select(row_id(id_col, text_col).alias("rid"), F.col(text_col).cast("binary").alias("text"))
        linked = linked.union(shingles.links(rows, texts, scratch, jaccard))
    stars = star_components(linked, scratch)
    rooted = prints.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = scratch.save(rooted.select("fp", "root").join(least, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("keep_key")), "named")
    return rows.join(named, "fp").select("doc_id", "rid", "fp", "component_id", "keep_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: float | None = None) -> DataFrame:
    """docs without the rows of each component that are not its first; columns as they were."""
    named = components(docs, id_col, text_col, jaccard=jaccard)
    keep = named.where(F.col("rid") == F.col("keep_key")).groupBy("keep_key").agg(F.count("*").alias("n"))
    keep = Scratch(docs.sparkSession, "simhash-keep").save(keep, "keep")
    return keep_rows(docs, keep, row_id(id_col, text_col), again=not keep.where("n > 1").isEmpty())


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = components(table(spark, sf_dir, "documents"))
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
