"""Exact dedup against a minimal perfect hash over historical distinct digests.

History (rows of earlier batches) becomes one entry for each distinct SHA-256 digest, dealt over shards by the digest's last
bytes. A shard's minimal perfect hash sends its n digests to n slots; a slot holds the full digest, the winner's locator
and the number of copies so far. A new batch is first grouped by digest, so a copied text is one row however often it
occurs; each looks up its slot and compares all 32 bytes there. Members add to the slot's class, others group separately.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import Scratch, keep_rows, table

#: Distinct digests for each shard, about; a shard is one task's group.
SHARD = 32_768
CLASS = "digest binary, doc_id long, part int, n long"
INDEX = "shard int, hash binary, digests binary, doc_ids binary, nulls binary, parts binary, counts binary"


class PerfectHash:
    """Bit arrays by level: a key's slot is the rank of its bit in the first level where no other key hit that bit."""

    def __init__(self, levels: list[np.ndarray], rest: list[bytes]):
        self.levels, self.rest = levels, {d: k for k, d in enumerate(rest)}
        self.below, total = [], 0
        for bits in levels:
            self.below.append(total + np.concatenate([[0], np.cumsum(bits)]))
            total += int(bits.sum())
        self.size, self.placed = total + len(rest), total

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys[:, 0] + np.uint64(2 * level + 1) * keys[:, 1]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(size)).astype(np.int64)

    @staticmethod
    def _keys(digests: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(d[:16] for d in digests), "<u8").reshape(-1, 2)

    @classmethod
    def build(cls, digests: list[bytes], load: float = 2.0, depth: int = 32) -> PerfectHash:
        keys, left, levels = cls._keys(digests), np.arange(len(digests)), []
        for level in range(depth):
            if not len(left):
                break
            size = max(8, int(load * len(left)))
            at = cls._at(keys[left], level, size)
            once = np.bincount(at, minlength=size) == 1
            levels.append(once)
            left = left[~once[at]]
        return cls(levels, [digests[k] for k in left])

    def slots(self, digests: list[bytes]) -> np.ndarray:
        """The slot of each digest; of one that isn't in the set, any slot or -1."""
        keys = self._keys(digests)
        out, open_ = np.full(len(digests), -1), np.arange(len(digests))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self._at(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.below[level][at[hit]]
            open_ = open_[~hit]
        for k in open_:
            out[k] = self.placed + self.rest[digests[k]] if digests[k] in self.rest else -1
        return out

    def dumps(self) -> bytes:
        head = np.array([len(self.levels), len(self.rest), *map(len, self.levels)], "<u4").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels) + b"".join(self.rest)

    @classmethod
    def loads(cls, data: bytes) -> PerfectHash:
        n, rest = np.frombuffer(data, "<u4", 2).tolist()
        sizes, at, levels = np.frombuffer(data, "<u4", n, 8).tolist(), 8 + 4 * n, []
        for size in sizes:
            held = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, held, at), count=size).astype(bool))
            at += held
        return cls(levels, [data[at + 32 * k : at + 32 * (k + 1)] for k in range(rest)])


def _shard_of(shards: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 57, 7), 16, 10).cast("int"), F.lit(shards)).alias("shard")


def build_index(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """classes (CLASS, a row for each digest) -> the index, a row for each shard, and the number of shards."""
    shards = -(-max(1, classes.count()) // SHARD)

    def one(t: pa.Table) -> pa.Table:
        digests = t.column("digest").to_pylist()
        perfect = PerfectHash.build(digests)
        order = np.argsort(perfect.slots(digests))
        ids = t.column("doc_id").combine_chunks()
        cells = {
            "hash": perfect.dumps(), "digests": b"".join(digests[k] for k in order), "doc_ids": ids.fill_null(0).to_numpy()[order].tobytes(), "nulls": ids.is_null().to_numpy(zero_copy_only=False)[order].tobytes(),
            "parts": t.column("part").to_numpy()[order].astype("int32").tobytes(), "counts": t.column("n").to_numpy()[order].astype("int64").tobytes(),
        }
        return pa.table({"shard": t.column("shard")[:1]} | {k: pa.array([v], pa.binary()) for k, v in cells.items()})

    sharded = classes.select("digest", "doc_id", "part", "n", _shard_of(shards))
    return scratch.save(sharded.groupBy("shard").applyInArrow(one, INDEX), "index"), shards


def _cells(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Classes as arrays: digests as rows of bytes, ids (0 for null), nulls, parts and counts."""
    ids = t.column("doc_id").combine_chunks()
    digests = np.frombuffer(b"".join(t.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
    return digests, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), t.column("part").to_numpy(), t.column("n").to_numpy()


def _classes_of(parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    digests, ids, nulls, own, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pa.table({"digest": pa.array([d.tobytes() for d in digests], pa.binary()), "doc_id": pa.array(ids, pa.int64(), mask=nulls), "part": pa.array(own, pa.int32()), "n": pa.array(n, pa.int64())})


def merge(index: DataFrame, shards: int, fresh_classes: DataFrame) -> DataFrame:
    """All classes (CLASS) of history and a new batch that is already grouped by digest."""

    def run(held: pa.Table, new: pa.Table) -> pa.Table:
        mine = _cells(new)
        if not held.num_rows:
            return _classes_of([mine])
        cell = held.to_pylist()[0]
        perfect = PerfectHash.loads(cell["hash"])
        slots = (np.frombuffer(cell["digests"], np.uint8).reshape(-1, 32), np.frombuffer(cell["doc_ids"], "int64").copy(), np.frombuffer(cell["nulls"], bool).copy(), np.frombuffer(cell["parts"], "int32").copy(), np.frombuffer(cell["counts"], "int64").copy())
        digests, ids, nulls, parts, counts = slots
        at = perfect.slots([d.tobytes() for d in mine[0]])
        member = at >= 0
        member[member] = (digests[at[member]] == mine[0][member]).all(axis=1)  # all 32 bytes, or it is another text
        _, new_ids, new_nulls, new_parts, new_counts = (c[member] for c in mine)
        s = at[member]  # a digest comes once, so a slot does
        win = (~new_nulls & nulls[s]) | ((new_nulls == nulls[s]) & ((new_ids > ids[s]) | ((new_ids == ids[s]) & (new_parts < parts[s]))))
        for own, theirs in ((ids, new_ids), (nulls, new_nulls), (parts, new_parts)):
            own[s[win]] = theirs[win]
        counts[s] += new_counts
        return _classes_of([slots, tuple(c[~member] for c in mine)])

    asked = fresh_classes.select("digest", "doc_id", "part", "n", _shard_of(shards))
    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(run, CLASS)


def _classes(rows: DataFrame) -> DataFrame:
    """A row for each digest: the winner (largest doc_id, nulls last; of repeated rows the least part) and the copies."""
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", (-F.col("part")).alias("back")))
    got = rows.groupBy("digest").agg(best.alias("best"), F.sum("n").alias("n"))
    return got.select("digest", "best.doc_id", (-F.col("best.back")).alias("part"), "n")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (digest, doc_id, part, n copies) and classes (CLASS) of a table.

    Texts are equal as they are; null counts as empty; the row with the largest doc_id wins and nulls lose. Rows repeated
    with the same doc_id and text are counted in ``n`` by the task that read them (``part``): one of them can win. Half the
    rows, by a hash of doc_id, play history and the rest the new batch.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    base = docs.select(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"), F.col(id_col).cast("long").alias("doc_id"), F.spark_partition_id().alias("part"))
    rows = scratch.save(base.groupBy("digest", "doc_id", "part").agg(F.count("*").alias("n")), "rows")
    late = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    index, shards = build_index(scratch.save(_classes(rows.where(~late)), "history"), scratch)
    return rows, scratch.save(merge(index, shards, _classes(rows.where(late))), "classes")


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256. Other columns are not read."""
    rows, classes = dedup(docs, id_col, text_col)
    best = classes.select("digest", F.col("doc_id").alias("keep_id"), F.col("part").alias("keep_part"), F.col("n").alias("group_size"))
    got = rows.join(best, "digest").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("part") == F.col("keep_part")) & (F.col("copy") == 1)
    return got.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the winner of each group of equal texts; columns as they were."""
    scratch = Scratch(docs.sparkSession, "exact-keep")
    rows, classes = dedup(docs, id_col, text_col, scratch)
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    keep = classes.select(F.struct(F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "digest").alias("keep_key"))
    repeated = not rows.groupBy("digest", "doc_id").agg(F.sum("n").alias("n")).where("n > 1").isEmpty()
    doc = F.col(id_col).cast("long")
    return keep_rows(docs, keep, F.struct(F.coalesce(doc, F.lit(0)).alias("id"), doc.isNull().alias("none"), digest.alias("digest")), again=repeated)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""
