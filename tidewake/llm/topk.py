"""Exact top-k inner product by multi-resolution segment statistics.

A vector is cut into segments; with a segment's mean m and deviation s, the squared distance of two vectors is at least
sum(len * ((m - m')^2 + (s - s')^2)), and their score, (|q|^2 + |x|^2 - distance^2) / 2, at most sum(len * (m m' + s s')). From
1 segment over 4 to 16, pairs whose bound is below the query's k-th best score so far go; for the rest the exact score is
computed.

Rows are dealt into groups of about ``GROUP``, which a task holds with their statistics, made once. Every query goes to every
group, and there ``QUERIES`` of them at a time pass over the group's rows; a task returns its best k for each. So the number
of jobs is fixed, nothing passes through the driver, and what moves is each row once and each query once for each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import Scratch, table

SEGMENTS = (1, 4, 16)
#: Rows of a group, about; queries that pass over it at a time; rows scored at once.
GROUP, QUERIES, ROWS = 131_072, 1024, 4096


def stats(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row and segment sqrt(len) * mean and sqrt(len) * deviation, side by side."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    cols = []
    for p in parts:
        s = x[:, p].astype(np.float64)
        cols += [s.mean(axis=1) * len(p) ** 0.5, s.std(axis=1) * len(p) ** 0.5]
    return np.column_stack(cols)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly."""
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * a.shape[1]
    if most < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return a @ b.T


class Rows:
    """Some rows of one length with their statistics, made when first asked for."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self._stats = ids, x, {}

    def stats(self, segments: int) -> np.ndarray:
        if segments not in self._stats:
            self._stats[segments] = stats(self.x, segments)
        return self._stats[segments]


class Block:
    """Queries of one length with their statistics and the scores that a row must reach."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.stats = [stats(x, s) for s in SEGMENTS] if x.shape[1] else []
        self.floor = np.full(len(ids), np.iinfo(np.int64).min)

    def offer(self, best: dict[int, list[tuple[int, int]]], rows: Rows) -> None:
        """Merge rows into the best (score, -vec_id) of each query."""
        ids, x = rows.ids, rows.x
        pairs = self.survivors(rows)
        if not len(pairs[0]):
            return
        q, r = pairs
        if len(q) * 3 > len(self.ids) * len(ids):
            score = _product(self.x, x)[q, r]
        else:
            score = np.concatenate([_dot(self.x[q[a : a + 65536]], x[r[a : a + 65536]]) for a in range(0, len(q), 65536)])
        fine = (score >= self.floor[q]) & (ids[r] != self.ids[q])
        q, r, score = q[fine], r[fine], score[fine]
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        new = np.ones(len(q), bool)  # a repeated row counts once
        new[1:] = (q[1:] != q[:-1]) | (score[1:] != score[:-1]) | (ids[r[1:]] != ids[r[:-1]])
        q, r, score = q[new], r[new], score[new]
        start = np.searchsorted(q, q, "left")
        for i in np.flatnonzero(np.arange(len(q)) - start < self.k):
            best.setdefault(int(q[i]), []).append((int(score[i]), -int(ids[r[i]])))
        for n in np.unique(q).tolist():
            top = best[n] = sorted(set(best[n]), reverse=True)[: self.k]
            if len(top) == self.k:
                self.floor[n] = max(self.floor[n], top[-1][0])

    def survivors(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        alive = np.ones((len(self.ids), len(rows.ids)), bool)
        for mine, segments in zip(self.stats, SEGMENTS, strict=False):  # no statistics of empty vectors
            if not (self.floor > np.iinfo(np.int64).min).any():
                break
            theirs = rows.stats(segments)
            q, r = np.nonzero(alive)
            slack = 1e-9 * np.abs(mine).max() * max(1.0, np.abs(theirs).max()) * mine.shape[1] + 1e-6
            if len(q) * 3 > alive.size:
                alive &= mine @ theirs.T + slack >= self.floor[:, None]
            else:
                for a in range(0, len(q), 65536):
                    i, j = q[a : a + 65536], r[a : a + 65536]
                    alive[i, j] = np.einsum("ij,ij->i", mine[i], theirs[j]) + slack >= self.floor[i]
        return np.nonzero(alive)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if most >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return np.einsum("ij,ij->i", a, b)


def _grid(vec: Column, scale: float) -> Column:
    return F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: float, wanted: Column) -> DataFrame:
    """(vec_id, x array<long>, asked) of the rows that take part."""
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), _grid(F.col(vec_col), scale).alias("x"), F.coalesce(wanted, F.lit(False)).alias("asked"))


def top_k(vectors: DataFrame, wanted: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``wanted`` holds its k best others by integer inner product.

    Components become floor(scale * x). Ties go to the smaller vec_id. Rows without id or vector, or with a null or non-finite
    component, take no part. Rows repeated with the same id and vector count once; a query never meets its own id. Vectors of
    another length than the query's are no candidates. Components too large for a score of 64 bits stop the query. Other
    columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    held = scratch.save(usable(vectors, id_col, vec_col, scale, wanted).groupBy("vec_id", "x").agg(F.bool_or("asked").alias("asked")), "rows")
    groups = -(-max(1, held.count()) // GROUP)
    rows = held.select(F.pmod(F.xxhash64("vec_id", "x"), F.lit(groups)).cast("int").alias("grp"), F.lit(0).alias("kind"), "vec_id", "x")
    asked = held.where("asked").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(1).alias("kind"), "vec_id", "x")
    dealt = rows.union(asked).repartitionById(groups, F.col("grp")).sortWithinPartitions("kind")
    got = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long").distinct()
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(k: int):
    """A task's rows come first, then the queries in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[Rows]] = {}
        fresh: dict[int, list] = {}  # rows that are not put together yet, by length
        asked: dict[int, list] = {}
        for b in batches:
            ids, kinds, col = b.column("vec_id").to_numpy(), b.column("kind").to_numpy(), b.column("x")
            sizes = np.asarray(col.value_lengths())
            flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for d in np.unique(sizes).tolist():
                for kind, store, most in ((0, fresh, ROWS), (1, asked, QUERIES)):
                    at = np.flatnonzero((sizes == d) & (kinds == kind))
                    if not len(at):
                        continue
                    if kind and d in fresh:  # all rows are here
                        rows.setdefault(d, []).append(Rows(*_joined(fresh.pop(d))))
                    store.setdefault(d, []).append((ids[at], flat[(ends[at] - d)[:, None] + np.arange(d)]))
                    if sum(len(i) for i, _ in store[d]) < most:
                        continue
                    if kind:
                        yield from _asked(asked.pop(d), rows.get(d, []), k)
                    else:
                        rows.setdefault(d, []).append(Rows(*_joined(fresh.pop(d))))
        for d, own in asked.items():
            yield from _asked(own, rows.get(d, []), k)

    return run


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])


def _asked(parts: list[tuple[np.ndarray, np.ndarray]], rows: list[Rows], k: int) -> Iterator[pa.RecordBatch]:
    """The best of a group's rows for some queries of one length."""
    ids, x = _joined(parts)
    for at in range(0, len(ids), QUERIES):
        block, best = Block(ids[at : at + QUERIES], x[at : at + QUERIES], k), {}
        if x.shape[1]:  # scores among the queries themselves give each a floor to begin with
            block.offer({}, Rows(block.ids, block.x))
        for r in rows:
            block.offer(best, r)
        out = [(int(block.ids[q]), -back, score) for q, top in best.items() for score, back in top]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
