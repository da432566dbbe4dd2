"""Filter interaction audit: what each filter removes at each step of every order of the filters.

Spark counts, by part and by the set of filters that a document fails (a mask), the documents, the good ones and the toxic
ones: 2^n cells for each part, whatever the number of documents. Orders are then walked by adjacent transpositions: each is
one swap of neighbours away from the one before, and a swap changes the figures of its two steps only, which are read off the
cells anew. What each filter removes in an order is added up along the walk: that is its Shapley value, times the number of orders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import WHITE, table

#: Rows without an id are spread over this many parts where ids meet, as nulls would all meet in one.
SPREAD = 1024
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def words(text: Column) -> Column:
    """Maximal runs of what isn't ASCII white space."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))


def too_short(text: Column, least: int = 100) -> Column:
    return F.size(words(text)) < least


def too_repetitive(text: Column, least_percent: int = 80) -> Column:
    return 100 * F.size(F.array_distinct(words(text))) < least_percent * F.size(words(text))


def shouting(text: Column, most_percent: int = 10) -> Column:
    return 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > most_percent * F.char_length(text)


def marked(text: Column, marks: str = r"[#$%&*|]") -> Column:
    return text.rlike(marks)


#: Failure conditions of whole texts, by name; the name of the copies' filter follows them.
CONDITIONS: dict[str, Callable[[Column], Column]] = {"A": too_short, "B": too_repetitive, "C": shouting, "D": marked}
COPIES = "E"


def cells(docs: DataFrame, labels: DataFrame, conditions: dict[str, Callable[[Column], Column]] = CONDITIONS, copies: bool = True, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, bit k of the mask for the k-th condition, the last for copies.

    A null text is empty, a null part the empty string. A document is a copy if its text is that of a row with a smaller id:
    rows of the smallest id aren't, however often it comes, nor rows without an id, which count towards no other's copies. Of
    several labels for an id any that says good or toxic counts; rows without an id have none.

    Whatever a text alone decides is the same for all its copies, so these are counted by digest before copies are told apart:
    a text of a third of all rows is a few rows from each task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.when(fails(text), 1 << k).otherwise(0) for k, fails in enumerate(conditions.values())), F.lit(0))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest"))
    base = base.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest"), F.lit(SPREAD))).otherwise(0))
    named = labels.where("doc_id is not null").groupBy("doc_id", F.lit(0).alias("salt")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    met = base.join(named, ["doc_id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    alike = ["digest", "mask", "part", "good", "toxic"]
    by_id = met.groupBy("doc_id", "salt", *alike).agg(F.count("*").alias("c"))
    if copies:
        by_text = by_id.groupBy(*alike).agg(
            F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("c"))), F.lit(0)).alias("unnamed"), F.min("doc_id").alias("least"), F.min_by("c", "doc_id").alias("at_least"))
        by_text = by_text.withColumn("first", F.min("least").over(W.partitionBy("digest")))  # a row for each part and label of a text
        passes = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
        told = by_text.select("part", "good", "toxic", F.explode(F.array(
            F.struct("mask", passes.alias("c")), F.struct((F.col("mask") + (1 << len(conditions))).alias("mask"), (F.col("n") - passes).alias("c")))).alias("z"))
        by_id = told.select("part", "good", "toxic", "z.mask", "z.c")
    n = F.sum("c")
    return by_id.groupBy("part", "mask").agg(n.alias("n"), F.coalesce(F.sum(F.when(F.col("good"), F.col("c"))), F.lit(0)).alias("good"), F.coalesce(F.sum(F.when(F.col("toxic"), F.col("c"))), F.lit(0)).alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places k whose swap with k + 1 leads through all orders of n things, from the first one: the largest thing that can moves."""
    order, way = list(range(n)), [-1] * n
    while True:
        for thing in reversed(range(n)):
            p = order.index(thing)
            q = p + way[thing]
            if 0 <= q < n and order[q] < thing:
                break
        else:
            return
        order[p], order[q] = order[q], order[p]
        for larger in range(thing + 1, n):
            way[larger] = -way[larger]
        yield min(p, q)


def walk(counts: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """counts: documents, good and toxic ones by mask. The orders, the FIGURES of each order's steps, and what each filter removes over all orders."""
    masks = np.arange(1 << n)
    only = [int(counts[1 << f, 0]) for f in range(n)]

    def figures(before: int, f: int) -> tuple[int, ...]:
        fails, still = (masks >> f & 1).astype(bool), (masks & before) == 0
        removed = counts[fails & still].sum(axis=0)
        return int(counts[still & ~fails, 0].sum()), int(removed[0]), int(counts[fails & ~still, 0].sum()), only[f], int(removed[1]), int(removed[2])

    order = list(range(n))
    gone = [0] * (n + 1)  # filters before each step, as a mask
    for k in range(n):
        gone[k + 1] = gone[k] | 1 << order[k]
    now = np.array([figures(gone[k], order[k]) for k in range(n)], np.int64)
    orders, steps, removed = [tuple(order)], [now.copy()], np.zeros(n, np.int64)
    removed[order] += now[:, 1]
    for k in swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        gone[k + 1] = gone[k] | 1 << order[k]
        now[k], now[k + 1] = figures(gone[k], order[k]), figures(gone[k + 1], order[k + 1])
        orders.append(tuple(order))
        steps.append(now.copy())
        removed[order] += now[:, 1]
    return orders, np.array(steps), removed


def audit(counted: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, FIGURES..., shapley) for each part of ``cells`` and each order of the filters named by one letter each.

    A part is one row of 2^n cells, walked in one task of many. No parts, no rows.
    """
    n = len(names)
    if not 0 < n < 9:
        raise ValueError("one to eight filters: each part has a row for every order and step")
    whole = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, own in zip(b.column("part"), b.column("cells"), strict=True):
                counts = np.zeros((1 << n, 3), np.int64)
                for cell in own.as_py():
                    counts[cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                orders, steps, removed = walk(counts, n)
                at = {"part": [part.as_py()] * (n * len(orders)), "filter_order": ["".join(names[f] for f in o) for o in orders for _ in o], "step": pa.array(list(range(1, n + 1)) * len(orders), pa.int32())}
                flat = steps.reshape(-1, len(FIGURES))
                at |= {name: flat[:, k] for k, name in enumerate(FIGURES)} | {"shapley": removed[np.array(orders).reshape(-1)]}
                yield pa.RecordBatch.from_pydict(at)

    return whole.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in (*FIGURES, "shapley")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "".join(CONDITIONS) + COPIES)


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM m GROUP BY part, f),
i AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT part, o, i.k AS step, n, g, x, f[o[i.k]] AS fails, list_bool_or(list_transform(o[1:i.k - 1], lambda z: f[z])) AS before, len(list_filter(f, lambda z: z)) AS failed FROM c, o, i),
r AS (SELECT part, o, step, sum(n) FILTER (WHERE NOT fails AND NOT coalesce(before, false)) AS kept, sum(n) FILTER (WHERE fails AND NOT coalesce(before, false)) AS removed,
      sum(n) FILTER (WHERE fails AND before) AS redundant, sum(n) FILTER (WHERE fails AND failed = 1) AS unique_fails,
      sum(g) FILTER (WHERE fails AND NOT coalesce(before, false)) AS good_lost, sum(x) FILTER (WHERE fails AND NOT coalesce(before, false)) AS toxic_lost FROM s GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda z: substr('ABCDE', z, 1)), '') AS filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, o[step]), 0)::BIGINT AS shapley FROM r
"""
