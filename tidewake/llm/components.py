"""Connected components by alternating large and small stars, in rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import Scratch

#: Links in a task, about: few links need few tasks, whatever the session's number of partitions is.
LINKS = 200_000


def star_components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """links (a long, b long) -> (node, root): root is the least node of node's component; nodes without links are missing.

    A round sends each node's larger neighbours, then its smaller ones, to the least neighbour. Both group with partial
    aggregates and join on the node, so a hub's rows can be split among tasks.
    """
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges0")
    before = _mark(edges)
    for k in range(1, rounds + 1):
        if before[0] == 0:
            break
        tasks = -(-2 * before[0] // LINKS)
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).coalesce(tasks)
        edges = scratch.save(small.distinct().coalesce(tasks), f"edges{k}")
        scratch.drop(f"edges{k - 1}")
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1] or 0
