"""Activity states, class shares and distributions: the data behind the figures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.config import STATES, ActivityConfig
from tidewake.functions.values import chunk_minute, per_chunk
from tidewake.operators.numbering import numbered, with_next

# Logical names and the physical columns of an activity table.
COLUMNS = {"activity_class": "activity_class", "movement": "MFC5_movement_distance", "swim_count": "Tail1_swim_count"}


def safe(df: DataFrame, name: str, default: object = None) -> Column:
    """A column, or a constant where it is missing."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(default)


def prepare(df: DataFrame, columns: dict[str, str] | None = None, order: str = "event_id", by: list[str] | None = None) -> DataFrame:
    """Logical columns of an activity table; a missing one is an error. chunk_id is the row's place in its recording (by) if there is none.

    Without ``by`` the whole table is one recording: it is numbered by ranges (``numbering``), not in one task.
    """
    columns = columns or COLUMNS
    missing = [p for p in columns.values() if p not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    if "chunk_id" not in df.columns:
        df = df.withColumn("chunk_id", F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1) if by else numbered(df, [F.col(order)], name="chunk_id")
    chunk = F.col("chunk_id")
    return df.select(*(by or []), chunk.cast("long").alias("chunk_id"), *[F.col(p).alias(n) for n, p in columns.items()])


def movement_lines(df: DataFrame, cfg: ActivityConfig = ActivityConfig()) -> DataFrame:
    """Minutes and the two threshold lines of each chunk."""
    return df.withColumns({
        "minute": chunk_minute(F.col("chunk_id"), cfg.chunk_minutes),
        "count_threshold": F.lit(per_chunk(cfg.counts_per_hour, cfg.chunk_minutes)),
        "distance_threshold": F.lit(per_chunk(cfg.distance_per_hour, cfg.chunk_minutes)),
    })


def state_counts(df: DataFrame, state: str = "state", states: tuple[str, ...] = STATES) -> DataFrame:
    """A row for each of the fixed states, 0 where it doesn't occur, and its share of the rows in a state."""
    spine = df.sparkSession.createDataFrame([(k, s) for k, s in enumerate(states)], "ordinal int, state string")
    n = df.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("n"))
    got = spine.join(F.broadcast(n.where(F.col("state").isin(*states))), "state", "left").select("ordinal", "state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = F.sum("n").over(W.partitionBy())  # over the few states
    return got.select("ordinal", "state", "n", F.when(total > 0, F.col("n") * 100.0 / total).otherwise(0.0).alias("pct"))


def transitions(df: DataFrame, order: list[str], state: str = "state", states: tuple[str, ...] = STATES, by: list[str] | None = None) -> DataFrame:
    """(from_state, to_state, n, pct) of rows next to each other; unknown and null states break pairs; rows without any are 0.

    by: sequences of their own, as a recording each. Without it the whole table is one sequence, ordered by ranges (``numbering``).
    """
    known = lambda c: F.col(c).isin(*states)
    if by:
        nxt = df.select(F.col(state).alias("a"), F.lead(state).over(W.partitionBy(*by).orderBy(*order)).alias("b"))
    else:
        own = df.select(F.col(state).alias("a"), *[F.col(o).alias(f"o{k}") for k, o in enumerate(order)])
        nxt = with_next(own, "a", [F.col(f"o{k}") for k in range(len(order))], "b")
    n = nxt.where(known("a") & known("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in states for b in states], "a string, b string")
    got = grid.join(F.broadcast(n), ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = F.sum("n").over(W.partitionBy("a"))
    return got.select(F.col("a").alias("from_state"), F.col("b").alias("to_state"), "n", F.when(total > 0, F.col("n") * 100.0 / total).otherwise(0.0).alias("pct"))


def without_invalid(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) != "Invalid")


def class_shares(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, pct, n_invalid, invalid_pct): shares among labels that are not Invalid, most frequent first by n."""
    n = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = W.partitionBy()  # over the few labels
    n = n.withColumns({"every": F.sum("n").over(whole), "n_invalid": F.coalesce(F.sum(F.when(F.col("label") == "Invalid", F.col("n"))).over(whole), F.lit(0))})
    got = n.where("label <> 'Invalid'").select("label", "n", (F.col("n") * 100.0 / (F.col("every") - F.col("n_invalid"))).alias("pct"), "n_invalid", (F.col("n_invalid") * 100.0 / F.col("every")).alias("invalid_pct"))
    return got.orderBy(F.desc("n"), "label")


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n, density) over [min, max] with the last bin closed, empty bins too; and the mean."""
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("every"), F.avg("v").alias("mean"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    known = ends.select(F.struct("*")).scalar()
    counts = v.withColumn("ends", known).select("v", "ends.*").groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    got = spine.join(F.broadcast(counts), "bin", "left").withColumn("ends", known).select("bin", "n", "ends.*")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return got.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), n.alias("n"), F.when(width > 0, n / (F.col("every") * width)).alias("density"), "mean")


def density(df: DataFrame, value: str, points: int = 300) -> DataFrame:
    """(x, density): a Gaussian kernel estimate on evenly spaced points from the least to the largest value, bandwidth n^(-1/5) sample deviations.

    Exact: every row adds to every point. A task adds its rows up in an array of ``points`` numbers, so what moves is that
    array from each task. No rows where there is a single value or none.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("every"), F.stddev_samp("v").alias("sd"))
    ends = ends.select(F.struct("lo", "hi", "every", (F.col("sd") * F.pow("every", F.lit(-0.2))).alias("h"))).scalar()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, grid = None, None
        for b in batches:
            if not b.num_rows:
                continue
            v, lo, hi, h = (b.column(c).to_numpy() for c in ("v", "lo", "hi", "h"))
            if not h[0] > 0:
                return
            if total is None:
                total, grid = np.zeros(points), lo[0] + np.arange(points) * (hi[0] - lo[0]) / (points - 1)
            for at in range(0, len(v), 4096):
                z = (grid[:, None] - v[None, at : at + 4096]) / h[0]
                total += np.exp(-z * z / 2).sum(axis=1)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(points, dtype=np.int32)), pa.array(total)], ["k", "part"])

    sums = v.withColumn("ends", ends).select("v", "ends.lo", "ends.hi", "ends.h").mapInArrow(run, "k int, part double").groupBy("k").agg(F.sum("part").alias("total"))
    x = F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (points - 1)
    return sums.withColumn("ends", ends).select("k", "total", "ends.*").select(x.alias("x"), (F.col("total") / (F.col("every") * F.col("h")) / math.sqrt(2 * math.pi)).alias("density"))


def thinned(df: DataFrame, index: str, total: int, most: int = 15) -> DataFrame:
    """Every n-th row, so that about ``most`` labels stay on an axis."""
    return df.where(F.col(index) % max(1, total // most) == 0)
