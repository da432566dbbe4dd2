"""Totals over sessions that grow by files: each file leaves a partial summary, and totals are made of these alone.

A partial is what merges: counts, means with sums of squares about them, ends, weighted sums, and the counts of each value for exact
percentiles. New files are summarised and appended; files that were added before, under the same key, are left out, so adding
again changes nothing and no old window table is read twice. The totals are those of ``files.integrate``, whatever the order.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.values import divide
from tidewake.operators import ranks
from tidewake.operators.files import RATES, bending_section, series_columns

WEIGHT = "frames_non_skipped_window"


def summarise(windows: DataFrame, key: list[str], weight: str = WEIGHT) -> dict[str, DataFrame]:
    """Partials of a window table by key: ``files`` (a row each), ``moments`` (a row for each series of window figures) and ``values``."""
    curved, others = series_columns(windows)
    series = [*RATES, *curved, *others]
    n, s = F.coalesce(F.sum("frames_in_window"), F.lit(0)), F.coalesce(F.sum("frames_skipped_window"), F.lit(0))
    files = windows.groupBy(*key).agg(F.count("*").alias("windows"), n.alias("frames"), s.alias("skipped"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in series])).alias("p")
    long = windows.select(*key, F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"), pairs).select(*key, "w", "p.name", "p.v")
    v, w = F.col("v"), F.col("w")
    moments = long.groupBy(*key, "name").agg(
        F.count("*").alias("rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("squares"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_if(v > 0).alias("positive"), F.sum(w).alias("weight_all"), F.coalesce(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0)).alias("weight"), F.coalesce(F.sum(v * w), F.lit(0.0)).alias("weighted"))
    return {"files": files, "moments": moments, "values": long.where("v is not null").groupBy(*key, "name", "v").agg(F.count("*").alias("c"))}


def add(spark: SparkSession, path: str, windows: DataFrame, counts: DataFrame, key: list[str], weight: str = WEIGHT) -> None:
    """Appends the partials of a window table's files, and their bending counts (``windows.bending_counts`` by key), to the tables under ``path``.

    The table of files is written last and tells which count: what a run left that ended before is without them, and is left out.
    """
    have = known(spark, path)
    if have is not None:
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"h.{k}")) for k in key]
        windows, counts = (df.alias("n").join(have.select(*key).alias("h"), same, "left_anti").select("n.*") for df in (windows, counts))
    run, made = F.lit(uuid.uuid4().hex), summarise(windows, key, weight)
    for name, df in {"moments": made["moments"], "values": made["values"], "bending": counts, "files": made["files"]}.items():
        df.withColumn("run", run).write.mode("append").parquet(f"{path}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def known(spark: SparkSession, path: str) -> DataFrame | None:
    """The files that were added, or None before any."""
    return spark.read.parquet(f"{path}/files") if _exists(spark, f"{path}/files") else None


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of runs that came to their end."""
    return spark.read.parquet(f"{path}/{name}").join(spark.read.parquet(f"{path}/files").select("run").distinct(), "run", "left_semi").drop("run")


def _percentiles(values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., p10, median, p90) from values with their counts, exact."""
    merged = values.groupBy(*by, "v").agg(F.sum("c").alias("c"))
    if merged.count() <= ranks.WHOLE:
        got = merged.groupBy(*by).agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), F.col("c")).alias("q"))
        return got.select(*by, *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("p10", "median", "p90"))])
    each = merged.select(*by, "v", F.explode(F.sequence(F.lit(1).cast("long"), "c")))
    return ranks.quantiles(each, by, {n: (F.col("v"), p) for n, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))})


def _series(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Figures of each series over all files, or by some of the key."""
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    squares = F.sum(F.col("squares") + F.col("n") * F.col("mean") * F.col("mean")) - total * total / n
    got = _table(spark, path, "moments").groupBy(*by, "name").agg(
        F.sum("rows").alias("rows"), n.alias("n_valid"), F.when(n > 0, total / n).alias("plain_mean"), F.when(n > 0, F.sqrt(F.greatest(squares / n, F.lit(0.0)))).alias("std"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.sum("positive").alias("positive"), F.when((n > 0) & (F.sum("weight_all") > 0), F.sum("weighted") / F.greatest(F.lit(1.0), F.sum("weight"))).alias("mean"))
    exact = _percentiles(_table(spark, path, "values"), [*by, "name"])
    same = [F.col(f"g.{b}").eqNullSafe(F.col(f"q.{b}")) for b in (*by, "name")]
    return got.alias("g").join(exact.alias("q"), same, "left").select("g.*", "q.p10", "q.median", "q.p90")


def totals(spark: SparkSession, path: str, by: list[str] | None = None) -> DataFrame:
    """The sections of ``files.integrate`` from the partials under ``path``: over all files, or by some columns of their key."""
    by = list(by or [])
    series = _series(spark, path, by)
    whole = _table(spark, path, "files").groupBy(*by).agg(F.sum("windows").alias("total_windows"), F.coalesce(F.sum("frames"), F.lit(0)).alias("total_frames_est"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("total_skipped_frames"))
    whole = whole.withColumn("total_skipped_rate_pct", F.coalesce(divide(F.col("total_skipped_frames") * 100.0, F.col("total_frames_est")), F.lit(0.0)))
    figures = {"mean": F.col("plain_mean"), "std": F.col("std"), "min": F.col("min"), "max": F.col("max"), "nonzero_ratio": divide(F.col("positive") * 1.0, F.col("n_valid")), "median": F.col("median"), "p10": F.col("p10"), "p90": F.col("p90")}
    rates = series.groupBy(*by).agg(*[F.max(F.when(F.col("name") == c, v)).alias(f"{c}_{k}") for c in RATES for k, v in figures.items()])
    sum_ = sum((F.coalesce(f"tail{k}_hz_mean", F.lit(0.0)) for k in range(1, 5)), F.lit(0.0))
    rates = rates.withColumns({f"tail{k}_freq_pct": F.when(sum_ > 0, F.col(f"tail{k}_hz_mean") / sum_ * 100) for k in range(1, 5)})
    if by:
        same = [F.col(f"w.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by]
        frequency = whole.alias("w").join(rates.alias("r"), same).select("w.*", *[F.col(f"r.{c}") for c in rates.columns if c not in by])
    else:
        frequency = whole.withColumn("_r", rates.select(F.struct("*")).scalar()).select(*whole.columns, "_r.*")
    row = lambda k, section: [F.lit(section).alias("section"), F.lit("O").alias("variant"), F.lit(k).alias("section_order")]
    parts = [frequency.select(*row(0, "global_frequency"), "*")]
    stem = F.regexp_replace("name", "_mean$", "")
    shown = ["mean", "median", "std", "min", "max", (F.col("n_valid") / F.col("rows")).alias("valid_ratio"), "n_valid"]
    curved = F.col("name").rlike(r"^curvature_\d+_mm_mean$")
    parts.append(series.where(curved).select(*row(1, "global_curvature"), *by, F.regexp_replace(stem, "_mm$", "").alias("curvature"), *shown))
    parts.append(series.where(~curved & ~F.col("name").isin(*RATES)).select(*row(2, "global_series"), *by, stem.alias("series"), *shown))
    parts.append(bending_section(_table(spark, path, "bending"), [by] if by else None).withColumn("section_order", F.lit(3)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
