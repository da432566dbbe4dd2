"""Hour, day, week and long-term statistics of hourly observations (date, hour_bin, value columns).

Everything groups on (date, hour) or less with partial aggregates; windows without a partition run over daily tables only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.config import DielConfig
from tidewake.functions import text
from tidewake.functions.values import bubble_area, drawn, numeric, period, spearman_brown, week_start, wilson
from tidewake.operators.ranks import with_quantiles

SPEED = r"^Average speed of .*\(BL/s\)$"


def parse_keys(df: DataFrame, key: str = "Datetime") -> DataFrame:
    """Adds date, hour_code 1..24, hour_bin 0..23 and xcenter from ``YYYYMMDD_time_HH``; rows that can't be read go."""
    if key not in df.columns:
        raise ValueError(f"column {key} is missing")
    out = df.withColumns({"date": text.key_date(F.col(key)), "hour_code": text.key_hour_code(F.col(key))})
    return out.where("date is not null and hour_code is not null").withColumn("hour_bin", F.col("hour_code") - 1).withColumn("xcenter", F.col("hour_bin") + F.lit(0.5))


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of [start, end], YYYYMMDD, either open."""
    for bound in (start, end):
        if bound and not (len(bound) == 8 and bound.isdigit()):
            raise ValueError(f"{bound!r} is not YYYYMMDD")
    if start:
        df = df.where(F.col("date") >= F.to_date(F.lit(start), "yyyyMMdd"))
    if end:
        df = df.where(F.col("date") <= F.to_date(F.lit(end), "yyyyMMdd"))
    return df


def auto_columns(df: DataFrame) -> list[str]:
    import re

    return [c for c in df.columns if c == "tail1_hz_mean" or re.match(SPEED, c)]


def wanted_columns(df: DataFrame, names: list[str]) -> tuple[list[str], list[str]]:
    """Those that exist, in the order asked for, and those that are missing."""
    return [n for n in names if n in df.columns], [n for n in names if n not in df.columns]


def _row_mean(cols: list[Column]) -> Column:
    kept = F.array_compact(F.array(*cols))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def primary_frequency(df: DataFrame) -> Column:
    import re

    if "freq_mean_hz_mean" in df.columns:
        return numeric(F.col("freq_mean_hz_mean"), commas=True)
    tails = [c for c in df.columns if re.fullmatch(r"tail\d+_hz_mean", c)]
    if not tails:
        raise ValueError("no frequency column")
    return _row_mean([numeric(F.col(c), commas=True) for c in tails])


def primary_curvature(df: DataFrame) -> Column:
    import re

    for c in ("curvature_1_mm_median_all", "curvature_1_mm_mean_all", *[c for c in df.columns if re.fullmatch(r"curvature_\d+_mm_mean_all", c)]):
        if c in df.columns:
            return numeric(F.col(c), commas=True)
    raise ValueError("no curvature column")


def hour_spine(spark: SparkSession) -> DataFrame:
    return spark.range(24).select(F.col("id").cast("int").alias("hour_bin"))


def hourly(df: DataFrame, value: str = "value") -> DataFrame:
    """hour_bin 0..23, mean, sample std, count; hours without values are there with nulls."""
    agg = df.where(F.col(value).isNotNull()).groupBy("hour_bin").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))
    return hour_spine(df.sparkSession).join(F.broadcast(agg), "hour_bin", "left").orderBy("hour_bin")


def combined_hourly(df: DataFrame, values: list[str]) -> DataFrame:
    """One column of hourly means for each metric, in one aggregation."""
    agg = df.groupBy("hour_bin").agg(*[F.avg(v).alias(v) for v in values])
    return hour_spine(df.sparkSession).join(F.broadcast(agg), "hour_bin", "left").orderBy("hour_bin")


def day_night(df: DataFrame, value: str = "value", cfg: DielConfig = DielConfig()) -> DataFrame:
    """Stats by (date, period), and by period with a null date, in that order."""
    v = F.col(value)
    got = df.where(v.isNotNull()).withColumn("period", period(F.col("hour_bin"), cfg.sunrise, cfg.sunset))
    plain = {"mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v), "count": F.count(v)}
    got = with_quantiles(got, ["date", "period"], plain, {"median": (v, 0.5), "low": (v, 0.25), "high": (v, 0.75)}, [["date", "period"], ["period"]])
    return got.select("date", "period", "mean", "median", "std", (F.col("high") - F.col("low")).alias("iqr"), "min", "max", "count").orderBy(F.asc_nulls_last("date"), "period")


def date_hour_pivot(df: DataFrame, value: str = "value", how: str = "mean") -> DataFrame:
    """date x h0..h23 with one of mean, median, min, max, sum, count, by date."""
    agg = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[how]
    got = df.groupBy("date").pivot("hour_bin", list(range(24))).agg(agg(value))
    return got.select("date", *[F.col(str(h)).alias(f"h{h}") for h in range(24)]).orderBy("date")


def bubble_raster(df: DataFrame, value: str = "value") -> DataFrame:
    """(date, hour_bin, value, area): 24 hourly means of every date that has any, areas scaled over all of them."""
    cells = df.where(F.col(value).isNotNull()).groupBy("date", "hour_bin").agg(F.avg(value).alias("value"))
    grid = cells.select("date").distinct().select("date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour_bin"))
    ends = cells.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    got = grid.join(cells, ["date", "hour_bin"], "left").withColumn("ends", ends.select(F.struct("low", "high")).scalar()).select("*", "ends.*")
    return got.select("date", "hour_bin", "value", bubble_area(F.col("value"), F.col("low"), F.col("high")).alias("area"))


def daily_mean(df: DataFrame, value: str = "value") -> DataFrame:
    return df.where(F.col("date").isNotNull() & F.col(value).isNotNull()).groupBy("date").agg(F.avg(value).alias("value"))


def daily_max(df: DataFrame, values: list[str]) -> DataFrame:
    """Largest value of a date over several columns; dates without values are missing."""
    cols = [F.col(v) for v in values]
    row = cols[0] if len(cols) == 1 else F.greatest(*cols)
    return df.select("date", row.alias("v")).where("v is not null").groupBy("date").agg(F.max("v").alias("value"))


def icc(df: DataFrame, value: str = "value", group: str = "date") -> DataFrame:
    """One row: icc, ms_between, ms_within, k_bar, g, n of a one-way model with unequal groups, from per-group moments."""
    by = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("ssw"))
    # deviations from the grand mean, over the table of groups: moments would cancel where the mean is large
    every = W.partitionBy()
    by = by.withColumn("off", F.col("m") - F.sum(F.col("n") * F.col("m")).over(every) / F.sum("n").over(every))
    got = by.agg(F.count("*").alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("ssw").alias("ssw"), F.sum(F.col("n") * F.col("off") ** 2).alias("ssb"), F.avg("n").alias("k"))
    ok = (F.col("n") >= 3) & (F.col("g") >= 2) & (F.col("n") > F.col("g"))
    msb = F.when(ok, F.col("ssb") / (F.col("g") - 1))
    msw = F.when(ok, F.col("ssw") / (F.col("n") - F.col("g")))
    got = got.select(msb.alias("ms_between"), msw.alias("ms_within"), F.when(ok, F.col("k")).alias("k_bar"), "g", "n")
    below = F.col("ms_between") + (F.col("k_bar") - 1) * F.col("ms_within")
    return got.select(F.when(below != 0, (F.col("ms_between") - F.col("ms_within")) / below).alias("icc"), "*")


def reliability(icc_row: DataFrame) -> DataFrame:
    """(k, reliability, icc, n_days) for k = 1..n_days; no rows below two days."""
    k = F.explode(F.sequence(F.lit(1).cast("long"), F.col("g"))).alias("k")
    got = icc_row.where("g >= 2").select(k, "icc", F.col("g").alias("n_days"))
    return got.select("k", spearman_brown(F.col("icc"), F.col("k")).alias("reliability"), "icc", "n_days")


def diel_index(df: DataFrame, value: str = "value", cfg: DielConfig = DielConfig()) -> DataFrame:
    """day_mean, night_mean and night / day by date; no index where |day| is 1e-12 or less."""
    day = period(F.col("hour_bin"), cfg.sunrise, cfg.sunset) == "Day"
    got = df.where(F.col(value).isNotNull()).groupBy("date").agg(F.avg(F.when(day, F.col(value))).alias("day_mean"), F.avg(F.when(~day, F.col(value))).alias("night_mean"))
    return got.withColumn("diel_index", F.when(F.abs("day_mean") > 1e-12, F.col("night_mean") / F.col("day_mean")))


def weekly_extreme(df: DataFrame, pct: str, frames: str) -> DataFrame:
    """Frame-weighted share by week with its Wilson interval, for rows with finite values and frames > 0."""
    p, n = F.col(pct).cast("double"), F.col(frames).cast("double")
    ok = F.col("date").isNotNull() & (F.abs(p) < float("inf")) & (F.abs(n) < float("inf")) & (n > 0)
    got = df.where(ok).groupBy(week_start(F.col("date")).alias("week")).agg(F.sum(p / 100 * n).alias("hits"), F.sum(n).alias("n_frames"))
    return got.select("week", *[c.alias(name) for name, c in wilson(F.col("hits"), F.col("n_frames")).items()], "n_frames")


def rolling_mean(daily: DataFrame, cfg: DielConfig = DielConfig()) -> DataFrame:
    """Mean of the last observed days, null until there are five or as many as half the window, ten at most."""
    least = max(5, min(10, cfg.rolling_days // 2))
    w = W.orderBy("date").rowsBetween(1 - cfg.rolling_days, 0)
    return daily.where("value is not null").select("date", F.when(F.count("value").over(w) >= least, F.avg("value").over(w)).alias("mean"))


def rolling_bootstrap(daily: DataFrame, cfg: DielConfig = DielConfig()) -> DataFrame:
    """rolling_mean with lo and hi, the 2.5 and 97.5 percentiles of means of as many days drawn from the window.

    Draws are counter-based: which day stands at a place of a replicate is a hash of (seed, date, replicate, place), so every
    run, on any number of tasks, draws the same.
    """
    least = max(5, min(10, cfg.rolling_days // 2))
    w = W.orderBy("date").rowsBetween(1 - cfg.rolling_days, 0)
    held = daily.where("value is not null").select("date", F.avg("value").over(w).alias("mean"), F.collect_list("value").over(w).alias("days")).withColumn("n", F.size("days"))
    enough = F.col("n") >= least

    def replicate(r: Column) -> Column:
        day = lambda p: F.get("days", drawn(F.col("n"), F.lit(cfg.seed), F.col("date"), r, p).cast("int"))
        return F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda acc, p: acc + day(p)) / F.col("n")

    boot = held.withColumn("boot", F.when(enough, F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(cfg.n_boot - 1)), replicate))))

    def percentile(share: float) -> Column:
        place = share * (cfg.n_boot - 1)
        at = lambda k: F.get("boot", F.lit(min(k, cfg.n_boot - 1)))
        return at(int(place)) + (at(int(place) + 1) - at(int(place))) * (place - int(place))

    return boot.select("date", F.when(enough, F.col("mean")).alias("mean"), percentile(0.025).alias("lo"), percentile(0.975).alias("hi"))


def cumulative_max(daily: DataFrame) -> DataFrame:
    return daily.select("date", "value", F.max("value").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)).alias("cummax"))


def distinct_days(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("date").alias("n_days"))


#: The analyses of ``report`` by name; each takes the observations and the settings.
ANALYSES = {
    "hourly": lambda df, cfg: hourly(df), "day_night": lambda df, cfg: day_night(df, cfg=cfg), "date_hour": lambda df, cfg: date_hour_pivot(df), "bubbles": lambda df, cfg: bubble_raster(df),
    "daily": lambda df, cfg: daily_mean(df), "stability": lambda df, cfg: rolling_bootstrap(daily_mean(df), cfg), "reliability": lambda df, cfg: reliability(icc(df)),
    "diel_index": lambda df, cfg: diel_index(df, cfg=cfg), "cumulative_max": lambda df, cfg: cumulative_max(daily_max(df, ["value"])), "annotations": lambda df, cfg: annotation_means(df, cfg=cfg),
}


def report(df: DataFrame, wanted: dict[str, bool] | None = None, cfg: DielConfig = DielConfig()) -> dict[str, DataFrame]:
    """The analyses of observations (date, hour_bin, value) that are switched on, by name; all where nothing is said."""
    unknown = set(wanted or {}) - set(ANALYSES)
    if unknown:
        raise ValueError(f"unknown analyses: {', '.join(sorted(unknown))}")
    return {name: make(df, cfg) for name, make in ANALYSES.items() if (wanted or {}).get(name, True)}


def annotation_means(df: DataFrame, value: str = "value", cfg: DielConfig = DielConfig()) -> DataFrame:
    """Day and night averages by their three definitions: of hourly means, of date-hour cells, of rows."""
    p = period(F.col("hour_bin"), cfg.sunrise, cfg.sunset).alias("period")
    cells = df.groupBy("date", "hour_bin").agg(F.avg(value).alias("cell"))
    parts = [
        hourly(df, value).groupBy(p).agg(F.avg("mean").alias("v")).select(F.lit("hourly_means").alias("kind"), "period", "v"),
        cells.groupBy(p).agg(F.avg("cell").alias("v")).select(F.lit("cells").alias("kind"), "period", "v"),
        df.groupBy(p).agg(F.avg(value).alias("v")).select(F.lit("rows").alias("kind"), "period", "v"),
    ]
    return reduce(DataFrame.unionByName, parts)
