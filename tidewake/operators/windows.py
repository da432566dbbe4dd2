"""Fixed windows of frames: (file, frame, ...) tracking rows to one row for each window.

Column sets are chosen from the schema by name, as tracking tables differ in the parts they hold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.config import WindowConfig
from tidewake.functions.values import divide, numeric
from tidewake.operators.ranks import with_quantiles

TAILS = ("Tail1", "Tail2", "Tail3", "Tail4")


def matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.fullmatch(pattern, c, re.IGNORECASE)]


def curvature_columns(df: DataFrame) -> list[str]:
    return sorted([c for c in df.columns if re.fullmatch(r"curvature_(\d+)_mm", c)], key=lambda c: int(re.findall(r"\d+", c)[0]))


def radius_columns(df: DataFrame) -> list[str]:
    return matching(df, r"curvature_\d+_radius_(px|mm)")


def length_columns(df: DataFrame) -> list[str]:
    return matching(df, r"(mfc_length|body_length)_(px|mm)")


def frame_distance_columns(df: DataFrame) -> list[str]:
    return matching(df, r"(Head\d+|MFC\d+|Tail\d+)_frame_dist_(px|mm)")


def travel_columns(df: DataFrame) -> list[str]:
    return matching(df, r"Tail\d+_travel_distance_(px|mm)")


def swim_count_columns(df: DataFrame) -> list[str]:
    return matching(df, r"Tail\d+_swim_count")


def total_distance_columns(df: DataFrame) -> list[str]:
    """Totals of older tables; frame tables have none."""
    return matching(df, r".*_total_distance_(px|mm)")


def reference_curvature(df: DataFrame) -> str | None:
    return next((c for c in ("curvature_3_mm", "curvature_2_mm", "curvature_1_mm", *curvature_columns(df)) if c in df.columns), None)


def peak_curvature(df: DataFrame) -> str | None:
    return "curvature_1_mm" if "curvature_1_mm" in df.columns else reference_curvature(df)


def usable(df: DataFrame) -> bool:
    """Whether a table has any signal to work on."""
    return any(f"{t}_swim_count" in df.columns for t in TAILS) or bool(curvature_columns(df))


def window_index(frame: Column, cfg: WindowConfig = WindowConfig()) -> Column:
    return F.floor(frame / cfg.frames)


def _grows(c: str, step: Column, over=None, tol: float = 1e-6) -> Column:
    """Five values or more and no step down; an aggregate, or over a window."""
    n, least = F.count(c), F.min(step)
    if over is not None:
        n, least = n.over(over), least.over(over)
    return (n >= 5) & F.coalesce(least >= -tol, F.lit(False))


def _steps(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds _step_{c}: growth since the last row with a value."""
    above = W.partitionBy("file").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)
    return df.withColumns({f"_step_{c}": F.col(c) - F.last(c, ignorenulls=True).over(above) for c in cols})


def looks_cumulative(df: DataFrame, cols: list[str]) -> DataFrame:
    """(file, {c}_cumulative): five values or more and no step down among those that exist."""
    return _steps(df, cols).groupBy("file").agg(*[_grows(c, F.col(f"_step_{c}")).alias(f"{c}_cumulative") for c in cols])


def adjacent_increments(c: Column, skip: Column, w) -> Column:
    """Growth since the row before, where both rows count; never below 0."""
    was, gap = F.lag(c).over(w), F.lag(skip).over(w)
    return F.when(~skip & ~gap & c.isNotNull() & was.isNotNull(), F.greatest(F.lit(0.0), c - was)).otherwise(0.0)


def instant_increments(c: Column, skip: Column) -> Column:
    return F.when(~skip & c.isNotNull(), F.greatest(F.lit(0.0), c.cast("double"))).otherwise(0.0)


def prepare(df: DataFrame, reference: str | None = None, numbers: bool = False) -> DataFrame:
    """Adds skip (the reference curvature is null) and inc_Tail1..4, the swim increments by the better of the two series of each file.

    numbers: read text columns as numbers first. All windows are by file, so one exchange serves them and the window table.
    """
    df = df.repartition("file")
    if numbers:
        df = df.withColumns({c: numeric(F.col(f"`{c}`")) for c in df.columns if c not in ("file", "frame", "source_path") and not c.endswith("_class")})
    ref = reference or reference_curvature(df)
    df = df.withColumn("skip", F.col(ref).isNull() if ref else F.lit(False))
    w = W.partitionBy("file").orderBy("frame")
    pairs = {t: [c for c in (f"{t}_cumulative_swim_count", f"{t}_swim_count") if c in df.columns] for t in TAILS}
    tested = [c for p in pairs.values() for c in p]
    if tested:
        df = _steps(df, tested)
        df = df.withColumns({f"{c}_cumulative": _grows(c, F.col(f"_step_{c}"), W.partitionBy("file")) for c in tested})
    for t, cands in pairs.items():
        inc = None
        for c in reversed(cands):
            grows = F.coalesce(f"{c}_cumulative", F.lit(False))
            adjacent = adjacent_increments(F.col(c).cast("double"), F.col("skip"), w)
            if c.endswith("cumulative_swim_count"):
                inc = F.when(grows, adjacent).otherwise(inc if inc is not None else F.lit(None).cast("double"))
            else:
                inc = F.when(grows, adjacent).otherwise(instant_increments(F.col(c), F.col("skip")))
        df = df.withColumn(f"inc_{t}", inc if inc is not None else F.lit(None).cast("double"))
    return df.drop(*[f"{c}_cumulative" for c in tested], *[f"_step_{c}" for c in tested])


def six_stats(c: str, keep: Column) -> list[Column]:
    """mean, median, population std, min, max and n of a column over the rows that count; for groups of bounded size, as windows."""
    v = F.when(keep, F.col(c).cast("double"))
    return [F.avg(v).alias(f"{c}_mean"), F.median(v).alias(f"{c}_median"), F.stddev_pop(v).alias(f"{c}_std"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max"), F.count(v).alias(f"{c}_n")]


def six_of_groups(df: DataFrame, c: str, by: list[str], sets: list[list[str]] | None = None) -> DataFrame:
    """The same figures over all rows of groups of any size; sets: grouping sets over ``by``."""
    v = F.col(c).cast("double")
    plain = {f"{c}_mean": F.avg(v), f"{c}_std": F.stddev_pop(v), f"{c}_min": F.min(v), f"{c}_max": F.max(v), f"{c}_n": F.count(v)}
    return with_quantiles(df, by, plain, {f"{c}_median": (v, 0.5)}, sets)


def horizontal(values: list[Column]) -> dict[str, Column]:
    """Null-skipping mean, median, min, max and n over columns; the mean adds in the columns' order, so that equal rows give equal means."""
    given = F.array_compact(F.array(*values))
    kept = F.array_sort(given)
    n = F.size(kept)
    at = lambda k: F.get(kept, k.cast("int"))
    middle = F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)
    mean = F.when(n > 0, F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / n)
    return {"mean": mean, "median": middle, "min": F.array_min(kept), "max": F.array_max(kept), "n": n}


def window_table(df: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """One row for each (file, window) of a prepared table, in one aggregation."""
    keep = ~F.col("skip")
    stats = [c for group in (curvature_columns(df), radius_columns(df), length_columns(df)) for c in group]
    sums = [c for group in (total_distance_columns(df), frame_distance_columns(df), travel_columns(df), swim_count_columns(df)) for c in group]
    agg = [F.count("*").alias("frames_in_window"), F.count_if(keep).alias("frames_non_skipped_window"), F.max("frame").alias("_last")]
    agg += [F.sum(F.when(keep, F.col(f"inc_{t}"))).alias(f"_inc{k}") for k, t in enumerate(TAILS, 1)]
    agg += [F.count(f"inc_{t}").alias(f"_has{k}") for k, t in enumerate(TAILS, 1)]
    agg += [F.first("source_path").alias("source_path")] if "source_path" in df.columns else []
    agg += [s for c in stats for s in six_stats(c, keep)]
    agg += [F.coalesce(F.sum(F.when(keep, F.col(c).cast("double"))), F.lit(0.0)).alias(f"sum_{c}") for c in sums]
    got = df.groupBy("file", window_index(F.col("frame"), cfg).alias("window_idx")).agg(*agg)
    by_file = W.partitionBy("file")
    n, seen = F.col("frames_in_window"), F.col("frames_non_skipped_window")
    start = F.col("window_idx") * cfg.frames
    got = got.withColumns({
        "fps": F.lit(cfg.fps), "window_seconds": F.lit(cfg.seconds), "start_frame": start, "end_frame": start + n,
        "start_time_s": start / cfg.fps, "end_time_s": (start + n) / cfg.fps, "mid_time_s": (start + n / 2) / cfg.fps, "duration_s": n / cfg.fps,
        "frames_skipped_window": n - seen, "skipped_rate_window_pct": divide((n - seen) * 100.0, n),
        "file_skipped_frames": F.sum(n - seen).over(by_file), "file_skipped_rate_pct": divide(F.sum(n - seen).over(by_file) * 100.0, F.sum(n).over(by_file)),
    })
    low = (n - seen) / n <= cfg.high_skip
    seconds = F.greatest(F.lit(1e-9), seen / cfg.fps)
    for k in range(1, 5):
        count = F.when(low & (F.col(f"_has{k}") > 0), F.coalesce(f"_inc{k}", F.lit(0.0)))
        got = got.withColumns({f"tail{k}_count": count, f"tail{k}_hz": count / 2 / seconds})
    freq = horizontal([F.col(f"tail{k}_hz") for k in range(1, 5)])
    got = got.withColumns({**{f"freq_{s}_hz": freq[s] for s in ("mean", "median", "min", "max")}, "n_tails_used": freq["n"].cast("long")})
    return got.drop("_last", *[f"_{c}{k}" for c in ("inc", "has") for k in range(1, 5)])


def bending_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Additive counts of curvature_1_class over rows that count: considered, valid, invalid, minimal, normal, extreme.

    ``known`` tells whether the table has the class column, for ``bending_shares``. Without the class column every row that counts is invalid, and its shares are null.
    """
    keep, label = ~F.col("skip"), F.lower(F.trim("curvature_1_class")) if "curvature_1_class" in df.columns else F.lit(None).cast("string")
    count = lambda c: F.count_if(keep & c)
    known = F.lit("curvature_1_class" in df.columns).alias("known")
    return df.groupBy(*(by or [])).agg(known, F.count_if(keep).alias("considered"), count(label.isNotNull()).alias("valid"), count(label.isNull()).alias("invalid"), *[count(label == k).alias(k) for k in ("minimal", "normal", "extreme")])


def bending_shares(counts: DataFrame) -> DataFrame:
    """Percentages of what was considered; null where nothing was."""
    n = F.col("considered")
    share = {f"curvature_1_{k}_percentage": F.when(F.col("known"), divide(F.col(k) * 100.0, n)) for k in ("minimal", "normal", "extreme", "invalid")}
    others = [c for c in counts.columns if c not in ("known", "considered", "valid", "invalid", "minimal", "normal", "extreme")]
    return counts.select(*others, *[c.alias(k) for k, c in share.items()], F.col("valid").alias("bending_total_valid_frames"), n.alias("bending_total_considered_frames"))
