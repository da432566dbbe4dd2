"""File summaries of window tables, and their integration over sessions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.config import WindowConfig
from tidewake.functions import text
from tidewake.functions.values import divide, steady_sum
from tidewake.operators.ranks import with_quantiles
from tidewake.operators.windows import bending_shares, peak_curvature
from tidewake.shared import Scratch

RATES = ("tail1_hz", "tail2_hz", "tail3_hz", "tail4_hz", "freq_mean_hz")


def describe(c: str) -> dict[str, Column]:
    """Eight figures of a column, nulls left out; for groups of bounded size, as the windows of a file."""
    v = F.col(c).cast("double")
    p = F.percentile(v, F.array(F.lit(0.1), F.lit(0.9)))
    return _plain(c) | {f"{c}_median": F.median(v), f"{c}_p10": p[0], f"{c}_p90": p[1]}


def _plain(c: str) -> dict[str, Column]:
    v = F.col(c).cast("double")
    return {f"{c}_mean": F.avg(v), f"{c}_std": F.stddev_pop(v), f"{c}_min": F.min(v), f"{c}_max": F.max(v), f"{c}_nonzero_ratio": F.avg((v > 0).cast("double"))}


def _ranks(c: str) -> dict[str, tuple[Column, float]]:
    return {f"{c}_{k}": (F.col(c), p) for k, p in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))}


def describe_groups(df: DataFrame, cols: list[str], by: list[str], sets: list[list[str]] | None = None, **more: Column) -> DataFrame:
    """The same eight figures of columns by groups of any size, with other aggregates; sets: grouping sets over ``by``."""
    plain, ranks = dict(more), {}
    for c in cols:
        plain |= _plain(c)
        ranks |= _ranks(c)
    return with_quantiles(df, by, plain, ranks, sets)


def weighted(mean_col: str, weight: str = "frames_non_skipped_window") -> dict[str, Column]:
    """Figures of window means: the mean weighted by the rows that count where the value exists, the rest over windows."""
    v, w = F.col(mean_col).cast("double"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    total = F.sum(F.when(v.isNotNull(), w))
    mean = F.when((F.count(v) > 0) & (F.sum(w) > 0), steady_sum(v * w) / F.greatest(F.lit(1.0), total))
    return {"mean": mean, "median": F.median(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v), "valid_ratio": F.avg(v.isNotNull().cast("double")), "n_valid": F.count(v)}


def series_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Mean columns of curvatures, and of radii and lengths."""
    curved = [c for c in df.columns if re.fullmatch(r"curvature_\d+_mm_mean", c)]
    return curved, [c for c in df.columns if re.fullmatch(r"curvature_\d+_radius_(px|mm)_mean|(mfc_length|body_length)_(px|mm)_mean", c)]


def first_max(value: Column, order: Column, *carry: Column) -> Column:
    """Struct of the carried columns at the largest value, the first in order of equals; null without values."""
    return F.max_by(F.struct(*carry), F.when(value.isNotNull(), F.struct(value, -order)))


def file_summary(windows: DataFrame, cfg: WindowConfig = WindowConfig(), bending: DataFrame | None = None, peaks: DataFrame | None = None) -> DataFrame:
    """One row for each file of a window table. bending: counts by file; peaks: the output of ``curvature_peaks``.

    The file's name is shortened to its date, hour and what follows ``tracking_analysis``.
    """
    agg: dict[str, Column] = {"fps": F.first("fps"), "window_seconds": F.first("window_seconds"), "n_windows": F.count("*"), "n_frames": F.sum("frames_in_window"), "skipped_frames": F.sum("frames_skipped_window")}
    for c in RATES:
        agg |= describe(c)
    for c in [c for group in series_columns(windows) for c in group]:
        agg |= {f"{c[:-5]}_{k if k == 'valid_ratio' else k + '_all'}": v for k, v in weighted(c).items() if k != "n_valid"}
    sums = [c for c in windows.columns if c.startswith("sum_")]
    agg |= {f"file_{c}": F.coalesce(steady_sum(F.col(c)), F.lit(0.0)) for c in sums}
    agg["_top"] = first_max(F.col("freq_mean_hz"), F.col("window_idx"), F.col("window_idx"), F.col("freq_mean_hz"), F.col("start_frame"), F.col("end_frame"), F.col("mid_time_s"))
    got = windows.groupBy("file").agg(*[c.alias(k) for k, c in agg.items()])
    got = got.withColumn("Datetime", text.datetime_key(F.col("file"))).withColumn("skipped_rate_pct", F.coalesce(divide(F.col("skipped_frames") * 100.0, F.col("n_frames")), F.lit(0.0)))
    means = [F.col(f"tail{k}_hz_mean") for k in range(1, 5)]
    total = sum((F.coalesce(m, F.lit(0.0)) for m in means), F.lit(0.0))
    got = got.withColumns({f"tail{k}_freq_pct": F.when(total > 0, m / total * 100) for k, m in enumerate(means, 1)})
    seconds = (F.col("n_frames") - F.col("skipped_frames")) / cfg.fps
    for c in sums:
        part = re.fullmatch(r"sum_(\w+\d)_frame_dist_mm", c)
        tail = re.fullmatch(r"sum_(Tail\d)_travel_distance_mm", c)
        if part or tail:
            name = f"Average speed of {part[1]}(BL/s)" if part else f"Average speed(reference line) of {tail[1]}(BL/s)"
            got = got.withColumn(name, F.when(seconds > 0, F.col(f"file_{c}") / seconds / cfg.body_length_mm))
    got = got.withColumns({"max_freq_window_idx": F.col("_top.window_idx"), "max_freq_hz": F.col("_top.freq_mean_hz"), "max_freq_start_frame": F.col("_top.start_frame"), "max_freq_end_frame": F.col("_top.end_frame"), "max_freq_timestamp_s": F.col("_top.mid_time_s"), "max_freq_timestamp_mmss": text.mmss(F.col("_top.mid_time_s"))}).drop("_top")
    for more in ([bending_shares(bending)] if bending is not None else []) + ([peaks] if peaks is not None else []):
        got = got.join(more, "file", "left")
    return got.withColumn("file", text.simple_stem(F.col("file")))


def curvature_peaks(frames: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """The frame of each file with the largest curvature, the first of equals."""
    name = peak_curvature(frames)
    top = frames.groupBy("file").agg(first_max(F.col(name), F.col("frame"), F.col(name).alias("v"), F.col("frame").alias("f")).alias("t"))
    seconds = F.col("t.f") / cfg.fps
    return top.select("file", F.lit(name).alias("max_curvature_column"), F.col("t.v").alias("max_curvature_value_mm"), F.col("t.f").alias("max_curvature_frame_idx"), seconds.alias("max_curvature_timestamp_s"), text.mmss(seconds).alias("max_curvature_timestamp_mmss"))


def frequency_section(windows: DataFrame, by: list[list[str]] | None = None) -> DataFrame:
    """Global frequency figures; by: grouping sets, as [["root"], []] for each root and the grand total."""
    n, s = F.coalesce(F.sum("frames_in_window"), F.lit(0)), F.coalesce(F.sum("frames_skipped_window"), F.lit(0))
    agg = {"total_windows": F.count("*"), "total_frames_est": n, "total_skipped_frames": s, "total_skipped_rate_pct": F.coalesce(divide(s * 100.0, n), F.lit(0.0))}
    got = describe_groups(windows, list(RATES), _names(by), by, **agg)
    total = sum((F.coalesce(f"tail{k}_hz_mean", F.lit(0.0)) for k in range(1, 5)), F.lit(0.0))
    got = got.withColumns({f"tail{k}_freq_pct": F.when(total > 0, F.col(f"tail{k}_hz_mean") / total * 100) for k in range(1, 5)})
    return got.select(F.lit("global_frequency").alias("section"), F.lit("O").alias("variant"), "*")


def _names(by: list[list[str]] | None) -> list[str]:
    return sorted({c for g in by or [] for c in g})


def series_section(windows: DataFrame, cols: list[str], section: str, label: str, weight: str = "frames_non_skipped_window", by: list[list[str]] | None = None) -> DataFrame:
    """A row for each series of window means (and each group of the grouping sets), unpivoted before one aggregation."""
    names = _names(by)
    pairs = F.explode(F.array(*[F.struct(F.lit(c[:-5]).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("p")
    long = windows.select(*names, weight, pairs).select(*names, weight, "p.name", "p.v")
    plain = {k: c for k, c in weighted("v", weight).items() if k != "median"}
    got = with_quantiles(long, [*names, "name"], plain, {"median": (F.col("v"), 0.5)}, [[*g, "name"] for g in by or [[]]])
    name = F.regexp_replace("name", "_mm$", "") if label == "curvature" else F.col("name")
    return got.select(F.lit(section).alias("section"), F.lit("O").alias("variant"), *names, name.alias(label), "mean", "median", "std", "min", "max", "valid_ratio", "n_valid")


def bending_section(counts: DataFrame, by: list[list[str]] | None = None) -> DataFrame:
    """Global bending shares from additive counts, for each group of the grouping sets."""
    cols, names = ["considered", "valid", "invalid", "minimal", "normal", "extreme"], _names(by)
    total = (counts.groupingSets(by, *names) if by else counts.groupBy()).agg(F.lit(True).alias("known"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols])
    return bending_shares(total).select(F.lit("global_bending_distribution").alias("section"), F.lit("O").alias("variant"), "*")


def integrate(windows: DataFrame, counts: DataFrame, by: list[list[str]] | None = None) -> DataFrame:
    """The four sections below each other in their fixed order (section_order), columns that one lacks as nulls.

    by: grouping sets over columns of both tables, as [["root"], []] for every session and the grand total. The window table is
    written once, as each section reads it.
    """
    windows = Scratch(windows.sparkSession, "integrate").save(windows, "windows")
    curved, others = series_columns(windows)
    parts = [frequency_section(windows, by)]
    parts += [series_section(windows, curved, "global_curvature", "curvature", by=by)] if curved else []
    parts += [series_section(windows, others, "global_series", "series", by=by)] if others else []
    parts.append(bending_section(counts, by))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("section_order", F.lit(k)) for k, p in enumerate(parts)])
