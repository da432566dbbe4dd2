"""Rounding projections by column name, as the sinks apply them; half to even."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.config import FrameConfig

_NUMBERS = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)


def frame_rule(name: str, cfg: FrameConfig = FrameConfig()) -> tuple[str, int]:
    """(kind, digits) of a frame or summary column, the first rule that fits: kinds plain, int, curvature (blank beyond the limit), body (blank outside the bounds)."""
    n = name.lower()
    # The words that make a curvature column another figure.
    curved = n.startswith("curvature_") and not any(k in n for k in ("radius", "center", "class", "u_shape", "n_shape", "percentage", "count"))
    rules = (
        ("frequency_hz" in n, ("plain", 4)),
        ("radius_px" in n or "radius_mm" in n, ("int", 0)),
        (curved and n.endswith("_mm"), ("curvature", 4)),
        (curved and n.endswith("_px"), ("plain", 4)),
        ("body_length" in n and n.endswith("_mm"), ("body", 0)),
        (n.endswith(("_mm", "_px")) and "curvature" not in n, ("int", 0)),
        (n.endswith(("_x", "_y")) or "center_x" in n or "center_y" in n, ("plain", 3)),
        ("likelihood" in n, ("plain", 3)),
        (any(k in n for k in ("count", "swim", "bending")), ("int", 0)),
        ("percentage" in n, ("plain", 2)),
    )
    return next((rule for fits, rule in rules if fits), ("plain", 3))


def round_frame_value(c: Column, name: str, cfg: FrameConfig = FrameConfig()) -> Column:
    kind, digits = frame_rule(name, cfg)
    v = c.cast("double")
    if kind == "curvature":
        v = F.when(F.abs(v) <= cfg.invalid, v)
    elif kind == "body":
        v = F.when(v.between(*cfg.body_mm), v)
    return F.bround(v, digits)


def round_frames(df: DataFrame, cfg: FrameConfig = FrameConfig(), keep: tuple[str, ...] = ("coords",)) -> DataFrame:
    """Every numeric column by its rule; text and the frame number stay."""
    return df.select(*[round_frame_value(F.col(f"`{f.name}`"), f.name, cfg).alias(f.name) if isinstance(f.dataType, _NUMBERS) and f.name not in keep else F.col(f"`{f.name}`") for f in df.schema])


# Columns cast to whole numbers, in window tables and in file summaries.
WINDOW_INTS = ("window_idx", "start_frame", "end_frame", "n_tails_used", "frames_in_window", "frames_non_skipped_window", "frames_skipped_window", "file_skipped_frames")
SUMMARY_INTS = ("n_windows", "n_frames", "skipped_frames", "bending_total_valid_frames", "bending_total_considered_frames", "max_freq_window_idx", "max_freq_start_frame", "max_freq_end_frame", "max_curvature_frame_idx")


def table_digits(name: str, summary: bool) -> int | None:
    """Digits of a window or summary column; None: whole numbers."""
    low = name.lower()
    if name in SUMMARY_INTS if summary else name in WINDOW_INTS or name.endswith("_n"):
        return None
    if re.match(r"curvature_\d+_mm", name):
        return 5
    if "hz" in low or low.endswith("_pct") or "percentage" in low:
        return 2
    if low.endswith("_time_s") or low == "duration_s":
        return 3
    if low.endswith(("_total_distance_px", "_total_distance_mm")) or low.startswith(("sum_", "file_sum_")) or name in ("fps", "window_seconds"):
        return 2
    return 3


def round_table(df: DataFrame, summary: bool = False) -> DataFrame:
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, _NUMBERS):
            cols.append(c)
            continue
        digits = table_digits(f.name, summary)
        cols.append((F.bround(c.cast("double"), 0).cast("long") if digits is None else F.bround(c.cast("double"), digits)).alias(f.name))
    return df.select(*cols)
