"""Per-video summaries of analysed frames (the output of ``frames.analyse``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.config import CURVATURE_SETS, PARTS, SWIM_PARTS, FrameConfig
from tidewake.functions.values import divide
from tidewake.operators.frames import all_likely


def _last(c: Column) -> Column:
    """Value of the last row that has one; 0 without."""
    return F.coalesce(F.max_by(c, F.when(c.isNotNull(), F.col("frame"))), F.lit(0))


def _curvature(name: str, cfg: FrameConfig) -> list[Column]:
    seen = all_likely(F.col("kp"), cfg.sets[name], cfg)
    label = F.col(f"{name}_class")
    out = []
    for unit, scale in (("px", cfg.mm_per_px), ("mm", 1.0)):
        c = F.col(f"{name}_{unit}")
        kept = F.when(seen & (F.abs(c / scale) <= cfg.invalid), c)
        out += [f(kept).alias(f"{name}_{s}_{unit}") for s, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))]
        r = F.when(seen, F.col(f"{name}_radius_{unit}"))
        out += [f(r).alias(f"{name}_radius_{s}_{unit}") for s, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    share = lambda n, of: F.coalesce(divide(n * 100.0, of), F.lit(0.0))
    shown = F.count_if(seen & ~F.coalesce(label == "Invalid", F.lit(False)))
    for side in ("u", "n"):
        n = F.coalesce(F.sum(F.when(seen & ~F.coalesce(label == "Invalid", F.lit(False)), F.col(f"{name}_{side}_shape"))), F.lit(0))
        out += [n.alias(f"{name}_{side}_shape_count"), share(n, shown).alias(f"{name}_{side}_shape_percentage")]
    classified, every = F.count_if(seen & (label != "Invalid")), F.count_if(seen & label.isNotNull())
    for kind in ("Extreme", "Normal", "Minimal", "Invalid"):
        n = F.count_if(seen & (label == kind))
        out += [n.alias(f"{name}_{kind.lower()}_count"), share(n, every if kind == "Invalid" else classified).alias(f"{name}_{kind.lower()}_percentage")]
    return out


def video_summary(df: DataFrame, cfg: FrameConfig = FrameConfig(), sets: tuple[str, ...] = tuple(CURVATURE_SETS)) -> DataFrame:
    """One row for each video, in one aggregation: frames, distances, curvature, swimming, lengths and tail-beat frequencies."""
    r = cfg.mm_per_px
    cols = [
        F.count("*").alias("total_frames"),
        F.count_if(~F.col("valid")).alias("skipped_frames_missing_invalid"),
        F.count_if("skip").alias("skipped_frames_wrong_detection"),
    ]
    total = {p: _last(F.col("cum_px")[k]) for k, p in enumerate(PARTS)}
    for p, c in total.items():
        cols += [c.alias(f"{p}_total_distance_px"), (c * r).alias(f"{p}_total_distance_mm")]
    for name in sets:
        cols += _curvature(name, cfg)
    for p in SWIM_PARTS:
        flips, bends, rel, travel, whole = (_last(F.col(f"{p}_cum_{m}")) for m in ("swim", "bend", "rel", "travel", "travel_whole"))
        cols += [flips.alias(f"{p}_total_swim_count"), bends.alias(f"{p}_total_one_sided_bending")]
        for n, c in (("relative_travel_distance", rel), ("travel_distance", travel), ("travel_distance_whole", whole)):
            cols += [c.alias(f"{p}_{n}_px"), (c * r).alias(f"{p}_{n}_mm")]
        cols.append(F.when(travel > 0, total["MFC5"] / travel * 100).alias(f"{p}_swimming_efficiency_%"))
        seconds = F.count(f"{p}_sign") / cfg.fps
        for n, c in (("swim", flips), ("one_sided", bends), ("combined", flips + bends)):
            cols.append(divide(c / 2, seconds).alias(f"{p}_{n}_frequency_hz"))
    for length in ("mfc_length_mm", "body_length_mm"):
        c = F.col(length)
        kept = c if length == "mfc_length_mm" else F.when(c.between(*cfg.body_mm), c)
        stem = length.removesuffix("_mm")
        cols += [f(kept).alias(f"{stem}_{s}_mm") for s, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return df.groupBy(F.col("video_id").alias("video_name")).agg(*cols)


def tail_beats(summary: DataFrame, tracking: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """Frequencies from a summary and the frames of the same video, joined on the video's name."""
    seen = tracking.groupBy(F.col("video_id").alias("video_name")).agg(*[F.count(f"{p}_sign").alias(f"_n_{p}") for p in SWIM_PARTS])
    got = summary.join(seen, "video_name", "left")
    for p in SWIM_PARTS:
        flips, bends = F.coalesce(F.col(f"{p}_total_swim_count"), F.lit(0)), F.coalesce(F.col(f"{p}_total_one_sided_bending"), F.lit(0))
        for n, c in (("swim", flips), ("one_sided", bends), ("combined", flips + bends)):
            got = got.withColumn(f"{p}_{n}_frequency_hz", divide(c / 2, F.col(f"_n_{p}") / cfg.fps))
    return got.drop(*[f"_n_{p}" for p in SWIM_PARTS])


def total_summary(parts: list[DataFrame]) -> DataFrame:
    """Summaries of several sessions, columns that one lacks as nulls."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
