"""Recording metadata: snapshot choice, corrupted frames, routing of video files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.config import ActivityConfig
from tidewake.functions import text


def best_snapshot(df: DataFrame, error: str, iteration: str, by: list[str] | None = None) -> DataFrame:
    """The iteration with the least test error, the first of equals."""
    best = F.min_by(F.struct(F.col(iteration).alias("iteration"), F.col(error).alias("error")), F.struct(F.col(error), F.col(iteration)))
    got = df.where(F.col(error).isNotNull()).groupBy(*(by or [])).agg(best.alias("b"))
    return got.select(*(by or []), F.col("b.iteration").alias("iteration"), F.col("b.error").alias("error"))


def corrupted(df: DataFrame, video: str, frame: list[str], bad: str, cfg: ActivityConfig = ActivityConfig()) -> DataFrame:
    """(video, n_frames, n_bad, worst_ratio, failed): a video fails if the share of bad frames so far is ever over the limit."""
    run = W.partitionBy(video).orderBy(*frame).rowsBetween(W.unboundedPreceding, 0)
    ratio = F.sum(F.col(bad).cast("int")).over(run) / F.count("*").over(run)
    got = df.select(video, F.col(bad).cast("int").alias("bad"), ratio.alias("ratio"))
    return got.groupBy(video).agg(F.count("*").alias("n_frames"), F.sum("bad").alias("n_bad"), F.max("ratio").alias("worst_ratio"), (F.max("ratio") > cfg.corrupted_ratio).alias("failed"))


def last_good(df: DataFrame, video: str, frame: list[str], value: str, bad: str) -> DataFrame:
    """A bad frame's value becomes that of the last good one."""
    w = W.partitionBy(video).orderBy(*frame).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(value, F.last(F.when(~F.col(bad), F.col(value)), ignorenulls=True).over(w))


def route(df: DataFrame, name: str = "file") -> DataFrame:
    """Camera and hour folder of video files; others go. Hour folders are for the main camera only."""
    got = df.where(text.is_video(F.col(name)) & text.camera(F.col(name)).isNotNull()).withColumn("camera", text.camera(F.col(name)))
    return got.withColumn("hour_folder", F.when(F.col("camera") == "RecM", text.hour_folder(F.col(name))))


def unlabeled(df: DataFrame, name: str = "file") -> DataFrame:
    return df.where(text.is_unlabeled_video(F.col(name)))


def progress(df: DataFrame) -> DataFrame:
    """Mean percent done over files with (done, total)."""
    return df.agg(F.avg(F.when(F.col("total") > 0, F.col("done") * 100.0 / F.col("total")).otherwise(0.0)).alias("percent"))
