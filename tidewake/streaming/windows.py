"""Window statistics of frames that arrive as a stream, for recordings still under way.

A frame's event time is its recording's start plus frame / fps; windows of the batch form become event-time windows with a
watermark for late frames. Cumulative counters need the row before, which a stream has no order for, so only statistics
that add up within a window are here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.config import WindowConfig
from tidewake.operators.windows import bending_counts


def frame_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Parquet files of (file, start, frame, ...) as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def window_counts(frames: DataFrame, cfg: WindowConfig = WindowConfig(), late: str = "30 seconds") -> DataFrame:
    """(file, window_idx, n, n_kept, mean and max of curvature_1_mm) of closed windows; frames: (file, start, frame, curvature_1_mm)."""
    at = F.timestamp_micros(F.unix_micros("start") + (F.col("frame") * 1_000_000 / cfg.fps).cast("long"))
    c = F.col("curvature_1_mm")
    got = frames.withColumn("at", at).withWatermark("at", late)
    got = got.groupBy(F.window("at", f"{cfg.seconds} seconds"), "file", F.floor(F.col("frame") / cfg.frames).alias("window_idx"))
    return got.agg(F.count("*").alias("n"), F.count(c).alias("n_kept"), F.avg(c).alias("mean"), F.max(c).alias("max")).drop("window")


def running_bending(frames: DataFrame) -> DataFrame:
    """Counts of bending classes of each file so far, for a complete-mode sink."""
    return bending_counts(frames.withColumn("skip", F.col("curvature_1_mm").isNull()), ["file"])
