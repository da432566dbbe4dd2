"""A stream of files gives the batch's windows."""

from pyspark.sql import functions as F

from tidewake.config import WindowConfig
from tidewake.streaming import tracker
from tidewake.streaming import windows as streaming

SCHEMA = "file string, start timestamp, frame long, curvature_1_mm double, curvature_1_class string"


def test_stream_equals_batch(spark, tmp_path):
    src, cfg = str(tmp_path / "in"), WindowConfig(frames=20)
    df = spark.range(100).select(F.lit("f").alias("file"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("start"), F.col("id").alias("frame"), F.when(F.col("id") % 5 != 0, F.col("id") / 1000.0).alias("curvature_1_mm"), F.lit("Normal").alias("curvature_1_class"))
    for k in range(4):
        df.where(f"frame between {25 * k} and {25 * k + 24}").coalesce(1).write.mode("append").parquet(src)
    stream = streaming.frame_files(spark, src, SCHEMA)
    q = streaming.window_counts(stream, cfg, "0 seconds").writeStream.outputMode("append").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["window_idx"]: (r["n"], r["n_kept"]) for r in spark.sql("SELECT * FROM win").collect()}
    assert set(got) <= set(range(5)) and len(got) >= 3 and set(got.values()) == {(20, 16)}
    q = streaming.running_bending(streaming.frame_files(spark, src, SCHEMA)).writeStream.outputMode("complete").format("memory").queryName("bend").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT considered, normal FROM bend").collect() == [(80, 80)]


def test_counters_go_on_from_batch_to_batch(spark, tmp_path):
    """Sides over three files; nulls carry the last side over, frames that come again don't count."""
    signs, src = [-4.0, 4.0, None, 0.0, 5.0, 9.0, 13.0, -1.0, None, -5.0, 2.0, 3.0], str(tmp_path / "in")
    rows = [("v", k, "Tail1", s) for k, s in enumerate(signs)]
    for own in (rows[:5], rows[3:9], rows[9:]):
        spark.createDataFrame(own, "video_id string, frame long, part string, sign double").coalesce(1).write.mode("append").parquet(src)
    progress = tracker.Progress()
    spark.streams.addListener(progress)
    try:
        stream = spark.readStream.schema("video_id string, frame long, part string, sign double").option("maxFilesPerTrigger", 1).parquet(src)
        q = tracker.count_swims(stream).writeStream.outputMode("update").format("memory").queryName("swims").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        got = spark.sql("SELECT * FROM swims ORDER BY frame").collect()
    finally:
        spark.streams.removeListener(progress)
    side, swims, bends, seen = None, 0, 0, {}
    for k, s in enumerate(signs):
        if s is not None:
            swims += side is not None and side * s < 0
            bends += side is not None and side * s > 0 and abs(s - side) > 3
            side = s
        seen[k] = (swims, bends)
    assert [(r["frame"], r["swims"], r["bends"]) for r in got] == [(k, *seen[k]) for k in (4, 8, 11)]
    assert sum(b[2] for b in progress.batches) == 14
