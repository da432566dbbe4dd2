"""Readers and writers on files."""

import logging

import pytest
from pyspark.sql import functions as F

from tidewake.config import PARTS, WindowConfig
from tidewake.operators import activity, files, frames, summary, windows
from tidewake.sources import scans, sinks


def pose_csv(path, rows, parts=PARTS):
    names = [f"{p},{p},{p}" for p in parts]
    lines = ["scorer" + ",net" * 3 * len(parts), "bodyparts," + ",".join(names), "coords" + ",x,y,likelihood" * len(parts)]
    path.write_text("\n".join(lines + [",".join(map(str, r)) for r in rows]) + "\n")


def test_pose_files_and_rejects(spark, tmp_path):
    row = lambda k: [k] + [v for i in range(len(PARTS)) for v in (100 + 20 * i, 200, 0.9)]
    gap = row(1)
    gap[1] = ""
    pose_csv(tmp_path / "T20241018_time_18.csv", [row(0), gap])
    pose_csv(tmp_path / "short.csv", [row(0)[:10]], PARTS[:3])
    pose_csv(tmp_path / "empty.csv", [])
    good, bad = scans.pose(spark, str(tmp_path))
    got = good.orderBy("frame").collect()
    assert [(r["video_id"], r["frame"], r["kp"][0]["x"]) for r in got] == [("T20241018_time_18", 0, 100.0), ("T20241018_time_18", 1, None)]
    assert sorted(r["error"] for r in bad.collect()) == ["no frames", "only 10 columns"]
    assert [r["valid"] for r in frames.flags(good).orderBy("frame").collect()] == [True, False]


def test_encodings_and_marks(spark, tmp_path):
    (tmp_path / "a_tracking.csv").write_bytes("﻿file,note\nf1,ä\n".encode())
    (tmp_path / "b_tracking.csv").write_bytes("file,note\nf2,é\n".encode("cp1252"))
    got = scans.tracking(spark, str(tmp_path)).orderBy("file").collect()
    assert [(r["file"], r["note"]) for r in got] == [("f1", "ä"), ("f2", "é")]


def test_summary_with_separators(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Datetime,n\n20241018_time_18,"1,234"\n20241018_time_19,x\n')
    assert [r["n"] for r in scans.summary(spark, str(tmp_path / "s.csv")).orderBy("Datetime").collect()] == [1234.0, None]


def test_snapshot_headers(spark, tmp_path):
    (tmp_path / "e.csv").write_text(",Training iterations:, Test error(px)\n0,100000,5.10\n1,700000,3.79\n")
    assert scans.snapshots(spark, str(tmp_path / "e.csv")).columns == ["index", "Training iterations:", "Test error(px)"]


def test_listings(spark, tmp_path):
    for name in ("b.MP4", "a.mp4", "x.csv", "X_labeled.mp4"):
        (tmp_path / name).write_text("x")
    assert {r["file"] for r in scans.videos(spark, str(tmp_path)).collect()} == {"b.MP4", "a.mp4", "X_labeled.mp4"}
    assert [r["file"] for r in scans.list_files(spark, str(tmp_path), "*.mp4", "LABEL").collect()] == ["X_labeled.mp4"]
    assert scans.pick_csv(str(tmp_path)).endswith("x.csv") and scans.pick_csv("/any/file.csv") == "/any/file.csv"
    deep = tmp_path / "20241018" / "RecM" / "241018_time_03"
    deep.mkdir(parents=True)
    (deep / "RecM03_20241018_020000.mp4").write_text("x")
    assert [(r["date"], r["hour_folder"]) for r in scans.raw_videos(spark, str(tmp_path)).collect()] == [("20241018", "241018_time_03")]
    with pytest.raises(FileNotFoundError):
        scans.pick_csv(str(deep))


def test_lists_are_in_order_of_names(spark, tmp_path):
    for name in ("c.mp4", "a.mp4", "b.mp4"):
        (tmp_path / name).write_text("x")
    for got in (scans.videos(spark, str(tmp_path)), scans.list_files(spark, str(tmp_path))):
        assert [r["file"] for r in got.collect()] == ["a.mp4", "b.mp4", "c.mp4"]


def test_roots_and_rejects(spark, tmp_path):
    for k, letter in enumerate("äé"):
        (tmp_path / f"s{k}").mkdir()
        (tmp_path / f"s{k}" / "a b.csv").write_bytes(f"file,note\nf{k},{letter}\n".encode("utf-8" if k else "cp1252"))
    (tmp_path / "s1" / "broken.csv").write_bytes(b"file,note\nf9,\x81\xff\n")
    got = scans.roots(spark, [str(tmp_path / "s0"), str(tmp_path / "s1")]).orderBy("file").collect()
    assert [(r["file"], r["note"], r["root"].rsplit("/", 1)[1]) for r in got] == [("f0", "ä", "s0"), ("f1", "é", "s1")]
    told = {r["file"].rsplit("/", 1)[1]: (r["ok"], r["error"]) for r in scans.tracking_files(spark, str(tmp_path / "s1")).collect()}
    assert told == {"a%20b.csv": (True, None), "broken.csv": (False, "no encoding reads it")}
    sinks.rejects(scans.tracking_files(spark, str(tmp_path / "s1")), str(tmp_path / "told"))
    assert sorted(str(r["ok"]) for r in scans.table(spark, str(tmp_path / "told")).collect()) == ["False", "True"]


def test_names_of_columns_in_either_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Größe,x\n1,2\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("\ufeffGröße,x\n1,2\n".encode())
    assert [scans.tracking(spark, str(tmp_path / f)).columns[:2] for f in ("a.csv", "b.csv")] == [["Größe", "x"]] * 2


def test_home_root(monkeypatch):
    monkeypatch.setenv("TIDEWAKE_TEST_HOME", "/data")
    monkeypatch.delenv("TIDEWAKE_TEST_NONE", raising=False)
    assert scans.home_root("TIDEWAKE_TEST_NONE", "TIDEWAKE_TEST_HOME") == "/data"
    assert scans.home_root("TIDEWAKE_TEST_NONE").startswith("/")


def test_nested_settings(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("skeleton:\n  head:\n    a: 1\n    b: [x]\n  tail: 2.5\nvideos: # none\nlist:\n- 1\n- two\nnet:\n  layers:\n  - 3\n  - 4\n  rate: 0.5\nlast: yes\n")
    assert scans.settings(str(f)) == {"skeleton": {"head": {"a": 1, "b": "[x]"}, "tail": 2.5}, "videos": [], "list": [1, "two"], "net": {"layers": [3, 4], "rate": 0.5}, "last": "yes"}


def test_settings(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("Task: fish\niteration: 0 # first\nbodyparts:\n- Head1\n- Tail1\npcutoff: 0.6\n")
    assert scans.settings(str(f)) == {"Task": "fish", "iteration": 0, "bodyparts": ["Head1", "Tail1"], "pcutoff": 0.6}
    scans.update_settings(str(f), {"iteration": 3, "new": 1})
    assert scans.settings(str(f))["iteration"] == 3 and scans.settings(str(f))["new"] == 1


def test_sinks_round_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("v1", 0, 1.26, 12.5), ("v2", 0, None, 13.5)], "video_id string, coords long, Head1_x double, Head1_frame_dist_mm double")
    sinks.tracking(df, str(tmp_path / "t"))
    got = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "t")).orderBy("video_id").collect()
    assert [(r["Head1_x"], r["Head1_frame_dist_mm"]) for r in got] == [(1.26, 12.0), (None, 14.0)]
    sinks.series(spark.createDataFrame([("b", 2.0), ("a", 1.0)], "date string, value double"), str(tmp_path / "s"))
    assert [r["date"] for r in scans.table(spark, str(tmp_path / "s")).collect()] == ["a", "b"]
    sinks.rejects(df.select(F.col("video_id").alias("file"), F.lit("bad").alias("error")), str(tmp_path / "r"))
    assert scans.table(spark, str(tmp_path / "r")).count() == 2


def test_logger_rotates(tmp_path):
    log = sinks.logger("tidewake-test", str(tmp_path / "run.log"))
    log.info("hello")
    logging.shutdown()
    assert "hello" in (tmp_path / "run.log").read_text()


def windows_and_counts(spark):
    df = spark.createDataFrame([(f"T2024101{f}_time_18_x_tracking_analysis", k, 0.001 * (k + f), "Normal", k) for f in range(2) for k in range(12)], "file string, frame long, curvature_1_mm double, curvature_1_class string, Tail1_cumulative_swim_count long")
    frames_ = windows.prepare(df)
    return windows.window_table(frames_, WindowConfig(frames=4)), windows.bending_counts(frames_, ["file"])


def read(spark, path):
    return scans.table(spark, str(path))


def test_tables_that_the_sinks_write(spark, tmp_path):
    win, counts = windows_and_counts(spark)
    sinks.windows(win, str(tmp_path / "w"))
    got = read(spark, tmp_path / "w")
    assert got.count() == 6 and {"file", "window_idx", "curvature_1_mm_mean"} <= set(got.columns)
    assert "\ufeff" in next((tmp_path / "w").rglob("*.csv")).read_text(encoding="utf-8")[:1]
    root = F.substring("file", 1, 9)
    sinks.file_summaries(files.file_summary(win, WindowConfig(frames=4), counts).withColumn("root", F.lit("r")), str(tmp_path / "f"), "root")
    got = read(spark, tmp_path / "f").orderBy("file").collect()
    assert [r["file"] for r in got] == ["T20241010_time_18_tracking_analysis", "T20241011_time_18_tracking_analysis"] and got[0]["n_windows"] == 3
    by = files.integrate(win.withColumn("root", root), counts.withColumn("root", root), [["root"], []])
    sinks.integrated(by, str(tmp_path / "i"), "root")
    got = read(spark, tmp_path / "i").groupBy("root").count().collect()
    assert {(r["root"], r["count"]) for r in got} == {("T20241010", 3), ("T20241011", 3), (None, 3)}
    total = summary.total_summary([spark.createDataFrame([("a", 1.0)], "video_name string, Tail1_swim_frequency_hz double"), spark.createDataFrame([("b", 12.5)], "video_name string, Head1_total_distance_mm double")])
    sinks.video_summaries(total, str(tmp_path / "v"))
    got = {r["video_name"]: r for r in read(spark, tmp_path / "v").collect()}
    assert got["a"]["Tail1_swim_frequency_hz"] == 1.0 and got["a"]["Head1_total_distance_mm"] is None and got["b"]["Head1_total_distance_mm"] == 12.0
    sinks.combined_hourly(spark.createDataFrame([(1, 2.0), (0, 1.0)], "hour_bin int, x double"), str(tmp_path / "h"))
    assert [r["hour_bin"] for r in read(spark, tmp_path / "h").collect()] == [0, 1]


def test_a_missing_column_has_its_default(spark):
    df = spark.createDataFrame([(1,)], "a int")
    got = df.select(activity.safe(df, "a").alias("a"), activity.safe(df, "b", 7).alias("b"), activity.safe(df, "c").alias("c")).first()
    assert tuple(got) == (1, 7, None)


def _tracked(spark, videos):
    rows = [(v, k, 1.23456, 300.0 if k % 3 else None) for v in videos for k in range(7)]
    return spark.createDataFrame(rows, "video_id string, coords long, Head1_x double, body_length_mm double").repartition(3)


def test_published_files_are_named_and_counted(spark, tmp_path):
    out = tmp_path / "out"
    told = spark.createDataFrame([("a.csv", True, None), ("b.csv", False, "no frames")], "file string, ok boolean, error string")
    got = sinks.publish(_tracked(spark, ["v1", "v 2/x"[:3]]), told, str(out))
    assert got == {"frames": 14, "frames_without_body": 6, "files": 2, "files_rejected": 1}
    names = sorted(p.name for p in (out / "tracking").iterdir() if p.suffix == ".csv" and not p.name.startswith("."))
    assert names == ["v 2_tracking_analysis.csv", "v1_tracking_analysis.csv"]
    read = scans.tracking(spark, str(out / "tracking" / "v1_tracking_analysis.csv")).collect()
    assert sorted((r["coords"], r["Head1_x"], r["body_length_mm"]) for r in read) == [(str(k), "1.235", "300.0" if k % 3 else None) for k in range(7)]
    lines = (out / "tracking" / "v1_tracking_analysis.csv").read_text(encoding="utf-8-sig").splitlines()
    assert lines[0] == "video_id,coords,Head1_x,body_length_mm" and [x.split(",")[:2] for x in lines[1:]] == [["v1", str(k)] for k in range(7)]
    # what is there is replaced as a whole
    sinks.publish(_tracked(spark, ["v3"]), told.limit(0), str(out))
    assert [p.name for p in (out / "tracking").iterdir() if p.suffix == ".csv" and not p.name.startswith(".")] == ["v3_tracking_analysis.csv"]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failing_task_publishes_nothing(spark, tmp_path):
    told = spark.createDataFrame([], "file string, ok boolean, error string")
    sinks.publish(_tracked(spark, ["v1"]), told, str(tmp_path / "out"))
    broken = _tracked(spark, ["v1", "v2", "v3"]).withColumn("Head1_x", F.when(F.col("video_id") == "v3", F.raise_error(F.lit("lost"))).otherwise(F.col("Head1_x")))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(broken, told, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out" / "tracking").iterdir() if p.suffix == ".csv" and not p.name.startswith(".")] == ["v1_tracking_analysis.csv"]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
