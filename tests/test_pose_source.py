"""The pose data source against the reader by Spark's own text scan, in batches and as a stream."""

import os

import pytest

from tests.test_sources import pose_csv
from tidewake.config import PARTS
from tidewake.sources import pose_source, scans


def fill(folder, names, n=5):
    row = lambda k, f: [k] + [v for i in range(len(PARTS)) for v in (100 + 20 * i + f, 200.5, "" if (k + i) % 7 == 0 else 0.9)]
    for f, name in enumerate(names):
        pose_csv(folder / f"{name}.csv", [row(k, f) for k in range(n)])


@pytest.fixture
def folder(spark, tmp_path):
    pose_source.register(spark)
    src = tmp_path / "in"
    src.mkdir()
    fill(src, ["T20241018_time_18", "b", "c"], 2100)
    pose_csv(src / "short.csv", [[0, 1, 2]], PARTS[:1])
    pose_csv(src / "empty.csv", [])
    (src / "other.txt").write_text("1,2,3")
    return src


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [10, 1 << 27])
def test_the_frames_of_the_text_scan_in_one_pass(spark, folder, most):
    good, bad = pose_source.split(spark.read.format("tidewake_pose").option("bytes", most).load(str(folder)))
    want, rejected = scans.pose(spark, str(folder / "*.csv"))
    assert rows(good) == rows(want) and good.count() == 6300
    assert sorted((os.path.basename(r["file"]), r["error"]) for r in bad.collect()) == sorted((os.path.basename(r["file"]), r["error"]) for r in rejected.collect()) == [("empty.csv", "no frames"), ("short.csv", "only 3 columns")]
    assert good.rdd.getNumPartitions() == (5 if most == 10 else 1)


def test_parts_and_paths(spark, folder):
    read = spark.read.format("tidewake_pose")
    got = read.option("parts", "Tail1,Head1").load(str(folder / "b.csv")).first()
    assert [p["part"] for p in got["kp"]] == ["Tail1", "Head1"] and got["kp"][1]["x"] == 101.0 or got["kp"][1]["x"] == 102.0 or got["kp"][1]["x"] == 100.0
    assert read.load(str(folder / "none*.csv")).collect() == []
    with pytest.raises(Exception, match="unknown parts"):
        spark.read.format("tidewake_pose").option("parts", "Nose").load(str(folder)).collect()


def test_files_arrive_in_a_stream(spark, folder, tmp_path):
    q = spark.readStream.format("tidewake_pose").load(str(folder)).writeStream.format("memory").queryName("poses").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT count(*) n, count(error) e FROM poses").first()[:] == (6302, 2)
        fill(folder, ["d"], 3)
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.sql("SELECT count(*) n, count(error) e FROM poses").first()[:] == (6305, 2)
    assert spark.sql("SELECT count(*) n FROM poses WHERE video_id = 'd'").first()["n"] == 3
