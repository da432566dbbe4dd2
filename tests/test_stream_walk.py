"""The walk on a stream against the batch walk, in any cut, from a batch's end, and closed when idle."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_frames import KP
from tests.test_segments import near, wild
from tidewake.config import SWIM_PARTS, FrameConfig
from tidewake.operators import frames
from tidewake.streaming import walk

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)


@pytest.fixture(scope="module")
def recording(spark):
    """Frames of three videos, and the batch walk's rows in the stream's columns."""
    data = wild(11, 90)
    swum = frames.swim(frames.distances(frames.flags(spark.createDataFrame(data, KP)))).cache()
    arrays = {m: F.array(*[F.col(f"{p}_{m}") for p in SWIM_PARTS]) for m in ("swim", "bend", "rel", "travel", "cum_swim", "cum_bend", "cum_rel", "cum_travel", "cum_travel_whole")}
    batch = swum.select("video_id", "frame", "valid", "bad", "skip", "accepted", "dist_px", "cum_px", F.array(*[F.col(f"{p}_sign") for p in SWIM_PARTS]).alias("signs"), *[c.alias(n) for n, c in arrays.items()])
    return data, swum, {(r["video_id"], r["frame"]): near([r[c] for c in batch.columns]) for r in batch.collect()}, batch.columns


def plain(rows, cuts, cfg=FrameConfig()):
    """Rows of one video through ``advance`` in pieces."""
    out, state = [], walk.Walk()
    for own in np.split(np.arange(len(rows)), cuts):
        if len(own):
            grid = [np.array([[np.nan if p[c] is None else p[c] for p in rows[k][2]] for k in own], float) for c in (1, 2, 3)]
            got, state = walk.advance(state, np.array([rows[k][1] for k in own]), *grid, cfg)
            out += [[rows[own[0]][0], *v] for v in zip(*[walk._listed(c) for c in got.values()], strict=True)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_any_cut_gives_the_batch_rows(recording, seed):
    data, _, want, columns = recording
    rng = random.Random(seed)
    for v in ("a", "b", "c"):
        rows = [r for r in data if r[0] == v]
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, 25 * seed)))
        got = plain(rows, cuts)
        assert len(got) == len(rows)
        for g in got:
            assert near([x.tolist() if hasattr(x, "tolist") else x for x in g]) == want[g[0], g[1]], (columns, g[:2])


def stream(spark, pieces, path, name, **more):
    src = str(path / "in")
    for own in pieces:
        spark.createDataFrame(own, KP).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    frames_ = spark.readStream.schema(KP).option("maxFilesPerTrigger", 1).parquet(src)
    return walk.track(frames_, **more).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(path / "c")).start()


def test_a_stream_of_files(spark, recording, tmp_path):
    """Three files, the second with frames that come again; two recordings, one of which a batch has begun."""
    data, swum, want, columns = recording
    a, b = [r for r in data if r[0] == "a"], [r for r in data if r[0] == "b"]
    begun = walk.end_states(frames.swim(frames.distances(frames.flags(spark.createDataFrame(b[:40], KP)))))
    q = stream(spark, [a[:30], a[20:61] + b[40:50], a[61:] + b[50:]], tmp_path, "walk", begun=begun)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("SELECT * FROM walk").collect()
    assert sorted((r["video_id"], r["frame"]) for r in got) == sorted((r[0], r[1]) for r in a + b[40:]) and not any(r["closed"] for r in got)
    for r in got:
        assert near([r[c] for c in columns]) == want[r["video_id"], r["frame"]], (r["video_id"], r["frame"])


def test_idle_recordings_are_closed(spark, recording, tmp_path):
    data, _, want, columns = recording
    c = [r for r in data if r[0] == "c"]
    q = stream(spark, [c], tmp_path, "idle", idle=0.01)
    ends, until = {}, time.time() + 60  # with timers a stream always has another batch, so it is never all processed
    try:
        while not ends and time.time() < until:
            time.sleep(1)
            ends = {r["video_id"]: r for r in spark.sql("SELECT * FROM idle WHERE closed").collect()}
    finally:
        q.stop()
    last = want["c", c[-1][1]]
    assert ends["c"]["frame"] == c[-1][1] and near(list(ends["c"]["cum_px"])) == last[columns.index("cum_px")]
    assert near(list(ends["c"]["cum_travel_whole"])) == last[columns.index("cum_travel_whole")]
