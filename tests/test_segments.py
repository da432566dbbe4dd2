"""The walk over segments against the walk over whole videos."""

import random

import pytest

from tests.test_frames import KP
from tests.test_plans import plan
from tidewake.config import PARTS
from tidewake.operators import frames, segments


def wild(seed, n=160, videos=("a", "b", "c")):
    """Runs of jumps, missing parts, bodies without a reference line and gaps in the numbers of frames."""
    rng, out = random.Random(seed), []
    for v in videos:
        x, frame = 0.0, 0
        for _ in range(n if v != "c" else 5):
            frame += rng.choice([1, 1, 1, 1, 2, 9])
            x += rng.uniform(-3, 6)
            jump = rng.random() < 0.35
            kp = []
            for i, p in enumerate(PARTS):
                off = rng.choice([-400.0, 400.0]) if jump and i >= 8 else 0.0
                lik = 0.3 if rng.random() < 0.015 else None if rng.random() < 0.003 else 0.9
                kp.append((p, 100.0 + 25 * i + x + off, 200.0 + rng.uniform(-12, 12) * i / 4, lik))
            if rng.random() < 0.05:
                kp[1] = ("Head2", kp[0][1], kp[0][2], 0.9)  # no reference line
            out.append((v, frame, kp))
    return out


def near(v):
    """Doubles to 8 digits, in arrays and structs too: sums add up in another order."""
    if isinstance(v, float):
        return round(v, 8) + 0.0
    return [near(x) for x in v] if isinstance(v, list | tuple) else v


def rows(df):
    return sorted((near([r[c] for c in sorted(df.columns)]) for r in df.drop("kp").collect()), key=repr)


@pytest.fixture(scope="module")
def recording(spark):
    df = spark.createDataFrame(wild(5), KP).repartition(3)
    return df, rows(frames.swim(frames.distances(frames.flags(df))).drop("kp"))


@pytest.mark.parametrize("size", [1, 7, 50])
def test_any_segment_gives_the_same_rows(recording, size):
    df, want = recording
    got = segments.walk(df, segment=size).drop("kp")
    assert rows(got) == want
    if size == 7:
        assert sorted(got.columns) == sorted(frames.swim(frames.distances(frames.flags(df))).drop("kp").columns)
        assert got.where("skip").count() > 10 and got.where("Tail1_swim > 0").count() > 10


def test_no_window_over_a_whole_video(recording):
    """Rows are dealt and ordered by video and segment; windows by video are over the summaries, which are written by then."""
    text = plan(segments.walk(recording[0], segment=50))
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all("_seg" in line for line in windows)
    assert "hashpartitioning(video_id#" in text and "SinglePartition" not in text


def test_no_frames(spark):
    assert segments.walk(spark.createDataFrame([], KP)).collect() == []
    with pytest.raises(ValueError):
        segments.walk(spark.createDataFrame([], KP), segment=0)
