"""Plans that scale: one exchange and one sort for each sequence, filters and columns pushed to the scan, no Cartesian product."""

import re

import pytest

from tests.conftest import DATA
from tidewake.config import FrameConfig
from tidewake.operators import activity, diel, frames, windows
from tidewake.plans import common
from tidewake.plans import diel as diel_plans
from tidewake.plans import frames as frame_plans
from tidewake.plans import misc, windows as window_plans

ALL = diel_plans.QUERIES | window_plans.QUERIES | frame_plans.QUERIES | misc.QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(text, node):
    return len(re.findall(rf"[ \-+:]{node}\b", text))


@pytest.mark.parametrize("name", sorted(ALL))
def test_no_join_without_a_key(name, spark):
    text = plan(ALL[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_frames_need_one_exchange_and_sort(spark, tmp_path):
    common.poses(spark, DATA).write.parquet(str(tmp_path / "kp"))
    got = plan(frames.swim(frames.distances(frames.flags(spark.read.parquet(str(tmp_path / "kp"))))))
    assert count(got, "Exchange") == 1 and count(got, "Sort") == 1


@pytest.mark.parametrize("fit, trips", [("threept", 1), ("hyper", 0), ("pratt", 0)])
def test_fits_of_all_sets_are_one_trip_to_python_or_none(spark, fit, trips):
    assert count(plan(frames.curvature(frames.flags(common.poses(spark, DATA)), FrameConfig(fit=fit))), "ArrowEvalPython") == trips


def test_whole_tables_are_ordered_by_ranges(spark):
    """A recording without a key is numbered, and its neighbours found, without a window over all of it."""
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumnRenamed("event_type", "state")
    columns = {"activity_class": "state", "movement": "value", "swim_count": "user_id"}
    for got in (activity.prepare(events, columns), activity.transitions(events, ["ts", "event_id"])):
        text = plan(got)
        windows_ = [line for line in text.splitlines() if "Window [" in line]
        assert all("_part" in line or "sum(n" in line for line in windows_), windows_  # by part, or over the nine states


def test_windows_need_one_exchange(spark, tmp_path):
    common.tracking(spark, DATA).write.parquet(str(tmp_path / "t"))
    got = plan(windows.window_table(windows.prepare(spark.read.parquet(str(tmp_path / "t")))))
    assert count(got, "Exchange") == 1


def test_scans_read_what_they_need(spark):
    got = plan(diel.daily_mean(spark.read.parquet(f"{DATA}/events.parquet").where("user_id = 3").selectExpr("cast(ts as date) as date", "value")))
    assert "EqualTo(user_id,3)" in got and re.search(r"ReadSchema: struct<ts:\w+,user_id:bigint,value:double>", got)
