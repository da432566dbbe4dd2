"""Dates, hours, weeks, rolling statistics and intervals."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.functions import text, values
from tidewake.operators import activity, diel, media


def obs(spark, rows):
    return spark.createDataFrame([(dt.date(2024, 10, d), h, v) for d, h, v in rows], "date date, hour_bin int, value double")


def test_icc_of_large_values(spark):
    """Deviations from the mean: a shift of all values changes nothing."""
    rows = [(1 + k % 9, k % 24, float(k * 7 % 13)) for k in range(200)]
    near = diel.icc(obs(spark, rows)).first()
    far = diel.icc(obs(spark, [(d, h, v + 1e7) for d, h, v in rows])).first()
    assert far["icc"] == pytest.approx(near["icc"], rel=1e-4, abs=1e-6) and far["ms_between"] == pytest.approx(near["ms_between"], rel=1e-4)


def test_analyses_are_switched_by_name(spark):
    df = obs(spark, [(1, 3, 2.0), (2, 3, 4.0)])
    assert set(diel.report(df)) == set(diel.ANALYSES)
    got = diel.report(df, {name: name == "hourly" for name in diel.ANALYSES})
    assert set(got) == {"hourly"} and [r["hour_bin"] for r in got["hourly"].collect()] == list(range(24))
    with pytest.raises(ValueError):
        diel.report(df, {"other": True})


def test_density_is_the_sum_over_all_rows(spark):
    import numpy as np

    v = np.random.default_rng(3).normal(5, 2, 400)
    got = activity.density(spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(3), "v", 11).orderBy("x").collect()
    h = v.std(ddof=1) * len(v) ** -0.2
    x = np.linspace(v.min(), v.max(), 11)
    want = np.exp(-(((x[:, None] - v) / h) ** 2) / 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
    assert [r["x"] for r in got] == pytest.approx(x) and [r["density"] for r in got] == pytest.approx(want)
    assert activity.density(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").collect() == []
    assert activity.density(spark.createDataFrame([], "v double"), "v").collect() == []


def test_classes_come_most_frequent_first(spark):
    df = spark.createDataFrame([(x,) for x in ["a", "b", "b", "Invalid", None, "c", "c", "c"]], "label string")
    assert [(r["label"], r["n"], r["n_invalid"]) for r in activity.class_shares(df).collect()] == [("c", 3, 1), ("b", 2, 1), ("a", 1, 1)]


def test_keys(spark):
    df = spark.createDataFrame([("20241018_time_18",), ("20241018_time_0",), ("20241018_time_30",), ("x",), (None,), ("20241340_time_3",)], "Datetime string")
    assert sorted(r["hour_bin"] for r in diel.parse_keys(df).collect()) == [0, 17, 23]
    with pytest.raises(ValueError):
        diel.parse_keys(df.withColumnRenamed("Datetime", "other"))


def test_weeks_start_on_tuesday(spark):
    df = spark.createDataFrame([(dt.date(2024, 10, 14),), (dt.date(2024, 10, 15),)], "d date").select(values.week_start(F.col("d")).alias("w"))
    assert [r["w"] for r in df.collect()] == [dt.date(2024, 10, 8), dt.date(2024, 10, 15)]


def test_rolling_needs_five_observed_days(spark):
    daily = spark.createDataFrame([(dt.date(2024, 1, d), float(d)) for d in (1, 2, 3, 4, 9)], "date date, value double")
    assert [r["mean"] for r in diel.rolling_mean(daily).orderBy("date").collect()] == [None, None, None, None, 3.8]
    boot = diel.rolling_bootstrap(daily).orderBy("date").collect()
    assert boot[3]["lo"] is None and boot[4]["lo"] <= 3.8 <= boot[4]["hi"]
    assert boot == diel.rolling_bootstrap(daily).orderBy("date").collect()


def test_hours_without_values_stay(spark):
    got = diel.hourly(obs(spark, [(1, 3, 2.0), (2, 3, 4.0), (2, 5, None)])).collect()
    assert len(got) == 24 and {r["hour_bin"]: r["mean"] for r in got}[3] == 3.0 and {r["hour_bin"]: r["count"] for r in got}[5] is None


def test_icc_against_its_definition(spark):
    rows = [(1, 0, 1.0), (1, 1, 2.0), (2, 0, 5.0), (2, 1, 7.0), (2, 2, 6.0), (3, 0, 2.0)]
    got = diel.icc(obs(spark, rows)).first()
    groups = {}
    for d, _, v in rows:
        groups.setdefault(d, []).append(v)
    n, g = len(rows), len(groups)
    grand = sum(v for _, _, v in rows) / n
    msb = sum(len(x) * (sum(x) / len(x) - grand) ** 2 for x in groups.values()) / (g - 1)
    msw = sum(sum((v - sum(x) / len(x)) ** 2 for v in x) for x in groups.values()) / (n - g)
    want = (msb - msw) / (msb + (n / g - 1) * msw)
    assert got["icc"] == pytest.approx(want)
    first = diel.reliability(diel.icc(obs(spark, rows))).orderBy("k").first()
    assert first["reliability"] == pytest.approx(want)
    assert diel.icc(obs(spark, rows[:2])).first()["icc"] is None
    assert diel.reliability(diel.icc(obs(spark, rows[:2]))).count() == 0


def test_index_without_day(spark):
    got = diel.diel_index(obs(spark, [(1, 3, 2.0), (2, 3, 4.0), (2, 10, 8.0), (3, 10, 0.0), (3, 1, 1.0)])).orderBy("date").collect()
    assert [r["diel_index"] for r in got] == [None, 0.5, None]


def test_day_and_night_bounds(spark):
    df = spark.createDataFrame([(h,) for h in range(24)], "h int")
    assert df.where(values.day_hour(F.col("h"), 6, 20)).count() == 14
    assert df.where(values.day_hour(F.col("h"), 20, 6)).count() == 14 and df.where(values.day_hour(F.col("h"), -3, 99)).count() == 24


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 100), st.floats(0, 1e6)), min_size=1, max_size=20))
def test_wilson_is_inside(spark, pairs):
    df = spark.createDataFrame([(p / 100 * max(1.0, n), n) for p, n in pairs], "s double, n double")
    for r in df.select(*[c.alias(k) for k, c in values.wilson(F.col("s"), F.col("n")).items()]).collect():
        assert 0 <= r["lo"] <= r["p_hat"] + 1e-9 and r["p_hat"] - 1e-9 <= r["hi"] <= 1


def test_date_range(spark):
    df = obs(spark, [(d, 0, 1.0) for d in range(1, 6)])
    assert diel.date_range(df, "20241002", "20241004").count() == 3 and diel.date_range(df, None, "20241001").count() == 1
    with pytest.raises(ValueError):
        diel.date_range(df, "2024-10-02")
    assert [text.date_range_caption(*x) for x in (("a", "b"), ("a", None), (None, "b"), (None, None))] == ["Date Range: a to b", "Date Range: a onwards", "Date Range: up to b", "Date Range: All dates"]


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1,234.5",), (" 7 ",), ("x",), ("NaN",), (None,)], "t string")
    assert [r["v"] for r in df.select(values.numeric(F.col("t"), commas=True).alias("v")).collect()] == [1234.5, 7.0, None, None, None]


def test_row_max_of_one_or_more_columns(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, None), (dt.date(2024, 1, 1), None, 3.0), (dt.date(2024, 1, 2), None, None)], "date date, a double, b double")
    assert [r["value"] for r in diel.daily_max(df, ["a", "b"]).collect()] == [3.0]
    assert [r["value"] for r in diel.daily_max(df, ["a"]).collect()] == [1.0]


def test_column_choice(spark):
    df = spark.createDataFrame([("1,0", 2.0)], "tail1_hz_mean string, `Average speed of MFC5(BL/s)` double")
    assert diel.auto_columns(df) == ["tail1_hz_mean", "Average speed of MFC5(BL/s)"]
    assert diel.wanted_columns(df, ["x", "tail1_hz_mean"]) == (["tail1_hz_mean"], ["x"])
    assert df.select(diel.primary_frequency(df).alias("v")).first()["v"] == 10.0
    with pytest.raises(ValueError):
        diel.primary_curvature(df)


def test_transitions_break_at_unknown_states(spark):
    df = spark.createDataFrame(list(enumerate(["Active", "Active", "Resting", None, "Active"])), "k int, state string")
    got = {(r["from_state"], r["to_state"]): (r["n"], r["pct"]) for r in activity.transitions(df, ["k"]).collect()}
    assert got[("Active", "Active")] == (1, 50.0) and got[("Active", "Resting")] == (1, 50.0)
    assert sum(n for n, _ in got.values()) == 2 and got[("Swimming", "Active")] == (0, 0.0)


def test_activity_columns_are_required(spark):
    with pytest.raises(ValueError):
        activity.prepare(spark.range(1))


def test_density_integrates_to_one(spark):
    df = spark.range(2000).select(((F.col("id") * 37 % 101) / 10).alias("x"))
    got = activity.density(df, "x").orderBy("x").collect()
    area = sum((b["x"] - a["x"]) * (a["density"] + b["density"]) / 2 for a, b in zip(got, got[1:], strict=False))
    assert 0.85 < area < 1.0 and len(got) == 300


def test_histogram_of_equal_values(spark):
    got = activity.histogram(spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double"), "x").orderBy("bin").collect()
    assert len(got) == 50 and got[0]["n"] == 2 and got[0]["density"] is None


def test_corrupted_by_any_prefix(spark):
    late = [("a", k, k == 9) for k in range(10)]
    early = [("b", k, k == 0) for k in range(100)]
    got = {r["v"]: r["failed"] for r in media.corrupted(spark.createDataFrame(late + early, "v string, k int, bad boolean"), "v", ["k"], "bad").collect()}
    assert got == {"a": False, "b": True}


def test_best_snapshot(spark):
    rows = [(100000, 5.10), (200000, 4.14), (700000, 3.79), (800000, 3.93), (900000, 3.79)]
    assert media.best_snapshot(spark.createDataFrame(rows, "iteration long, error double"), "error", "iteration").first()["iteration"] == 700000


def test_minutes_and_seconds(spark):
    df = spark.createDataFrame([(125.25,), (-1.0,), (None,), (float("inf"),)], "s double")
    assert [r["t"] for r in df.select(text.mmss(F.col("s")).alias("t")).collect()] == ["02:05.250", "00:00.000", None, None]
    assert math.isclose(values.per_chunk(7200, 1), 120)


def test_seconds_round_their_stored_value(spark):
    """As Python and C format them: the binary value, ties to even."""
    seconds = [0.0305, 0.0005, 0.0015, 0.0625, 0.1875, 59.9995, 59.9996, 75.0625, 119.9995, 711.5605, 6000.1235]
    got = spark.createDataFrame([(k, s) for k, s in enumerate(seconds)], "k long, s double").select("k", text.mmss(F.col("s")).alias("t")).orderBy("k").collect()
    assert [r["t"] for r in got] == [f"{int(s // 60):02d}:{s - s // 60 * 60:06.3f}" for s in seconds]
