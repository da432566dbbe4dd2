"""Windows, increments, summaries and integration on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from tidewake.config import WindowConfig
from tidewake.functions.values import steady_sum
from tidewake.operators import files, windows
from tidewake.plans.common import rounded, scaled_round

CFG = WindowConfig(frames=4)


def table(spark, values, cum=None, raw=None, name="T20241018_time_18_x"):
    cum = cum or [None] * len(values)
    raw = raw or [None] * len(values)
    return spark.createDataFrame([(name, k, v, c, r) for k, (v, c, r) in enumerate(zip(values, cum, raw, strict=True))], "file string, frame long, curvature_1_mm double, Tail1_cumulative_swim_count long, Tail1_swim_count long")


def test_tumbling_windows(spark):
    df = spark.range(450).select(F.lit("f").alias("file"), F.col("id").alias("frame"), F.lit(0.001).alias("curvature_1_mm"))
    got = windows.window_table(windows.prepare(df)).orderBy("window_idx").collect()
    assert [(r["start_frame"], r["end_frame"], r["mid_time_s"]) for r in got] == [(0, 200, 5.0), (200, 400, 15.0), (400, 450, 21.25)]


@pytest.mark.parametrize(("skipped", "has"), [(70, True), (71, False)])
def test_high_skip_gate(spark, skipped, has):
    df = table(spark, [None] * skipped + [0.001] * (100 - skipped), list(range(100)))
    got = windows.window_table(windows.prepare(df), WindowConfig(frames=100)).first()
    assert (got["tail1_hz"] is not None) == has and got["n_tails_used"] == int(has)


def test_adjacent_increments_lose_what_is_skipped(spark):
    df = table(spark, [0.1, 0.1, None, 0.1, 0.1], [0, 1, 2, 3, 4])
    assert [r["inc_Tail1"] for r in windows.prepare(df).orderBy("frame").collect()] == [0.0, 1.0, 0.0, 0.0, 1.0]


def test_series_choice(spark):
    raw = windows.prepare(table(spark, [0.1] * 6, [5, 4, 3, 2, 1, 0], [1, 0, 1, 1, 0, 1])).orderBy("frame")
    assert [r["inc_Tail1"] for r in raw.collect()] == [1.0, 0.0, 1.0, 1.0, 0.0, 1.0]
    constant = windows.looks_cumulative(table(spark, [0.1] * 6, [3] * 6), ["Tail1_cumulative_swim_count"]).first()
    short = windows.looks_cumulative(table(spark, [0.1] * 4, [1, 2, 3, 4]), ["Tail1_cumulative_swim_count"]).first()
    assert constant["Tail1_cumulative_swim_count_cumulative"] and not short["Tail1_cumulative_swim_count_cumulative"]


def test_standard_deviations_and_percentiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    got = df.agg(*[c.alias(k) for k, c in files.describe("x").items()], F.stddev_samp("x").alias("sample")).first()
    assert got["x_std"] == pytest.approx(1.247219128924647) and got["sample"] == pytest.approx(1.5275252316519468)
    assert (got["x_p10"], got["x_p90"], got["x_nonzero_ratio"]) == pytest.approx((1.2, 3.6, 1.0))


def test_weighted_mean_counts_rows_not_values(spark):
    df = spark.createDataFrame([(1.0, 10), (3.0, 30), (None, 100)], "x_mean double, frames_non_skipped_window long")
    got = df.agg(*[c.alias(k) for k, c in files.weighted("x_mean").items()]).first()
    assert (got["mean"], got["median"], got["n_valid"]) == (2.5, 2.0, 2) and got["valid_ratio"] == pytest.approx(2 / 3)


def test_first_of_equal_maxima(spark):
    df = spark.createDataFrame([("f", 0, None), ("f", 1, 2.0), ("f", 2, 5.0), ("f", 3, 5.0)], "file string, frame long, curvature_1_mm double")
    got = files.curvature_peaks(df).first()
    assert (got["max_curvature_frame_idx"], got["max_curvature_timestamp_mmss"]) == (2, "00:00.100")
    none = files.curvature_peaks(df.where("frame = 0")).first()
    assert none["max_curvature_frame_idx"] is None and none["max_curvature_timestamp_mmss"] is None


def test_means_over_columns_add_in_their_order(spark):
    """Equal rates of other tails give other last bits, and so another window of the largest mean."""
    rates = [(0.3, 0.2, 0.1), (0.1, 0.2, 0.3), (0.2, 0.3, 0.1), (0.7, 0.1, 0.3), (0.1, 0.3, 0.7)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rates)], "k long, a double, b double, c double")
    got = df.select("k", windows.horizontal([F.col("a"), F.col("b"), F.lit(None).cast("double"), F.col("c")])["mean"].alias("mean")).orderBy("k").collect()
    assert [r["mean"] for r in got] == [(a + b + c) / 3 for a, b, c in rates]


def test_sums_of_a_file_do_not_drift(spark):
    """2,000 windows of one value each: the running sum of doubles is off by more than the ninth decimal."""
    df = spark.range(2000).coalesce(1).select(F.lit("T20241018_time_18_x").alias("file"), F.col("id").alias("frame"), F.lit(0.001).alias("curvature_1_mm"), F.lit(121.3).alias("MFC5_frame_dist_mm"))
    got = files.file_summary(windows.window_table(windows.prepare(df), WindowConfig(frames=1))).first()
    assert got["n_windows"] == 2000 and abs(got["file_sum_MFC5_frame_dist_mm"] - 242600) < 1e-10


def test_steady_sums_take_any_double(spark):
    groups = {"none": [None, None], "inf": [1.0, math.inf], "nan": [1.0, math.nan], "huge": [1e300, 1.0, None], "small": [1e-300, 2e-300], "mixed": [-0.1, 2.0**43, 0.1, 1e-9]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r["g"]: r["s"] for r in df.groupBy("g").agg(steady_sum(F.col("v")).alias("s")).collect()}
    assert math.isnan(got.pop("nan")) and got == {"none": None, "inf": math.inf, "huge": 1e300, "small": pytest.approx(3e-300), "mixed": pytest.approx(2.0**43)}


def test_rounding_is_that_of_the_sql(spark, duck):
    """Products with a power of ten that come out as halves, and what has no finite product."""
    own = [1048.9791577185, 1092.1438727715, 826.4436496984999, 80.39088161949999, 777.1908882814998, -80.39088161949999, 0.0009765625, 1e300, 12345678.123456789, -0.0, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(own)], "k long, v double")
    got = [r["v"] for r in rounded(df, 9, scaled_round).orderBy("k").collect()]
    assert got == [duck.execute("SELECT round(?::DOUBLE, 9) + 0.0", [v]).fetchone()[0] for v in own]


def test_bending_counts_by_their_own_definition(spark):
    df = spark.createDataFrame([("Extreme", False), ("Invalid", False), (None, False), ("Normal", True)], "curvature_1_class string, skip boolean")
    got = windows.bending_counts(df).first().asDict()
    assert got.pop("known") and got == {"considered": 3, "valid": 2, "invalid": 1, "minimal": 0, "normal": 0, "extreme": 1}


def test_integration_of_several_files(spark):
    df = table(spark, [0.1] * 6, list(range(6))).union(table(spark, [0.2, None, 0.2, 0.2, 0.2], [0, 0, 1, 1, 2], name="T20241019_time_3_x"))
    frames = windows.prepare(df.withColumn("curvature_1_class", F.lit("Extreme")))
    win = windows.window_table(frames, CFG)
    got = files.integrate(win, windows.bending_counts(frames, ["file"])).orderBy("section_order").collect()
    assert [r["section"] for r in got] == ["global_frequency", "global_curvature", "global_bending_distribution"]
    assert got[0]["total_windows"] == 4 and got[0]["total_frames_est"] == 11 and got[2]["curvature_1_extreme_percentage"] == 100.0
    own = files.file_summary(win, CFG, windows.bending_counts(frames, ["file"])).orderBy("file").collect()
    assert [r["Datetime"] for r in own] == ["20241018_time_18", "20241019_time_3"] and own[0]["n_frames"] == 6


def test_tables_without_signals(spark):
    df = spark.createDataFrame([("f", 0, 1.0)], "file string, frame long, other double")
    assert not windows.usable(df) and windows.reference_curvature(df) is None
    assert windows.window_table(windows.prepare(df), CFG).first()["tail1_hz"] is None


def test_a_table_without_classes_has_no_shares(spark):
    df = windows.prepare(table(spark, [0.1, None, 0.1])).drop("curvature_1_class")
    got = windows.bending_shares(windows.bending_counts(df, ["file"])).first()
    assert got["curvature_1_invalid_percentage"] is None and (got["bending_total_valid_frames"], got["bending_total_considered_frames"]) == (0, 2)
    assert files.bending_section(windows.bending_counts(df, ["file"])).first()["curvature_1_invalid_percentage"] == 100.0


def test_windows_keep_their_source(spark):
    df = table(spark, [0.1] * 5).withColumn("source_path", F.lit("/data/a.csv"))
    assert {r["source_path"] for r in windows.window_table(windows.prepare(df), CFG).collect()} == {"/data/a.csv"}
