"""Queries of windows, file summaries and their integration, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.config import WindowConfig
from tidewake.operators import files, partials, rounding, windows
from tidewake.plans.common import TRACK, WINDOW, rounded, scaled_round, sql_rounded, table, tracking
from tidewake.shared import Scratch

CFG = WindowConfig(frames=WINDOW)


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return windows.prepare(tracking(spark, d))


def increments(spark: SparkSession, d: str) -> DataFrame:
    got = _prepared(spark, d)
    return rounded(got.select("file", "frame", "skip", "inc_Tail1", "inc_Tail2", "inc_Tail3", "inc_Tail4"))


def cumulative_series(spark: SparkSession, d: str) -> DataFrame:
    return windows.looks_cumulative(tracking(spark, d), ["Tail1_cumulative_swim_count", "Tail2_swim_count", "Tail3_swim_count"])


def window_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.window_table(_prepared(spark, d), CFG), 9)


def rounded_window_table(spark: SparkSession, d: str) -> DataFrame:
    """A few columns of each rounding rule."""
    got = rounding.round_table(windows.window_table(_prepared(spark, d), CFG))
    return got.select("file", "window_idx", "curvature_1_mm_mean", "curvature_1_mm_n", "tail1_hz", "skipped_rate_window_pct", "mid_time_s", "sum_MFC5_frame_dist_mm", "body_length_mm_mean", "fps")


def file_summary(spark: SparkSession, d: str) -> DataFrame:
    frames = _prepared(spark, d)
    got = files.file_summary(windows.window_table(frames, CFG), CFG, windows.bending_counts(frames, ["file"]), files.curvature_peaks(frames, CFG))
    return rounded(got, 9, scaled_round)


def bending_by_file(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.bending_shares(windows.bending_counts(_prepared(spark, d), ["file"])))


def integrated(spark: SparkSession, d: str) -> DataFrame:
    """The four sections over rounded windows and additive counts of all files."""
    frames = _prepared(spark, d)
    win = rounding.round_table(windows.window_table(frames, CFG))
    return rounded(files.integrate(win, windows.bending_counts(frames, ["file"])), 4)


def integrated_by_partials(spark: SparkSession, d: str) -> DataFrame:
    """The same from partial summaries, as if the files had come in two lots."""
    frames = _prepared(spark, d)
    win, counts = rounding.round_table(windows.window_table(frames, CFG)), windows.bending_counts(frames, ["file"])
    path = Scratch(spark, "partials").path("added")
    for lot in range(2):
        own = F.pmod(F.xxhash64("file"), F.lit(2)) == lot
        partials.add(spark, path, win.where(own), counts.where(own), ["file"])
    return rounded(partials.totals(spark, path), 4)


def root_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The four sections of each session and of all."""
    frames = _prepared(spark, d)
    root = F.concat(F.lit("session"), F.regexp_extract("file", r"_time_(\d+)_", 1))
    win = rounding.round_table(windows.window_table(frames, CFG)).withColumn("root", root)
    return rounded(files.integrate(win, windows.bending_counts(frames, ["file"]).withColumn("root", root), [["root"], []]), 4)


def order_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Six figures by priority and in total."""
    return rounded(windows.six_of_groups(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"], [["o_orderpriority"], []]), 2)


def arg_max_part(spark: SparkSession, d: str) -> DataFrame:
    """The dearest part of each brand, the first of equals."""
    top = files.first_max(F.col("p_retailprice"), F.col("p_partkey"), F.col("p_partkey"), F.col("p_name"), F.col("p_retailprice"))
    return rounded(table(spark, d, "part").groupBy("p_brand").agg(top.alias("t")).select("p_brand", "t.p_partkey", "t.p_name", "t.p_retailprice"))


def describe_prices(spark: SparkSession, d: str) -> DataFrame:
    """Eight figures of line prices by return flag."""
    return rounded(files.describe_groups(table(spark, d, "lineitem"), ["l_extendedprice"], ["l_returnflag"]), 3)


def horizontal_stats(spark: SparkSession, d: str) -> DataFrame:
    """Figures over four columns of a row, gaps left out."""
    li = table(spark, d, "lineitem")
    q, t, s = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    cols = windows.horizontal([F.when(q > 25, q), t, s, F.when(q < 10, q * 2)])
    return rounded(li.select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(k) for k, c in cols.items()]))


def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 200 frames over all events, the last one short."""
    ev = table(spark, d, "events").select("event_id", "value")
    idx = windows.window_index(F.col("event_id"))
    return rounded(ev.groupBy(idx.alias("window_idx")).agg(F.min("event_id").alias("start_frame"), (F.max("event_id") + 1).alias("end_frame"), *windows.six_stats("value", F.col("value") >= 5)))


def _six(c: str, name: str, keep: str = "NOT skip") -> str:
    f = f"FILTER (WHERE {keep})"
    return f"avg({c}) {f} AS {name}_mean, median({c}) {f} AS {name}_median, stddev_pop({c}) {f} AS {name}_std, min({c}) {f} AS {name}_min, max({c}) {f} AS {name}_max, count({c}) {f} AS {name}_n"


_SERIES = ("curvature_1_mm", "curvature_1_radius_mm", "body_length_mm")
_SUMS = {"MFC5_frame_dist_mm": "dist", "Tail1_travel_distance_mm": "travel", "Tail1_swim_count": "raw1", "Tail2_swim_count": "raw2", "Tail3_swim_count": "raw3"}
_WIN = TRACK + f""", w0 AS (SELECT file, window_idx, count(*) AS frames_in_window, count(*) FILTER (WHERE NOT skip) AS frames_non_skipped_window,
    coalesce(sum(inc1) FILTER (WHERE NOT skip), 0) AS s1, coalesce(sum(inc2) FILTER (WHERE NOT skip), 0) AS s2, coalesce(sum(inc3) FILTER (WHERE NOT skip), 0) AS s3,
    {", ".join(_six(c, c) for c in _SERIES)}, {", ".join(f'coalesce(sum({v}) FILTER (WHERE NOT skip), 0.0) AS "sum_{k}"' for k, v in _SUMS.items())}
  FROM inc GROUP BY file, window_idx),
w1 AS (SELECT *, 20.0::DOUBLE AS fps, 1.0::DOUBLE AS window_seconds, window_idx * 20 AS start_frame, window_idx * 20 + frames_in_window AS end_frame,
    window_idx * 20 / 20.0::DOUBLE AS start_time_s, (window_idx * 20 + frames_in_window) / 20.0::DOUBLE AS end_time_s, (window_idx * 20 + frames_in_window / 2.0::DOUBLE) / 20 AS mid_time_s, frames_in_window / 20.0::DOUBLE AS duration_s,
    frames_in_window - frames_non_skipped_window AS frames_skipped_window, (frames_in_window - frames_non_skipped_window) * 100.0::DOUBLE / frames_in_window AS skipped_rate_window_pct,
    sum(frames_in_window - frames_non_skipped_window) OVER f AS file_skipped_frames, sum(frames_in_window - frames_non_skipped_window) OVER f * 100.0::DOUBLE / sum(frames_in_window) OVER f AS file_skipped_rate_pct,
    CASE WHEN (frames_in_window - frames_non_skipped_window) / frames_in_window::DOUBLE <= 0.7 THEN greatest(1e-9, frames_non_skipped_window / 20.0::DOUBLE) END AS sec FROM w0 WINDOW f AS (PARTITION BY file)),
w2 AS (SELECT *, CASE WHEN sec IS NOT NULL THEN s1 END AS tail1_count, CASE WHEN sec IS NOT NULL THEN s2 END AS tail2_count, CASE WHEN sec IS NOT NULL THEN s3 END AS tail3_count, NULL::DOUBLE AS tail4_count,
    s1 / 2 / sec AS tail1_hz, s2 / 2 / sec AS tail2_hz, s3 / 2 / sec AS tail3_hz, NULL::DOUBLE AS tail4_hz FROM w1),
w AS (SELECT * EXCLUDE (s1, s2, s3, sec, file_skipped_frames), file_skipped_frames::BIGINT AS file_skipped_frames, (tail1_hz + tail2_hz + tail3_hz) / 3 AS freq_mean_hz, CASE WHEN sec IS NOT NULL THEN list_median([tail1_hz, tail2_hz, tail3_hz]) END AS freq_median_hz,
    CASE WHEN sec IS NOT NULL THEN least(tail1_hz, tail2_hz, tail3_hz) END AS freq_min_hz, CASE WHEN sec IS NOT NULL THEN greatest(tail1_hz, tail2_hz, tail3_hz) END AS freq_max_hz, CASE WHEN sec IS NOT NULL THEN 3 ELSE 0 END::BIGINT AS n_tails_used FROM w2)"""
_RATES = ("tail1_hz", "tail2_hz", "tail3_hz", "tail4_hz", "freq_mean_hz")
_WIN_DOUBLES = [f"{c}_{s}" for c in _SERIES for s in ("mean", "median", "std", "min", "max")] + [f"sum_{c}" for c in _SUMS] + "fps window_seconds start_time_s end_time_s mid_time_s duration_s skipped_rate_window_pct file_skipped_rate_pct".split() + [f"tail{k}_{m}" for k in range(1, 5) for m in ("count", "hz")] + [f"freq_{s}_hz" for s in ("mean", "median", "min", "max")]


def _eight(c: str) -> str:
    return f"avg({c}) AS {c}_mean, median({c}) AS {c}_median, stddev_pop({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max, quantile_cont({c}, 0.1) AS {c}_p10, quantile_cont({c}, 0.9) AS {c}_p90, avg(CASE WHEN {c} > 0 THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END::DOUBLE) AS {c}_nonzero_ratio"


_EIGHT = [f"{c}_{s}" for c in _RATES for s in ("mean", "median", "std", "min", "max", "p10", "p90", "nonzero_ratio")]
_SHARE = ", ".join(f"CASE WHEN coalesce(tail1_hz_mean, 0) + coalesce(tail2_hz_mean, 0) + coalesce(tail3_hz_mean, 0) > 0 THEN tail{k}_hz_mean / (tail1_hz_mean + tail2_hz_mean + tail3_hz_mean) * 100 END AS tail{k}_freq_pct" for k in range(1, 5))
_BEND = "count(*) FILTER (WHERE NOT skip) AS considered, count(curvature_1_class) FILTER (WHERE NOT skip) AS valid, count(*) FILTER (WHERE NOT skip AND curvature_1_class IS NULL) AS invalid, " + ", ".join(f"count(*) FILTER (WHERE NOT skip AND lower(curvature_1_class) = '{k}') AS {k}" for k in ("minimal", "normal", "extreme"))
_BENT = ", ".join(f"CASE WHEN considered > 0 THEN {k} * 100.0::DOUBLE / considered END AS curvature_1_{k}_percentage" for k in ("minimal", "normal", "extreme", "invalid")) + ", valid AS bending_total_valid_frames, considered AS bending_total_considered_frames"
_BENT_DOUBLES = [f"curvature_1_{k}_percentage" for k in ("minimal", "normal", "extreme", "invalid")]


def _weighted(c: str, out: str, ending: str = "_all") -> str:
    w = "frames_non_skipped_window"
    mean = f"CASE WHEN count({c}) > 0 AND sum({w}) > 0 THEN sum({c} * {w}) / greatest(1.0, sum(CASE WHEN {c} IS NOT NULL THEN {w} END)) END"
    return f"{mean} AS {out}mean{ending}, median({c}) AS {out}median{ending}, stddev_pop({c}) AS {out}std{ending}, min({c}) AS {out}min{ending}, max({c}) AS {out}max{ending}, avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE) AS {out}valid_ratio"


_MMSS = "CASE WHEN {0} IS NOT NULL THEN printf('%02d:%06.3f', floor({0} / 60)::BIGINT, {0} - floor({0} / 60) * 60) END"
_FILE = _WIN + f""", f0 AS (SELECT file, first(fps) AS fps, first(window_seconds) AS window_seconds, count(*) AS n_windows, sum(frames_in_window)::BIGINT AS n_frames, sum(frames_skipped_window)::BIGINT AS skipped_frames,
    {", ".join(_eight(c) for c in _RATES)}, {", ".join(_weighted(c + "_mean", c + "_") for c in _SERIES)}, {", ".join(f'sum("sum_{c}") AS "file_sum_{c}"' for c in _SUMS)},
    first(window_idx ORDER BY freq_mean_hz DESC NULLS LAST, window_idx) AS top, max(freq_mean_hz) AS top_hz FROM w GROUP BY file),
bend AS (SELECT file, {_BENT} FROM (SELECT file, {_BEND} FROM inc GROUP BY file)),
peak AS (SELECT file, max(curvature_1_mm) AS max_curvature_value_mm, first(frame ORDER BY curvature_1_mm DESC NULLS LAST, frame) AS pf FROM inc GROUP BY file)"""
_STEM = "regexp_extract(f0.file, '(T[0-9]{8}_time_[0-9]+)', 1) || '_' || substr(f0.file, instr(lower(f0.file), 'tracking_analysis'))"
_FILE_BODY = f"""SELECT {_STEM} AS file, f0.* EXCLUDE (file, top, top_hz), regexp_extract(f0.file, 'T([0-9]{{8}}_time_[0-9]+)', 1) AS "Datetime", skipped_frames * 100.0::DOUBLE / n_frames AS skipped_rate_pct, {_SHARE},
    CASE WHEN n_frames > skipped_frames THEN "file_sum_MFC5_frame_dist_mm" / ((n_frames - skipped_frames) / 20.0::DOUBLE) / 490 END AS "Average speed of MFC5(BL/s)",
    CASE WHEN n_frames > skipped_frames THEN "file_sum_Tail1_travel_distance_mm" / ((n_frames - skipped_frames) / 20.0::DOUBLE) / 490 END AS "Average speed(reference line) of Tail1(BL/s)",
    CASE WHEN top_hz IS NOT NULL THEN w.window_idx END AS max_freq_window_idx, top_hz AS max_freq_hz, CASE WHEN top_hz IS NOT NULL THEN w.start_frame END AS max_freq_start_frame, CASE WHEN top_hz IS NOT NULL THEN w.end_frame END AS max_freq_end_frame,
    CASE WHEN top_hz IS NOT NULL THEN w.mid_time_s END AS max_freq_timestamp_s, CASE WHEN top_hz IS NOT NULL THEN {_MMSS.format("w.mid_time_s")} END AS max_freq_timestamp_mmss, bend.* EXCLUDE (file),
    'curvature_1_mm' AS max_curvature_column, max_curvature_value_mm, CASE WHEN max_curvature_value_mm IS NOT NULL THEN pf END AS max_curvature_frame_idx, CASE WHEN max_curvature_value_mm IS NOT NULL THEN pf / 20.0::DOUBLE END AS max_curvature_timestamp_s,
    CASE WHEN max_curvature_value_mm IS NOT NULL THEN {_MMSS.format("(pf / 20.0::DOUBLE)")} END AS max_curvature_timestamp_mmss
  FROM f0 JOIN w ON w.file = f0.file AND w.window_idx = f0.top JOIN bend ON bend.file = f0.file JOIN peak ON peak.file = f0.file"""
_FILE_DOUBLES = ["fps", "window_seconds", *_EIGHT, *[f"{c}_{s}_all" for c in _SERIES for s in ("mean", "median", "std", "min", "max")], *[f"{c}_valid_ratio" for c in _SERIES], *[f"file_sum_{c}" for c in _SUMS], "skipped_rate_pct", *[f"tail{k}_freq_pct" for k in range(1, 5)], "Average speed of MFC5(BL/s)", "Average speed(reference line) of Tail1(BL/s)", "max_freq_hz", "max_freq_timestamp_s", *_BENT_DOUBLES, "max_curvature_value_mm", "max_curvature_timestamp_s"]
_FREQ = f"count(*) AS total_windows, sum(frames_in_window)::BIGINT AS total_frames_est, sum(frames_skipped_window)::BIGINT AS total_skipped_frames, sum(frames_skipped_window) * 100.0::DOUBLE / sum(frames_in_window) AS total_skipped_rate_pct, {', '.join(_eight(c) for c in _RATES)}"
_ROUNDED = _WIN + ", rw AS (SELECT * REPLACE (" + ", ".join(
    [f"round_even({c}_{s}, {5 if c == 'curvature_1_mm' else 3}) AS {c}_{s}" for c in _SERIES for s in ("mean", "median", "std", "min", "max")]
    + [f"round_even({c}, 2) AS {c}" for c in _RATES]
) + ") FROM w)"
_SECTION_DOUBLES = ["total_skipped_rate_pct", *_EIGHT, *[f"tail{k}_freq_pct" for k in range(1, 5)], "mean", "median", "std", "min", "max", "valid_ratio", *_BENT_DOUBLES]


def _sections(group: str = "") -> str:
    """The four sections, over all rows or by each root and over all."""
    by, sets = ("root, ", " GROUP BY GROUPING SETS ((root), ())") if group else ("", "")
    return f"""SELECT 'global_frequency' AS section, 'O' AS variant, *, {_SHARE}, 0 AS section_order FROM (SELECT {by}{_FREQ} FROM rw{sets})
  UNION ALL BY NAME SELECT 'global_curvature' AS section, 'O' AS variant, {by}'curvature_1' AS curvature, {_weighted("curvature_1_mm_mean", "", "")}, count(curvature_1_mm_mean) AS n_valid, 1 AS section_order FROM rw{sets}
  UNION ALL BY NAME SELECT 'global_series' AS section, 'O' AS variant, {by}'curvature_1_radius_mm' AS series, {_weighted("curvature_1_radius_mm_mean", "", "")}, count(curvature_1_radius_mm_mean) AS n_valid, 2 AS section_order FROM rw{sets}
  UNION ALL BY NAME SELECT 'global_series' AS section, 'O' AS variant, {by}'body_length_mm' AS series, {_weighted("body_length_mm_mean", "", "")}, count(body_length_mm_mean) AS n_valid, 2 AS section_order FROM rw{sets}
  UNION ALL BY NAME SELECT 'global_bending_distribution' AS section, 'O' AS variant, {by}{_BENT}, 3 AS section_order FROM (SELECT {by}{_BEND} FROM ri{sets})"""


_ROOT = "'session' || regexp_extract(file, '_time_([0-9]+)_', 1) AS root"
_BY_ROOT = _ROUNDED.replace("rw AS (SELECT *", f"ri AS (SELECT *, {_ROOT} FROM inc), rw AS (SELECT {_ROOT}, *")

QUERIES = {
    "window_increments": increments, "window_cumulative_series": cumulative_series, "window_table": window_table, "window_table_rounded": rounded_window_table, "window_tumbling": tumbling_windows,
    "file_summary": file_summary, "file_bending": bending_by_file, "integrated_sections": integrated, "integrated_by_partials": integrated_by_partials, "integrated_root_rollup": root_rollup, "order_rollup": order_rollup,
    "arg_max_part": arg_max_part, "describe_prices": describe_prices, "horizontal_stats": horizontal_stats,
}

ORACLES = {
    "window_increments": sql_rounded("inc_Tail1 inc_Tail2 inc_Tail3 inc_Tail4", 'SELECT file, frame, skip, inc1 AS "inc_Tail1", inc2 AS "inc_Tail2", inc3 AS "inc_Tail3", NULL::DOUBLE AS "inc_Tail4" FROM inc', TRACK),
    "window_cumulative_series": TRACK + ' SELECT file, g1 AS "Tail1_cumulative_swim_count_cumulative", g2 AS "Tail2_swim_count_cumulative", g3 AS "Tail3_swim_count_cumulative" FROM grows',
    "window_table": sql_rounded(_WIN_DOUBLES, "SELECT * FROM w", _WIN, 9),
    "window_table_rounded": _WIN + ' SELECT file, window_idx, round_even(curvature_1_mm_mean, 5) AS curvature_1_mm_mean, curvature_1_mm_n, round_even(tail1_hz, 2) AS tail1_hz, round_even(skipped_rate_window_pct, 2) AS skipped_rate_window_pct, round_even(mid_time_s, 3) AS mid_time_s, round_even("sum_MFC5_frame_dist_mm", 2) AS "sum_MFC5_frame_dist_mm", round_even(body_length_mm_mean, 3) AS body_length_mm_mean, fps FROM w',
    "window_tumbling": sql_rounded("value_mean value_median value_std value_min value_max", f"SELECT floor(event_id / 200)::BIGINT AS window_idx, min(event_id) AS start_frame, max(event_id) + 1 AS end_frame, {_six('value', 'value', 'value >= 5')} FROM events GROUP BY 1"),
    "file_summary": sql_rounded(_FILE_DOUBLES, _FILE_BODY, _FILE, 9),
    "file_bending": sql_rounded(_BENT_DOUBLES, f"SELECT file, {_BENT} FROM (SELECT file, {_BEND} FROM inc GROUP BY file)", TRACK),
    "integrated_sections": sql_rounded(_SECTION_DOUBLES, _sections(), _ROUNDED + ", ri AS (SELECT * FROM inc)", 4),
    "integrated_root_rollup": sql_rounded(_SECTION_DOUBLES, _sections("root"), _BY_ROOT, 4),
    "order_rollup": sql_rounded("o_totalprice_mean o_totalprice_median o_totalprice_std o_totalprice_min o_totalprice_max", f"SELECT o_orderpriority, {_six('o_totalprice', 'o_totalprice', 'true')} FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())", digits=2),
    "arg_max_part": sql_rounded("p_retailprice", "SELECT p_brand, p_partkey, p_name, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1"),
    "describe_prices": sql_rounded([f"l_extendedprice_{s}" for s in ("mean", "median", "std", "min", "max", "p10", "p90", "nonzero_ratio")], f"SELECT l_returnflag, {_eight('l_extendedprice')} FROM lineitem GROUP BY 1", digits=3),
    "horizontal_stats": sql_rounded("mean median min max", "SELECT l_orderkey, l_linenumber, l_partkey, list_avg(v) AS mean, list_median(v) AS median, list_min(v) AS min, list_max(v) AS max, len(v)::INTEGER AS n FROM (SELECT *, list_filter([CASE WHEN l_quantity > 25 THEN l_quantity END, l_tax, l_discount, CASE WHEN l_quantity < 10 THEN l_quantity * 2 END], lambda x: x IS NOT NULL) AS v FROM lineitem)"),
}
ORACLES["integrated_by_partials"] = ORACLES["integrated_sections"]
