"""Queries of the diel family and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.values import numeric, period
from tidewake.operators import diel
from tidewake.plans.common import OBS, observations, rounded, sql_rounded, table

_DAY = "CASE WHEN hour_bin >= 6 AND hour_bin < 20 THEN 'Day' ELSE 'Night' END"
_STATS = "avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, min(value) AS min, max(value) AS max, count(value) AS count"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.hourly(observations(spark, d)))


def hourly_partial(spark: SparkSession, d: str) -> DataFrame:
    """Only large values of three hours: most hours are missing."""
    return rounded(diel.hourly(observations(spark, d).where("value > 200 and hour_bin in (3, 4, 17)")))


def combined_hourly(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("click", "error", "view")
    wide = observations(spark, d).select("hour_bin", *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in kinds])
    return rounded(diel.combined_hourly(wide, list(kinds)))


def day_night(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.day_night(observations(spark, d)))


def date_hour_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.date_hour_pivot(observations(spark, d)))


def date_hour_pivot_max(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.date_hour_pivot(observations(spark, d), how="max"))


def bubble_raster(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.bubble_raster(observations(spark, d)))


def daily_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.daily_mean(observations(spark, d)))


def daily_row_max(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    return rounded(diel.daily_max(li, ["l_quantity", "l_tax", "l_discount"]))


def icc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.icc(observations(spark, d)))


def reliability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.reliability(diel.icc(observations(spark, d))))


def diel_index(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.diel_index(observations(spark, d)))


def weekly_extreme(spark: SparkSession, d: str) -> DataFrame:
    """Share of error events by week, from daily percentages and counts."""
    day = observations(spark, d).groupBy("date").agg((F.count_if(F.col("event_type") == "error") * 100.0 / F.count("*")).alias("pct"), F.count("*").alias("frames"))
    return rounded(diel.weekly_extreme(day, "pct", "frames"))


def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.rolling_mean(diel.daily_mean(observations(spark, d))))


def rolling_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.rolling_bootstrap(diel.daily_mean(observations(spark, d))))


def cumulative_max(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.cumulative_max(diel.daily_max(observations(spark, d), ["value"])))


def annotation_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.annotation_means(observations(spark, d)))


def date_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diel.daily_mean(diel.date_range(observations(spark, d), "20240105", "20240120")))


def distinct_days(spark: SparkSession, d: str) -> DataFrame:
    return diel.distinct_days(observations(spark, d))


def keyed_hours(spark: SparkSession, d: str) -> DataFrame:
    """Keys ``YYYYMMDD_time_H`` with codes beyond 24, unreadable ones, and numbers with separators."""
    ev = table(spark, d, "events")
    key = F.when(F.col("event_id") % 11 == 0, "broken").otherwise(F.format_string("%s_time_%d", F.date_format("ts", "yyyyMMdd"), F.hour("ts") + F.col("event_id") % 4))
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.format_number(F.col("value") * 1000, 2)))
    obs = diel.parse_keys(ev.select("event_id", key.alias("Datetime"), text.alias("t"))).withColumn("value", numeric(F.col("t"), commas=True))
    return rounded(obs.select("event_id", "date", "hour_code", "hour_bin", "xcenter", "value", period(F.col("hour_bin"), 6, 20).alias("period")))


def primary_series(spark: SparkSession, d: str) -> DataFrame:
    """Row means of tail columns with gaps, then daily means."""
    v = F.col("value")
    wide = observations(spark, d).select("date", v.alias("tail1_hz_mean"), F.when(v > 50, v * 2).alias("tail2_hz_mean"), F.when(v > 400, v).alias("tail3_hz_mean"))
    return rounded(diel.daily_mean(wide.select("date", diel.primary_frequency(wide).alias("value"))))


_DAILY = OBS + ", y AS (SELECT date, avg(value) AS value FROM o WHERE value IS NOT NULL GROUP BY date)"
_ICC = OBS + """, g AS (SELECT date, count(value) AS n, avg(value) AS m FROM o WHERE value IS NOT NULL GROUP BY date),
a AS (SELECT count(*) AS g, sum(n)::BIGINT AS n, avg(n) AS k, sum(n * m) / sum(n) AS grand FROM g),
w AS (SELECT sum((o.value - g.m) * (o.value - g.m)) AS ssw FROM o JOIN g USING (date)),
b AS (SELECT sum(g.n * (g.m - a.grand) * (g.m - a.grand)) AS ssb FROM g, a),
i AS (SELECT ssb / (g - 1) AS ms_between, ssw / (n - g) AS ms_within, k AS k_bar, g, n FROM a, w, b)"""
_PIVOT = ", ".join("{0}(value) FILTER (WHERE hour_bin = %d) AS h%d" % (h, h) for h in range(24))
_H = " ".join(f"h{h}" for h in range(24))

QUERIES = {
    "diel_hourly": hourly, "diel_hourly_partial": hourly_partial, "diel_combined_hourly": combined_hourly, "diel_day_night": day_night,
    "diel_date_hour_pivot": date_hour_pivot, "diel_date_hour_pivot_max": date_hour_pivot_max, "diel_bubble_raster": bubble_raster,
    "diel_daily_mean": daily_mean, "diel_daily_row_max": daily_row_max, "diel_icc": icc, "diel_reliability": reliability, "diel_index": diel_index,
    "diel_weekly_extreme": weekly_extreme, "diel_rolling_mean": rolling_mean, "diel_rolling_bootstrap": rolling_bootstrap, "diel_cumulative_max": cumulative_max,
    "diel_annotation_means": annotation_means, "diel_date_range": date_range, "diel_distinct_days": distinct_days, "diel_keyed_hours": keyed_hours,
    "diel_primary_series": primary_series,
}

ORACLES = {
    "diel_hourly": sql_rounded("mean std", "SELECT s.hour_bin, mean, std, count FROM (SELECT range::INTEGER AS hour_bin FROM range(24)) s LEFT JOIN (SELECT hour_bin, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS count FROM o GROUP BY hour_bin) a USING (hour_bin)", OBS),
    "diel_hourly_partial": sql_rounded("mean std", "SELECT s.hour_bin, mean, std, count FROM (SELECT range::INTEGER AS hour_bin FROM range(24)) s LEFT JOIN (SELECT hour_bin, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS count FROM o WHERE value > 200 AND hour_bin IN (3, 4, 17) GROUP BY hour_bin) a USING (hour_bin)", OBS),
    "diel_combined_hourly": sql_rounded("click error view", "SELECT s.hour_bin, click, error, view FROM (SELECT range::INTEGER AS hour_bin FROM range(24)) s LEFT JOIN (SELECT hour_bin, avg(value) FILTER (WHERE event_type = 'click') AS click, avg(value) FILTER (WHERE event_type = 'error') AS error, avg(value) FILTER (WHERE event_type = 'view') AS view FROM o GROUP BY hour_bin) a USING (hour_bin)", OBS),
    "diel_day_night": sql_rounded("mean median std iqr min max", f"SELECT date, period, {_STATS} FROM (SELECT *, {_DAY} AS period FROM o) GROUP BY GROUPING SETS ((date, period), (period))", OBS),
    "diel_date_hour_pivot": sql_rounded(_H, f"SELECT date, {_PIVOT.format('avg')} FROM o GROUP BY date", OBS),
    "diel_date_hour_pivot_max": sql_rounded(_H, f"SELECT date, {_PIVOT.format('max')} FROM o GROUP BY date", OBS),
    "diel_bubble_raster": sql_rounded("value area", "SELECT date, hour_bin, value, CASE WHEN value IS NULL THEN NULL WHEN hi = lo THEN 368.0 ELSE 16 + (value - lo) / (hi - lo) * 704 END AS area FROM (SELECT d.date, h.hour_bin, c.value FROM (SELECT DISTINCT date FROM c) d CROSS JOIN (SELECT range::INTEGER AS hour_bin FROM range(24)) h LEFT JOIN c ON c.date = d.date AND c.hour_bin = h.hour_bin), (SELECT min(value) AS lo, max(value) AS hi FROM c)", OBS + ", c AS (SELECT date, hour_bin, avg(value) AS value FROM o GROUP BY date, hour_bin)"),
    "diel_daily_mean": sql_rounded("value", "SELECT * FROM y", _DAILY),
    "diel_daily_row_max": sql_rounded("value", "SELECT CAST(l_shipdate AS DATE) AS date, max(greatest(l_quantity, l_tax, l_discount)) AS value FROM lineitem GROUP BY 1"),
    "diel_icc": sql_rounded("icc ms_between ms_within k_bar", "SELECT (ms_between - ms_within) / (ms_between + (k_bar - 1) * ms_within) AS icc, * FROM i", _ICC),
    "diel_reliability": sql_rounded("reliability icc", "SELECT k, k * icc / (1 + (k - 1) * icc) AS reliability, icc, g AS n_days FROM (SELECT (ms_between - ms_within) / (ms_between + (k_bar - 1) * ms_within) AS icc, g, unnest(generate_series(1, g)) AS k FROM i)", _ICC),
    "diel_index": sql_rounded("day_mean night_mean diel_index", f"SELECT *, CASE WHEN abs(day_mean) > 1e-12 THEN night_mean / day_mean END AS diel_index FROM (SELECT date, avg(value) FILTER (WHERE {_DAY} = 'Day') AS day_mean, avg(value) FILTER (WHERE {_DAY} = 'Night') AS night_mean FROM o GROUP BY date)", OBS),
    "diel_weekly_extreme": sql_rounded("p_hat lo hi n_frames", """SELECT week, hits / n AS p_hat, greatest(0.0, (hits / n + z2 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + z2 / (4 * n * n))) / (1 + z2 / n)) AS lo,
        least(1.0, (hits / n + z2 / (2 * n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + z2 / (4 * n * n))) / (1 + z2 / n)) AS hi, n AS n_frames
        FROM (SELECT CAST(date - CAST((dayofweek(date) + 5) % 7 AS INTEGER) AS DATE) AS week, sum(pct / 100 * frames) AS hits, sum(frames)::DOUBLE AS n, 1.96::DOUBLE * 1.96::DOUBLE AS z2
        FROM (SELECT date, count(*) FILTER (WHERE event_type = 'error') * 100.0::DOUBLE / count(*) AS pct, count(*) AS frames FROM o GROUP BY date) GROUP BY 1)""", OBS),
    "diel_rolling_mean": sql_rounded("mean", "SELECT date, CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END AS mean FROM y WINDOW w AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", _DAILY),
    "diel_rolling_bootstrap": sql_rounded("mean lo hi", """SELECT date, CASE WHEN len(days) >= 5 THEN any_value(mean) END AS mean, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi
        FROM (SELECT date, mean, days, CASE WHEN len(days) >= 5 THEN list_sum(list_transform(range(len(days)), lambda p: days[1 + ('0x' || substr(md5(concat_ws(':', 0, date, r, p)), 1, 8))::BIGINT % len(days)])) / len(days) END AS m
        FROM (SELECT date, mean, days, unnest(range(400)) AS r FROM (SELECT date, avg(value) OVER w AS mean, list(value) OVER w AS days FROM y WINDOW w AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))) GROUP BY date, days""", _DAILY),
    "diel_cumulative_max": sql_rounded("value cummax", "SELECT date, value, max(value) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cummax FROM (SELECT date, max(value) AS value FROM o GROUP BY date)", OBS),
    "diel_annotation_means": sql_rounded("v", f"""SELECT 'hourly_means' AS kind, {_DAY} AS period, avg(m) AS v FROM (SELECT range AS hour_bin, m FROM range(24) LEFT JOIN (SELECT hour_bin, avg(value) AS m FROM o GROUP BY 1) x ON x.hour_bin = range) GROUP BY 2
        UNION ALL SELECT 'cells', {_DAY} AS period, avg(m) FROM (SELECT date, hour_bin, avg(value) AS m FROM o GROUP BY 1, 2) GROUP BY 2
        UNION ALL SELECT 'rows', {_DAY} AS period, avg(value) FROM o GROUP BY 2""", OBS),
    "diel_date_range": sql_rounded("value", "SELECT * FROM y WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'", _DAILY),
    "diel_distinct_days": OBS + " SELECT count(DISTINCT date) AS n_days FROM o",
    "diel_keyed_hours": sql_rounded("xcenter value", f"""SELECT event_id, date, hour_code, hour_bin, hour_bin + 0.5::DOUBLE AS xcenter, value, {_DAY} AS period FROM (SELECT event_id, CAST(ts AS DATE) AS date, CAST(least(greatest(hour(ts) + event_id % 4, 1), 24) AS INTEGER) AS hour_code,
        CAST(least(greatest(hour(ts) + event_id % 4, 1), 24) - 1 AS INTEGER) AS hour_bin, CASE WHEN event_id % 7 <> 0 THEN round(value * 1000, 2) END AS value FROM events WHERE event_id % 11 <> 0)"""),
    "diel_primary_series": sql_rounded("value", "SELECT date, avg(CASE WHEN value > 400 THEN (value + value * 2 + value) / 3 WHEN value > 50 THEN (value + value * 2) / 2 ELSE value END) AS value FROM o GROUP BY date", OBS),
}
