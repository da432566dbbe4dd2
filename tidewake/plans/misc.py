"""Queries of activity, distributions, file names and recording metadata, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions import text, values
from tidewake.functions.geometry import crop
from tidewake.operators import activity, media
from tidewake.plans.common import rounded, sql_rounded, table

_STATE = {"click": "Active", "view": "Swimming", "purchase": "Resting"}
_STATE_SQL = "CASE event_type WHEN 'click' THEN 'Active' WHEN 'view' THEN 'Swimming' WHEN 'purchase' THEN 'Resting' WHEN 'signup' THEN 'Unknown' END"


def _states(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    state = F.when(t == "signup", "Unknown")
    for k, v in _STATE.items():
        state = state.when(t == k, v)
    return table(spark, d, "events").withColumn("state", state)


def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(activity.state_counts(_states(spark, d)))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of states next to each other in each user's order of time."""
    return rounded(activity.transitions(_states(spark, d), ["ts", "event_id"], by=["user_id"]))


def transitions_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same over the table as one sequence."""
    return rounded(activity.transitions(_states(spark, d), ["ts", "event_id"]))


def movement_whole(spark: SparkSession, d: str) -> DataFrame:
    """Chunks numbered over the table as one recording."""
    ev = table(spark, d, "events").select("event_id", F.col("event_type").alias("activity_class"), F.col("value").alias("MFC5_movement_distance"), (F.col("event_id") % 7).alias("Tail1_swim_count"))
    return rounded(activity.movement_lines(activity.prepare(ev)))


def movement(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("activity_class"), F.col("value").alias("MFC5_movement_distance"), (F.col("event_id") % 7).alias("Tail1_swim_count"))
    return rounded(activity.movement_lines(activity.prepare(ev, by=["user_id"])))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select(F.when(v > 200, "Invalid").when(v > 100, "Extreme").when(v > 40, "Normal").when(v > 5, "Minimal").alias("label"), "value")


def class_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(activity.class_shares(_labels(spark, d)))


def valid_classes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(activity.without_invalid(_labels(spark, d)).groupBy("label").agg(F.min("value").alias("low"), F.max("value").alias("high")))


def histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(activity.histogram(table(spark, d, "lineitem"), "l_extendedprice"), 9)


def density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(activity.density(table(spark, d, "lineitem"), "l_extendedprice"), 12)


def best_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(media.best_snapshot(table(spark, d, "part"), "p_retailprice", "p_partkey", ["p_brand"]))


def corrupted(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("bad", (F.col("event_type") == "error") & (F.col("value") > 60))
    return rounded(media.corrupted(ev, "user_id", ["ts", "event_id"], "bad"))


def last_good(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("bad", F.col("event_type") == "error").select("user_id", "event_id", "ts", "value", "bad")
    return rounded(media.last_good(ev, "user_id", ["ts", "event_id"], "value", "bad").select("user_id", "event_id", "value"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    """File names of several shapes from customers."""
    k = F.col("c_custkey")
    pick = lambda *c: F.element_at(F.array(*c), (k % len(c) + 1).cast("int"))
    day, hour = (k % 28 + 1).cast("int"), (k % 24).cast("int")
    name = pick(
        F.format_string("T2410%02d_time_%d_mergedDLC_resnet", day, hour), F.format_string("T202410%02d_time_%dDLC_x_Tracking_analysis_v2", day, hour),
        F.format_string("RecM03_202410%02d_%02d3000_merged.mp4", day, hour), F.format_string("RecS01_202410%02d_%02d3000_labeled.MP4", day, hour),
        F.format_string("a (b) c?%d.csv", k), F.lit("RecM_x_1.mp4"), F.lit("label: 2.5"), F.lit("__x*"),
    )
    return table(spark, d, "customer").select("c_custkey", name.alias("file"), F.when(k % 9 != 0, F.col("c_acctbal") / 10).alias("seconds"))


_NAMES = """WITH n AS (SELECT c_custkey, [printf('T2410%02d_time_%d_mergedDLC_resnet', c_custkey % 28 + 1, c_custkey % 24), printf('T202410%02d_time_%dDLC_x_Tracking_analysis_v2', c_custkey % 28 + 1, c_custkey % 24),
    printf('RecM03_202410%02d_%02d3000_merged.mp4', c_custkey % 28 + 1, c_custkey % 24), printf('RecS01_202410%02d_%02d3000_labeled.MP4', c_custkey % 28 + 1, c_custkey % 24), printf('a (b) c?%d.csv', c_custkey),
    'RecM_x_1.mp4', 'label: 2.5', '__x*'][c_custkey % 8 + 1] AS file, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal / 10 END AS seconds FROM customer)"""


def text_keys(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("file")
    return _names(spark, d).select(
        "c_custkey", "file", text.normalize_video_name(f).alias("normal"), text.truncate_name(f).alias("short"), text.video_name(f).alias("video"), text.simple_stem(f).alias("stem"),
        text.datetime_key(f).alias("key"), text.safe_file_name(f).alias("safe"), text.pretty(f).alias("pretty"), text.recording_hour(f).alias("hour"), F.round(text.sign_value(f), 6).alias("sign"), text.mmss(F.col("seconds")).alias("mmss"),
    )


def video_routing(spark: SparkSession, d: str) -> DataFrame:
    return media.route(_names(spark, d)).select("c_custkey", "file", "camera", "hour_folder")


def unlabeled_videos(spark: SparkSession, d: str) -> DataFrame:
    return media.unlabeled(_names(spark, d)).select("c_custkey", "file")


def crop_geometry(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 13 + 301).cast("long").alias("w"), (F.col("p_size") * 7 + 200).cast("long").alias("h"), (F.col("p_partkey") % 41 - 20).alias("ox"), (F.col("p_partkey") % 17 - 8).alias("oy"))
    return p.select("p_partkey", *[c.cast("long").alias(n) for n, c in crop(F.col("w"), F.col("h"), F.col("ox"), F.col("oy"), F.lit(640), F.lit(360)).items()])


def numeric_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with separators, words, and numbers behind a blank."""
    o = table(spark, d, "orders")
    t = F.when(F.col("o_orderkey") % 3 == 0, F.format_number("o_totalprice", 2)).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).otherwise(F.concat(F.lit(" "), F.col("o_orderkey").cast("string")))
    return rounded(o.select("o_orderkey", values.numeric(t, commas=True).alias("with_commas"), values.numeric(t).alias("plain")), 2)


def session_progress(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "orders").select((F.col("o_orderkey") % 100).alias("done"), F.when(F.col("o_orderkey") % 10 == 0, 0).otherwise(100).alias("total"))
    return rounded(media.progress(got))


def frame_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Time axes and thinned ticks of each user's frames."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, d, "events").select("user_id", (F.row_number().over(order) - 1).alias("frame"))
    return rounded(activity.thinned(ev, "frame", 150).select("user_id", "frame", values.frame_minute(F.col("frame")).alias("minute"), values.chunk_minute(F.col("frame"), 1.5).alias("chunk_minute")))


QUERIES = {
    "activity_state_counts": state_counts, "activity_transitions": transitions, "activity_movement": movement, "activity_transitions_whole": transitions_whole, "activity_movement_whole": movement_whole, "activity_class_shares": class_shares, "activity_valid_classes": valid_classes,
    "activity_histogram": histogram, "activity_density": density, "media_best_snapshot": best_snapshot, "media_corrupted": corrupted, "media_last_good": last_good, "media_progress": session_progress,
    "text_keys": text_keys, "video_routing": video_routing, "video_unlabeled": unlabeled_videos, "crop_geometry": crop_geometry, "numeric_coercion": numeric_coercion, "frame_minutes": frame_minutes,
}

_LABEL = "CASE WHEN value > 200 THEN 'Invalid' WHEN value > 100 THEN 'Extreme' WHEN value > 40 THEN 'Normal' WHEN value > 5 THEN 'Minimal' END AS label"
ORACLES = {
    "activity_state_counts": sql_rounded("pct", f"SELECT k::INTEGER AS ordinal, s.state, coalesce(n, 0) AS n, coalesce(n, 0) * 100.0::DOUBLE / sum(coalesce(n, 0)) OVER () AS pct FROM (VALUES (0, 'Active'), (1, 'Swimming'), (2, 'Resting')) s(k, state) LEFT JOIN (SELECT {_STATE_SQL} AS state, count(*) AS n FROM events GROUP BY 1) c ON c.state = s.state"),
    "activity_transitions": sql_rounded("pct", f"SELECT x.a AS from_state, y.b AS to_state, coalesce(n, 0) AS n, CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY x.a) > 0 THEN coalesce(n, 0) * 100.0::DOUBLE / sum(coalesce(n, 0)) OVER (PARTITION BY x.a) ELSE 0.0 END AS pct FROM (VALUES ('Active'), ('Swimming'), ('Resting')) x(a) CROSS JOIN (VALUES ('Active'), ('Swimming'), ('Resting')) y(b) LEFT JOIN (SELECT s, t, count(*) AS n FROM (SELECT {_STATE_SQL} AS s, lead({_STATE_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) GROUP BY 1, 2) c ON c.s = x.a AND c.t = y.b"),
    "activity_movement": sql_rounded("movement minute count_threshold distance_threshold", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS chunk_id, event_type AS activity_class, value AS movement, event_id % 7 AS swim_count, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 1.0::DOUBLE AS minute, 120.0::DOUBLE AS count_threshold, 20000.0::DOUBLE AS distance_threshold FROM events"),
    "activity_class_shares": sql_rounded("pct invalid_pct", f"SELECT label, n, n * 100.0::DOUBLE / (every - bad) AS pct, bad AS n_invalid, bad * 100.0::DOUBLE / every AS invalid_pct FROM (SELECT label, count(*) AS n FROM (SELECT {_LABEL} FROM events) WHERE label IS NOT NULL GROUP BY 1), (SELECT count(*) AS every, count(*) FILTER (WHERE label = 'Invalid') AS bad FROM (SELECT {_LABEL} FROM events) WHERE label IS NOT NULL) WHERE label <> 'Invalid'"),
    "activity_valid_classes": sql_rounded("low high", f"SELECT label, min(value) AS low, max(value) AS high FROM (SELECT {_LABEL}, value FROM events) WHERE label <> 'Invalid' GROUP BY 1"),
    "activity_histogram": sql_rounded("low high density mean", "SELECT b::INTEGER AS bin, lo + b * w AS low, lo + (b + 1) * w AS high, coalesce(n, 0) AS n, coalesce(n, 0) / (every * w) AS density, mean FROM (SELECT range AS b FROM range(50)) LEFT JOIN (SELECT least(floor((l_extendedprice - lo) / w), 49)::BIGINT AS b, count(*) AS n FROM lineitem, e GROUP BY 1) USING (b), e", "WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 50 AS w, count(*) AS every, avg(l_extendedprice) AS mean FROM lineitem)", 9),
    "activity_density": sql_rounded("x density", "SELECT x, sum(exp(-((x - v) / h) * ((x - v) / h) / 2)) / any_value(n * h) / sqrt(2 * pi()) AS density FROM (SELECT lo + k * (hi - lo) / 299 AS x, h, n FROM e, (SELECT range AS k FROM range(300))), (SELECT l_extendedprice AS v FROM lineitem) GROUP BY x", "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n, stddev_samp(l_extendedprice) * pow(count(*), -0.2) AS h FROM lineitem)", 12),
    "media_best_snapshot": sql_rounded("error", "SELECT p_brand, p_partkey AS iteration, p_retailprice AS error FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1"),
    "media_corrupted": sql_rounded("worst_ratio", "SELECT user_id, count(*) AS n_frames, sum(bad)::BIGINT AS n_bad, max(r) AS worst_ratio, max(r) > 0.1 AS failed FROM (SELECT user_id, bad, sum(bad) OVER w / (count(*) OVER w)::DOUBLE AS r FROM (SELECT *, CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END AS bad FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1"),
    "media_last_good": sql_rounded("value", "SELECT user_id, event_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events"),
    "media_progress": sql_rounded("percent", "SELECT avg(CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE o_orderkey % 100 END::DOUBLE) AS percent FROM orders"),
    "text_keys": _NAMES + r""" SELECT c_custkey, file, regexp_replace(file, '^T(\d{6})_', 'T20\1_') AS normal, CASE WHEN contains(file, '_mergedDLC_') THEN split_part(file, '_mergedDLC_', 1) ELSE split_part(file, 'DLC_', 1) END AS short,
        regexp_replace(CASE WHEN contains(file, '_mergedDLC_') THEN split_part(file, '_mergedDLC_', 1) ELSE split_part(file, 'DLC_', 1) END, '\.csv$', '') AS video,
        CASE WHEN regexp_matches(file, 'T\d{8}_time_\d+') AND contains(lower(file), 'tracking_analysis') THEN regexp_extract(file, '(T\d{8}_time_\d+)', 1) || '_' || substr(file, instr(lower(file), 'tracking_analysis')) ELSE file END AS stem,
        CASE WHEN regexp_matches(file, 'T\d{8}_time_\d+') THEN regexp_extract(file, 'T(\d{8}_time_\d+)', 1) END AS key, trim(regexp_replace(file, '[\\/*?:"<>|() ]+', '_', 'g'), '_') AS safe,
        upper(substr(trim(regexp_replace(file, '_+', ' ', 'g')), 1, 1)) || substr(trim(regexp_replace(file, '_+', ' ', 'g')), 2) AS pretty,
        CASE WHEN length(split_part(file, '_', 3)) >= 6 THEN try_cast(substr(split_part(file, '_', 3), 1, 2) AS INTEGER) END AS hour, CASE WHEN file = 'label: 2.5' THEN 2.5 ELSE 0.0 END::DOUBLE AS sign,
        CASE WHEN seconds IS NOT NULL THEN printf('%02d:%06.3f', floor(greatest(seconds, 0) / 60)::BIGINT, greatest(seconds, 0) - floor(greatest(seconds, 0) / 60) * 60) END AS mmss FROM n""",
    "video_routing": _NAMES + " SELECT c_custkey, file, CASE WHEN contains(file, 'RecM') THEN 'RecM' ELSE 'RecS' END AS camera, CASE WHEN contains(file, 'RecM') AND length(split_part(file, '_', 3)) >= 6 AND try_cast(substr(split_part(file, '_', 3), 1, 2) AS INTEGER) IS NOT NULL THEN printf('%s_time_%02d', substr(split_part(file, '_', 2), 3), substr(split_part(file, '_', 3), 1, 2)::INTEGER + 1) END AS hour_folder FROM n WHERE lower(file) LIKE '%.mp4' AND (contains(file, 'RecM') OR contains(file, 'RecS'))",
    "video_unlabeled": _NAMES + " SELECT c_custkey, file FROM n WHERE lower(file) LIKE '%.mp4' AND NOT contains(lower(file), '_labeled')",
    "crop_geometry": "SELECT p_partkey, cx, cy, greatest(0, cx - 320) AS x0, greatest(0, cy - 180) AS y0, least(w, cx + 320) AS x1, least(h, cy + 180) AS y1 FROM (SELECT p_partkey, w, h, w // 2 + p_partkey % 41 - 20 AS cx, h // 2 + p_partkey % 17 - 8 AS cy FROM (SELECT p_partkey, p_size::BIGINT * 13 + 301 AS w, p_size::BIGINT * 7 + 200 AS h FROM part))",
    "numeric_coercion": sql_rounded("with_commas plain", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 2 THEN o_orderkey::DOUBLE END AS with_commas, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN round(o_totalprice, 2) < 1000 THEN o_totalprice END WHEN 2 THEN o_orderkey::DOUBLE END AS plain FROM orders", digits=2),
    "frame_minutes": sql_rounded("minute chunk_minute", "SELECT user_id, frame::INTEGER AS frame, frame / 60.0::DOUBLE AS minute, frame * 1.5::DOUBLE AS chunk_minute FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events) WHERE frame % 10 = 0"),
}
ORACLES["activity_transitions_whole"] = ORACLES["activity_transitions"].replace("PARTITION BY user_id ORDER BY ts", "ORDER BY ts")
ORACLES["activity_movement_whole"] = ORACLES["activity_movement"].replace("SELECT user_id, row_number()", "SELECT row_number()").replace("PARTITION BY user_id ORDER BY event_id", "ORDER BY event_id")
