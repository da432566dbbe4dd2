"""What the registered queries share: reading, rounding on both sides, and the adapters to the engine's inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.config import PARTS

DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scaled_round(c: Column, digits: int) -> Column:
    """Rounds the product with the power of ten, as SQL engines do; ``F.round`` rounds the shortest decimal form, another value near halves."""
    scaled = c * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(c)


def rounded(df: DataFrame, digits: int = DIGITS, by: Callable[[Column, int], Column] = F.round) -> DataFrame:
    """Doubles rounded (and -0 as 0), so that sums in another order compare equal."""
    return df.select(*[(by(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def sql_rounded(doubles: str | list[str], inner: str, ctes: str = "", digits: int = DIGITS) -> str:
    """The same for DuckDB: names separated by blanks, or a list."""
    names = doubles.split() if isinstance(doubles, str) else doubles
    cols = ", ".join(f'round("{n}", {digits}) + 0.0 AS "{n}"' for n in names)
    return f"{ctes} SELECT * REPLACE ({cols}) FROM ({inner}) AS q"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly observations (date, hour_bin, value, ...) from events."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.to_date("ts").alias("date"), F.hour("ts").alias("hour_bin"), "value", "event_id", "user_id", "event_type")


OBS = "WITH o AS (SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour_bin, value, event_id, user_id, event_type FROM events)"

#: Frames of a window, for sequences of some dozens of events.
WINDOW = 20


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tracking table from each user's events in order of time: signals from the value, skipped where it is below 5."""
    ev = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    run = order.rowsBetween(W.unboundedPreceding, 0)
    v = F.col("value")
    name = F.format_string("T202410%02d_time_%d_u%d_tracking_analysis", F.col("user_id") % 28 + 1, F.col("user_id") % 24 + 1, F.col("user_id"))
    on = v >= 5
    return ev.select(
        name.alias("file"), (F.row_number().over(order) - 1).cast("long").alias("frame"),
        F.when(on, v / 21700).alias("curvature_1_mm"), F.when(on, 21700 / v).alias("curvature_1_radius_mm"), (300 + v).alias("body_length_mm"),
        F.when(on, F.when(v >= 200, "Extreme").when(v >= 66, "Normal").when(v >= 12, "Minimal")).alias("curvature_1_class"),
        F.sum((v > 100).cast("long")).over(run).alias("Tail1_cumulative_swim_count"), (v > 100).cast("long").alias("Tail1_swim_count"),
        (v > 60).cast("long").alias("Tail2_swim_count"), F.sum((v > 30).cast("long")).over(run).alias("Tail3_swim_count"),
        v.alias("MFC5_frame_dist_mm"), (v / 2).alias("Tail1_travel_distance_mm"),
    )


TRACK = """WITH t0 AS (SELECT *, row_number() OVER w - 1 AS frame,
    sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) OVER w AS c1, sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) OVER w AS c3
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT printf('T202410%02d_time_%d_u%d_tracking_analysis', user_id % 28 + 1, user_id % 24 + 1, user_id) AS file, frame,
    CASE WHEN value >= 5 THEN value / 21700 END AS curvature_1_mm, CASE WHEN value >= 5 THEN 21700 / value END AS curvature_1_radius_mm,
    300 + value AS body_length_mm,
    CASE WHEN value < 5 THEN NULL WHEN value >= 200 THEN 'Extreme' WHEN value >= 66 THEN 'Normal' WHEN value >= 12 THEN 'Minimal' END AS curvature_1_class,
    c1::DOUBLE AS cum1, CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END::DOUBLE AS raw1, CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END::DOUBLE AS raw2, c3::DOUBLE AS raw3,
    value AS dist, value / 2 AS travel, NOT coalesce(value >= 5, false) AS skip
  FROM t0),
lagged AS (SELECT *, lag(cum1) OVER f AS p1, lag(raw2) OVER f AS p2, lag(raw3) OVER f AS p3, lag(raw1) OVER f AS pr1, lag(skip) OVER f AS ps
  FROM t WINDOW f AS (PARTITION BY file ORDER BY frame)),
grows AS (SELECT file, count(cum1) >= 5 AND coalesce(min(cum1 - p1) >= -1e-6, false) AS g1, count(raw1) >= 5 AND coalesce(min(raw1 - pr1) >= -1e-6, false) AS gr1,
    count(raw2) >= 5 AND coalesce(min(raw2 - p2) >= -1e-6, false) AS g2, count(raw3) >= 5 AND coalesce(min(raw3 - p3) >= -1e-6, false) AS g3 FROM lagged GROUP BY file),
inc AS (SELECT l.*, floor(frame / 20)::BIGINT AS window_idx,
    CASE WHEN g1 THEN CASE WHEN NOT skip AND NOT ps THEN greatest(0.0, cum1 - p1) ELSE 0.0 END
         WHEN gr1 THEN CASE WHEN NOT skip AND NOT ps THEN greatest(0.0, raw1 - pr1) ELSE 0.0 END ELSE CASE WHEN NOT skip THEN raw1 ELSE 0.0 END END AS inc1,
    CASE WHEN g2 THEN CASE WHEN NOT skip AND NOT ps THEN greatest(0.0, raw2 - p2) ELSE 0.0 END ELSE CASE WHEN NOT skip THEN raw2 ELSE 0.0 END END AS inc2,
    CASE WHEN g3 THEN CASE WHEN NOT skip AND NOT ps THEN greatest(0.0, raw3 - p3) ELSE 0.0 END ELSE CASE WHEN NOT skip THEN raw3 ELSE 0.0 END END AS inc3
  FROM lagged l JOIN grows USING (file))"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame, kp) from embeddings: a label is a video, its vectors in order are frames."""
    em = table(spark, sf_dir, "embeddings")
    e = lambda k: F.col("embedding")[k].cast("double")
    kp = [F.struct(F.lit(p).alias("part"), (200 + 20 * i + 60 * e(2 * i) + 800 * e(62)).alias("x"), (400 + 60 * e(2 * i + 1) + 800 * e(63)).alias("y"), (0.85 + e(22 + i)).alias("likelihood")) for i, p in enumerate(PARTS)]
    frame = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return em.select(F.col("label").cast("string").alias("video_id"), frame.cast("long").alias("frame"), F.array(*kp).alias("kp"))


def _pose_sql() -> str:
    """CTEs of the frame machine: p (points), v (validity, lengths), b (bad), s (skip, accepted), a (accepted lag), d (steps)."""
    n = len(PARTS)
    cols = ", ".join(f"200 + {20 * i} + 60 * embedding[{2 * i + 1}]::DOUBLE + 800 * embedding[63]::DOUBLE AS x{i}, 400 + 60 * embedding[{2 * i + 2}]::DOUBLE + 800 * embedding[64]::DOUBLE AS y{i}, 0.85 + embedding[{23 + i}]::DOUBLE AS l{i}" for i in range(n))
    valid = " AND ".join(f"l{i} >= 0.6" for i in range(n))
    seg = [f"sqrt((x{i + 1} - x{i}) * (x{i + 1} - x{i}) + (y{i + 1} - y{i}) * (y{i + 1} - y{i}))" for i in range(n - 1)]
    lag = lambda w, t: ", ".join(f"lag(x{i}) OVER {w} AS {t}x{i}, lag(y{i}) OVER {w} AS {t}y{i}" for i in range(n))
    step = lambda t, i: f"sqrt((x{i} - {t}x{i}) * (x{i} - {t}x{i}) + (y{i} - {t}y{i}) * (y{i} - {t}y{i}))"
    far = " + ".join(f"CASE WHEN {step('v', i)} > lim THEN 1 ELSE 0 END" for i in range(n))
    dist = ", ".join(f"CASE WHEN accepted THEN CASE WHEN {step('a', i)} < 1 THEN 0.0 ELSE {step('a', i)} END END AS d{i}" for i in range(n))
    return f"""WITH p AS (SELECT label::VARCHAR AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, {cols} FROM embeddings),
v0 AS (SELECT *, {valid} AS valid, {" + ".join(seg[2:6])} AS mfc0, {" + ".join(seg)} AS body0 FROM p),
v AS (SELECT *, CASE WHEN valid THEN mfc0 END AS mfc, CASE WHEN valid AND body0 * 2.0 BETWEEN 270 AND 670 THEN body0 END AS body FROM v0),
b0 AS (SELECT *, greatest(200.0, coalesce(0.25 * body, 200.0)) AS lim, {lag("w", "v")} FROM v WINDOW w AS (PARTITION BY video_id, valid ORDER BY frame)),
b AS (SELECT *, valid AND vx0 IS NOT NULL AND ({far}) >= 2 AS bad FROM b0),
r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, valid ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM b),
s AS (SELECT *, bad AND sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, valid, run ORDER BY frame ROWS UNBOUNDED PRECEDING) % 2 = 1 AS skip FROM r),
a0 AS (SELECT *, valid AND NOT skip AS accepted FROM s),
a AS (SELECT *, {lag("w2", "a")} FROM a0 WINDOW w2 AS (PARTITION BY video_id, accepted ORDER BY frame)),
d AS (SELECT *, {dist} FROM a)"""


POSE = _pose_sql()
