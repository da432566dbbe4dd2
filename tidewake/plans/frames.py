"""Queries of frame kinematics and per-video summaries, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.config import CURVATURE_SETS, ONE_SIDED, PARTS, SWIM_PARTS, FrameConfig
from tidewake.operators import frames, rounding, segments, summary
from tidewake.plans.common import DIGITS, POSE, poses, rounded, sql_rounded

CFG = FrameConfig()
AT = frames.AT


def likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Points that pass by frame, and whether each curvature set is likely throughout."""
    got = poses(spark, d).withColumn("pts", frames.gate(F.col("kp")))
    n = F.size(F.filter("pts", lambda p: p.isNotNull()))
    return got.select("video_id", "frame", n.alias("n_points"), *[frames.all_likely(F.col("kp"), parts).alias(f"{name}_likely") for name, parts in CURVATURE_SETS.items()])


def flags(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frames.flags(poses(spark, d)).select("video_id", "frame", "valid", "bad", "skip", "accepted", "mfc_length_px", "body_length_mm"))


def distances(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frames.long_distances(frames.distances(frames.flags(poses(spark, d)))))


#: The tables' recordings have some dozens of frames.
SEGMENT = 16


def walked_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of a walk over segments."""
    return rounded(segments.walk(poses(spark, d), segment=SEGMENT).select("video_id", "frame", "valid", "bad", "skip", "accepted", "mfc_length_px", "body_length_mm"))


def walked_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of a walk over segments."""
    return rounded(frames.long_distances(segments.walk(poses(spark, d), segment=SEGMENT)))


def walked_swim(spark: SparkSession, d: str) -> DataFrame:
    """Swim columns of a walk over segments."""
    return rounded(_swim_rows(segments.walk(poses(spark, d), segment=SEGMENT)))


def _swum(spark: SparkSession, d: str) -> DataFrame:
    return frames.swim(frames.distances(frames.flags(poses(spark, d))))


_SWIM = ("sign", "swim", "bend", "rel", "travel", "cum_swim", "cum_bend", "cum_rel", "cum_travel", "cum_travel_whole")


def _swim_rows(swum: DataFrame) -> DataFrame:
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), *[F.col(f"{p}_{m}").alias(m) for m in _SWIM]) for p in SWIM_PARTS])).alias("z")
    return swum.select("video_id", "frame", parts).select("video_id", "frame", "z.*")


def swim(spark: SparkSession, d: str) -> DataFrame:
    """A row for each frame and swim part."""
    return rounded(_swim_rows(_swum(spark, d)))


_CURVED = ("px", "mm", "radius_px", "radius_mm", "center_x", "center_y", "class", "u_shape", "n_shape")


def curvature_by_ends(spark: SparkSession, d: str) -> DataFrame:
    got = frames.curvature_by_ends(frames.flags(poses(spark, d)))
    return rounded(got.select("video_id", "frame", *[f"curvature_1_{c}" for c in _CURVED]))


def _fitted(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        got = frames.curvature(frames.flags(poses(spark, d)), replace(CFG, fit=method))
        return rounded(got.select("video_id", "frame", *[f"{s}_{c}" for s in CURVATURE_SETS for c in _CURVED]), 5 if method == "threept" else DIGITS)

    run.__doc__ = f"Curvature of the three part sets by the {method} fit."
    return run


def video_summary(spark: SparkSession, d: str) -> DataFrame:
    got = frames.curvature_by_ends(_swum(spark, d))
    return rounded(summary.video_summary(got, CFG, ("curvature_1",)))


def video_summary_all_sets(spark: SparkSession, d: str) -> DataFrame:
    """The summary over the three curvature sets with the configured fit."""
    return rounded(summary.video_summary(frames.curvature(_swum(spark, d)), CFG, tuple(CURVATURE_SETS)))


def rounded_video_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the summary as the sink writes it."""
    got = frames.curvature_by_ends(_swum(spark, d))
    return rounding.round_frames(summary.video_summary(got, CFG, ("curvature_1",)))


def tail_beats(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of a summary joined with its frames."""
    got = frames.curvature_by_ends(_swum(spark, d))
    own = summary.video_summary(got, CFG, ()).select("video_name", *[f"{p}_{m}" for p in SWIM_PARTS for m in ("total_swim_count", "total_one_sided_bending")])
    out = summary.tail_beats(own, got)
    return rounded(out.select("video_name", *[f"{p}_{m}_frequency_hz" for p in SWIM_PARTS for m in ("swim", "one_sided", "combined")]))


def tracking_table(spark: SparkSession, d: str) -> DataFrame:
    """The rounded wide table of the sink."""
    return rounding.round_frames(frames.tracking_table(frames.analyse(poses(spark, d))))


def rounded_distances(spark: SparkSession, d: str) -> DataFrame:
    """Rounding rules on real columns: whole distances, blanked bodies, three digits for places."""
    got = frames.tracking_table(frames.curvature_by_ends(frames.curvature_by_ends(frames.curvature_by_ends(_swum(spark, d)), "curvature_2"), "curvature_3"))
    return rounding.round_frames(got.select("video_id", "coords", "Head1_x", "Head1_likelihood", "Head1_frame_dist_mm", "Head1_cum_dist_px", "curvature_1_mm", "curvature_1_radius_px", "body_length_mm", "mfc_length_mm", "Tail1_swim_count", "Tail1_sign"))


def _swim_sql() -> str:
    """CTEs behind d: g (signs), h (signs before), and a table for each swim part."""
    ref = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"
    sign = ", ".join(f"CASE WHEN accepted AND {ref} > 0 THEN (x1 - x0) / {ref} * (y{AT[p]} - y0) - (y1 - y0) / {ref} * (x{AT[p]} - x0) END AS g{AT[p]}" for p in SWIM_PARTS)
    lags = ", ".join(f"lag(g{AT[p]}) OVER w3 AS was{AT[p]}, lag(g{AT[p]}) OVER w4 AS above{AT[p]}" for p in SWIM_PARTS)
    out = f", g AS (SELECT *, {sign} FROM d), g1 AS (SELECT *, g{AT[SWIM_PARTS[0]]} IS NOT NULL AS live FROM g), h AS (SELECT *, {lags} FROM g1 WINDOW w3 AS (PARTITION BY video_id, live ORDER BY frame), w4 AS (PARTITION BY video_id ORDER BY frame))"
    for p in SWIM_PARTS:
        k = AT[p]
        flip = f"(was{k} < 0 AND g{k} > 0) OR (was{k} > 0 AND g{k} < 0)"
        step = f"sqrt((x{k} - ax{k}) * (x{k} - ax{k}) + (y{k} - ay{k}) * (y{k} - ay{k}))"
        out += f""", q{k} AS (SELECT video_id, frame, accepted, live, above{k} AS above, g{k} AS sign, CASE WHEN live AND ({flip}) THEN 1 ELSE 0 END::BIGINT AS swim,
            CASE WHEN live AND coalesce(NOT ({flip}) AND ((was{k} > 0 AND g{k} > 0) OR (was{k} < 0 AND g{k} < 0)) AND abs(g{k} - was{k}) > {ONE_SIDED[p]}, false) THEN 1 ELSE 0 END::BIGINT AS bend,
            CASE WHEN live AND above{k} IS NOT NULL THEN abs(g{k} - above{k}) ELSE 0.0 END AS rel, CASE WHEN live AND above{k} IS NOT NULL AND {step} >= 1 THEN {step} ELSE 0.0 END AS travel FROM h),
        z{k} AS (SELECT *, CASE WHEN accepted AND NOT live THEN 0 ELSE sum(swim) OVER r END::BIGINT AS cum_swim, CASE WHEN accepted AND NOT live THEN 0 ELSE sum(bend) OVER r END::BIGINT AS cum_bend,
            CASE WHEN accepted AND (NOT live OR above IS NULL) THEN 0.0 ELSE sum(rel) OVER r END AS cum_rel, CASE WHEN accepted AND (NOT live OR above IS NULL) THEN 0.0 ELSE sum(travel) OVER r END AS cum_travel, sum(travel) OVER r AS cum_travel_whole
            FROM q{k} WINDOW r AS (PARTITION BY video_id ORDER BY frame ROWS UNBOUNDED PRECEDING))"""
    return out


def _ends_sql(source: str = "d") -> str:
    """CTEs e (circle through MFC1, MFC3, MFC5) and c (curvature columns)."""
    return f""", e0 AS (SELECT *, x4 - x2 AS ux, y4 - y2 AS uy, x6 - x2 AS vx, y6 - y2 AS vy FROM {source}),
e1 AS (SELECT *, 2 * (ux * vy - uy * vx) AS cr FROM e0),
e2 AS (SELECT *, CASE WHEN accepted AND abs(cr) >= 1e-12 THEN (vy * (ux * ux + uy * uy) - uy * (vx * vx + vy * vy)) / cr END AS ox, CASE WHEN accepted AND abs(cr) >= 1e-12 THEN (ux * (vx * vx + vy * vy) - vx * (ux * ux + uy * uy)) / cr END AS oy FROM e1),
e AS (SELECT *, sqrt(ox * ox + oy * oy) AS rad FROM e2),
c0 AS (SELECT *, 1 / rad AS kappa, 1 / rad / 2.0 AS mm, abs(1 / rad / 2.0) <= 0.02 AS ok FROM e),
c1 AS (SELECT *, CASE WHEN ok AND body IS NULL THEN 'Invalid' WHEN ok AND mm >= 0.02 THEN 'Invalid' WHEN ok AND mm >= 0.01 THEN 'Extreme' WHEN ok AND mm >= 0.0033 THEN 'Normal' WHEN ok THEN 'Minimal' WHEN mm IS NOT NULL THEN 'Invalid' END AS label,
    (x6 - x0) * (y2 + oy - y0) - (y6 - y0) * (x2 + ox - x0) AS side FROM c0),
c AS (SELECT *, CASE WHEN ok THEN kappa END AS curvature_1_px, CASE WHEN ok THEN mm END AS curvature_1_mm, CASE WHEN ok THEN round_even(rad, 0) END AS curvature_1_radius_px, CASE WHEN ok THEN round_even(rad * 2.0, 0) END AS curvature_1_radius_mm,
    CASE WHEN ok THEN x2 + ox END AS curvature_1_center_x, CASE WHEN ok THEN y2 + oy END AS curvature_1_center_y, label AS curvature_1_class,
    CASE WHEN coalesce(ok AND label <> 'Invalid' AND side > 0, false) THEN 1 ELSE 0 END::BIGINT AS curvature_1_u_shape, CASE WHEN coalesce(ok AND label <> 'Invalid' AND side < 0, false) THEN 1 ELSE 0 END::BIGINT AS curvature_1_n_shape FROM c1)"""


_DISTANCE_ROWS = " UNION ALL ".join(f"SELECT video_id, frame, '{p}' AS part, d{k} AS dist_px, sum(coalesce(d{k}, 0.0)) OVER (PARTITION BY video_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS cum_px FROM d" for k, p in enumerate(PARTS))
_SWIM_ROWS = " UNION ALL ".join(f"SELECT video_id, frame, '{p}' AS part, {', '.join(_SWIM)} FROM z{AT[p]}" for p in SWIM_PARTS)
_BEATS = ", ".join(f"f{AT[p]}.swim AS \"{p}_swim_frequency_hz\", f{AT[p]}.one AS \"{p}_one_sided_frequency_hz\", f{AT[p]}.both_ AS \"{p}_combined_frequency_hz\"" for p in SWIM_PARTS)
_BEAT_CTES = "".join(
    f", f{AT[p]} AS (SELECT video_id, s / 2 / nullif(n / 20.0, 0) AS swim, b / 2 / nullif(n / 20.0, 0) AS one, (s + b) / 2 / nullif(n / 20.0, 0) AS both_ FROM (SELECT video_id, arg_max(cum_swim, frame)::DOUBLE AS s, arg_max(cum_bend, frame)::DOUBLE AS b, count(sign)::DOUBLE AS n FROM z{AT[p]} GROUP BY 1))" for p in SWIM_PARTS
)
_BEAT_JOIN = " ".join(f"JOIN f{AT[p]} ON f{AT[p]}.video_id = v.video_id" for p in SWIM_PARTS)


def _summary_sql(sets: dict[str, str]) -> tuple[list[str], str, str]:
    """Doubles, body and CTEs of the video summary of the table c. sets: the curvature sets and their class columns."""
    doubles: list[str] = []
    cols = ["count(*) AS total_frames", "count(*) FILTER (WHERE NOT valid) AS skipped_frames_missing_invalid", "count(*) FILTER (WHERE skip) AS skipped_frames_wrong_detection"]
    for k, p in enumerate(PARTS):
        cols += [f'sum(coalesce(d{k}, 0.0)) AS "{p}_total_distance_px"', f'sum(coalesce(d{k}, 0.0)) * 2.0 AS "{p}_total_distance_mm"']
        doubles += [f"{p}_total_distance_px", f"{p}_total_distance_mm"]
    for name, label in sets.items():
        seen = " AND ".join(f"l{AT[p]} >= 0.6" for p in CURVATURE_SETS[name])
        for u in ("px", "mm"):
            cols += [f"{f}({name}_{u}) FILTER (WHERE {seen}) AS {name}_{s}_{u}" for s, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_samp"))]
            cols += [f"{f}({name}_radius_{u}) FILTER (WHERE {seen}) AS {name}_radius_{s}_{u}" for s, f in (("min", "min"), ("max", "max"), ("mean", "avg"))]
            doubles += [f"{name}_{s}_{u}" for s in ("min", "max", "mean", "std")] + [f"{name}_radius_{s}_{u}" for s in ("min", "max", "mean")]
        shown = f"count(*) FILTER (WHERE {seen} AND coalesce({label} <> 'Invalid', true))"
        for s in ("u", "n"):
            n = f"coalesce(sum({name}_{s}_shape) FILTER (WHERE {seen}), 0)"
            cols += [f"{n}::BIGINT AS {name}_{s}_shape_count", f"coalesce({n} * 100.0::DOUBLE / nullif({shown}, 0), 0.0) AS {name}_{s}_shape_percentage"]
        for kind in ("Extreme", "Normal", "Minimal", "Invalid"):
            n = f"count(*) FILTER (WHERE {seen} AND {label} = '{kind}')"
            of = f"count(*) FILTER (WHERE {seen} AND {label} IS NOT NULL)" if kind == "Invalid" else f"count(*) FILTER (WHERE {seen} AND {label} <> 'Invalid')"
            cols += [f"{n} AS {name}_{kind.lower()}_count", f"coalesce({n} * 100.0::DOUBLE / nullif({of}, 0), 0.0) AS {name}_{kind.lower()}_percentage"]
        doubles += [f"{name}_{k}_percentage" for k in ("u_shape", "n_shape", "extreme", "normal", "minimal", "invalid")]
    for n, c in (("mfc_length", "mfc * 2.0"), ("body_length", "body * 2.0")):
        cols += [f"{f}({c}) AS {n}_{s}_mm" for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
        doubles += [f"{n}_{s}_mm" for s in ("mean", "std", "min", "max")]
    ctes = f", base AS (SELECT video_id, {', '.join(cols)} FROM c GROUP BY 1)"
    joins, more = "", []
    for p in SWIM_PARTS:
        k = AT[p]
        ctes += f", y{k} AS (SELECT video_id, " + ", ".join(f"arg_max(cum_{m}, frame) AS {m}" for m in ("swim", "bend", "rel", "travel", "travel_whole")) + f", count(sign)::DOUBLE / 20.0 AS sec FROM z{k} GROUP BY 1)"
        joins += f" JOIN y{k} ON y{k}.video_id = base.video_id"
        more += [f'y{k}.swim AS "{p}_total_swim_count"', f'y{k}.bend AS "{p}_total_one_sided_bending"']
        for n, m in (("relative_travel_distance", "rel"), ("travel_distance", "travel"), ("travel_distance_whole", "travel_whole")):
            more += [f'y{k}.{m} AS "{p}_{n}_px"', f'y{k}.{m} * 2.0 AS "{p}_{n}_mm"']
            doubles += [f"{p}_{n}_px", f"{p}_{n}_mm"]
        more.append(f'CASE WHEN y{k}.travel > 0 THEN base."MFC5_total_distance_px" / y{k}.travel * 100 END AS "{p}_swimming_efficiency_%"')
        more += [f'({c}) / 2.0::DOUBLE / nullif(y{k}.sec, 0) AS "{p}_{n}_frequency_hz"' for n, c in (("swim", f"y{k}.swim"), ("one_sided", f"y{k}.bend"), ("combined", f"y{k}.swim + y{k}.bend"))]
        doubles += [f"{p}_swimming_efficiency_%", *[f"{p}_{n}_frequency_hz" for n in ("swim", "one_sided", "combined")]]
    return doubles, f"SELECT base.video_id AS video_name, base.* EXCLUDE (video_id), {', '.join(more)} FROM base{joins}", ctes


_SUM_DOUBLES, _SUM_BODY, _SUM_CTES = _summary_sql({"curvature_1": "label"})
_SWIM_CTES = _swim_sql()



def _rounded_summary_sql() -> str:
    """The summary's columns to the digits that the written table has, by what they are."""
    out = ["video_name"]
    whole = ["total_frames", "skipped_frames_missing_invalid", "skipped_frames_wrong_detection"]
    whole += [f"{p}_total_distance_{u}" for p in PARTS for u in ("px", "mm")]
    whole += [f"curvature_1_{k}_count" for k in ("u_shape", "n_shape", "extreme", "normal", "minimal", "invalid")] + [f"mfc_length_{s}_mm" for s in ("mean", "std", "min", "max")]
    for p in SWIM_PARTS:
        whole += [f"{p}_total_swim_count", f"{p}_total_one_sided_bending", f"{p}_swimming_efficiency_%"]
        whole += [f"{p}_{n}_{u}" for n in ("relative_travel_distance", "travel_distance", "travel_distance_whole") for u in ("px", "mm")]
    out += [f'round_even("{c}"::DOUBLE, 0) AS "{c}"' for c in whole]
    out += [f"round_even(curvature_1_radius_{s}_{u}, 3) AS curvature_1_radius_{s}_{u}" for s in ("min", "max", "mean") for u in ("px", "mm")]
    out += [f"round_even(curvature_1_{s}_px, 4) AS curvature_1_{s}_px, CASE WHEN abs(curvature_1_{s}_mm) <= 0.02 THEN round_even(curvature_1_{s}_mm, 4) END AS curvature_1_{s}_mm" for s in ("min", "max", "mean", "std")]
    out += [f"round_even(curvature_1_{k}_percentage, 2) AS curvature_1_{k}_percentage" for k in ("u_shape", "n_shape", "extreme", "normal", "minimal", "invalid")]
    out += [f"CASE WHEN body_length_{s}_mm BETWEEN 270 AND 670 THEN round_even(body_length_{s}_mm, 0) END AS body_length_{s}_mm" for s in ("mean", "std", "min", "max")]
    out += [f'round_even("{p}_{n}_frequency_hz", 4) AS "{p}_{n}_frequency_hz"' for p in SWIM_PARTS for n in ("swim", "one_sided", "combined")]
    return POSE + _SWIM_CTES + _ends_sql() + _SUM_CTES + f" SELECT {', '.join(out)} FROM ({_SUM_BODY})"


def _triplet_sql() -> str:
    """The largest triangle of each set's points, by hand: corners of every triplet, then the first of the largest."""
    ctes, out = POSE, []
    for name, parts in CURVATURE_SETS.items():
        n, last = len(parts), AT[parts[-1]]
        xs, ys = (f"[{', '.join(f'{c}{AT[p]}' for p in parts)}]" for c in "xy")
        ctes += f""", {name}_t AS (SELECT i.range AS i, j.range AS j, k.range AS k FROM range({n}) i JOIN range({n}) j ON j.range > i.range JOIN range({n}) k ON k.range > j.range),
{name}_p AS (SELECT video_id, frame, body, x0 AS hx, y0 AS hy, x{last} AS ex, y{last} AS ey, {xs} AS xs, {ys} AS ys FROM d WHERE accepted),
{name}_c AS (SELECT p.*, i, j, k, xs[i + 1] AS px, ys[i + 1] AS py, xs[j + 1] - xs[i + 1] AS ux, ys[j + 1] - ys[i + 1] AS uy, xs[k + 1] - xs[i + 1] AS vx, ys[k + 1] - ys[i + 1] AS vy FROM {name}_p p, {name}_t),
{name}_a AS (SELECT *, ux * vy - uy * vx AS cr FROM {name}_c),
{name}_b AS (SELECT * FROM {name}_a WHERE abs(cr) >= 1e-6 QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY abs(cr) DESC, i, j, k) = 1),
{name}_o AS (SELECT *, (vy * (ux * ux + uy * uy) - uy * (vx * vx + vy * vy)) / (2 * cr) AS ox, (ux * (vx * vx + vy * vy) - vx * (ux * ux + uy * uy)) / (2 * cr) AS oy FROM {name}_b),
{name}_k AS (SELECT *, 1 / sqrt(ox * ox + oy * oy) AS kappa, 1 / sqrt(ox * ox + oy * oy) / 2.0 AS mm FROM {name}_o),
{name}_l AS (SELECT *, abs(mm) <= 0.02 AS ok, CASE WHEN abs(mm) <= 0.02 AND body IS NULL THEN 'Invalid' WHEN abs(mm) >= 0.02 THEN 'Invalid' WHEN mm >= 0.01 THEN 'Extreme' WHEN mm >= 0.0033 THEN 'Normal' ELSE 'Minimal' END AS label,
    (ex - hx) * (py + oy - hy) - (ey - hy) * (px + ox - hx) AS side FROM {name}_k),
{name} AS (SELECT video_id, frame, CASE WHEN ok THEN kappa END AS {name}_px, CASE WHEN ok THEN mm END AS {name}_mm, CASE WHEN ok THEN round_even(1 / kappa, 0) END AS {name}_radius_px, CASE WHEN ok THEN round_even(2 / kappa, 0) END AS {name}_radius_mm,
    CASE WHEN ok THEN px + ox END AS {name}_center_x, CASE WHEN ok THEN py + oy END AS {name}_center_y, label AS {name}_class,
    CASE WHEN ok AND label <> 'Invalid' AND side > 0 THEN 1 ELSE 0 END::BIGINT AS {name}_u_shape, CASE WHEN ok AND label <> 'Invalid' AND side < 0 THEN 1 ELSE 0 END::BIGINT AS {name}_n_shape FROM {name}_l)"""
        out += [f"coalesce({name}_{c}, 0)::BIGINT AS {name}_{c}" if c.endswith("shape") else f"{name}_{c}" for c in _CURVED]
    joins = " ".join(f"LEFT JOIN {name} ON {name}.video_id = d.video_id AND {name}.frame = d.frame" for name in CURVATURE_SETS)
    return sql_rounded([f"{name}_{c}" for name in CURVATURE_SETS for c in _CURVED[:6]], f"SELECT d.video_id, d.frame, {', '.join(out)} FROM d {joins}", ctes, 5)


def _curved_sql(name: str, source: str) -> str:
    """CTE {name} of curvature columns from rad, ccx, ccy (a circle), body and the head and end points (hx, hy, ex, ey)."""
    return f""", {name}_k AS (SELECT *, 1 / rad AS kappa, 1 / rad / 2.0 AS mm FROM {source}),
{name}_l AS (SELECT *, abs(mm) <= 0.02 AS ok, CASE WHEN abs(mm) <= 0.02 AND body IS NULL THEN 'Invalid' WHEN abs(mm) >= 0.02 THEN 'Invalid' WHEN mm >= 0.01 THEN 'Extreme' WHEN mm >= 0.0033 THEN 'Normal' WHEN mm IS NOT NULL THEN 'Minimal' END AS label,
    (ex - hx) * (ccy - hy) - (ey - hy) * (ccx - hx) AS side FROM {name}_k),
{name} AS (SELECT video_id, frame, CASE WHEN ok THEN kappa END AS {name}_px, CASE WHEN ok THEN mm END AS {name}_mm, CASE WHEN ok THEN round_even(rad, 0) END AS {name}_radius_px, CASE WHEN ok THEN round_even(rad * 2.0, 0) END AS {name}_radius_mm,
    CASE WHEN ok THEN ccx END AS {name}_center_x, CASE WHEN ok THEN ccy END AS {name}_center_y, label AS {name}_class,
    CASE WHEN ok AND label <> 'Invalid' AND side > 0 THEN 1 ELSE 0 END::BIGINT AS {name}_u_shape, CASE WHEN ok AND label <> 'Invalid' AND side < 0 THEN 1 ELSE 0 END::BIGINT AS {name}_n_shape FROM {name}_l)"""


#: Newton steps written out in SQL; on these tables none helps after the twelfth.
_SQL_STEPS = 16


def _algebraic_ctes(hyper: bool, source: str = "d") -> str:
    """A CTE of curvature columns for each set: centred moments, the quartic by Newton steps, one CTE each, then the circle."""
    out = ""
    for name, parts in CURVATURE_SETS.items():
        at, last = [AT[p] for p in parts], AT[parts[-1]]
        n = len(at)
        mean = lambda f: "(" + " + ".join(f(k) for k in at) + f") / {n}.0::DOUBLE"
        dx, dy = (lambda k: f"(x{k} - mx)"), (lambda k: f"(y{k} - my)")
        z = lambda k: f"({dx(k)} * {dx(k)} + {dy(k)} * {dy(k)})"
        moments = {"mxx": (dx, dx), "myy": (dy, dy), "mxy": (dx, dy), "mxz": (dx, z), "myz": (dy, z), "mzz": (z, z)}
        made = ", ".join(mean(lambda k, a=a, b=b: f"{a(k)} * {b(k)}") + f" AS {m}" for m, (a, b) in moments.items())  # noqa: B023
        a1 = "var * mz + 4 * cov * mz - mxz * mxz - myz * myz" if hyper else "mzz * mz + 4 * cov * mz - mxz * mxz - myz * myz - mz * mz * mz"
        a0 = "mxz * (mxz * myy - myz * mxy) + myz * (myz * mxx - mxz * mxy) - var * cov" if hyper else "mxz * mxz * myy + myz * myz * mxx - mzz * cov - 2 * mxz * myz * mxy + mz * mz * cov"
        out += f""", {name}_m AS (SELECT *, {mean(lambda k: f"x{k}")} AS mx, {mean(lambda k: f"y{k}")} AS my FROM {source} WHERE accepted),
{name}_q AS (SELECT video_id, frame, body, mx, my, x0 AS hx, y0 AS hy, x{last} AS ex, y{last} AS ey, {made} FROM {name}_m),
{name}_p AS (SELECT *, mxx + myy AS mz, mxx * myy - mxy * mxy AS cov, mzz - (mxx + myy) * (mxx + myy) AS var FROM {name}_q),
{name}_a AS (SELECT *, 4 * cov - 3 * mz * mz - mzz AS a2, {a1} AS a1, {a0} AS a0 FROM {name}_p),
{name}_0 AS (SELECT *, 0.0::DOUBLE AS root, a0 AS val FROM {name}_a)"""
        for k in range(_SQL_STEPS):
            out += f""", {name}_t{k} AS (SELECT *, root - val / nullif(a1 + root * (2 * a2 + 16 * root * root), 0) AS nxt FROM {name}_{k}),
{name}_v{k} AS (SELECT *, a0 + nxt * (a1 + nxt * (a2 + 4 * nxt * nxt)) AS nv FROM {name}_t{k}),
{name}_{k + 1} AS (SELECT * EXCLUDE (root, val, nxt, nv), CASE WHEN abs(nv) < abs(val) THEN nxt ELSE root END AS root, CASE WHEN abs(nv) < abs(val) THEN nv ELSE val END AS val FROM {name}_v{k})"""
        out += f""", {name}_d AS (SELECT *, nullif(root * root - root * mz + cov, 0) AS det FROM {name}_{_SQL_STEPS}),
{name}_e AS (SELECT *, (mxz * (myy - root) - myz * mxy) / det / 2 AS ox, (myz * (mxx - root) - mxz * mxy) / det / 2 AS oy FROM {name}_d),
{name}_f AS (SELECT *, ox * ox + oy * oy + mz + ({-2 if hyper else 2}) * root AS r2 FROM {name}_e),
{name}_c AS (SELECT *, CASE WHEN r2 > 0 THEN sqrt(r2) END AS rad, CASE WHEN r2 > 0 THEN ox + mx END AS ccx, CASE WHEN r2 > 0 THEN oy + my END AS ccy FROM {name}_f)""" + _curved_sql(name, f"{name}_c")
    return out


def _curvature_rows(ctes: str, digits: int = DIGITS) -> str:
    """All sets' columns of each frame, 0 or null where a set has no row."""
    out = [f"coalesce({name}.{name}_{c}, 0)::BIGINT AS {name}_{c}" if c.endswith("shape") else f"{name}.{name}_{c}" for name in CURVATURE_SETS for c in _CURVED]
    joins = " ".join(f"LEFT JOIN {name} ON {name}.video_id = d.video_id AND {name}.frame = d.frame" for name in CURVATURE_SETS)
    return sql_rounded([f"{name}_{c}" for name in CURVATURE_SETS for c in _CURVED[:6]], f"SELECT d.video_id, d.frame, {', '.join(out)} FROM d {joins}", ctes, digits)


QUERIES = {
    "frame_likelihood": likelihood, "frame_flags": flags, "frame_distances": distances, "frame_swim": swim,
    "frame_flags_by_segments": walked_flags, "frame_distances_by_segments": walked_distances, "frame_swim_by_segments": walked_swim, "frame_curvature_by_ends": curvature_by_ends,
    "frame_curvature_hyper": _fitted("hyper"), "frame_curvature_pratt": _fitted("pratt"), "frame_curvature_three_points": _fitted("threept"),
    "video_summary": video_summary, "video_summary_all_sets": video_summary_all_sets, "video_summary_rounded": rounded_video_summary, "video_tail_beats": tail_beats, "tracking_table": tracking_table, "tracking_rounded": rounded_distances,
}

ORACLES = {
    "frame_likelihood": POSE + " SELECT video_id, frame, (" + " + ".join(f"CASE WHEN l{k} >= 0.6 THEN 1 ELSE 0 END" for k in range(len(PARTS))) + ")::INTEGER AS n_points, " + ", ".join("(" + " AND ".join(f"l{AT[p]} >= 0.6" for p in parts) + f") AS {name}_likely" for name, parts in CURVATURE_SETS.items()) + " FROM p",
    "frame_flags": sql_rounded("mfc_length_px body_length_mm", "SELECT video_id, frame, valid, bad, skip, accepted, mfc AS mfc_length_px, body * 2.0 AS body_length_mm FROM d", POSE),
    "frame_distances": sql_rounded("dist_px cum_px", _DISTANCE_ROWS, POSE),
    "frame_swim": sql_rounded("sign rel travel cum_rel cum_travel cum_travel_whole", _SWIM_ROWS, POSE + _SWIM_CTES),
    "frame_curvature_by_ends": sql_rounded([f"curvature_1_{c}" for c in _CURVED[:6]], f"SELECT video_id, frame, {', '.join(f'curvature_1_{c}' for c in _CURVED)} FROM c", POSE + _ends_sql()),
    "video_summary": sql_rounded(_SUM_DOUBLES, _SUM_BODY, POSE + _SWIM_CTES + _ends_sql() + _SUM_CTES),
    "video_summary_rounded": _rounded_summary_sql(),
    "frame_curvature_three_points": _triplet_sql(),
    "frame_curvature_hyper": _curvature_rows(POSE + _algebraic_ctes(True)),
    "frame_curvature_pratt": _curvature_rows(POSE + _algebraic_ctes(False)),
    "video_tail_beats": sql_rounded([f"{p}_{m}_frequency_hz" for p in SWIM_PARTS for m in ("swim", "one_sided", "combined")], f"SELECT v.video_id AS video_name, {_BEATS} FROM (SELECT DISTINCT video_id FROM d) v {_BEAT_JOIN}", POSE + _SWIM_CTES + _BEAT_CTES),
    "tracking_rounded": POSE + _SWIM_CTES + _ends_sql("h") + """ SELECT video_id, frame AS coords, round_even(x0, 3) AS "Head1_x", round_even(l0, 3) AS "Head1_likelihood", round_even(d0 * 2.0, 0) AS "Head1_frame_dist_mm",
        round_even(sum(coalesce(d0, 0.0)) OVER (PARTITION BY video_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS "Head1_cum_dist_px", CASE WHEN abs(curvature_1_mm) <= 0.02 THEN round_even(curvature_1_mm, 4) END AS curvature_1_mm, curvature_1_radius_px,
        round_even(body * 2.0, 0) AS body_length_mm, round_even(mfc * 2.0, 0) AS mfc_length_mm, CASE WHEN (was7 < 0 AND g7 > 0) OR (was7 > 0 AND g7 < 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS "Tail1_swim_count", round_even(g7, 3) AS "Tail1_sign" FROM c""",
}
ORACLES |= {f"{name}_by_segments": ORACLES[name] for name in ("frame_flags", "frame_distances", "frame_swim")}


def _all_sets_sql() -> str:
    doubles, body, ctes = _summary_sql({name: f"{name}_class" for name in CURVATURE_SETS})
    fits = ", ".join(f"{name}.{name}_{c}" for name in CURVATURE_SETS for c in _CURVED)
    joins = " ".join(f"LEFT JOIN {name} ON {name}.video_id = d.video_id AND {name}.frame = d.frame" for name in CURVATURE_SETS)
    return sql_rounded(doubles, body, POSE + _SWIM_CTES + _algebraic_ctes(True) + f", c AS (SELECT d.*, {fits} FROM d {joins})" + ctes)


ORACLES["video_summary_all_sets"] = _all_sets_sql()


def _tracking_sql() -> str:
    """The wide table column by column, rounded by what each column is."""
    even = lambda c, digits, name: f'round_even(({c})::DOUBLE, {digits}) AS "{name}"'
    cols = ["w.video_id", "w.frame AS coords"]
    for k, p in enumerate(PARTS):
        cols += [even(f"w.{c}{k}", 3, f"{p}_{n}") for c, n in (("x", "x"), ("y", "y"), ("l", "likelihood"))]
        cols += [even(f"w.{c}{k} * {r}", 0, f"{p}_{n}_dist_{u}") for c, n in (("d", "frame"), ("cum", "cum")) for u, r in (("px", 1.0), ("mm", 2.0))]
    for s in CURVATURE_SETS:
        cols += [even(f"{s}.{s}_px", 4, f"{s}_px"), even(f"CASE WHEN abs({s}.{s}_mm) <= 0.02 THEN {s}.{s}_mm END", 4, f"{s}_mm"), f"{s}.{s}_class"]
        cols += [even(f"{s}.{s}_radius_{u}", 0, f"{s}_radius_{u}") for u in ("px", "mm")] + [even(f"{s}.{s}_center_{u}", 3, f"{s}_center_{u}") for u in "xy"]
        cols += [even(f"coalesce({s}.{s}_{u}_shape, 0)", 3, f"{s}_{u}_shape") for u in "un"]
    for p in SWIM_PARTS:
        z = f"z{AT[p]}"
        cols.append(even(f"{z}.sign", 3, f"{p}_sign"))
        for c, n in (("swim", "swim_count"), ("bend", "one_sided_bending_count")):
            cols += [even(f"{z}.{c}", 0, f"{p}_{n}"), even(f"{z}.cum_{c}", 0, f"{p}_cumulative_{n}")]
        for c, n in (("rel", "relative_travel_distance"), ("travel", "travel_distance")):
            cols += [even(f"{z}.{b}{c} * {r}", 0, f"{p}_{a}{n}_{u}") for a, b in (("", ""), ("cumulative_", "cum_")) for u, r in (("px", 1.0), ("mm", 2.0))]
    cols += [even("w.mfc", 0, "mfc_length_px"), even("w.mfc * 2.0", 0, "mfc_length_mm"), even("w.body", 0, "body_length_px"), even("CASE WHEN w.body * 2.0 BETWEEN 270 AND 670 THEN w.body * 2.0 END", 0, "body_length_mm")]
    sums = ", ".join(f"sum(coalesce(d{k}, 0.0)) OVER r AS cum{k}" for k in range(len(PARTS)))
    joins = " ".join(f"LEFT JOIN {t} ON {t}.video_id = w.video_id AND {t}.frame = w.frame" for t in (*CURVATURE_SETS, *[f"z{AT[p]}" for p in SWIM_PARTS]))
    whole = f", w AS (SELECT *, {sums} FROM d WINDOW r AS (PARTITION BY video_id ORDER BY frame ROWS UNBOUNDED PRECEDING))"
    return POSE + _SWIM_CTES + _algebraic_ctes(True) + whole + f" SELECT {', '.join(cols)} FROM w {joins}"


ORACLES["tracking_table"] = _tracking_sql()
