"""Micro fixtures of the frame machine, with results by hand, and a sequential model."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.config import ONE_SIDED, PARTS, FrameConfig
from tidewake.functions import circles
from tidewake.operators import frames, rounding, summary

KP = "video_id string, frame long, kp array<struct<part:string,x:double,y:double,likelihood:double>>"


def video(spark, moves, changes=None, name="v"):
    """Frames of a straight body at the given x offsets; changes: {(frame, part): (dx, dy, likelihood)}."""
    out = []
    for k, dx in enumerate(moves):
        kp = []
        for i, p in enumerate(PARTS):
            cx, cy, lik = (changes or {}).get((k, p), (0.0, 0.0, 0.9))
            kp.append((p, 100.0 + 20 * i + dx + cx, 200.0 + cy, lik))
        out.append((name, k, kp))
    return spark.createDataFrame(out, KP)


def run(df):
    return frames.swim(frames.distances(frames.flags(df)))


def test_distance_and_cumulative(spark):
    got = [(r["dist_px"][0], r["cum_px"][0]) for r in run(video(spark, [0, 3, 6, 9, 12, 15])).orderBy("frame").collect()]
    assert got == [(None, 0.0), (3.0, 3.0), (3.0, 6.0), (3.0, 9.0), (3.0, 12.0), (3.0, 15.0)]


def test_jitter_is_no_distance(spark):
    assert [r["dist_px"][3] for r in run(video(spark, [0, 0.5])).orderBy("frame").collect()] == [None, 0.0]


def test_missing_part_rejects_the_frame(spark):
    got = run(video(spark, [0, 3, 6, 9], {(2, "Tail1"): (0.0, 0.0, 0.59)})).orderBy("frame").collect()
    assert [r["valid"] for r in got] == [True, True, False, True]
    assert [r["cum_px"][0] for r in got] == [0.0, 3.0, 3.0, 9.0]
    assert got[2]["dist_px"][0] is None and got[3]["dist_px"][0] == 6.0


def test_two_jumping_parts_have_one_frame_of_grace(spark):
    jumps = {(k, p): (300.0 * (k - 2), 0.0, 0.9) for k in (3, 4, 5) for p in ("Tail3", "Tail4")}
    got = run(video(spark, [0] * 6, jumps)).orderBy("frame").collect()
    assert [r["skip"] for r in got] == [False, False, False, True, False, True]


def test_one_jumping_part_is_accepted(spark):
    got = run(video(spark, [0, 0], {(1, "Tail4"): (300.0, 0.0, 0.9)})).orderBy("frame").collect()
    assert got[1]["accepted"] and got[1]["dist_px"][10] == 300.0


def test_swim_events_and_bends(spark):
    signs = [-4.0, 4.0, 0.0, 5.0, 9.0, 12.0]
    got = run(video(spark, [0] * 6, {(k, "Tail1"): (0.0, s, 0.9) for k, s in enumerate(signs)})).orderBy("frame").collect()
    assert [r["Tail1_sign"] for r in got] == signs
    assert [r["Tail1_swim"] for r in got] == [0, 1, 0, 0, 0, 0]
    assert [r["Tail1_bend"] for r in got] == [0, 0, 0, 0, 1, 0]  # 9 - 5 is over 3; 12 - 9 is not


def test_cumulative_travel_restarts_behind_a_rejected_frame(spark):
    moved = {(k, "Tail1"): (0.0, 5.0 * k, 0.9) for k in range(4)} | {(2, "Head1"): (0.0, 0.0, 0.1)}
    got = run(video(spark, [0] * 4, moved)).orderBy("frame").collect()
    assert [r["Tail1_cum_travel"] for r in got] == [0.0, 5.0, 5.0, 0.0]
    assert [r["Tail1_cum_travel_whole"] for r in got] == [0.0, 5.0, 5.0, 5.0]


def test_reference_line_without_length_leaves_zeros(spark):
    at = {(2, "Head2"): (-20.0, 0.0, 0.9)} | {(k, "Tail1"): (0.0, (-1) ** k * 8.0, 0.9) for k in range(4)}
    got = run(video(spark, [0] * 4, at)).orderBy("frame").collect()
    assert [r["Tail1_cum_swim"] for r in got] == [0, 1, 0, 1]  # frames 1 and 3 are on one side


def model(points, sign_part="Tail1"):
    """One video, frame by frame: (valid, skip, cumulative Head1 distance, swims, bends)."""
    out, seen, last, grace, cum, swims, bends, was = [], None, None, 0, 0.0, 0, 0, None
    for p in points:
        valid = all(q is not None for q in p)
        skip = False
        if valid:
            bad = seen is not None and sum(math.dist(a, b) > 200 for a, b in zip(p, seen, strict=True)) >= 2
            if grace:  # the next valid frame uses it up, whether it needs it or not
                grace = 0
            elif bad:
                skip, grace = True, 1
            seen = p
        if valid and not skip:
            if last is not None:
                step = math.dist(p[0], last[0])
                cum += step if step >= 1 else 0
            last = p
            (x0, y0), (x1, y1), (xt, yt) = p[0], p[1], p[PARTS.index(sign_part)]
            n = math.hypot(x1 - x0, y1 - y0)
            sign = (x1 - x0) / n * (yt - y0) - (y1 - y0) / n * (xt - x0)
            if was is not None:
                if was * sign < 0:
                    swims += 1
                elif was * sign > 0 and abs(sign - was) > ONE_SIDED[sign_part]:
                    bends += 1
            was = sign
        out.append((valid, skip, round(cum, 6), swims, bends))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_a_sequential_model(spark, seed):
    rng = random.Random(seed)
    rows, points = [], []
    for k in range(80):
        jump = rng.choice([0, 0, 0, 320])
        kp, pts = [], []
        for i, p in enumerate(PARTS):
            x, y, lik = 100 + 20 * i + rng.gauss(0, 3) + (jump if i % 3 == 0 else 0), 200 + rng.gauss(0, 8), rng.choice([0.95] * 40 + [0.2])
            kp.append((p, x, y, lik))
            pts.append((x, y) if lik >= 0.6 else None)
        rows.append(("v", k, kp))
        points.append(pts)
    got = run(spark.createDataFrame(rows, KP)).orderBy("frame").collect()
    want = model(points)
    assert [(r["valid"], r["skip"], round(r["cum_px"][0], 6)) for r in got] == [w[:3] for w in want]
    # counts of accepted frames; rejected ones carry on
    assert [(r["Tail1_cum_swim"], r["Tail1_cum_bend"]) for r in got] == [w[3:] for w in want]


def arc(radius, n=7, centre=(10.0, -5.0), span=1.5):
    t = np.linspace(0.2, 0.2 + span, n)
    return np.column_stack([centre[0] + radius * np.cos(t), centre[1] + radius * np.sin(t)])


@pytest.mark.parametrize("method", ["hyper", "pratt", "threept"])
def test_fits_find_the_circle(method):
    kappa, radius, cx, cy = circles.fit(arc(100.0)[None], method)[0]
    assert (kappa, radius, cx, cy) == pytest.approx((0.01, 100.0, 10.0, -5.0), abs=1e-6)


@pytest.mark.parametrize("method", ["hyper", "pratt"])
def test_moment_form_equals_singular_vectors(method):
    rng = np.random.default_rng(5)
    for _ in range(40):
        p = arc(rng.uniform(50, 300), 7, tuple(rng.uniform(-50, 50, 2)), rng.uniform(0.8, 2)) + rng.normal(0, 0.5, (7, 2))
        q = p - p.mean(0)
        z = (q * q).sum(1)
        m = np.column_stack([z, q, np.ones(len(q))])
        c = np.array([[8 * z.mean(), 0, 0, 2], [0, 1, 0, 0], [0, 0, 1, 0], [2, 0, 0, 0]]) if method == "hyper" else np.array([[0, 0, 0, -2], [0, 1, 0, 0], [0, 0, 1, 0], [-2, 0, 0, 0]])
        values, vectors = np.linalg.eig(np.linalg.solve(c, m.T @ m))
        best = np.argmin(np.where(values.real > 0, values.real, np.inf))
        a, b, d, e = vectors[:, best].real
        radius = math.sqrt(b * b + d * d - 4 * a * e) / abs(2 * a)
        assert circles.fit(p[None], method)[0][1] == pytest.approx(radius, rel=1e-6)


def test_collinear_points_have_no_circle(spark):
    line = np.column_stack([np.arange(5.0), np.zeros(5)])[None]
    assert np.isnan(circles.fit(line, "threept")).all()
    got = frames.curvature(frames.flags(video(spark, [0, 1])), FrameConfig(fit="threept")).first()
    assert got["curvature_1_px"] is None and got["curvature_1_class"] is None


def test_arc_length_bounds(spark):
    df = frames.flags(video(spark, [0], {(0, "MFC3"): (0.0, 5.0, 0.9)}))
    fits = [frames.curvature(df, FrameConfig(length_mm=b), ("curvature_1",)).first()["curvature_1_px"] for b in ((None, None), (100.0, 200.0), (200.0, None), (None, 100.0))]
    assert fits[0] is not None and fits[0] == fits[1] and fits[2] is None and fits[3] is None


def test_settings_by_set(spark):
    df = frames.flags(video(spark, [0], {(0, "MFC3"): (0.0, 5.0, 0.9), (0, "Tail2"): (0.0, 30.0, 0.9)}))
    cfg = FrameConfig(sets={"front": PARTS[:6], "back": PARTS[5:]}, length_mm={"front": (None, 50.0)})
    got = frames.curvature(df, cfg).first()
    assert got["front_px"] is None and got["back_px"] is not None and cfg.least_points("front") == 5


def test_weights_choose_the_triplet():
    rng = np.random.default_rng(2)
    p = rng.normal(0, 50, (6, 5, 2))
    w = rng.uniform(0, 3, (6, 5))
    got = circles.fit(p, "threept", w)
    for row, points, weights in zip(got, p, w, strict=True):
        best = max(((abs(np.linalg.det([points[j] - points[i], points[k] - points[i]])) * (weights[i] + weights[j] + weights[k]), (i, j, k)) for i in range(5) for j in range(i + 1, 5) for k in range(j + 1, 5)))[1]
        assert row == pytest.approx(circles.fit(points[None, list(best)], "threept")[0])
    assert circles.fit(p, "threept", np.ones((6, 5))) == pytest.approx(circles.fit(p, "threept"))


def test_weights_as_a_column(spark):
    p = arc(80.0, 5)
    df = spark.createDataFrame([(p.tolist(), [1.0] * 5), (p[:2].tolist(), [1.0] * 2), (None, None)], "p array<array<double>>, w array<double>")
    points = F.transform("p", lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))
    got = [r["r"] for r in df.select(circles.fit_circle(points, "threept", F.col("w")).alias("c")).select(F.col("c.radius").alias("r")).collect()]
    assert got == [pytest.approx(80.0), None, None]


def test_unknown_fit_is_an_error():
    with pytest.raises(ValueError):
        circles.fit(arc(10)[None], "other")


def test_class_edges(spark):
    from tidewake.functions.geometry import curvature_class

    got = spark.createDataFrame([(0.0033,), (0.01,), (0.02,), (0.003,), (None,)], "k double").select(curvature_class(F.col("k")).alias("c"))
    assert [r["c"] for r in got.collect()] == ["Normal", "Extreme", "Invalid", "Minimal", None]


def test_rounding_rules(spark):
    names = {"curvature_1_mm": 0.00335, "curvature_2_mm": 0.03, "body_length_mm": 200.0, "body_length_std_mm": 12.5, "Head1_frame_dist_mm": 2.5, "Tail1_swim_frequency_hz": 1.23456, "Tail1_one_sided_frequency_hz": 1.23456, "u_shape_percentage": 1.005, "Head1_x": 1.23456}
    got = rounding.round_frames(spark.createDataFrame([tuple(names.values())], ", ".join(f"{n} double" for n in names))).first().asDict()
    assert got == {"curvature_1_mm": 0.0034, "curvature_2_mm": None, "body_length_mm": None, "body_length_std_mm": None, "Head1_frame_dist_mm": 2.0, "Tail1_swim_frequency_hz": 1.2346, "Tail1_one_sided_frequency_hz": 1.2346, "u_shape_percentage": 1.0, "Head1_x": 1.235}
    assert [rounding.table_digits(n, False) for n in ("curvature_1_mm_mean", "tail1_hz", "skipped_rate_window_pct", "mid_time_s", "sum_x", "fps", "x", "x_n")] == [5, 2, 2, 3, 2, 2, 3, None]


def test_summary_of_a_video_without_frames_in_order(spark):
    got = summary.video_summary(frames.curvature_by_ends(run(video(spark, [0, 3, 6], {(1, "Head1"): (0.0, 0.0, 0.1)}))), sets=("curvature_1",)).first()
    assert (got["total_frames"], got["skipped_frames_missing_invalid"], got["Head1_total_distance_mm"], got["curvature_1_std_mm"]) == (3, 1, 12.0, None)
    assert got["MFC5_swim_frequency_hz"] == 0.0 and got["Tail1_swimming_efficiency_%"] is None


def test_tracking_table_has_its_columns(spark):
    got = frames.tracking_table(frames.analyse(video(spark, [0, 3])))
    assert len(got.columns) == 175 and got.count() == 2


def test_fit_is_there_for_sql(spark):
    circles.register(spark)
    p = arc(50.0)
    df = spark.createDataFrame([(p[:, 0].tolist(), p[:, 1].tolist())], "xs array<double>, ys array<double>")
    assert df.selectExpr("fit_circle(xs, ys).radius AS r").first()["r"] == pytest.approx(50.0)
    gaps = spark.createDataFrame([(None, None), ([1.0], [2.0]), ([1.0, None, 2.0], [0.0, 1.0, 5.0]), ([1.0, 2.0, 4.0], [1.0])], "xs array<double>, ys array<double>")
    assert [r["r"] for r in gaps.selectExpr("fit_circle(xs, ys).radius AS r").collect()] == [None] * 4


def test_cpu_share():
    from tidewake.config import cpu_share

    assert [cpu_share(8, 0.5), cpu_share(1, 0.4)] == [4, 1]


@pytest.mark.parametrize("method", ["hyper", "pratt"])
def test_fits_as_expressions_are_those_of_arrays(spark, method):
    """Random, straight, circular, repeated and missing points: expressions and numpy agree."""
    rng = np.random.default_rng(4)
    sets = [rng.normal(size=(n, 2)) * s for n in (3, 4, 5, 11) for s in (0.1, 1, 300) for _ in range(10)]
    sets += [np.column_stack([np.arange(5.0), 2 * np.arange(5.0)]), np.ones((4, 2)), np.array([[0.0, 1], [1, 0], [0, -1], [-1, 0]]), np.array([[1.0, 2], [3, 4]]), np.zeros((0, 2))]
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in p] + [None, (None, 1.0)]) for k, p in enumerate(sets)] + [(999, None)], "k int, p array<struct<x:double,y:double>>")
    got = {r["k"]: r["c"] for r in df.select("k", circles.fit_circle(F.col("p"), method).alias("c")).collect()}
    assert got[999] is None or got[999]["radius"] is None
    for k, p in enumerate(sets):
        want = circles.fit(p[None], method)[0] if len(p) else [np.nan] * 4
        assert [got[k][f] is None for f in ("kappa", "radius", "cx", "cy")] == [bool(np.isnan(w)) for w in want] or want[1] > 1e6  # straight: rounding decides
        if got[k]["radius"] is not None and want[1] < 1e6:
            assert [got[k][f] for f in ("kappa", "radius", "cx", "cy")] == pytest.approx(list(want), rel=1e-6, abs=1e-6)
