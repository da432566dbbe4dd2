"""Circle fits of point lists: the algebraic ones as expressions, the one through three points batched over an Arrow batch.

Both algebraic fits minimise A z + B x + C y + D over centred points, z = x^2 + y^2, under a quadratic constraint N on the
coefficients; Pratt takes B^2 + C^2 - 4 A D = 1 and the hyper-accurate one 8 zbar A D + ... = 1. In moment form the constraint
multiplier is the root next to zero of a quartic, found by Newton steps from zero; both quartics share their coefficients
and the radius differs in the sign of that root's term.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "kappa double, radius double, cx double, cy double"


def _algebraic(p: np.ndarray, hyper: bool) -> np.ndarray:
    """p: rows x points x 2 -> rows x (radius, cx, cy); NaN where no circle fits."""
    middle = p.mean(axis=1, keepdims=True)
    x, y = (p - middle)[..., 0], (p - middle)[..., 1]
    z = x * x + y * y
    mxx, myy, mxy = (x * x).mean(1), (y * y).mean(1), (x * y).mean(1)
    mxz, myz, mzz = (x * z).mean(1), (y * z).mean(1), (z * z).mean(1)
    mz, cov, var = mxx + myy, mxx * myy - mxy * mxy, mzz - (mxx + myy) ** 2
    if hyper:
        a2 = 4 * cov - 3 * mz * mz - mzz
        a1 = var * mz + 4 * cov * mz - mxz * mxz - myz * myz
        a0 = mxz * (mxz * myy - myz * mxy) + myz * (myz * mxx - mxz * mxy) - var * cov
    else:
        a2 = 4 * cov - 3 * mz * mz - mzz
        a1 = mzz * mz + 4 * cov * mz - mxz * mxz - myz * myz - mz**3
        a0 = mxz * mxz * myy + myz * myz * mxx - mzz * cov - 2 * mxz * myz * mxy + mz * mz * cov
    root = np.zeros(len(p))
    with np.errstate(all="ignore"):
        value = a0.copy()
        for _ in range(99):
            slope = a1 + root * (2 * a2 + 16 * root * root)
            new = root - value / slope
            new_value = a0 + new * (a1 + new * (a2 + 4 * new * new))
            better = np.isfinite(new) & (np.abs(new_value) < np.abs(value))
            if not better.any():
                break
            root, value = np.where(better, new, root), np.where(better, new_value, value)
        det = root * root - root * mz + cov
        cx = (mxz * (myy - root) - myz * mxy) / det / 2
        cy = (myz * (mxx - root) - mxz * mxy) / det / 2
        radius = np.sqrt(cx * cx + cy * cy + mz + (-2 if hyper else 2) * root)
    out = np.column_stack([radius, cx + middle[:, 0, 0], cy + middle[:, 0, 1]])
    out[~(np.isfinite(radius) & (radius > 0) & np.isfinite(cx) & np.isfinite(cy))] = np.nan
    return out


def _three_points(p: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The circle of the triplet with the largest area times the weights of its points, the first of equals; all triplets of 12 points or fewer, else of ten spread ones."""
    n = p.shape[1]
    w = np.ones(p.shape[:2]) if weights is None else np.maximum(weights, 1e-6)
    at = list(range(n)) if n <= 12 else [0, *np.linspace(1, n - 2, 8, dtype=int).tolist(), n - 1]
    triplets = [*combinations(at, 3), (0, n // 2, n - 1)]
    best, out = np.full(len(p), -1.0), np.full((len(p), 3), np.nan)
    with np.errstate(all="ignore"):
        for i, j, k in triplets:
            u, v = p[:, j] - p[:, i], p[:, k] - p[:, i]
            cross = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
            u2, v2 = (u * u).sum(1), (v * v).sum(1)
            ox, oy = (v[:, 1] * u2 - u[:, 1] * v2) / (2 * cross), (u[:, 0] * v2 - v[:, 0] * u2) / (2 * cross)
            radius, score = np.hypot(ox, oy), np.abs(cross) * (w[:, i] + w[:, j] + w[:, k])
            win = (np.abs(cross) >= 1e-6) & (score > best) & np.isfinite(radius) & (radius > 0)
            best = np.where(win, score, best)
            out[win] = np.column_stack([radius, p[:, i, 0] + ox, p[:, i, 1] + oy])[win]
    return out


METHODS = ("hyper", "pratt", "threept")


def fit(points: np.ndarray, method: str, weights: np.ndarray | None = None) -> np.ndarray:
    """rows x points x 2 -> rows x (kappa, radius, cx, cy). weights: rows x points, for the fit through three points."""
    if method not in METHODS:
        raise ValueError(f"unknown fit {method!r}")
    if points.shape[1] < 3:
        return np.full((len(points), 4), np.nan)
    got = _three_points(points, weights) if method == "threept" else _algebraic(points, method == "hyper")
    return np.column_stack([1.0 / got[:, 0], got])


def _fit_lists(method: str, *lists: pa.Array) -> pa.Array:
    """Lists of x, y and, where given, weights: rows of equal length are fitted together; null or short lists, and lists of unequal lengths or with gaps, have null fields."""
    sizes = [np.asarray(c.value_lengths().fill_null(0)) for c in lists]
    # null lists have no values in what flatten gives
    flat = [np.asarray(c.flatten().cast(pa.float64()).fill_null(np.nan)) for c in lists]
    ends, out = [np.cumsum(s) for s in sizes], np.full((len(sizes[0]), 4), np.nan)
    same = np.all([s == sizes[0] for s in sizes], axis=0)
    for n in np.unique(sizes[0][same & (sizes[0] >= 3)]):
        rows = np.flatnonzero(same & (sizes[0] == n))
        x, y, *w = (f[(e[rows] - n)[:, None] + np.arange(n)] for f, e in zip(flat, ends, strict=True))
        out[rows] = fit(np.stack([x, y], axis=2), method, *w)
    return pa.StructArray.from_arrays([pa.array(out[:, k], pa.float64(), mask=~np.isfinite(out[:, k])) for k in range(4)], ["kappa", "radius", "cx", "cy"])


#: Newton steps at most; they end where a step no longer helps, after ten or so.
STEPS = 60


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def algebraic(points: Column, hyper: bool) -> Column:
    """struct (kappa, radius, cx, cy) of array<struct<x, y>> without gaps, in expressions only; null fields where no circle fits."""

    def fields(kappa: Column, radius: Column, cx: Column, cy: Column) -> Column:
        return F.struct(kappa.alias("kappa"), radius.alias("radius"), cx.alias("cx"), cy.alias("cy"))

    none = fields(*[F.lit(None).cast("double")] * 4)
    sums = lambda names: F.struct(*[F.lit(0.0).alias(n) for n in names])
    plus = lambda names: lambda acc, p: F.struct(*[(acc[n] + of(p)).alias(n) for n, of in names.items()])
    middle = {"x": lambda p: p["x"], "y": lambda p: p["y"]}
    products = {"xx": ("x", "x"), "yy": ("y", "y"), "xy": ("x", "y"), "xz": ("x", "z"), "yz": ("y", "z"), "zz": ("z", "z")}
    products = {n: (lambda p, a=a, b=b: p[a] * p[b]) for n, (a, b) in products.items()}

    def from_middle(m: Column) -> Column:
        centred = F.transform(points, lambda p: F.struct((p["x"] - m["x"]).alias("x"), (p["y"] - m["y"]).alias("y")))
        with_z = F.transform(centred, lambda p: F.struct(p["x"], p["y"], (p["x"] * p["x"] + p["y"] * p["y"]).alias("z")))
        n = F.size(points)
        moments = F.aggregate(with_z, sums(products), plus(products), lambda acc: F.struct(*[(acc[k] / n).alias(k) for k in products]))
        return _let(moments, lambda q: _let(F.struct(*q_fields(q)), lambda c: from_moments(m, c)))

    def q_fields(q: Column) -> list[Column]:
        mz, cov = q["xx"] + q["yy"], q["xx"] * q["yy"] - q["xy"] * q["xy"]
        return [*[q[k].alias(k) for k in products], mz.alias("mz"), cov.alias("cov"), (q["zz"] - mz * mz).alias("var")]

    def from_moments(m: Column, q: Column) -> Column:
        xz, yz, mz, cov = q["xz"], q["yz"], q["mz"], q["cov"]
        a2 = 4 * cov - 3 * mz * mz - q["zz"]
        if hyper:
            a1 = q["var"] * mz + 4 * cov * mz - xz * xz - yz * yz
            a0 = xz * (xz * q["yy"] - yz * q["xy"]) + yz * (yz * q["xx"] - xz * q["xy"]) - q["var"] * cov
        else:
            a1 = q["zz"] * mz + 4 * cov * mz - xz * xz - yz * yz - mz * mz * mz
            a0 = xz * xz * q["yy"] + yz * yz * q["xx"] - q["zz"] * cov - 2 * xz * yz * q["xy"] + mz * mz * cov
        return _let(F.struct(a0.alias("a0"), a1.alias("a1"), a2.alias("a2")), lambda a: _let(newton(a), lambda root: circle(m, q, root)))

    def newton(a: Column) -> Column:
        state = lambda root, value, ended: F.struct(root.alias("root"), value.alias("value"), ended.alias("ended"))

        def step(acc: Column, _: Column) -> Column:
            slope = a["a1"] + acc["root"] * (2 * a["a2"] + 16 * acc["root"] * acc["root"])

            def tried(new: Column) -> Column:
                value = a["a0"] + new * (a["a1"] + new * (a["a2"] + 4 * new * new))
                better = lambda v: F.when(F.abs(v) < F.abs(acc["value"]), state(new, v, F.lit(False))).otherwise(state(acc["root"], acc["value"], F.lit(True)))
                return _let(value, better)

            return F.when(acc["ended"], acc).otherwise(_let(acc["root"] - F.try_divide(acc["value"], slope), tried))

        return F.aggregate(F.array_repeat(F.lit(0), STEPS), state(F.lit(0.0), a["a0"], F.lit(False)), step, lambda acc: acc["root"])

    def circle(m: Column, q: Column, root: Column) -> Column:
        det = root * root - root * q["mz"] + q["cov"]
        cx = F.try_divide(q["xz"] * (q["yy"] - root) - q["yz"] * q["xy"], det) / 2
        cy = F.try_divide(q["yz"] * (q["xx"] - root) - q["xz"] * q["xy"], det) / 2
        at = lambda c: _let(F.sqrt(c["cx"] * c["cx"] + c["cy"] * c["cy"] + q["mz"] + (-2 if hyper else 2) * root), lambda r: F.when((r > 0) & (r < float("inf")), fields(1 / r, r, c["cx"] + m["x"], c["cy"] + m["y"])).otherwise(none))
        return _let(F.struct(cx.alias("cx"), cy.alias("cy")), at)

    middles = F.aggregate(points, sums(middle), plus(middle), lambda acc: F.struct(*[(acc[k] / F.size(points)).alias(k) for k in middle]))
    return F.when(F.size(points) >= 3, _let(middles, from_middle)).otherwise(none)


def fit_circle(points: Column, method: str = "hyper", weights: Column | None = None) -> Column:
    """struct (kappa, radius, cx, cy) of array<struct<x, y>>; missing points are left out; a row that no circle fits is null fields, not an error.

    The algebraic fits are expressions, the one through three points is a trip to Python. weights: array<double> beside the points,
    for that one; a point without one weighs the least.
    """
    if method not in METHODS:
        raise ValueError(f"unknown fit {method!r}")
    there = lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull()
    if method != "threept":
        return algebraic(F.filter(points, there), method == "hyper")
    if weights is None:

        @F.arrow_udf(RESULT)
        def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
            return _fit_lists(method, xs, ys)

        kept = F.filter(points, there)
        return run(F.transform(kept, lambda p: p["x"]), F.transform(kept, lambda p: p["y"]))

    @F.arrow_udf(RESULT)
    def run_weighted(xs: pa.Array, ys: pa.Array, ws: pa.Array) -> pa.Array:
        return _fit_lists(method, xs, ys, ws)

    pairs = F.filter(F.zip_with(points, weights, lambda p, w: F.struct(p.alias("p"), F.coalesce(w, F.lit(0.0)).alias("w"))), lambda z: there(z["p"]))
    return run_weighted(*[F.transform(pairs, f) for f in (lambda z: z["p"]["x"], lambda z: z["p"]["y"], lambda z: z["w"])])


_POINTS = "_circle_points"


@cache
def _on_points(application: str, hyper: bool) -> Column:
    """The fit of the column _POINTS: some hundreds of nodes, so it is built once for a session."""
    return algebraic(F.col(_POINTS), hyper)


def with_circles(df: DataFrame, points: dict[str, Column], method: str = "hyper") -> DataFrame:
    """Adds ``fit_circle`` of several lists of points by name."""
    if method not in METHODS:
        raise ValueError(f"unknown fit {method!r}")
    if method == "threept":
        return df.withColumns({n: fit_circle(p, method) for n, p in points.items()})  # one trip to Python for all
    fit_ = _on_points(df.sparkSession.sparkContext.applicationId, method == "hyper")
    for name, p in points.items():
        df = df.withColumn(_POINTS, F.filter(p, lambda z: z.isNotNull() & z["x"].isNotNull() & z["y"].isNotNull())).withColumn(name, fit_)
    return df.drop(_POINTS)


def register(spark, name: str = "fit_circle", method: str = "hyper") -> None:
    """fit_circle(xs, ys) for SQL; nulls as in ``fit_circle``."""

    @F.pandas_udf(RESULT)
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        got = _fit_lists(method, *[pa.array(list(s), pa.list_(pa.float64())) for s in (xs, ys)])
        return pd.DataFrame({f.name: got.field(k).to_pandas() for k, f in enumerate(got.type)})

    spark.udf.register(name, run)
