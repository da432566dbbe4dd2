"""Plane geometry on points struct<x, y>, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def distance(a: Column, b: Column) -> Column:
    """Null if a point is missing."""
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def path_length(points: list[Column]) -> Column:
    """Length of a polyline; null if any point is missing."""
    total = F.lit(0.0)
    for a, b in zip(points, points[1:], strict=False):
        total = total + distance(a, b)
    return total


def with_circumcircle(df: DataFrame, p: Column, q: Column, r: Column, to: str = "_") -> DataFrame:
    """Adds {to}kappa, {to}radius, {to}cx, {to}cy of the circle through three points; nulls where they are on a line.

    Step by step, so that each intermediate value is computed once and the generated code stays small.
    """
    ux, uy, vx, vy, cross, u2, v2, ox, oy, radius = (F.col(f"{to}{n}") for n in ("ux", "uy", "vx", "vy", "cross", "u2", "v2", "ox", "oy", "radius"))
    df = df.withColumns({f"{to}px": p["x"], f"{to}py": p["y"], f"{to}ux": q["x"] - p["x"], f"{to}uy": q["y"] - p["y"], f"{to}vx": r["x"] - p["x"], f"{to}vy": r["y"] - p["y"]})
    df = df.withColumns({f"{to}cross": 2.0 * (ux * vy - uy * vx), f"{to}u2": ux * ux + uy * uy, f"{to}v2": vx * vx + vy * vy})
    ok = F.abs(cross) >= 1e-12
    df = df.withColumns({f"{to}ox": F.when(ok, (vy * u2 - uy * v2) / cross), f"{to}oy": F.when(ok, (ux * v2 - vx * u2) / cross)})
    size = F.sqrt(ox * ox + oy * oy)
    df = df.withColumn(f"{to}radius", F.when(size > 0, size))
    df = df.withColumns({f"{to}kappa": 1.0 / radius, f"{to}cx": F.when(radius.isNotNull(), F.col(f"{to}px") + ox), f"{to}cy": F.when(radius.isNotNull(), F.col(f"{to}py") + oy)})
    return df.drop(*[f"{to}{n}" for n in ("px", "py", "ux", "uy", "vx", "vy", "cross", "u2", "v2", "ox", "oy")])


def curvature_class(k: Column, extreme: float = 0.01, normal: float = 0.0033, invalid: float = 0.02) -> Column:
    a = F.abs(k)
    return F.when(a >= invalid, "Invalid").when(a >= extreme, "Extreme").when(a >= normal, "Normal").when(a.isNotNull(), "Minimal")


def bend_side(cx: Column, cy: Column, head: Column, tail: Column) -> Column:
    """U or N by the side of the head-tail line on which the centre lies; Unknown on it or without points."""
    cross = (tail["x"] - head["x"]) * (cy - head["y"]) - (tail["y"] - head["y"]) * (cx - head["x"])
    return F.when(cross > 0, "U").when(cross < 0, "N").otherwise("Unknown")


def lateral(p: Column, start: Column, end: Column) -> Column:
    """Signed distance of a point from the line start - end; null where the line has no length."""
    dx, dy = end["x"] - start["x"], end["y"] - start["y"]
    length = F.sqrt(dx * dx + dy * dy)
    return F.when(length > 0, dx / length * (p["y"] - start["y"]) - dy / length * (p["x"] - start["x"]))


def crop(width: Column, height: Column, offset_x: Column, offset_y: Column, crop_w: Column, crop_h: Column) -> dict[str, Column]:
    """Centre of a frame with offsets and the crop rectangle around it, kept inside the frame."""
    cx, cy = F.floor(width / 2) + offset_x, F.floor(height / 2) + offset_y
    x0, y0 = F.greatest(F.lit(0), cx - F.floor(crop_w / 2)), F.greatest(F.lit(0), cy - F.floor(crop_h / 2))
    return {"cx": cx, "cy": cy, "x0": x0, "y0": y0, "x1": F.least(width, cx + F.floor(crop_w / 2)), "y1": F.least(height, cy + F.floor(crop_h / 2))}
