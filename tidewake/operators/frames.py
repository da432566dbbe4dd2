"""Frame kinematics: from keypoints by frame to flags, distances, lengths, curvature and tail beats.

Input is (video_id, frame, kp array<struct<part, x, y, likelihood>>) with one row for each frame. The machine that walks from
frame to frame becomes window functions over (video, frame): a rejected frame is an odd place in a run of bad frames among
the valid ones, and "the last accepted frame" is the last non-null among the rows above. Points travel as one array, so each
window has one expression instead of one for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.config import MFC_PARTS, ONE_SIDED, PARTS, SWIM_PARTS, FrameConfig
from tidewake.functions.circles import with_circles
from tidewake.functions.geometry import bend_side, curvature_class, distance, lateral, path_length, with_circumcircle

AT = {p: k for k, p in enumerate(PARTS)}


def at(points: str | Column, part: str) -> Column:
    """A part's point in an array of points."""
    return (F.col(points) if isinstance(points, str) else points)[AT[part]]


def gate(kp: Column, cfg: FrameConfig = FrameConfig()) -> Column:
    """Points whose likelihood reaches the threshold; others are null."""
    return F.transform(kp, lambda p: F.when((p["likelihood"] >= cfg.likelihood) & p["x"].isNotNull() & p["y"].isNotNull(), F.struct(p["x"].alias("x"), p["y"].alias("y"))))


def all_likely(kp: Column, parts: tuple[str, ...], cfg: FrameConfig = FrameConfig()) -> Column:
    """Whether the likelihood of every part of a set reaches the threshold, whatever its x and y."""
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(kp[AT[p]]["likelihood"] >= cfg.likelihood, F.lit(False))
    return out


def lengths(df: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """mfc_length_px/mm and body_length_px/mm on valid rows; a body outside its bounds has none."""
    mfc = F.when(F.col("valid"), path_length([at("pts", p) for p in MFC_PARTS]))
    body = F.when(F.col("valid"), path_length([at("pts", p) for p in PARTS]))
    inside = (body * cfg.mm_per_px).between(*cfg.body_mm)
    return df.withColumns({"mfc_length_px": mfc, "mfc_length_mm": mfc * cfg.mm_per_px, "body_length_px": F.when(inside, body), "body_length_mm": F.when(inside, body * cfg.mm_per_px)})


def _run():
    return W.partitionBy("video_id").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)


def _above():
    return W.partitionBy("video_id").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)


def measured(df: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """Adds what a frame says by itself: pts, valid and lengths."""
    return lengths(df.withColumn("pts", gate(F.col("kp"), cfg)).withColumn("valid", F.forall("pts", lambda p: p.isNotNull())), cfg)


def jump_limit(cfg: FrameConfig = FrameConfig()) -> Column:
    """How far a part may go between valid frames; to be taken behind a window, where the length is worked out already."""
    return F.greatest(F.lit(cfg.jump_px), F.coalesce(cfg.jump_of_body * F.col("body_length_px"), F.lit(cfg.jump_px)))


def jumps(pts: str | Column, before: str | Column, limit: Column, cfg: FrameConfig = FrameConfig()) -> Column:
    """Whether enough parts lie farther than the limit from where they were; false where either is missing."""
    far = sum((F.coalesce(distance(at(pts, p), at(before, p)) > limit, F.lit(False)).cast("int") for p in PARTS), F.lit(0))
    return far >= cfg.jump_parts


def judged(df: DataFrame) -> DataFrame:
    """skip and accepted from bad and place: of a run of bad frames among the valid ones every other has grace."""
    df = df.withColumn("skip", F.col("bad") & (F.col("place") % 2 == 1))
    return df.withColumn("accepted", F.col("valid") & ~F.col("skip"))


def flags(df: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """Adds pts, valid, lengths, bad, skip and accepted.

    Every window here and below is over (video_id, frame): one exchange by video and one sort serve them all. A recording too
    long for one task is walked by ``segments.walk``, which gives the same rows.
    """
    df = measured(df.repartition("video_id"), cfg)
    run, above = _run(), _above()
    df = df.withColumn("last_valid", F.when(F.col("valid"), F.last(F.when(F.col("valid"), F.col("pts")), ignorenulls=True).over(above))).withColumn("jump_limit", jump_limit(cfg))
    df = df.withColumn("bad", F.col("valid") & F.col("last_valid").isNotNull() & jumps("pts", "last_valid", F.col("jump_limit"), cfg)).drop("jump_limit")
    # a bad frame's place in its run: bad frames so far, less those up to the last good one
    df = df.withColumn("bad_so_far", F.sum(F.col("bad").cast("long")).over(run))
    before = F.last(F.when(F.col("valid") & ~F.col("bad"), F.col("bad_so_far")), ignorenulls=True).over(run)
    df = judged(df.withColumn("place", F.col("bad_so_far") - F.coalesce(before, F.lit(0))))
    return df.drop("last_valid", "bad_so_far", "place")


def steps(accepted: Column, pts: str | Column = "pts", last: str | Column = "last", cfg: FrameConfig = FrameConfig()) -> dict[str, Column]:
    """_d0, _d1, ...: how far each part went since the accepted frame before; null without one, 0 below the jitter."""
    step = [distance(at(pts, p), at(last, p)) for p in PARTS]
    return {f"_d{k}": F.when(accepted, F.when(s < cfg.jitter_px, 0.0).otherwise(s)) for k, s in enumerate(step)}


def distances(df: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """Adds last (points of the accepted frame before), and dist_px and cum_px, arrays by part.

    dist_px is null on rejected frames and on a video's first accepted one, and 0 below the jitter; cum_px carries on.
    """
    df = df.withColumn("last", F.when(F.col("accepted"), F.last(F.when(F.col("accepted"), F.col("pts")), ignorenulls=True).over(_above())))
    df = df.withColumns(steps(F.col("accepted"), cfg=cfg))
    run = _run()
    return gathered(df.withColumns({f"_c{k}": F.sum(F.coalesce(f"_d{k}", F.lit(0.0))).over(run) for k in range(len(PARTS))}))


def gathered(df: DataFrame) -> DataFrame:
    """dist_px and cum_px from the columns of each part."""
    out = df.withColumns({"dist_px": F.array(*[F.col(f"_d{k}") for k in range(len(PARTS))]), "cum_px": F.array(*[F.col(f"_c{k}") for k in range(len(PARTS))])})
    return out.drop(*[f"_{c}{k}" for c in "dc" for k in range(len(PARTS))])


def long_distances(df: DataFrame) -> DataFrame:
    """(video_id, frame, part, dist_px, cum_px), a row for each part."""
    zipped = F.arrays_zip(F.array(*[F.lit(p) for p in PARTS]).alias("part"), "dist_px", "cum_px")
    return df.select("video_id", "frame", F.explode(zipped).alias("z")).select("video_id", "frame", "z.part", "z.dist_px", "z.cum_px")


def signed(df: DataFrame) -> DataFrame:
    """Adds {p}_sign, _signs (all of a row, null on rows without a reference line) and _on."""
    sign = {p: F.when(F.col("accepted"), lateral(at("pts", p), at("pts", "Head1"), F.coalesce(at("pts", "Head2"), at("pts", "MFC1")))) for p in SWIM_PARTS}
    df = df.withColumns({f"{p}_sign": c for p, c in sign.items()})
    return df.withColumn("_signs", F.when(F.col(f"{SWIM_PARTS[0]}_sign").isNotNull(), F.array(*[F.col(f"{p}_sign") for p in SWIM_PARTS]))).withColumn("_on", F.col("_signs").isNotNull())


def turns(signs: Column, before: Column) -> dict[str, Column]:
    """{p}_swim and {p}_bend of a row with signs, by those of the last row that had any."""
    new = {}
    for k, p in enumerate(SWIM_PARTS):
        now, was = signs[k], before[k]
        flip = F.coalesce(((was < 0) & (now > 0)) | ((was > 0) & (now < 0)), F.lit(False))
        same = F.coalesce(((was > 0) & (now > 0)) | ((was < 0) & (now < 0)), F.lit(False)) & (F.abs(now - was) > ONE_SIDED[p])
        new |= {f"{p}_swim": flip.cast("long"), f"{p}_bend": (~flip & same).cast("long")}
    return new


def travels(signs: Column, above: Column, pts: str | Column = "pts", last: str | Column = "last", cfg: FrameConfig = FrameConfig()) -> dict[str, Column]:
    """{p}_rel and {p}_travel of a row: both need signs on the row just above."""
    new, follows = {}, signs.isNotNull() & above.isNotNull()
    for k, p in enumerate(SWIM_PARTS):
        step = distance(at(pts, p), at(last, p))
        new |= {f"{p}_rel": F.when(follows, F.abs(signs[k] - above[k])).otherwise(0.0), f"{p}_travel": F.when(follows & (step >= cfg.jitter_px), step).otherwise(0.0)}
    return new


MEASURES = ("swim", "bend", "rel", "travel")


def restarted(df: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """{p}_cum_travel_whole, and the restarts of the cumulative columns that the settings ask for."""
    dead = F.col("accepted") & ~F.col("_on")  # a reference line without length leaves the initial zeros
    restart = F.col("_on") & F.col("_above").isNull()
    last = {}
    for p in SWIM_PARTS:
        last[f"{p}_cum_travel_whole"] = F.col(f"{p}_cum_travel")
        if cfg.compat_quirks:
            last |= {f"{p}_cum_{m}": F.when(dead, 0).otherwise(F.col(f"{p}_cum_{m}")) for m in ("swim", "bend")}
            last |= {f"{p}_cum_{m}": F.when(dead | restart, 0.0).otherwise(F.col(f"{p}_cum_{m}")) for m in ("rel", "travel")}
    return df.withColumns(last).drop("_signs", "_on", "_before", "_above")


def swim(df: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """Adds by swim part p: {p}_sign, _swim, _bend, _cum_swim, _cum_bend, _rel, _cum_rel, _travel, _cum_travel (px) and _cum_travel_whole without restarts.

    A swim event is a change of side between accepted frames; a one-sided bend a step over the part's threshold on one side.
    Relative travel and travel need a sign on the row just before.
    """
    df = signed(df)
    df = df.withColumn("_before", F.when(F.col("_on"), F.last("_signs", ignorenulls=True).over(_above())))
    df = df.withColumn("_above", F.lag("_signs").over(W.partitionBy("video_id").orderBy("frame")))
    df = df.withColumns(turns(F.col("_signs"), F.col("_before")) | travels(F.col("_signs"), F.col("_above"), cfg=cfg))
    run = _run()
    df = df.withColumns({f"{p}_cum_{m}": F.sum(f"{p}_{m}").over(run) for p in SWIM_PARTS for m in MEASURES})
    return restarted(df, cfg)


def _curvature_columns(df: DataFrame, name: str, kappa: Column, radius: Column, cx: Column, cy: Column, cfg: FrameConfig) -> DataFrame:
    """The columns of one curvature set from a fit: what bends beyond the limit is Invalid and has no figures."""
    df = df.withColumn("_mm", kappa / cfg.mm_per_px)
    mm, ok = F.col("_mm"), F.abs("_mm") <= cfg.invalid
    label = F.when(ok & F.col("body_length_mm").isNull(), "Invalid").when(ok, curvature_class(mm, cfg.extreme, cfg.normal, cfg.invalid)).when(mm.isNotNull(), "Invalid")
    side = bend_side(cx, cy, at("pts", "Head1"), at("pts", cfg.sets[name][-1]))
    df = df.withColumns({f"{name}_class": label, "_side": side})
    bent = lambda s: F.coalesce(ok & (F.col(f"{name}_class") != "Invalid") & (F.col("_side") == s), F.lit(False)).cast("long")
    return df.withColumns({
        f"{name}_px": F.when(ok, kappa), f"{name}_mm": F.when(ok, mm),
        f"{name}_radius_px": F.when(ok, F.bround(radius)), f"{name}_radius_mm": F.when(ok, F.bround(radius * cfg.mm_per_px)),
        f"{name}_center_x": F.when(ok, cx), f"{name}_center_y": F.when(ok, cy), f"{name}_u_shape": bent("U"), f"{name}_n_shape": bent("N"),
    }).drop("_mm", "_side")


def curvature(df: DataFrame, cfg: FrameConfig = FrameConfig(), sets: tuple[str, ...] | None = None) -> DataFrame:
    """Curvature columns of each set (all of the settings' if none are named) on accepted frames, by the configured fit."""
    sets, fits = sets or tuple(cfg.sets), {}
    for name in sets:
        low, high = cfg.bounds(name)
        points = F.array(*[at("pts", p) for p in cfg.sets[name]])
        seen = F.filter(points, lambda p: p.isNotNull())
        usable = F.col("accepted") & (F.size(seen) >= cfg.least_points(name))
        if low is not None or high is not None:
            arc = path_length([at("pts", p) for p in cfg.sets[name]]) * cfg.mm_per_px
            usable = usable & (arc >= low if low is not None else F.lit(True)) & (arc <= high if high is not None else F.lit(True))
        fits[f"_fit_{name}"] = F.when(usable, seen)
    df = with_circles(df, fits, cfg.fit)
    for name in sets:
        fit = F.col(f"_fit_{name}")
        df = _curvature_columns(df, name, fit["kappa"], fit["radius"], fit["cx"], fit["cy"], cfg)
    return df.drop(*fits)


def curvature_by_ends(df: DataFrame, name: str = "curvature_1", cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """Curvature columns of a set from the circle through its first, middle and last part; no Python."""
    parts = cfg.sets[name]
    ends = [F.when(F.col("accepted"), at("pts", p)) for p in (parts[0], parts[len(parts) // 2], parts[-1])]
    df = with_circumcircle(df, *ends)
    made = [F.col(f"_{k}") for k in ("kappa", "radius", "cx", "cy")]
    return _curvature_columns(df, name, *made, cfg).drop("_kappa", "_radius", "_cx", "_cy")


def analyse(df: DataFrame, cfg: FrameConfig = FrameConfig(), fits: bool = True) -> DataFrame:
    """All frame metrics in array form."""
    df = swim(distances(flags(df, cfg), cfg), cfg)
    return curvature(df, cfg) if fits else df


def tracking_table(df: DataFrame, cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """The wide table of the sink: pose, distance, curvature, swim and length columns, 174 and video_id, named as its readers expect."""
    r = cfg.mm_per_px
    cols = [F.col("video_id"), F.col("frame").alias("coords")]
    for k, p in enumerate(PARTS):
        cols += [F.col("kp")[k][c].alias(f"{p}_{c}") for c in ("x", "y", "likelihood")]
    for k, p in enumerate(PARTS):
        for name, c in (("frame_dist", F.col("dist_px")[k]), ("cum_dist", F.col("cum_px")[k])):
            cols += [c.alias(f"{p}_{name}_px"), (c * r).alias(f"{p}_{name}_mm")]
    for s in cfg.sets:
        cols += [F.col(f"{s}_{c}") for c in ("px", "mm", "radius_px", "radius_mm", "center_x", "center_y", "u_shape", "n_shape", "class")]
    for p in SWIM_PARTS:
        cols.append(F.col(f"{p}_sign"))
        for name, c in (("swim_count", "swim"), ("cumulative_swim_count", "cum_swim"), ("one_sided_bending_count", "bend"), ("cumulative_one_sided_bending_count", "cum_bend")):
            cols.append(F.col(f"{p}_{c}").alias(f"{p}_{name}"))
        for name, c in (("relative_travel_distance", "rel"), ("cumulative_relative_travel_distance", "cum_rel"), ("travel_distance", "travel"), ("cumulative_travel_distance", "cum_travel")):
            cols += [F.col(f"{p}_{c}").alias(f"{p}_{name}_px"), (F.col(f"{p}_{c}") * r).alias(f"{p}_{name}_mm")]
    return df.select(*cols, "mfc_length_px", "mfc_length_mm", "body_length_px", "body_length_mm")
