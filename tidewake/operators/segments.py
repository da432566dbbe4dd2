"""The walk from frame to frame over segments of a recording, so that one long recording spreads over tasks.

A segment is some thousands of frames of a video. What it does to the machine's state is a transition that composes: it hands
on its own last valid frame, last accepted frame and last signs, or those it was given; it adds to the counters; the place in a run
of bad frames starts anew at a good frame or carries on. Whatever depends on the frames before is at its edges only: its first valid
frame, the bad frames up to its first good one, its first accepted frame, first signs and first row. So two summaries of a row
for each segment (one for validity and grace, one for what follows from accepted frames) are scanned by video, and each
segment is walked with the state at its beginning. Frames are dealt by (video, segment); only summaries, a row for some
thousands of frames, are ordered by video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.config import PARTS, SWIM_PARTS, FrameConfig
from tidewake.operators import frames
from tidewake.shared import Scratch

KEY = ["video_id", "_seg"]
_SUMS = [f"_d{k}" for k in range(len(PARTS))] + [f"{p}_{m}" for p in SWIM_PARTS for m in frames.MEASURES]


def _order():
    return W.partitionBy(*KEY).orderBy("frame")


def _above():
    return _order().rowsBetween(W.unboundedPreceding, -1)


def _run():
    return _order().rowsBetween(W.unboundedPreceding, 0)


def _segments():
    return W.partitionBy("video_id").orderBy("_seg")  # over summaries


def _handed(name: str) -> Column:
    """The last value that a segment above handed on."""
    return F.last(name, ignorenulls=True).over(_segments().rowsBetween(W.unboundedPreceding, -1))


def _first(value: Column, where: Column) -> Column:
    return F.min_by(F.when(where, value), F.when(where, F.col("frame")))


def _last(value: Column, where: Column) -> Column:
    return F.max_by(F.when(where, value), F.when(where, F.col("frame")))


def _valid_above(df: DataFrame, cfg: FrameConfig) -> DataFrame:
    """_own_valid: the last valid frame above within the segment, null on the first valid one; and jump_limit."""
    return df.withColumn("_own_valid", F.when(F.col("valid"), F.last(F.when(F.col("valid"), F.col("pts")), ignorenulls=True).over(_above()))).withColumn("jump_limit", frames.jump_limit(cfg))


def _validity(df: DataFrame, cfg: FrameConfig) -> DataFrame:
    """(video_id, _seg, _in_valid, _in_place): the last valid points, and the bad frames since the last good one, before each segment."""
    df = _valid_above(df, cfg)
    first = F.col("valid") & F.col("_own_valid").isNull()
    df = df.withColumn("_bad", F.col("valid") & ~first & frames.jumps("pts", "_own_valid", F.col("jump_limit"), cfg))
    df = df.withColumn("_n_bad", F.sum(F.col("_bad").cast("long")).over(_run()))
    good = F.col("valid") & ~first & ~F.col("_bad")
    ends = df.groupBy(*KEY).agg(
        _first(F.struct("pts", F.col("jump_limit").alias("limit")), first).alias("first"), _last(F.col("pts"), F.col("valid")).alias("last"),
        F.max("_n_bad").alias("bad"), _last(F.col("_n_bad"), good).alias("at_good"))
    ends = ends.withColumn("_in_valid", _handed("last"))
    first_bad = F.col("first").isNotNull() & F.col("_in_valid").isNotNull() & frames.jumps(F.col("first.pts"), "_in_valid", F.col("first.limit"), cfg)
    ends = ends.withColumn("first_bad", first_bad).withColumn("upto", F.sum(F.col("bad") + F.col("first_bad").cast("long")).over(_segments().rowsBetween(W.unboundedPreceding, 0)))
    # bad frames after the last good one of a segment that has a good one
    trailing = F.when(F.col("at_good").isNotNull(), F.col("bad") - F.col("at_good")).when(F.col("first").isNotNull() & ~F.col("first_bad"), F.col("bad"))
    ends = ends.withColumn("base", F.col("upto") - trailing)
    place = F.coalesce(F.lag("upto").over(_segments()), F.lit(0)) - F.coalesce(_handed("base"), F.lit(0))
    return ends.select(*KEY, "_in_valid", place.alias("_in_place"))


def _judged(df: DataFrame, given: DataFrame, cfg: FrameConfig) -> DataFrame:
    """The rows with bad, skip and accepted as ``frames.flags`` has them, and with signs."""
    df = _valid_above(df.join(given, KEY), cfg)
    df = df.withColumn("_before_valid", F.when(F.col("valid"), F.coalesce("_own_valid", "_in_valid")))
    df = df.withColumn("bad", F.col("valid") & F.col("_before_valid").isNotNull() & frames.jumps("pts", "_before_valid", F.col("jump_limit"), cfg))
    df = df.withColumn("_n_bad", F.sum(F.col("bad").cast("long")).over(_run()))
    at_good = F.last(F.when(F.col("valid") & ~F.col("bad"), F.col("_n_bad")), ignorenulls=True).over(_run())
    df = frames.judged(df.withColumn("place", F.col("_n_bad") - F.coalesce(at_good, -F.col("_in_place"))))
    df = frames.signed(df)
    own = {"_own_last": F.when(F.col("accepted"), F.last(F.when(F.col("accepted"), F.col("pts")), ignorenulls=True).over(_above())),
           "_own_before": F.when(F.col("_on"), F.last("_signs", ignorenulls=True).over(_above())), "_own_above": F.lag("_signs").over(_order()), "_head": F.row_number().over(_order()) == 1}
    return df.withColumns(own).drop("_own_valid", "_in_valid", "_before_valid", "_n_bad", "place", "_in_place", "jump_limit")


def _motion(df: DataFrame, cfg: FrameConfig) -> DataFrame:
    """(video_id, _seg, _in_last, _in_before, _in_above, _in_sums): accepted points, signs and the row's signs above each segment, and all counters."""
    df = df.withColumns(frames.steps(F.col("accepted"), last="_own_last", cfg=cfg) | frames.turns(F.col("_signs"), F.col("_own_before")) | frames.travels(F.col("_signs"), F.col("_own_above"), last="_own_last", cfg=cfg))
    on, accepted = F.col("_on"), F.col("accepted")
    ends = df.groupBy(*KEY).agg(
        *[F.sum(F.coalesce(c, F.lit(0).cast(df.schema[c].dataType))).alias(c) for c in _SUMS],
        _first(F.col("pts"), accepted).alias("first_pts"), _first(F.col("_signs"), on).alias("first_signs"), F.min_by(F.struct("_signs", "pts"), "frame").alias("head"),
        _last(F.col("pts"), accepted).alias("last_pts"), _last(F.col("_signs"), on).alias("last_signs"), F.max_by(F.struct("_signs"), "frame").alias("tail"))
    ends = ends.withColumns({"_in_last": _handed("last_pts"), "_in_before": _handed("last_signs"), "_in_above": F.lag("tail").over(_segments())["_signs"]})
    # what the first accepted frame, first signs and first row add once the state above is known
    edge = frames.steps(F.col("first_pts").isNotNull() & F.col("_in_last").isNotNull(), "first_pts", "_in_last", cfg)
    edge |= frames.turns(F.col("first_signs"), F.col("_in_before")) | frames.travels(F.col("head._signs"), F.col("_in_above"), F.col("head.pts"), "_in_last", cfg)
    ends = ends.withColumns({f"_e{c}": F.coalesce(c, F.lit(0)) + F.coalesce(edge[c], F.lit(0)) for c in _SUMS})
    upto = _segments().rowsBetween(W.unboundedPreceding, -1)
    sums = F.struct(*[F.coalesce(F.sum(f"_e{c}").over(upto), F.lit(0).cast(df.schema[c].dataType)).alias(c) for c in _SUMS])
    return ends.select(*KEY, "_in_last", "_in_before", "_in_above", sums.alias("_in_sums"))


def walk(df: DataFrame, cfg: FrameConfig = FrameConfig(), segment: int = 20_000) -> DataFrame:
    """The rows of ``frames.swim(frames.distances(frames.flags(df)))``, walked over segments of as many frame numbers.

    The frames are read and dealt three times, once for each summary and once for the result. Cumulative sums add up by
    segment, so they can differ from a whole walk's in their last bits. A frame number must come once in a video.
    """
    if segment < 1:
        raise ValueError("a segment has one frame at least")
    scratch = Scratch(df.sparkSession, "segments")
    dealt = df.withColumn("_seg", F.floor(F.col("frame") / segment)).repartition(*KEY)
    rows = frames.measured(dealt, cfg)
    given = scratch.save(_validity(rows, cfg), "validity")
    rows = _judged(rows, given, cfg)
    given = scratch.save(_motion(rows, cfg), "motion")
    rows = rows.join(given, KEY)
    rows = rows.withColumns({"last": F.when(F.col("accepted"), F.coalesce("_own_last", "_in_last")), "_before": F.when(F.col("_on"), F.coalesce("_own_before", "_in_before")), "_above": F.when(F.col("_head"), F.col("_in_above")).otherwise(F.col("_own_above"))})
    rows = rows.withColumns(frames.steps(F.col("accepted"), cfg=cfg) | frames.turns(F.col("_signs"), F.col("_before")) | frames.travels(F.col("_signs"), F.col("_above"), cfg=cfg))
    sums = {f"_c{k}": f"_d{k}" for k in range(len(PARTS))} | {f"{p}_cum_{m}": f"{p}_{m}" for p in SWIM_PARTS for m in frames.MEASURES}
    rows = rows.withColumns({n: F.col("_in_sums")[c] + F.sum(F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType))).over(_run()) for n, c in sums.items()})
    rows = frames.restarted(frames.gathered(rows), cfg)
    return rows.drop("_seg", "_own_last", "_own_before", "_own_above", "_head", "_in_last", "_in_before", "_in_above", "_in_sums")
