"""The whole frame walk on a stream: what ``operators.frames`` computes over a recording, frame batch by frame batch.

A recording's state is what its next frame depends on: the last valid points, the place in a run of bad frames, the last accepted
points, the sides of the last accepted frame and of the row just above, and all counters. A trigger's new frames of a recording are
walked at once, with shifted arrays, from that state. Frames that come again or too late, not behind the last one seen, are
left out. An idle recording's state can be closed by a timer, and a stream can begin where a batch walk ended.

transformWithStateInPandas keeps its state in RocksDB: set ``spark.sql.streaming.stateStore.providerClass`` to Spark's
RocksDBStateStoreProvider before the stream starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidewake.config import ONE_SIDED, PARTS, SWIM_PARTS, FrameConfig
from tidewake.operators.frames import MEASURES

AT = [PARTS.index(p) for p in SWIM_PARTS]
HEAD, NECK = PARTS.index("Head1"), PARTS.index("Head2")
_COUNTERS = ", ".join(f"{m} array<{t}>" for m, t in (("swim", "bigint"), ("bend", "bigint"), ("rel", "double"), ("travel", "double")))
_CUMULATIVE = ", ".join(f"cum_{c}" for c in _COUNTERS.split(", "))
OUTPUT = f"video_id string, frame bigint, valid boolean, bad boolean, skip boolean, accepted boolean, dist_px array<double>, cum_px array<double>, signs array<double>, {_COUNTERS}, {_CUMULATIVE}, cum_travel_whole array<double>, closed boolean"
#: State variables and their fields; points are x, y by part, sides by swim part, an empty array is none.
STATE = {"place": "frame bigint, place bigint", "points": "valid array<double>, last array<double>", "sides": "before array<double>, above array<double>", "sums": f"dist array<double>, {_COUNTERS}"}
_FIELDS = {name: [f.split()[0] for f in schema.split(", ")] for name, schema in STATE.items()}


@dataclass
class Walk:
    """A recording's state, empty before its first frame."""

    frame: int = -(1 << 62)
    place: int = 0
    valid: list[float] = field(default_factory=list)
    last: list[float] = field(default_factory=list)
    before: list[float] = field(default_factory=list)
    above: list[float] = field(default_factory=list)
    dist: list[float] = field(default_factory=lambda: [0.0] * len(PARTS))
    swim: list[int] = field(default_factory=lambda: [0] * len(AT))
    bend: list[int] = field(default_factory=lambda: [0] * len(AT))
    rel: list[float] = field(default_factory=lambda: [0.0] * len(AT))
    travel: list[float] = field(default_factory=lambda: [0.0] * len(AT))


def _shifted(values: np.ndarray, where: np.ndarray, first: list[float]) -> np.ndarray:
    """For each row that counts the values of the one before that did, NaN on others; the first one's are given."""
    out = np.full(values.shape, np.nan)
    rows = np.flatnonzero(where)
    if len(rows):
        out[rows[1:]] = values[rows[:-1]]
        if len(first):
            out[rows[0]] = np.reshape(first, values.shape[1:])
    return out


def _end(values: np.ndarray, where: np.ndarray, first: list[float]) -> list[float]:
    rows = np.flatnonzero(where)
    return values[rows[-1]].ravel().tolist() if len(rows) else first


def advance(state: Walk, frames: np.ndarray, x: np.ndarray, y: np.ndarray, likelihood: np.ndarray, cfg: FrameConfig = FrameConfig()) -> tuple[dict[str, np.ndarray], Walk]:
    """Columns of new frames, ascending and behind the state's, and the state after them. x, y, likelihood: frames x parts, NaN where missing."""
    with np.errstate(invalid="ignore"):
        p = np.stack([x, y], axis=2)
        valid = ((likelihood >= cfg.likelihood) & ~np.isnan(x) & ~np.isnan(y)).all(axis=1)
        far = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=2))
        body = far(p[:, 1:], p[:, :-1]).sum(axis=1)
        mm = body * cfg.mm_per_px
        inside = valid & (mm >= cfg.body_mm[0]) & (mm <= cfg.body_mm[1])
        limit = np.where(inside, np.maximum(cfg.jump_px, cfg.jump_of_body * body), cfg.jump_px)
        bad = valid & ((far(p, _shifted(p, valid, state.valid)) > limit[:, None]).sum(axis=1) >= cfg.jump_parts)
        so_far = np.cumsum(bad)
        base = np.maximum.accumulate(np.where(valid & ~bad, so_far, -state.place))
        place = so_far - base
        skip = bad & (place % 2 == 1)
        accepted = valid & ~skip
        last = _shifted(p, accepted, state.last)
        step = far(p, last)
        dist = np.where(step < cfg.jitter_px, 0.0, step)
        cum = np.cumsum(np.nan_to_num(dist), axis=0) + state.dist
        line = p[:, NECK] - p[:, HEAD]
        length = np.sqrt((line**2).sum(axis=1))
        on = accepted & (length > 0)
        unit = line / np.where(length > 0, length, np.nan)[:, None]
        off = p[:, AT] - p[:, [HEAD]]
        signs = np.where(on[:, None], unit[:, None, 0] * off[..., 1] - unit[:, None, 1] * off[..., 0], np.nan)
        before = _shifted(signs, on, state.before)
        above = np.vstack([np.reshape(state.above, (1, -1)) if state.above else np.full((1, len(AT)), np.nan), signs[:-1]])
        flip = before * signs < 0
        bend = ~flip & (before * signs > 0) & (np.abs(signs - before) > [ONE_SIDED[q] for q in SWIM_PARTS])
        follows = on & ~np.isnan(above).any(axis=1)
        rel = np.where(follows[:, None], np.abs(signs - above), 0.0)
        travel = np.where(follows[:, None] & (step[:, AT] >= cfg.jitter_px), step[:, AT], 0.0)
    new = {"swim": flip.astype(np.int64), "bend": bend.astype(np.int64), "rel": rel, "travel": travel}
    sums = {m: np.cumsum(v, axis=0) + np.array(getattr(state, m), v.dtype) for m, v in new.items()}
    after = Walk(int(frames[-1]), int(place[-1]), _end(p, valid, state.valid), _end(p, accepted, state.last), _end(signs, on, state.before), signs[-1].tolist() if on[-1] else [], cum[-1].tolist(), *[sums[m][-1].tolist() for m in MEASURES])
    shown = {f"cum_{m}": v for m, v in sums.items()} | {"cum_travel_whole": sums["travel"]}
    if cfg.compat_quirks:
        dead, restart = (accepted & ~on)[:, None], (on & np.isnan(above).any(axis=1))[:, None]
        shown |= {f"cum_{m}": np.where(dead if m in ("swim", "bend") else dead | restart, 0, sums[m]) for m in MEASURES}
    return {"frame": frames, "valid": valid, "bad": bad, "skip": skip, "accepted": accepted, "dist_px": dist, "cum_px": cum, "signs": signs, **new, **shown}, after


def _listed(values: np.ndarray) -> list:
    """Rows of a column; arrays as lists, NaN as null."""
    if values.ndim == 1:
        return values.tolist()
    if values.dtype.kind != "f":
        return list(values)
    return [[None if v != v else v for v in row] for row in values.tolist()]


class _Walker(StatefulProcessor):
    def __init__(self, cfg: FrameConfig, idle: float | None):
        self.cfg, self.idle = cfg, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = {name: handle.getValueState(name, schema) for name, schema in STATE.items()}

    def _get(self) -> Walk:
        if not self.held["place"].exists():
            return Walk()
        values = {f: v for name in STATE for f, v in zip(_FIELDS[name], self.held[name].get(), strict=True)}
        return Walk(**{f: v if np.isscalar(v) else list(v) for f, v in values.items()})

    def _put(self, walk: Walk) -> None:
        for name, fields in _FIELDS.items():
            self.held[name].update(tuple(getattr(walk, f) for f in fields))

    def _wait(self, timers: TimerValues) -> None:
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.idle * 1000))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        row = initialState.iloc[0]
        self._put(Walk(**{f: int(row[f]) if f in ("frame", "place") else [] if row[f] is None else list(row[f]) for fields in _FIELDS.values() for f in fields}))
        self._wait(timerValues)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))  # one trigger's frames of one recording
        new = new.sort_values("frame", kind="stable").drop_duplicates("frame")
        walk = self._get()
        new = new[new["frame"] > walk.frame]
        self._wait(timerValues)
        if not len(new):
            return
        grid = [np.array(new[c].tolist(), np.float64).reshape(len(new), len(PARTS)) for c in ("x", "y", "likelihood")]
        got, walk = advance(walk, new["frame"].to_numpy(np.int64), *grid, self.cfg)
        self._put(walk)
        yield pd.DataFrame({"video_id": key[0], **{c: _listed(v) for c, v in got.items()}, "closed": False})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        walk = self._get()
        for held in self.held.values():
            held.clear()
        ends = {"frame": walk.frame, "cum_px": walk.dist, **{f"cum_{m}": getattr(walk, m) for m in MEASURES}, "cum_travel_whole": walk.travel, "closed": True}
        yield pd.DataFrame({c: [key[0] if c == "video_id" else ends.get(c)] for c in (f.split()[0] for f in OUTPUT.split(", "))})

    def close(self) -> None:
        pass


def track(frames: DataFrame, cfg: FrameConfig = FrameConfig(), idle: float | None = None, begun: DataFrame | None = None) -> DataFrame:
    """The walk's columns (OUTPUT, arrays by part or swim part) of each new frame of a stream of (video_id, frame, kp), in append mode.

    idle: seconds without frames after which a recording is closed: a row with ``closed``, its last frame and counters, and its
    state is gone. begun: ``end_states`` of recordings that a batch walk has begun. The first of frames that come twice counts.
    """
    values = lambda c: F.transform("kp", lambda p: F.coalesce(p[c].cast("double"), F.lit(float("nan"))))
    flat = frames.select("video_id", "frame", *[values(c).alias(c) for c in ("x", "y", "likelihood")])
    start = None if begun is None else begun.groupBy("video_id")
    return flat.groupBy("video_id").transformWithStateInPandas(_Walker(cfg, idle), OUTPUT, "Append", "None" if idle is None else "ProcessingTime", start)


def end_states(swum: DataFrame) -> DataFrame:
    """A row for each recording of a batch walk (``frames.swim`` or ``segments.walk``): where a stream of its later frames begins."""
    flat = lambda pts: F.flatten(F.transform(pts, lambda p: F.array(p["x"], p["y"])))
    last = lambda value, where: F.max_by(F.when(where, value), F.when(where, F.col("frame")))
    signs = F.when(F.col(f"{SWIM_PARTS[0]}_sign").isNotNull(), F.array(*[F.col(f"{p}_sign") for p in SWIM_PARTS]))
    good, none = F.col("valid") & ~F.col("bad"), F.array().cast("array<double>")
    runs = swum.groupBy("video_id").agg(F.max(F.when(good, F.col("frame"))).alias("_good"))
    met = swum.join(runs, "video_id")
    sums = {m: F.array(*[F.sum(f"{p}_{m}") for p in SWIM_PARTS]) for m in MEASURES}
    return met.groupBy("video_id").agg(
        F.max("frame").alias("frame"), F.count_if(F.col("bad") & (F.col("_good").isNull() | (F.col("frame") > F.col("_good")))).alias("place"),
        F.coalesce(last(flat("pts"), F.col("valid")), none).alias("valid"), F.coalesce(last(flat("pts"), F.col("accepted")), none).alias("last"),
        F.coalesce(last(signs, signs.isNotNull()), none).alias("before"), F.coalesce(F.max_by(F.struct(signs.alias("s")), "frame")["s"], none).alias("above"),
        F.max_by("cum_px", "frame").alias("dist"), *[c.alias(m) for m, c in sums.items()])
