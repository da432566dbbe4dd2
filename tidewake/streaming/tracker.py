"""Counters that go from frame to frame, for recordings whose frames arrive in order.

A recording's state is the last accepted frame's sides and the counts so far, so a batch of new frames goes on where the one
before ended: the last valid sides are carried over rejected frames. Frames that come again or too late, not behind the last
one seen, are left out. The batch form of these counters is ``operators.frames.swim``;
``streaming.walk`` carries the whole walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewake.config import ONE_SIDED

OUTPUT = "video_id string, part string, frame long, swims long, bends long"
STATE = "frame long, side double, swims long, bends long"


def count_swims(frames: DataFrame, parts: tuple[str, ...] = tuple(ONE_SIDED)) -> DataFrame:
    """(video_id, part, frame, swims, bends) so far, a row for each part of a recording that has new frames, in update mode.

    frames: (video_id, frame, part, sign), a row for each frame and swim part; sign, the lateral side, is null on rejected
    frames. A swim is a change of side between accepted frames, a bend a step over the part's threshold on one side.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        video, part = key
        last, side, swims, bends = state.get if state.exists else (-1, None, 0, 0)
        new = pd.concat(list(batches)).sort_values("frame", kind="stable").drop_duplicates("frame")  # one trigger's frames of one part
        new = new[new["frame"] > last]
        if len(new):
            last = int(new["frame"].iloc[-1])
            signs = new["sign"].to_numpy(float)
            signs = signs[~np.isnan(signs)]
            before = np.concatenate([[np.nan if side is None else side], signs])[:-1]
            swims += int((before * signs < 0).sum())
            bends += int(((before * signs > 0) & (np.abs(signs - before) > ONE_SIDED[part])).sum())
            side = float(signs[-1]) if len(signs) else side
        state.update((last, side, swims, bends))
        yield pd.DataFrame({"video_id": [video], "part": [part], "frame": [last], "swims": [swims], "bends": [bends]})

    kept = frames.where(frames["part"].isin(*parts)).select("video_id", "part", "frame", "sign")
    return kept.groupBy("video_id", "part").applyInPandasWithState(run, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """Notes each batch of the session's streams: (name, batch, rows, rows a second); add with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.batches: list[tuple[str | None, int, int, float]] = []
        self.ended: list[str] = []

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        self.batches.append((p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.ended.append(str(event.id))
