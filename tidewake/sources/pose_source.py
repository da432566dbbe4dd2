"""Pose files as a data source of their own: ``spark.read.format("tidewake_pose")``, batch and stream, one pass over the files.

A task reads whole files, planned by size, so a file is judged and read where it lies: one without frames, or with a row of too few
fields, is one row with its ``error`` and no frames. For folders that driver and executors have mounted; files in other stores are read
by ``scans.pose``, which gives the same frames.

Options: ``path`` (a file, a folder or a pattern), ``bytes`` (what a task reads at most, 128 MB; a larger file is a task of its own),
``parts`` (body parts that come along, by comma; all without it).
"""

from __future__ import annotations

import glob
import math
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidewake.config import PARTS

SCHEMA = "file string, video_id string, frame bigint, kp array<struct<part: string, x: double, y: double, likelihood: double>>, error string"
_ARROW = pa.schema([("file", pa.string()), ("video_id", pa.string()), ("frame", pa.int64()), ("kp", pa.list_(pa.struct([("part", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("likelihood", pa.float64())]))), ("error", pa.string())])
WIDTH, BATCH = 1 + 3 * len(PARTS), 2000


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _listed(path: str) -> list[tuple[int, str, int]]:
    """(modified, path, size) of the files of a path, by modification time and name."""
    bare = path.removeprefix("file://").removeprefix("file:")
    found = glob.glob(os.path.join(bare, "*.csv")) if os.path.isdir(bare) else glob.glob(bare)
    return sorted((s.st_mtime_ns, p, s.st_size) for p in found if os.path.isfile(p) for s in [os.stat(p)])


def planned(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    """Files together up to ``most`` bytes, in their order."""
    parts: list[Files] = []
    held = 0
    for _, path, size in files:
        if not parts or held + size > most:
            parts.append(Files([]))
            held = 0
        parts[-1].paths.append(path)
        held += size
    return parts


def _number(text: str) -> float | None:
    try:
        value = float(text)
    except ValueError:
        return None
    return None if math.isnan(value) else value


def _is_frame(field: str) -> bool:
    try:
        return math.isfinite(float(field))
    except ValueError:
        return False


def _error(path: str) -> str | None:
    frames, least = 0, None
    with open(path, encoding="utf-8", errors="replace") as lines:
        for line in lines:
            fields = line.rstrip("\r\n").split(",")
            if _is_frame(fields[0]):
                frames += 1
                least = len(fields) if least is None else min(least, len(fields))
    if not frames:
        return "no frames"
    return f"only {least} columns" if least < WIDTH else None


def _video(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def read_files(paths: Sequence[str], parts: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of files, in batches; of a file with an error only that."""
    at = [(p, 1 + 3 * PARTS.index(p)) for p in parts]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)
    for path in paths:
        error = _error(path)
        if error:
            yield batch([(path, _video(path), None, None, error)])
            continue
        rows = []
        with open(path, encoding="utf-8", errors="replace") as lines:
            for line in lines:
                f = line.rstrip("\r\n").split(",")
                if not _is_frame(f[0]):
                    continue
                kp = [{"part": p, "x": _number(f[k]), "y": _number(f[k + 1]), "likelihood": _number(f[k + 2])} for p, k in at]
                rows.append((path, _video(path), int(float(f[0])), kp, None))
                if len(rows) == BATCH:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class _Plan:
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("give a path")
        self.path, self.most = options["path"], int(options.get("bytes", 128 << 20))
        self.parts = options["parts"].split(",") if options.get("parts") else list(PARTS)
        unknown = set(self.parts) - set(PARTS)
        if unknown:
            raise ValueError(f"unknown parts: {', '.join(sorted(unknown))}")


class _Reader(_Plan, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return planned(_listed(self.path), self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(partition.paths, self.parts)


class _StreamReader(_Plan, DataSourceStreamReader):
    """An offset is the last file read, by modification time and name; a file must be complete when it gets its name."""

    def initialOffset(self) -> dict:
        return {"modified": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.path)
        return {"modified": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = (start["modified"], start["path"]), (end["modified"], end["path"])
        return planned([f for f in _listed(self.path) if low < f[:2] <= high], self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(partition.paths, self.parts)


class PoseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewake_pose"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PoseSource)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames (video_id, frame, kp) and rejects (file, error) of what the source gives."""
    return rows.where("error is null").select("video_id", "frame", "kp"), rows.where(F.col("error").isNotNull()).select("file", "error")
