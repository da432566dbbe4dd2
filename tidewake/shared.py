"""What needs a place that driver and executors share: tables written on the way, and names that don't clash."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOTS: dict[str, str] = {}
_OPEN: list[list] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a single-process session gets a folder of its own; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOTS:
        _OWN_ROOTS[app] = tempfile.mkdtemp(prefix="tidewake-")
        atexit.register(shutil.rmtree, _OWN_ROOTS[app], ignore_errors=True)
    return _OWN_ROOTS[app]


class Scratch:
    """Tables that one operator call writes to the shared folder: they cut lineage and survive lost executors.

    The returned DataFrames read them lazily, so they stay until the session ends or ``drop`` is called.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/tidewake/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)
        for held in _OPEN:
            held.append(self)
        bound_batches(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended
            pass


@contextmanager
def passing() -> Iterator[None]:
    """All scratch tables that are begun within are dropped at the end: by then what is made of them must be written."""
    held: list[Scratch] = []
    _OPEN.append(held)
    try:
        yield
    finally:
        _OPEN.remove(held)
        for s in held:
            s._delete(s.root)
            atexit.unregister(s._delete)


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most ``size`` where the session doesn't say otherwise: ten thousand long texts are too many at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def fresh(df: DataFrame, name: str) -> str:
    """A column name near ``name`` that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
