"""What the corpus operators share: row identities, byte helpers, and the library's scratch folder under its names here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.shared import _OPEN, Scratch, bound_batches, fresh, passing, shared_root

__all__ = ["_OPEN", "Scratch", "bound_batches", "fresh", "passing", "shared_root"]

#: ASCII white space, ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits of (doc_id, text): equal for repeated rows only. Nulls differ from empty texts and from any number."""
    parts = [F.col(doc_id).isNull(), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text).isNull(), F.coalesce(F.col(text), F.lit(""))]
    return F.struct(F.xxhash64(*parts).alias("hi"), F.xxhash64(F.lit("row"), *parts).alias("lo"))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def keep_rows(docs: DataFrame, keep: DataFrame, key: Column, again: bool) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in ``keep.keep_key``, one row for each key, all columns as they were.

    again: some keys stand for several rows, all alike in the columns that ``key`` was made of; the least of them stays, by
    its columns in their order (columns that have no order, as maps, don't count).
    """
    k = fresh(docs, "keep_key")
    kept = docs.withColumn(k, key).join(keep.select(F.col("keep_key").alias(k)), k, "left_semi")
    if not again:
        return kept.select(*docs.columns)
    row = fresh(docs, "keep_row")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(*[F.col(f"`{f.name}`") for f in docs.schema if _ordered(f.dataType)])
    one = kept.groupBy(k).agg(F.min_by(whole, order).alias(row))
    return one.select(*[F.col(row)[c].alias(c) for c in docs.columns])


def _ordered(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _ordered(t.elementType)
    if isinstance(t, T.StructType):
        return all(_ordered(f.dataType) for f in t)
    return not isinstance(t, T.MapType | T.VariantType)


_CODEC = pa.Codec("zstd", compression_level=3)


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of numbers, split into planes of bytes, and bytes, as one compressed value."""
    head, body = [len(arrays)], []
    for a in arrays:
        if isinstance(a, bytes):
            head += [0, len(a)]
            body.append(a)
        else:
            top = int(a.max()) if len(a) else 0
            width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 3 if top < 1 << 24 else 4
            planes = a.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width]
            head += [width, len(a)]
            body.append(planes.tobytes())
    raw = np.array(head, "<u4").tobytes() + b"".join(body)
    return len(raw).to_bytes(4, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray | bytes]:
    raw = _CODEC.decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    head = np.frombuffer(raw, "<u4", 2 * n, 4).tolist()
    at, out = 4 + 8 * n, []
    for width, size in zip(head[::2], head[1::2], strict=True):
        if not width:
            out.append(raw[at : at + size])
            at += size
        else:
            wide = np.zeros((4, size), np.uint8)
            wide[:width] = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size)
            out.append(np.ascontiguousarray(wide.T).view("<u4").reshape(-1))
            at += width * size
    return out
