"""Readers: pose, tracking, summary and evaluation tables, file listings by name, and settings."""

from __future__ import annotations

import csv
import itertools
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.config import PARTS
from tidewake.functions.text import is_video, stem
from tidewake.functions.values import no_nan, numeric
from tidewake.shared import Scratch

VIDEO = (".mp4", ".avi", ".mov", ".mkv")
#: Where Windows-1252 differs from Latin-1, which Spark reads.
_LATIN = [(chr(b), t) for b in range(0x80, 0xA0) if (t := bytes([b]).decode("cp1252", "ignore"))]
_UNDEFINED = [b for b in range(0x80, 0xA0) if not bytes([b]).decode("cp1252", "ignore")]


def _pose_schema() -> str:
    return ", ".join(f"_c{k} string" for k in range(1 + 3 * len(PARTS))) + ", broken string"


def pose(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Frames (video_id, frame, kp) of pose CSVs, and rejects (file, error).

    Columns count by position; header lines are those whose first field is no number. A file without frames, or with rows of
    fewer than 34 fields, is rejected as a whole: one pass over the lines counts each file's frames and fields, one reads them.
    """
    raw = spark.read.text(paths).withColumn("file", F.input_file_name())
    rows = raw.select("file", F.split("value", ",", -1).alias("f")).withColumn("frame", F.get("f", F.lit(0)).try_cast("double"))
    body = rows.where("frame is not null")
    width = 1 + 3 * len(PARTS)
    seen = rows.groupBy("file").agg(F.count("frame").alias("frames"), F.min(F.when(F.col("frame").isNotNull(), F.size("f"))).alias("n"))
    error = F.when(F.col("frames") == 0, "no frames").when(F.col("n") < width, F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(" columns")))
    rejects = seen.select("file", error.alias("error")).where("error is not null")
    at = lambda k: no_nan(F.trim(F.get("f", F.lit(k))).try_cast("double"))
    kp = F.array(*[F.struct(F.lit(p).alias("part"), at(1 + 3 * k).alias("x"), at(2 + 3 * k).alias("y"), at(3 + 3 * k).alias("likelihood")) for k, p in enumerate(PARTS)])
    good = body.join(rejects.select("file"), "file", "left_anti")
    return good.select(stem(F.col("file")).alias("video_id"), F.col("frame").cast("long").alias("frame"), kp.alias("kp")), rejects


def keypoints(df: DataFrame, parts: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(video_id, frame, kp) from a wide table and each part's (x, y, likelihood) columns."""
    return df.select("video_id", "frame", F.array(*[F.struct(F.lit(p).alias("part"), *[no_nan(F.col(c).cast("double")).alias(n) for n, c in zip(("x", "y", "likelihood"), cols, strict=True)]) for p, cols in parts.items()]).alias("kp"))


def _without_bom(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def _file() -> Column:
    return F.col("_metadata.file_path")


def _marks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, encoding, header, fields): how a file is read, its first line that isn't blank as bytes, and the most fields of any line.

    A pass over the files' lines as bytes, so a file is never held as a whole and may be read by many tasks. The first line is
    that of the lowest place in the file's first block; commas within quotes part no fields.
    """
    line = F.col("value").cast("binary")
    undefined = reduce(Column.__or__, [F.contains(line, F.lit(bytes([b]))) for b in _UNDEFINED])
    bare = F.when(F.contains("value", F.lit('"')), F.regexp_replace("value", '"[^"]*"', "")).otherwise(F.col("value"))
    fields = 1 + F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(","), F.lit("")))
    lines = spark.read.text(paths).select(_file().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value", F.is_valid_utf8("value").alias("utf8"), undefined.alias("undefined"), fields.alias("fields"))
    full = F.when(F.trim("value") != "", F.struct("block", "place"))
    seen = lines.groupBy("file").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("undefined").alias("undefined"), F.min_by(line, full).alias("header"), F.max("fields").alias("fields"))
    return seen.select("file", F.when(F.col("utf8"), "utf-8").when(~F.col("undefined"), "cp1252").alias("encoding"), "header", "fields")


def encodings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, encoding): the first encoding that reads all lines of a file, UTF-8 with or without mark, then Windows-1252; null where neither does."""
    return _marks(spark, paths).select("file", "encoding")


def _names(header: bytes, encoding: str) -> list[str]:
    """The columns that a header line names: one without a name by its place, one that comes again with a number."""
    text = header.decode("utf-8-sig" if encoding == "utf-8" else encoding)
    names: list[str] = []
    for k, name in enumerate(next(csv.reader([text]), [])):
        name = name.strip() or f"Unnamed: {k}"
        again = next(n for n in itertools.count() if (f"{name}.{n}" if n else name) not in names)
        names.append(f"{name}.{again}" if again else name)
    return names


class _Headers:
    """Each file by the signature of its header. Signatures, not files, come to the driver, as they are the table's schema."""

    def __init__(self, spark: SparkSession, paths: str | list[str], most: int = 10_000):
        self.spark, self.paths = spark, paths
        self.marks = Scratch(spark, "headers").save(_marks(spark, paths), "marks")
        read = self.marks.where("encoding is not null and header is not null")
        found = read.groupBy("header", "encoding").agg(F.min("file").alias("first")).orderBy("first").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} different headers: these files are no one table")
        self.signatures = [(r["header"], r["encoding"], _names(bytes(r["header"]), r["encoding"])) for r in found]
        self.columns = list(dict.fromkeys(n for _, _, names in self.signatures for n in names))

    def files(self) -> DataFrame:
        """(file, encoding, ok, error, width, at): at is the place of each of the table's columns in the file, null where it has none."""
        places = []
        for header, encoding, names in self.signatures:
            where = {n: k for k, n in enumerate(names)}
            places.append((header, encoding, len(names), [where.get(c) for c in self.columns]))
        known = self.spark.createDataFrame(places, "header binary, encoding string, width int, at array<int>")
        met = self.marks.join(known, ["header", "encoding"], "left")
        error = F.when(F.col("encoding").isNull(), "no encoding reads it").when(F.col("width").isNull(), "no header").when(F.col("fields") > F.col("width"), F.format_string("a row of %d fields under a header of %d", "fields", "width"))
        return met.select("file", "encoding", error.isNull().alias("ok"), error.alias("error"), "width", "at")


def tracking_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, ok, error) of every file that has a line: what ``tracking`` reads and what it leaves out."""
    return _Headers(spark, paths).files().select("file", "ok", "error")


def by_header(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV files as one table of text, each by its own header, and ``_file``: columns meet by name, one that a file lacks is null there.

    All files are parsed byte by byte (marks of CSV are ASCII in either encoding), by place, as wide as the widest header, and
    meet the places of their columns in a join; then letters are put together by the file's encoding. Columns are in the order in which
    the files, by path, name them first. A short row ends in nulls. A file that no encoding reads, or with a row of more
    fields than its header, is left out and told by ``tracking_files``. Two passes: the lines as bytes, then the fields.
    """
    headers = _Headers(spark, paths)
    if not headers.signatures:
        return spark.createDataFrame([], "_file string")
    widest = max(len(names) for _, _, names in headers.signatures)
    fields = [f"_c{k}" for k in range(widest)]
    raw = spark.read.schema(", ".join(f"{c} string" for c in fields)).option("header", True).option("encoding", "ISO-8859-1").csv(paths)
    held = raw.select(_file().alias("_file"), F.array(*fields).alias("_cells"))
    met = held.join(headers.files().where("ok").select(F.col("file").alias("_file"), "encoding", "at"), "_file")
    old, new = ("".join(x) for x in zip(*_LATIN, strict=True))
    utf8 = F.col("encoding") == "utf-8"
    text = lambda c: F.when(utf8, F.encode(c, "ISO-8859-1").cast("string")).otherwise(F.translate(c, old, new))
    return met.select(*[text(F.get("_cells", F.get("at", F.lit(k)))).alias(n) for k, n in enumerate(headers.columns)], "_file")


def tracking(spark: SparkSession, paths: str | list[str], root: str | None = None) -> DataFrame:
    """Tracking or window tables with a header each (``by_header``); columns are text, ``source_path`` and ``root`` are added."""
    got = by_header(spark, paths)
    return got.select(*[F.col(f"`{c}`") for c in got.columns if c != "_file"], F.col("_file").alias("source_path"), F.lit(root).alias("root"))


def roots(spark: SparkSession, paths: list[str], **more) -> DataFrame:
    """The tables of several sessions with their root."""
    parts = [tracking(spark, p, p, **more) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def summary(spark: SparkSession, path: str | list[str], text_columns: tuple[str, ...] = ("file", "Datetime")) -> DataFrame:
    """An integrated summary, or several as one, each by its own header: numbers may have thousands separators."""
    df = by_header(spark, path).drop("_file")
    return df.select(*[F.col(f"`{c}`") if c in text_columns or c.endswith(("_mmss", "_column")) else numeric(F.col(f"`{c}`"), commas=True).alias(c) for c in df.columns])


def table(spark: SparkSession, path: str) -> DataFrame:
    """A figure's input table."""
    return _without_bom(spark.read.option("header", True).option("inferSchema", True).csv(path))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot evaluation table; blanks around header names go."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*["index" if c == "_c0" else c.strip() for c in df.columns])
    return df.select(*[numeric(F.col(f"`{c}`")).alias(c) for c in df.columns])


def list_files(spark: SparkSession, path: str, glob: str = "*", contains: str = "") -> DataFrame:
    """(path, file, size) of the files right below a folder, by name; contains: part of the name in any case."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("size"))
    return (got.where(F.lower("file").contains(contains.lower())) if contains else got).orderBy("path")


def videos(spark: SparkSession, path: str) -> DataFrame:
    """(path, file) of the videos right below a folder, by name."""
    got = spark.read.format("binaryFile").load(path).select("path", F.substring_index("path", "/", -1).alias("file"))
    return got.where(is_video(F.col("file"), VIDEO)).orderBy("path")


def raw_videos(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, date, hour_folder) of recordings in date folders below RecM hour folders, by name."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    shape = r"/([^/]+)/RecM/([^/]*_time_[^/]*)/([^/]+)$"
    got = got.where(F.col("path").rlike(shape))
    return got.select("path", F.regexp_extract("path", shape, 3).alias("file"), F.regexp_extract("path", shape, 1).alias("date"), F.regexp_extract("path", shape, 2).alias("hour_folder")).where(is_video(F.col("file"), VIDEO)).orderBy("path")


def pick_csv(path: str, glob: str = "*.csv") -> str:
    """A file as it is, or the first match in a folder, by name."""
    from fnmatch import fnmatch

    if not path:
        raise ValueError("give a file or a folder")
    if not os.path.isdir(path):
        return path
    found = sorted(f for f in os.listdir(path) if fnmatch(f.lower(), glob.lower()))
    if not found:
        raise FileNotFoundError(f"no {glob} in {path}")
    return os.path.join(path, found[0])


def home_root(*variables: str) -> str:
    """The first of the environment variables that is set, or the home folder."""
    return next((os.environ[v] for v in variables if os.environ.get(v)), os.path.expanduser("~"))


def settings(path: str) -> dict:
    """Settings of a YAML file: ``key: value`` lines, lists of scalars, and maps nested by indentation."""
    out: dict = {}
    open_: list[tuple[int, dict]] = [(-1, out)]  # maps under way with the indentation of their keys' parent
    last: tuple[dict, str] | None = None
    with open(path, encoding="utf-8") as f:
        for line in f:
            bare = line.split(" #")[0].rstrip()
            text = bare.lstrip()
            if not text or text.startswith("#"):
                continue
            depth = len(bare) - len(text)
            if text.startswith("- "):
                if last is not None:
                    held = last[0].get(last[1])
                    if not isinstance(held, list):
                        held = last[0][last[1]] = []
                    held.append(_scalar(text[2:].strip()))
                continue
            if ":" not in text:
                continue
            while depth <= open_[-1][0]:
                open_.pop()
            key, _, value = text.partition(":")
            mine = open_[-1][1]
            if value.strip():
                mine[key] = _scalar(value.strip())
            else:  # a list or a map, as the lines below tell; without any, an empty list
                mine[key] = _Later()
                open_.append((depth, mine[key]))
            last = (mine, key)
    return _settled(out)


class _Later(dict):
    """A value that the lines below make a map."""


def _settled(held: dict) -> dict:
    return {k: (_settled(v) if v else []) if isinstance(v, _Later) else v for k, v in held.items()}


def update_settings(path: str, new: dict) -> None:
    """Replace top-level scalars, or add them; other lines stay."""
    with open(path, encoding="utf-8") as f:
        lines = f.read().splitlines()
    left = dict(new)
    for k, line in enumerate(lines):
        name = line.partition(":")[0]
        if name in left and not line[:1].isspace():
            lines[k] = f"{name}: {left.pop(name)}"
    lines += [f"{k}: {v}" for k, v in left.items()]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def _scalar(s: str):
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None}.get(s.lower(), s.strip("'\""))
