"""Writers. Tables are partitioned by what their readers ask for; rounding belongs to the sink."""

from __future__ import annotations

import logging
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewake.config import FrameConfig
from tidewake.operators.rounding import round_frames, round_table


def csv(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite", mark: bool = False) -> None:
    """CSV with a header; nulls are empty fields. mark: files begin with a byte order mark, as spreadsheets ask for; this engine's readers take it off."""
    if mark:
        first = next(c for c in df.columns if c not in (by or []))
        df = df.withColumnRenamed(first, f"\ufeff{first}")
    writer = df.write.mode(mode).option("header", True).option("encoding", "UTF-8")
    (writer.partitionBy(*by) if by else writer).csv(path)


def tracking(df: DataFrame, path: str, cfg: FrameConfig = FrameConfig(), as_csv: bool = True) -> None:
    """The rounded tracking table, a folder for each video."""
    rounded = round_frames(df, cfg)
    if as_csv:
        csv(rounded, path, ["video_id"], mark=True)
    else:
        rounded.write.mode("overwrite").partitionBy("video_id").parquet(path)


def publish(df: DataFrame, rejected: DataFrame, path: str, cfg: FrameConfig = FrameConfig()) -> dict[str, int]:
    """The rounded tracking table as one named CSV file for each video, and the rejects, visible together or not at all; counts of the pass that wrote them.

    Both are written to a folder beside ``path``, each video's part is named ``{video}_tracking_analysis.csv``, and only then one
    rename puts the folder in place of what was there. A task that fails, or a driver that dies, leaves at most the folder beside
    it, which readers of ``path`` don't see. path/tracking holds the files, path/rejects the table of ``rejects``. A video is
    written by one task. Returned: frames, frames_without_body, files, files_rejected; no further job counts them.
    """
    spark, staged, old = df.sparkSession, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    seen, told = Observation(), Observation()
    ok = F.col("ok") if "ok" in rejected.columns else F.lit(False)
    try:
        counted = round_frames(df, cfg).observe(seen, F.count(F.lit(1)).alias("frames"), F.count_if(F.col("body_length_mm").isNull()).alias("frames_without_body"))
        dealt = counted.withColumn("_file", F.col("video_id")).repartition("_file").sortWithinPartitions("_file", "coords")
        csv(dealt, f"{staged}/tracking", ["_file"], mark=True)
        rejects(rejected.observe(told, F.count(F.lit(1)).alias("files"), F.count_if(~ok).alias("files_rejected")), f"{staged}/rejects")
        for folder in files.listStatus(at(f"{staged}/tracking")):
            if not folder.isDirectory():
                continue
            parts = [f.getPath() for f in files.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            video = unquote(folder.getPath().getName().partition("=")[2])
            for k, part in enumerate(sorted(parts, key=lambda p: p.getName())):  # one, but for a limit on a file's records
                files.rename(part, at(at(f"{staged}/tracking"), f"{video}_tracking_analysis{f'_{k}' if k else ''}.csv"))
            files.delete(folder.getPath(), True)
        if files.exists(at(path)):
            files.rename(at(path), at(old))
        if not files.rename(at(staged), at(path)):
            raise OSError(f"{path} could not be put in place")
        files.delete(at(old), True)
    except BaseException:
        files.delete(at(staged), True)
        raise
    return {**seen.get, **told.get}


def video_summaries(df: DataFrame, path: str, cfg: FrameConfig = FrameConfig()) -> None:
    csv(round_frames(df, cfg), path, mark=True)


def windows(df: DataFrame, path: str) -> None:
    csv(round_table(df), path, ["file"], mark=True)


def file_summaries(df: DataFrame, path: str, root: str | None = None) -> None:
    csv(round_table(df, summary=True), path, [root] if root else None, mark=True)


def integrated(df: DataFrame, path: str, root: str | None = None) -> None:
    """Section tables by root, or the grand totals without one."""
    csv(df.orderBy("section_order"), path, [root] if root else None, mark=True)


def series(df: DataFrame, path: str, index: str = "date") -> None:
    """A small daily or weekly table as one sorted file."""
    csv(df.orderBy(index).coalesce(1), path)


def combined_hourly(df: DataFrame, path: str) -> None:
    series(df, path, "hour_bin")


def rejects(df: DataFrame, path: str) -> None:
    """(file, ok, error) of files: what the readers say, or what could not be read where they don't say ``ok``."""
    csv(df.select("file", F.col("ok") if "ok" in df.columns else F.lit(False).alias("ok"), "error"), path)


def _drawn(df: DataFrame, most: int):
    pdf = df.limit(most + 1).toPandas()
    if len(pdf) > most:
        raise ValueError(f"a figure holds {most} points at most: aggregate the table first")
    return pdf


def _plotting():
    """The plotting library without a screen, or None."""
    try:
        import matplotlib
    except ImportError:
        return None
    matplotlib.use("Agg")
    from matplotlib import pyplot

    return pyplot


def figure(df: DataFrame, path: str, x: str, ys: list[str], most: int = 10_000, kind: str = "line", day: tuple[float, float] | None = None, band: str | None = None) -> bool:
    """A plot of a small aggregate where a plotting library is there; the data of every figure is a table first.

    kind: line, bar or scatter. day: hours between which the background stays light, as day; band: a column of deviations drawn
    around the first of ys. A table of more than ``most`` rows is an error: aggregate it before.
    """
    pyplot = _plotting()
    if pyplot is None:
        return False
    pdf = _drawn(df.select(x, *ys, *([band] if band else [])).orderBy(x), most)
    more = {} if kind == "line" else {"kind": kind}
    axes = pdf.plot(x=x, y=ys[0] if kind == "scatter" else ys, **more)
    if day:
        axes.axvspan(0, day[0], color="0.85", zorder=0)
        axes.axvspan(day[1], 24, color="0.85", zorder=0)
    if band:
        axes.fill_between(pdf[x], pdf[ys[0]] - pdf[band], pdf[ys[0]] + pdf[band], alpha=0.3)
    axes.figure.savefig(path)
    pyplot.close(axes.figure)
    return True


def heatmap(df: DataFrame, path: str, row: str, cols: list[str], most: int = 10_000) -> bool:
    """Cells of a pivot table as colours, a line for each row; as ``figure`` otherwise."""
    pyplot = _plotting()
    if pyplot is None:
        return False
    pdf = _drawn(df.select(row, *cols).orderBy(row), most)
    fig, axes = pyplot.subplots()
    fig.colorbar(axes.imshow(pdf[cols].to_numpy(dtype=float), aspect="auto"))
    axes.set_xticks(range(len(cols)), cols)
    axes.set_yticks(range(len(pdf)), [str(v) for v in pdf[row]])
    fig.savefig(path)
    pyplot.close(fig)
    return True


def logger(name: str, path: str | None = None, size: int = 5 << 20) -> logging.Logger:
    """A rotating log file, or the console."""
    from logging.handlers import RotatingFileHandler

    log = logging.getLogger(name)
    if not log.handlers:
        log.addHandler(RotatingFileHandler(path, maxBytes=size, backupCount=3) if path else logging.StreamHandler())
        log.setLevel(logging.INFO)
    return log
