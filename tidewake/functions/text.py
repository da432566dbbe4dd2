"""File names, keys and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def normalize_video_name(c: Column) -> Column:
    """TYYMMDD_ at the start becomes TYYYYMMDD_; other names stay."""
    return F.regexp_replace(c, r"^T(\d{6})_", "T20$1_")


def truncate_name(c: Column) -> Column:
    """The part before ``_mergedDLC_``, or else before ``DLC_``."""
    return F.when(c.contains("_mergedDLC_"), F.substring_index(c, "_mergedDLC_", 1)).otherwise(F.substring_index(c, "DLC_", 1))


def video_name(c: Column) -> Column:
    return F.regexp_replace(truncate_name(c), r"\.csv$", "")


def sign_value(c: Column) -> Column:
    """A number, or the number behind ``label:``; 0 otherwise."""
    return F.coalesce(c.try_cast("double"), F.trim(F.try_element_at(F.split(c, ":"), F.lit(2))).try_cast("double"), F.lit(0.0))


def simple_stem(c: Column) -> Column:
    """``T########_time_#`` and what follows ``tracking_analysis``, joined; the stem itself if either is missing."""
    at = F.instr(F.lower(c), "tracking_analysis")
    front = r"(T\d{8}_time_\d+)"
    return F.when(c.rlike(front) & (at > 0), F.concat_ws("_", F.regexp_extract(c, front, 1), F.substring(c, at, F.length(c)))).otherwise(c)


def datetime_key(c: Column) -> Column:
    return _found(c, r"T(\d{8}_time_\d+)")


def mmss(seconds: Column) -> Column:
    """``mm:ss.sss``; below zero counts as zero, null stays.

    ``format_number`` rounds the stored binary value, ties to even (but 0.0005, just above one, to 0); ``%.3f`` would round its
    shortest decimal form half up.
    """
    s = F.greatest(F.lit(0.0), seconds)
    m = F.floor(s / 60)
    rest = F.when(s == 0.0005, 0.001).otherwise(s - m * 60)
    return F.when(seconds.isNotNull() & (F.abs(seconds) < float("inf")), F.format_string("%02d:%s", m, F.lpad(F.format_number(rest, 3), 6, "0")))


def key_date(c: Column) -> Column:
    """Date of ``YYYYMMDD_time_H``."""
    return F.try_to_timestamp(_found(c, r"^(\d{8})_time_"), F.lit("yyyyMMdd")).cast("date")


def key_hour_code(c: Column) -> Column:
    """Hour code of a key, clipped to 1..24."""
    return F.least(F.greatest(_found(c, r"_time_(\d{1,2})$").try_cast("int"), F.lit(1)), F.lit(24))


def safe_file_name(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r'[\\/*?:"<>|() ]+', "_"), F.lit("_"))


def pretty(c: Column) -> Column:
    """Underscores as blanks, first letter upper."""
    spaced = F.trim(F.regexp_replace(c, "_+", " "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 20))


def recording_hour(c: Column) -> Column:
    """Hour of ``RecM03_YYYYMMDD_HHMMSS_...``; null for other shapes."""
    t = F.get(F.split(c, "_"), F.lit(2))
    return F.when(F.length(t) >= 6, F.substring(t, 1, 2).try_cast("int"))


def hour_folder(c: Column) -> Column:
    """``YYMMDD_time_HH`` with HH = hour + 1."""
    date = F.get(F.split(c, "_"), F.lit(1))
    hour = recording_hour(c)
    return F.when(hour.isNotNull(), F.format_string("%s_time_%02d", F.substring(date, 3, 100), hour + 1))


def camera(c: Column) -> Column:
    return F.when(c.contains("RecM"), F.lit("RecM")).when(c.contains("RecS"), F.lit("RecS"))


def is_video(c: Column, extensions: tuple[str, ...] = (".mp4",)) -> Column:
    low, out = F.lower(c), F.lit(False)
    for e in extensions:
        out = out | low.endswith(e)
    return out


def is_unlabeled_video(c: Column) -> Column:
    return is_video(c) & ~F.lower(c).contains("_labeled")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def date_range_caption(start: str | None, end: str | None) -> str:
    if start and end:
        return f"Date Range: {start} to {end}"
    return f"Date Range: {start} onwards" if start else f"Date Range: up to {end}" if end else "Date Range: All dates"
