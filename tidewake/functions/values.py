"""Scalar functions on numbers, dates and categories, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def no_nan(c: Column) -> Column:
    """NaN as null; missing is null everywhere behind a scan."""
    return F.when(~F.isnan(c), c)


def numeric(c: Column, commas: bool = False) -> Column:
    """Text or numbers as double; what can't be read, and NaN, is null. commas: thousands separators go first."""
    text = c.cast("string")
    if commas:
        text = F.replace(text, F.lit(","), F.lit(""))
    return no_nan(F.trim(text).try_cast("double"))


def steady_sum(v: Column) -> Column:
    """Sum of doubles that the order of rows leaves as it is but for a last rounding: parts that are multiples of 1/1024 add up
    exactly (to 2^43), and the rest is small."""
    v = v.cast("double")
    coarse = F.when(F.abs(v) < 2.0**42, F.rint(v * 1024) / 1024).otherwise(v)
    return F.sum(coarse) + F.sum(F.nanvl(v - coarse, F.lit(0.0)))


def divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def day_hour(hour: Column, sunrise: int, sunset: int) -> Column:
    """Whether an hour is in [sunrise, sunset), both clamped to 0..24 and swapped if reversed."""
    lo, hi = sorted((min(max(sunrise, 0), 24), min(max(sunset, 0), 24)))
    return (hour >= lo) & (hour < hi)


def period(hour: Column, sunrise: int, sunset: int) -> Column:
    return F.when(day_hour(hour, sunrise, sunset), F.lit("Day")).otherwise(F.lit("Night"))


def week_start(date: Column) -> Column:
    """First day (Tuesday) of the week that ends on the next Monday."""
    return F.date_sub(F.next_day(F.date_sub(date, 1), "MON"), 6)


def wilson(success: Column, total: Column, z: float = 1.96) -> dict[str, Column]:
    """p_hat, lo, hi of a proportion; the total is 1 at least, bounds are clipped to [0, 1]."""
    n = F.greatest(F.lit(1.0), total.cast("double"))
    p = success.cast("double") / n
    denom, centre = 1 + z * z / n, p + z * z / (2 * n)
    rad = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return {"p_hat": p, "lo": F.greatest(F.lit(0.0), (centre - rad) / denom), "hi": F.least(F.lit(1.0), (centre + rad) / denom)}


def spearman_brown(icc: Column, k: Column) -> Column:
    return F.when(icc > -1, k * icc / (1 + (k - 1) * icc))


def bubble_area(value: Column, low: Column, high: Column, smallest: float = 16.0, largest: float = 720.0) -> Column:
    """Min-max scaling to an area; the midpoint where all values are alike."""
    return F.when(low == high, F.when(value.isNotNull(), F.lit((smallest + largest) / 2))).otherwise(smallest + (value - low) / (high - low) * (largest - smallest))


def per_chunk(per_hour: float, minutes: float) -> float:
    return per_hour * minutes / 60


def chunk_minute(chunk: Column, minutes: float) -> Column:
    return chunk * minutes


def frame_minute(frame: Column) -> Column:
    return frame / 60


def iqr(c: Column) -> Column:
    return F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))


def drawn(n: Column, *counter: Column) -> Column:
    """A number from 0 to n - 1, the same for the same counter on any engine: the first 32 bits of its MD5, modulo n."""
    digits = F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in counter]).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % n
