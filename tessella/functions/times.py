"""Date and time functions. Timestamps have microseconds; ``*_ns`` helpers keep nanoseconds in long columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.math import col

#: Microseconds of each unit, by the short names in use.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def micros(t) -> Column:
    """Microseconds since 1970, of timestamps with and without zone (the latter in the session's zone)."""
    return F.unix_micros(col(t).cast("timestamp"))


def _step(freq: str) -> int:
    number = freq.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return int(number or 1) * UNITS[freq[len(number) :].lower()]


def floor(t, freq: str) -> Column:
    us, n = micros(t), _step(freq)
    return F.timestamp_micros(us - F.pmod(us, F.lit(n)))


def ceil(t, freq: str) -> Column:
    us, n = micros(t), _step(freq)
    return F.timestamp_micros(us + F.pmod(-us, F.lit(n)))


def round_(t, freq: str) -> Column:
    """Halves go to the even multiple."""
    us, n = micros(t), _step(freq)
    low = us - F.pmod(us, F.lit(n))
    rest = us - low
    up = (2 * rest > n) | ((2 * rest == n) & (F.pmod(F.call_function("div", low, F.lit(n)), F.lit(2)) == 1))
    return F.timestamp_micros(F.when(up, low + n).otherwise(low))


def parts(t) -> dict[str, Column]:
    """All calendar fields by name."""
    t = col(t)
    us = F.pmod(micros(t), F.lit(1_000_000))
    return {
        "nanosecond": F.lit(0),
        "microsecond": (us % 1000).cast("int"),
        "millisecond": (us / 1000).cast("int"),
        "second": F.second(t),
        "minute": F.minute(t),
        "hour": F.hour(t),
        "day": F.dayofmonth(t),
        "month": F.month(t),
        "year": F.year(t),
        "dayofyear": F.dayofyear(t),
        "dayofweek": F.weekday(t),
        "week": F.weekofyear(t),
        "date": F.to_date(t),
        "is_leap_year": is_leap_year(t),
    }


def is_leap_year(t) -> Column:
    y = F.year(col(t))
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def isocalendar(t) -> Column:
    """struct<year, week, day>, Monday being day 1."""
    t = col(t)
    return F.struct(F.extract(F.lit("YEAROFWEEK"), t).alias("year"), F.weekofyear(t).alias("week"), (F.weekday(t) + 1).alias("day"))


def timedelta_us(a, b) -> Column:
    """a - b in microseconds."""
    return micros(a) - micros(b)


def components(us) -> dict[str, Column]:
    """Days (rounded down) and the rest of a duration in microseconds."""
    us = col(us)
    day = UNITS["d"]
    rest = F.pmod(us, F.lit(day))
    div = lambda x, n: F.call_function("div", x, F.lit(n))
    return {
        "days": div(us - rest, day),
        "hours": div(rest, UNITS["h"]),
        "minutes": div(rest, UNITS["m"]) % 60,
        "seconds": div(rest, UNITS["s"]) % 60,
        "milliseconds": div(rest, 1000) % 1000,
        "microseconds": rest % 1000,
        "nanoseconds": F.lit(0),
        "total_seconds": us / F.lit(1e6),
        "second_of_day": div(rest, UNITS["s"]),
    }


def date_range(spark: SparkSession, start: str | None = None, periods: int | None = None, freq: str = "d", end: str | None = None, tz: str | None = None, normalize: bool = False, inclusive: str = "both") -> DataFrame:
    """(pos, t), made in the executors: two of start, periods and end.

    ``tz`` is the zone in which start and end are meant (the session's by
    default), ``normalize`` takes their midnights, and ``inclusive`` ('both',
    'left', 'right', 'neither') says which of the two may be among the times.
    """
    import pandas as pd

    if sum(x is not None for x in (start, periods, end)) != 2:
        raise ValueError("two of start, periods and end")
    zone, step = tz or spark.conf.get("spark.sql.session.timeZone"), _step(freq)
    ends = [pd.Timestamp(x) if x is not None else None for x in (start, end)]
    ends = [x.tz_localize(zone) if x is not None and x.tz is None else x for x in ends]
    low, high = ((x.normalize() if normalize else x).value // 1000 if x is not None else None for x in ends)
    if low is None:
        low = high - (periods - 1) * step
    elif periods is None:
        periods = max(0, (high - low) // step + 1)
    if high is None:
        high = low + (periods - 1) * step
    if periods and inclusive in ("right", "neither"):
        low, periods = low + step, periods - 1
    if periods and inclusive in ("left", "neither") and low + (periods - 1) * step == high:
        periods -= 1
    begin = F.lit(low)
    return spark.range(periods).select(F.col("id").alias("pos"), F.timestamp_micros(begin + F.col("id") * _step(freq)).alias("t"))


def timedelta_range(spark: SparkSession, start_us: int, periods: int, freq: str = "d") -> DataFrame:
    return spark.range(periods).select(F.col("id").alias("pos"), (F.lit(start_us) + F.col("id") * _step(freq)).alias("us"))


def split_ns(ns) -> tuple[Column, Column]:
    """(timestamp, nanoseconds within its microsecond) of a long of nanoseconds since 1970."""
    rest = F.pmod(col(ns), F.lit(1000))
    return F.timestamp_micros(F.call_function("div", col(ns) - rest, F.lit(1000))), rest
