"""Column helpers shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the timeframe units.
UNIT_SECONDS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def seconds(ts: Column | str) -> Column:
    return F.floor(micros(ts) / 1_000_000)


def timeframe_seconds(code: str) -> int:
    """Seconds of a code like 5m, 1h, 1d or 1w."""
    count, unit = code[:-1], code[-1:]
    if unit not in UNIT_SECONDS or not count.isdigit() or int(count) == 0:
        raise ValueError(f"not a timeframe: {code!r}")
    return int(count) * UNIT_SECONDS[unit]


def pair_sum(a: Column, b: Column) -> Column:
    """Sum of the products of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
