"""Coarser candles, inferred timeframes, dead bars, downsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastcast.functions.common import UNIT_SECONDS, micros, timeframe_seconds
from pastcast.operators import order_stats
from pastcast.sources.series import framed, in_chunk


def bucket(ts: Column, size: int, offset: int = 0) -> Column:
    """Start of the left-closed bucket of ``size`` seconds, anchored at midnight plus the offset; weeks begin on Monday."""
    anchor = offset + (4 * 86400 if size % 604800 == 0 else 0)
    start = F.floor((micros(ts) - anchor * 1_000_000) / (size * 1_000_000)) * size + anchor
    return F.timestamp_add("SECOND", start, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def coarser(bars: DataFrame, source: str, target: str, session: str | None = None, incomplete: bool = False) -> DataFrame:
    """Open first, high, low, close last, volume sum per bucket; a bucket is complete with target / source rows.

    session: HH:MM that buckets are anchored at. Incomplete buckets are left out unless asked for. ValueError if the target is
    not an even multiple of the source. Partial aggregates precede the shuffle.
    """
    a, b = timeframe_seconds(source), timeframe_seconds(target)
    if b <= a or b % a:
        raise ValueError(f"{target} is not a multiple of {source}")
    offset = int(session[:2]) * 3600 + int(session[3:]) * 60 if session else 0
    out = bars.groupBy("series_id", bucket(F.col("ts"), b, offset).alias("bucket")).agg(
        F.min_by("open", "pos").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "pos").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n")
    )
    out = out.withColumn("complete", F.col("n") >= b // a)
    return out if incomplete else out.filter("complete")


def timeframe_code(s: Column) -> Column:
    """A number of seconds in the largest unit that divides it."""
    out = F.concat(s.cast("string"), F.lit("s"))
    for unit, size in sorted(UNIT_SECONDS.items(), key=lambda x: x[1]):
        out = F.when(s % size == 0, F.concat((s / size).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return out


def inferred(rows: DataFrame, few: int = order_stats.FEW) -> DataFrame:
    """(series_id, seconds, timeframe): the median spacing in whole seconds."""
    gaps = framed(rows, {"gap": (micros("ts") - micros(F.lag("ts").over(in_chunk()))) / 1e6}, before=1)
    out = order_stats.per_key(gaps, ["series_id"], "gap", {"gap": 0.5}, few).select("series_id", F.floor("gap").alias("seconds"))
    return out.withColumn("timeframe", timeframe_code(F.col("seconds")))


def without_dead(bars: DataFrame, flat: float = 1e-4) -> DataFrame:
    """Bars that moved; weekends only of crypto."""
    still = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    thin = (F.col("high") - F.col("low")) / F.greatest("close", F.lit(0.01)) < flat
    weekend = (F.col("asset_class") != "crypto") & F.dayofweek("timestamp").isin(1, 7)
    return bars.filter(~still & ~thin & ~weekend)


def downsampled(rows: DataFrame, period: str) -> DataFrame:
    """The last value of each period; series that keep fewer than two bars are left out."""
    out = rows.groupBy("series_id", bucket(F.col("ts"), timeframe_seconds(period)).alias("ts")).agg(F.max_by("value", "pos").alias("value"))
    enough = out.groupBy("series_id").count().filter("count >= 2")
    return out.join(enough, "series_id", "left_semi")
