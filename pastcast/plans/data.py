"""Stand-ins for the domain's tables, derived from the given tables; each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastcast.session import table
from pastcast.sources.series import positions


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, event_id, ts, value, pos): one series per event type, values of at least 0.01."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.greatest("value", F.lit(0.01)).alias("value"))
    return positions(rows, "event_id")


SERIES = """series AS (SELECT event_type AS series_id, event_id, ts, greatest(value, 0.01) AS value,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events)"""


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_class, symbol, timeframe, timestamp, open, high, low, close, volume): order prices per priority and day."""
    o = table(spark, sf_dir, "orders").withColumn("timestamp", F.col("o_orderdate").cast("timestamp_ntz"))
    bars = o.groupBy(F.col("o_orderpriority").alias("symbol"), "timestamp").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume")
    )
    kind = F.when(F.col("symbol") < "3", "stocks").otherwise("crypto")
    return bars.select(kind.alias("asset_class"), "symbol", F.lit("1d").alias("timeframe"), "timestamp", "open", "high", "low", "close", "volume")


BARS = """bars AS (SELECT CASE WHEN o_orderpriority < '3' THEN 'stocks' ELSE 'crypto' END AS asset_class, o_orderpriority AS symbol, '1d' AS timeframe,
  o_orderdate AS "timestamp", arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY o_orderpriority, o_orderdate)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts, value, pos): closes of the daily bars, placed."""
    return positions(daily_bars(spark, sf_dir).select(F.col("symbol").alias("series_id"), F.col("timestamp").alias("ts"), F.col("close").alias("value")))


PANEL = BARS + """, panel AS (SELECT symbol AS series_id, "timestamp" AS ts, close AS value, row_number() OVER (PARTITION BY symbol ORDER BY "timestamp") - 1 AS pos FROM bars)"""


def day(n: str = "timestamp") -> F.Column:
    """ISO date text of a stamp."""
    return F.date_format(F.col(n).cast("date"), "yyyy-MM-dd")
