"""Queries of the streaming jobs, on whole tables as batches; the tests replay them as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastcast.operators.windows import windows
from pastcast.plans.data import SERIES, event_series
from pastcast.plans.registry import registry
from pastcast.streaming import jobs

QUERIES, ORACLES, query = registry()


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_series(spark, sf_dir).select("series_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


@query(f"""WITH {SERIES} SELECT series_id, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS at, arg_min(value, pos) AS open, max(value) AS high, min(value) AS low, arg_max(value, pos) AS close, round(sum(value), 6) AS volume, count(*) AS n FROM series GROUP BY 1, 2""")
def x4_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.candles(ticks(spark, sf_dir), "6 hours").select("series_id", F.date_format("ts", "yyyy-MM-dd HH").alias("at"), "open", "high", "low", "close", F.round("volume", 6).alias("volume"), "n")


@query(f"""WITH RECURSIVE {SERIES}, h AS (SELECT series_id AS w, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) AS k FROM series WHERE value >= 40),
  nx AS (SELECT w, k, us, (SELECT min(k) FROM h b WHERE b.w = h.w AND b.us >= h.us + 21600000000) AS next FROM h), f(w, k) AS (SELECT w, 1::BIGINT FROM (SELECT DISTINCT w FROM h) UNION ALL SELECT nx.w, nx.next FROM f JOIN nx ON nx.w = f.w AND nx.k = f.k WHERE nx.next IS NOT NULL)
  SELECT h.w AS watchlist_id, h.us, h.value AS score FROM f JOIN h ON h.w = f.w AND h.k = f.k""")
def x2_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).select(F.col("series_id").alias("watchlist_id"), "ts", F.col("value").alias("score"))
    lists = t.select("watchlist_id").distinct().withColumns({"threshold": F.lit(40.0), "cooldown_seconds": F.lit(21600.0), "enabled": F.lit(True)})
    return jobs.alerts(t, lists).select("watchlist_id", F.unix_micros("ts").alias("us"), "score")


_WATCHED = 12


@query(f"""WITH {SERIES}, w AS (SELECT series_id, pos, ts, list(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {_WATCHED - 1} PRECEDING AND CURRENT ROW) AS v FROM series), f AS (SELECT * FROM w WHERE len(v) = {_WATCHED}), q AS (SELECT series_id, v AS q FROM f WHERE pos = {_WATCHED - 1}),
  c AS (SELECT f.series_id, pos, ts, i, v[i] AS x, q[i] AS y FROM f JOIN q USING (series_id) JOIN range(1, {_WATCHED + 1}) r(i) ON true), s AS (SELECT series_id, pos, ts, coalesce(50 * (1 + corr(x, y)), 0.0) AS s FROM c GROUP BY 1, 2, 3),
  b AS (SELECT series_id, pos + 1 AS n, epoch_us(ts) AS us, max(s) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {100 - _WATCHED} PRECEDING AND CURRENT ROW) AS score FROM s)
  SELECT series_id AS watch_id, n, us, round(score, 6) AS score, CASE WHEN round(score, 9) >= 85 THEN 'alert' ELSE 'scan' END AS kind FROM b WHERE n % 5 = 0""")
def x1_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series watched for its own first twelve values over the last hundred."""
    t = ticks(spark, sf_dir)
    q = windows(event_series(spark, sf_dir), _WATCHED, 1 << 16).filter("start = 0")
    w = q.select(F.col("series_id").alias("watch_id"), "series_id", F.col("values").alias("query"), F.lit(85.0).alias("threshold"))
    return jobs.watch(t, w, most=100).select("watch_id", "n", F.unix_micros("ts").alias("us"), F.round("score", 6).alias("score"), "kind")
