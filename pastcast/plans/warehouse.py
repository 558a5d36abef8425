"""Queries of sources, bars and the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastcast.functions.common import micros, rounded
from pastcast.operators import candles, warehouse
from pastcast.plans.data import BARS, PANEL, SERIES, daily_bars, day, event_series, panel
from pastcast.plans.registry import registry
from pastcast.session import scratch, stored, table
from pastcast.sources import bars as bars_io
from pastcast.sources import files
from pastcast.sources import series as series_io

QUERIES, ORACLES, query = registry()


@query("SELECT event_type AS series_id, epoch_us(ts) AS us, value FROM events")
def s1_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series_io.load(spark, table(spark, sf_dir, "events"), "VALUE", "ts", "event_type")
    return out.select("series_id", micros("ts").alias("us"), "value")


@query(f"""WITH {SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, event_id DESC) AS k FROM series
  WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') SELECT series_id, event_id, epoch_us(ts) AS us, value FROM r WHERE k <= 200""")
def s2_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series_io.between(event_series(spark, sf_dir).drop("pos"), "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return series_io.newest(series_io.positions(rows, "event_id"), 200).select("series_id", "event_id", micros("ts").alias("us"), "value")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy bars of orders: several rows per priority and day, some prices that are no numbers, some volumes missing."""
    o = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 97 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return o.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("Timestamp"), price.alias("Open"), *[F.col("o_totalprice").alias(c) for c in ("High", "Low", "Close")], F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_custkey")).alias("Volume"), "o_orderkey")


_LAST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1)"""


@query(f"""WITH {_LAST} SELECT o_orderpriority AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS "day", o_totalprice AS open, o_totalprice AS close,
  CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_custkey::DOUBLE END AS volume FROM last WHERE o_orderkey % 97 <> 0""")
def s3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bars_io.canonical(_raw(spark, sf_dir), ["symbol"], ["o_orderkey"])
    return out.select("symbol", day().alias("day"), "open", "close", "volume")


@query("""WITH parts AS (SELECT *, o_orderkey % 2 AS src FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY src, o_orderpriority, o_orderdate ORDER BY o_orderkey DESC) AS a FROM parts),
  u AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY src DESC) AS b FROM k WHERE a = 1)
  SELECT o_orderpriority AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS "day", o_totalprice AS close FROM u WHERE b = 1""")
def s4_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("timestamp"), *[F.col("o_totalprice").alias(c) for c in ("open", "high", "low", "close")], "o_orderkey")
    part = lambda k: bars_io.canonical(o.filter(F.col("o_orderkey") % 2 == k), ["symbol"], ["o_orderkey"]).drop("o_orderkey")
    return bars_io.upsert(part(0), part(1), ["symbol"]).select("symbol", day().alias("day"), "close")


@query(f"""WITH {BARS}, m AS (SELECT asset_class, symbol, timeframe, min("timestamp") AS a, max("timestamp") AS b, count(*) AS n FROM bars GROUP BY ALL)
  SELECT asset_class, symbol, timeframe, CASE WHEN asset_class = 'stocks' THEN 'vendor' ELSE 'upload' END AS source, strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day, n AS row_count FROM m""")
def s5_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily_bars(spark, sf_dir)
    old = bars_io.manifest(bars.filter("volume > 1"), "2001-01-01").withColumn("source", F.when(F.col("asset_class") == "stocks", "vendor").otherwise("upload"))
    new = bars_io.manifest(bars, "2001-02-01").withColumn("source", F.when(F.col("asset_class") == "stocks", "vendor").otherwise("upload"))
    out = bars_io.replace_manifest(old, new)
    return out.select(*bars_io.DATASET, "source", day("start_timestamp").alias("first_day"), day("end_timestamp").alias("last_day"), "row_count")


@query(f"""WITH {BARS} SELECT asset_class, count(DISTINCT symbol) AS symbols, round(avg(close), 4) AS mean_close FROM bars WHERE timeframe = '1d' GROUP BY asset_class""")
def s7_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over the bars view."""
    daily_bars(spark, sf_dir).createOrReplaceTempView("ohlcv")
    return spark.sql("SELECT asset_class, count(DISTINCT symbol) AS symbols, round(avg(close), 4) AS mean_close FROM ohlcv WHERE timeframe = '1d' GROUP BY asset_class")


@query(f"""WITH {BARS} SELECT asset_class, symbol, timeframe, strftime("timestamp", '%Y-%m-%d') AS day, open, high, low, close, volume FROM bars""")
def s6_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars written as dataset files, beside files at other depths, and read through the view."""
    root = scratch(spark)
    bars = stored(daily_bars(spark, sf_dir))
    files.write(bars, root)
    for place in ("stray.parquet", "stocks/stray.parquet", "stocks/1-URGENT/more/1d.parquet"):
        bars.filter("day(timestamp) = 1").drop(*bars_io.DATASET).write.parquet(f"{root}/{place}")
    files.register(spark, root)
    return spark.sql("SELECT asset_class, symbol, timeframe, date_format(timestamp, 'yyyy-MM-dd') AS day, open, high, low, close, volume FROM ohlcv")


@query(f"""WITH {BARS} SELECT symbol, strftime("timestamp", '%Y-%m-%d') AS day, close FROM bars""")
def s4_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as bars, arriving in three batches of which the second is delivered twice, by two processes."""
    path = scratch(spark)
    bars = stored(daily_bars(spark, sf_dir).select("symbol", "timestamp", "open", "high", "low", "close", "volume"))
    early = bars.filter("month(timestamp) <= 8").withColumn("close", F.lit(0.0))  # corrected by later batches
    for batch_id, batch in ((0, early), (1, bars.filter("month(timestamp) <= 8")), (1, early), (2, bars.filter("month(timestamp) > 8"))):
        bars_io.BarStore(spark, path, ["symbol"]).upsert(batch, batch_id)
    return bars_io.BarStore(spark, path, ["symbol"]).read().select("symbol", day().alias("day"), "close")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return e.groupBy((F.col("user_id") % 3).cast("string").alias("asset_class"), F.col("user_id").cast("string").alias("symbol"), F.col("event_type").alias("timeframe")).agg(
        F.min("ts").alias("start_timestamp"), F.max("ts").alias("end_timestamp"), F.count("*").alias("row_count")
    ).withColumn("source", F.when(F.length("symbol") > 1, "b").otherwise("a"))


_CATALOG = """catalog AS (SELECT (user_id % 3)::VARCHAR AS asset_class, user_id::VARCHAR AS symbol, event_type AS timeframe, min(ts) AS start_timestamp, max(ts) AS end_timestamp, count(*) AS row_count,
  CASE WHEN length(user_id::VARCHAR) > 1 THEN 'b' ELSE 'a' END AS source FROM events GROUP BY user_id, event_type)"""


@query(f"""WITH {_CATALOG} SELECT asset_class, timeframe, source, count(*) AS datasets, sum(row_count)::BIGINT AS total_rows, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols, epoch_us(min(start_timestamp)) AS oldest, epoch_us(max(end_timestamp)) AS newest
  FROM catalog GROUP BY GROUPING SETS ((), (asset_class), (timeframe), (source))""")
def w1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.coverage(_catalog(spark, sf_dir)).withColumns({c: micros(c) for c in ("oldest", "newest")}).drop("level")


@query(f"""WITH {PANEL}, c AS (SELECT series_id AS dataset, count(*) AS n, max(ts) AS updated FROM panel GROUP BY 1),
  l AS (SELECT series_id AS dataset, value, lag(value) OVER w AS prev, epoch(ts) - epoch(lag(ts) OVER w) AS gap, ts FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
  f AS (SELECT dataset, count(*) FILTER (gap > 3 * 86400) AS gaps, count(*) FILTER (prev > 0 AND abs(value - prev) / prev > 0.5) AS spikes, count(*) - count(DISTINCT ts) AS dups FROM l GROUP BY 1)
  SELECT dataset, 'stale' AS issue, 'warning' AS severity, 1::BIGINT AS n FROM c WHERE date_diff('second', updated, TIMESTAMP '2024-01-01') / 3600.0 > 48
  UNION ALL SELECT dataset, 'gap', 'warning', gaps FROM f WHERE gaps > 0 UNION ALL SELECT dataset, 'spike', 'warning', spikes FROM f WHERE spikes > 0 UNION ALL SELECT dataset, 'duplicate', 'warning', dups FROM f WHERE dups > 0""")
def w2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).select(F.col("series_id").alias("dataset"), F.col("ts").alias("timestamp"), F.col("value").alias("close"), "pos")
    catalog = p.groupBy("dataset").agg(F.count("*").alias("row_count"), F.max("timestamp").alias("updated")).withColumn("timeframe", F.lit("1d"))
    return warehouse.quality(p, catalog, F.lit("2024-01-01").cast("timestamp_ntz"), size=500)


@query(f"""WITH {_CATALOG} SELECT symbol, timeframe, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(end_timestamp)) / 3.6e9, 1) AS hours, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(end_timestamp)) / 3.6e9 > 48 AS stale FROM catalog""")
def w3_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warehouse.freshness(_catalog(spark, sf_dir).withColumn("updated", F.col("end_timestamp")), F.lit("2024-02-01").cast("timestamp_ntz"))
    return out.select("symbol", "timeframe", "hours", "stale")


@query(f"""WITH {_CATALOG} SELECT symbol, timeframe, row_count FROM catalog WHERE asset_class = '1' AND source = 'b' AND row_count >= 3""")
def w4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.search(_catalog(spark, sf_dir), "1", "b", 3).select("symbol", "timeframe", "row_count")


@query(f"""WITH {BARS} SELECT strftime("timestamp", '%Y-%m-%d') AS "day", max(close) FILTER (symbol = '1-URGENT') AS urgent, max(close) FILTER (symbol = '5-LOW') AS low FROM bars WHERE symbol IN ('1-URGENT', '5-LOW') GROUP BY 1""")
def w5_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warehouse.aligned(daily_bars(spark, sf_dir), ["1-URGENT", "5-LOW"])
    return out.select(day().alias("day"), F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


_LEGS = f"""{SERIES}, a AS (SELECT ts, value FROM series WHERE series_id = 'click'), b AS (SELECT ts, value FROM series WHERE series_id = 'error')"""


@query(f"""WITH {_LEGS} SELECT epoch_us(a.ts) AS us, a.value AS "left", b.value AS "right" FROM a ASOF LEFT JOIN b ON a.ts >= b.ts""")
def w6_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_series(spark, sf_dir)
    leg = lambda k: s.filter(F.col("series_id") == k).select("ts", "value")
    return warehouse.align_pair(leg("click"), leg("error"), "left_anchor").select(micros("ts").alias("us"), "left", "right")


@query(f"""WITH {BARS}, s AS (SELECT * FROM (VALUES ('a', '1-URGENT', DATE '1996-01-01', DATE '1996-06-30', 'bull'), ('b', '5-LOW', DATE '1997-03-01', DATE '1997-03-31', 'bear'), ('c', '5-LOW', DATE '1997-03-15', DATE '1997-04-30', 'bull')) t(id, dataset, s, e, regime_class))
  SELECT id, regime_class, count(*) AS bars, strftime(min("timestamp"), '%Y-%m-%d') AS first_day, round(avg(close), 4) AS mean_close FROM bars JOIN s ON symbol = dataset AND "timestamp" BETWEEN s.s AND s.e GROUP BY 1, 2""")
def w7_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", "1-URGENT", "1996-01-01", "1996-06-30", "bull"), ("b", "5-LOW", "1997-03-01", "1997-03-31", "bear"), ("c", "5-LOW", "1997-03-15", "1997-04-30", "bull")]
    slices = spark.createDataFrame(rows, "id string, dataset string, start string, end string, regime_class string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    bars = daily_bars(spark, sf_dir).select(F.col("symbol").alias("dataset"), F.col("timestamp").alias("ts"), "close")
    return warehouse.slice_bars(bars, slices).groupBy("id", "regime_class").agg(F.count("*").alias("bars"), F.min(day("ts")).alias("first_day"), F.round(F.avg("close"), 4).alias("mean_close"))


_SLICES = """s AS (SELECT o_custkey % 1000 AS id, o_orderdate AS "start", o_orderdate + to_days((o_orderkey % 9)::INT - 2) AS "end", CASE WHEN o_orderkey % 11 = 0 THEN 'odd' ELSE o_orderstatus END AS regime_class,
  CASE WHEN o_orderkey % 7 = 0 THEN 'deprecated' ELSE 'live' END AS status, CASE WHEN o_orderkey % 14 = 0 THEN 'x' END AS successor_id FROM orders WHERE o_orderkey % 3 = 0),
  d AS (SELECT id, min("start") AS "start", max("end") AS "end" FROM s GROUP BY id), p AS (SELECT o_orderkey AS pair_id, o_custkey % 1200 AS l, o_orderkey % 1000 AS r FROM orders WHERE o_orderkey % 5 = 0)"""


def _slices(o: DataFrame) -> DataFrame:
    start = F.col("o_orderdate").cast("timestamp_ntz")
    return o.filter("o_orderkey % 3 = 0").select(
        (F.col("o_custkey") % 1000).alias("id"), start.alias("start"), (start + F.make_dt_interval(F.col("o_orderkey") % 9 - 2)).alias("end"), F.when(F.col("o_orderkey") % 11 == 0, "odd").otherwise(F.col("o_orderstatus")).alias("regime_class"),
        F.when(F.col("o_orderkey") % 7 == 0, "deprecated").otherwise("live").alias("status"), F.when(F.col("o_orderkey") % 14 == 0, "x").alias("successor_id"),
    )


@query(f"""WITH {_SLICES}, ps AS (
  SELECT id, 'duplicate id' AS problem FROM s GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT id, 'start not before end' FROM s WHERE "start" >= "end" UNION ALL SELECT id, 'end in the future' FROM s WHERE "end" > TIMESTAMP '2000-01-01'
  UNION ALL SELECT id, 'unknown regime class' FROM s WHERE regime_class NOT IN ('F', 'O', 'P') UNION ALL SELECT id, 'deprecated without successor' FROM s WHERE status = 'deprecated' AND successor_id IS NULL)
  SELECT problem, count(*) AS n, sum(id)::BIGINT AS ids FROM ps GROUP BY 1""")
def w8_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = _slices(o)
    none = o.filter("false").select(F.lit("").alias("pair_id"), F.lit(0).alias("left_id"), F.lit(0).alias("right_id"))
    out = warehouse.slice_problems(s, none, ["F", "O", "P"], F.lit("2000-01-01").cast("timestamp_ntz"))
    return out.groupBy("problem").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))


@query(f"""WITH {_SLICES}, x AS (SELECT pair_id, a.id AS l, b.id AS r, greatest(a."start", b."start") > least(a."end", b."end") AS apart FROM p LEFT JOIN d a ON a.id = p.l LEFT JOIN d b ON b.id = p.r)
  SELECT pair_id, CASE WHEN l IS NULL OR r IS NULL THEN 'dangling pair' ELSE 'pair does not overlap' END AS problem FROM x WHERE l IS NULL OR r IS NULL OR apart""")
def w8_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that dangle or don't overlap, over the whole span of each slice id."""
    o = table(spark, sf_dir, "orders")
    d = _slices(o).groupBy("id").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumns({"regime_class": F.lit("F"), "status": F.lit("live"), "successor_id": F.lit(None).cast("string")})
    pairs = o.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("pair_id"), (F.col("o_custkey") % 1200).alias("left_id"), (F.col("o_orderkey") % 1000).alias("right_id"))
    out = warehouse.slice_problems(d, pairs, ["F"], F.lit("2000-01-01").cast("timestamp_ntz"))
    return out.filter(F.col("problem").isin("dangling pair", "pair does not overlap")).select(F.col("id").cast("long").alias("pair_id"), "problem")


@query("""SELECT p_name || p_partkey AS name, CASE WHEN p_size % 4 = 0 THEN 'hourly' WHEN p_size % 4 = 1 THEN 'daily' WHEN p_size % 4 = 2 THEN '2h' ELSE 'unknown' END AS frequency FROM part p
  WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""")
def w9_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_size") % 4 == 0, "1h").when(F.col("p_size") % 4 == 1, "1d").when(F.col("p_size") % 4 == 2, "2h").alias("timeframe"))
    files = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("path"))
    return warehouse.merged_catalog(p, files).select("name", "frequency")


@query(f"""WITH {SERIES}, b AS (SELECT series_id, time_bucket(INTERVAL 4 HOUR, ts) AS bucket, arg_min(value, pos) AS open, max(value) AS high, min(value) AS low, arg_max(value, pos) AS close, sum(value) AS volume, count(*) AS n FROM series GROUP BY 1, 2)
  SELECT series_id, epoch_us(bucket) AS us, open, high, low, close, round(volume, 6) AS volume, n FROM b WHERE n >= 8""")
def b1_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_series(spark, sf_dir)
    bars = s.select("series_id", "ts", "pos", *[F.col("value").alias(c) for c in ("open", "high", "low", "close", "volume")])
    out = candles.coarser(bars, "30m", "4h")
    return out.select("series_id", micros("bucket").alias("us"), "open", "high", "low", "close", rounded("volume").alias("volume"), "n")


@query(f"""WITH {PANEL}, g AS (SELECT series_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY pos)) AS gap FROM panel)
  SELECT series_id, s AS seconds, CASE WHEN s % 604800 = 0 THEN s // 604800 || 'w' WHEN s % 86400 = 0 THEN s // 86400 || 'd' WHEN s % 3600 = 0 THEN s // 3600 || 'h' WHEN s % 60 = 0 THEN s // 60 || 'm' ELSE s || 's' END AS timeframe FROM (SELECT series_id, floor(quantile_cont(gap, 0.5))::BIGINT AS s FROM g WHERE gap IS NOT NULL GROUP BY 1)""")
def b2_timeframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.inferred(panel(spark, sf_dir))


@query(f"""WITH {BARS} SELECT symbol, strftime("timestamp", '%Y-%m-%d') AS "day", close FROM bars WHERE NOT (open = high AND high = low AND low = close) AND (high - low) / greatest(close, 0.01) >= 1e-4 AND (asset_class = 'crypto' OR isodow("timestamp") < 6)""")
def b3_dead_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.without_dead(daily_bars(spark, sf_dir)).select("symbol", day().alias("day"), "close")


@query(f"""WITH {SERIES} SELECT series_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS us, arg_max(value, pos) AS value FROM series GROUP BY 1, 2""")
def b4_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.downsampled(event_series(spark, sf_dir), "1h").select("series_id", micros("ts").alias("us"), "value")
