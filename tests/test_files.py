"""Dataset files, the bar store over restarts, alerts with long silences."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from pastcast.sources import files
from pastcast.sources.bars import BarStore
from pastcast.streaming import jobs


def bars_of(spark, rows):
    df = spark.createDataFrame(rows, "symbol string, timestamp string, x double")
    return df.select("symbol", "timestamp", *[F.col("x").alias(c) for c in ("open", "high", "low", "close")])


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    while "AdaptiveSparkPlan" in leaves.head().nodeName():
        leaves = leaves.head().executedPlan().collectLeaves()
    return leaves.head().metrics().get("numFiles").get().value()


def test_view_over_files(spark, tmp_path):
    root = str(tmp_path / "da ta")
    assert files.datasets(spark, root).count() == 0
    rows = [("crypto", s, t, "2024-01-01", float(k)) for k, (s, t) in enumerate([("btc usdt", "1d"), ("btc usdt", "1h"), ("a/b+c%", "1d"), ("eth", "1d")])]
    df = spark.createDataFrame(rows, "asset_class string, symbol string, timeframe string, timestamp string, close double")
    files.write(df, root)
    spark.range(1).write.parquet(f"{root}/crypto/1d.parquet")  # other depths
    spark.range(1).write.parquet(f"{root}/crypto/eth/more/1d.parquet")
    os.makedirs(f"{root}/stocks/spy")
    spark.createDataFrame([("2024-01-02", 7.0, 1)], "timestamp string, close double, extra int").toPandas().to_parquet(f"{root}/stocks/spy/1d.parquet")  # a plain file with a column more
    got = {(r.asset_class, r.symbol, r.timeframe, r.close, r.extra) for r in files.register(spark, root).collect()}
    assert got == {(a, s, t, c, None) for a, s, t, _, c in rows} | {("stocks", "spy", "1d", 7.0, 1)}
    assert spark.sql("SELECT count(*) AS n FROM ohlcv WHERE symbol = 'eth'").first().n == 1
    view = files.datasets(spark, root, "timestamp string, close double")
    assert files_read(view) == 5 and files_read(view.filter("symbol = 'eth'")) == 1 and files_read(view.filter("timeframe = '1h' and asset_class = 'crypto'")) == 1
    files.write(df.filter("symbol = 'eth'").withColumn("close", F.lit(-1.0)), root)  # replaces one
    assert sorted(r.close for r in files.datasets(spark, root).collect()) == [-1.0, 0.0, 1.0, 2.0, 7.0]


def test_store_outlives_its_writer(spark, tmp_path):
    path = str(tmp_path / "bars")
    store = lambda writer="a": BarStore(spark, path, ["symbol"], writer)  # noqa: E731  a new process each time
    assert store().read() is None and store().last_batch() == -1
    assert store().upsert(bars_of(spark, [("01", "2024-01-01", 1.0), ("1", "2024-01-01", 2.0), (None, "2024-01-01", 9.0)]), 0)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "bars" / "data").rglob("*.parquet")}
    assert store().upsert(bars_of(spark, [("1", "2024-01-01", 3.0), ("1", "2024-01-02", 4.0), ("x", "2024-01-01", 5.0)]), 1)
    assert not store().upsert(bars_of(spark, [("1", "2024-01-01", 99.0)]), 1)  # delivered again
    rows = lambda: sorted((r.symbol, str(r.timestamp)[:10], r.close) for r in store().read().collect())
    want = [("01", "2024-01-01", 1.0), ("1", "2024-01-01", 3.0), ("1", "2024-01-02", 4.0), ("x", "2024-01-01", 5.0)]
    assert rows() == want and all(os.stat(f).st_mtime_ns == t for f, t in before.items())
    assert store("b").upsert(bars_of(spark, [("x", "2024-01-02", 6.0)]), 0)  # another stream has batches of its own
    assert (store("a").last_batch(), store("b").last_batch(), store().version()) == (1, 0, 2)
    bars_of(spark, [("x", "2024-01-03", 7.0)]).write.parquet(f"{path}/data/version=3")  # a run that died before its commit
    assert rows() == sorted([*want, ("x", "2024-01-02", 6.0)])
    assert store().upsert(bars_of(spark, [("x", "2024-01-03", 8.0)]), 2) and rows()[-1] == ("x", "2024-01-03", 8.0)


def test_stream_of_bars_restarts(spark, tmp_path):
    path, src = str(tmp_path / "bars"), tmp_path / "in"
    schema = "symbol string, timestamp string, open double, high double, low double, close double"

    def run():
        q = spark.readStream.schema(schema).parquet(str(src)).writeStream.foreachBatch(jobs.BarTable(["symbol"], path)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()

    bars_of(spark, [("a", "2024-01-01", 1.0), ("b", "2024-01-01", 1.0)]).write.parquet(str(src))
    run()
    bars_of(spark, [("a", "2024-01-01", 2.0)]).write.mode("append").parquet(str(src))
    run()
    os.remove(tmp_path / "c" / "commits" / "1")  # as if it had ended between the batch and the stream's own note of it
    for f in (tmp_path / "c" / "commits").glob(".1*"):
        os.remove(f)
    run()
    store = BarStore(spark, path, ["symbol"])
    assert sorted((r.symbol, r.close) for r in store.read().collect()) == [("a", 2.0), ("b", 1.0)] and store.version() == 1


def fold(hits):
    out, last = [], {}
    for w, ts, score, quiet in sorted(hits, key=lambda x: (x[0], x[1], -x[2])):
        if w not in last or (ts - last[w]).total_seconds() >= quiet:
            out.append((w, ts, score))
            last[w] = ts
    return sorted(out)


@pytest.mark.parametrize("quiet", [0.0, 0.5, 3600.0, 2.5 * 86400])
def test_alerts_equal_a_fold(spark, quiet):
    import random

    r, start = random.Random(5), datetime.datetime(2024, 1, 1)
    hits = [(w, start + datetime.timedelta(seconds=r.choice([r.randint(0, 900_000), 7200, 86400 * r.randint(0, 9)])), float(r.randint(0, 60)), quiet) for w in ("a", "b") for _ in range(400)] + [("one", start, 5.0, quiet)]
    scores = spark.createDataFrame([h[:3] for h in hits], "watchlist_id string, ts timestamp, score double")
    lists = spark.createDataFrame([(w, 2.0, quiet, w != "off") for w in ("a", "b", "one", "off", "none")], "watchlist_id string, threshold double, cooldown_seconds double, enabled boolean")
    got = sorted(tuple(x) for x in jobs.alerts(scores, lists).collect())
    assert got == fold([h for h in hits if h[2] >= 2.0])


def test_silence_of_two_days_on_a_stream(spark, tmp_path):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    lists = spark.createDataFrame([("w", 1.0, 2 * 86400.0, True), ("v", 1.0, 60.0, True)], "watchlist_id string, threshold double, cooldown_seconds double, enabled boolean")
    src, schema = str(tmp_path / "in"), "watchlist_id string, ts timestamp, score double"
    batches = [[("w", day(1), 5.0), ("v", day(1), 2.0)], [("v", day(2, 12), 2.0)], [("w", day(2, 20), 6.0)], [("v", day(3, 1), 2.0)], [("w", day(3, 2), 7.0)]]
    for rows in batches:  # a query that stops and starts again between batches
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = jobs.alerts(spark.readStream.schema(schema).parquet(src), lists).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [(w, t) for w, t, _ in got if w == "w"] == [("w", day(1)), ("w", day(3, 2))]
    assert got == fold([(w, t, s, 2 * 86400.0 if w == "w" else 60.0) for rows in batches for w, t, s in rows])
