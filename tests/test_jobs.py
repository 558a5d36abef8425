"""Invariance, planted answers, edge cases and stream replay."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastcast.operators import candles, copies, regimes, relations, search, warehouse, windows
from pastcast.plans.streams import ticks
from pastcast.sources import bars, series
from pastcast.sources.bars import BarStore
from pastcast.streaming import jobs


def line(spark, values, name="a"):
    return spark.createDataFrame([(name, k, float(v)) for k, v in enumerate(values)], "series_id string, pos long, value double")


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(3)
    x = 100 + np.cumsum(rng.normal(size=900))
    x[200:240] = x[860:900] * 2 + 5  # a scaled copy of the end
    return line(spark, x)


@pytest.mark.parametrize("size", [7, 64, 5000])
def test_chunk_size_does_not_matter(spark, walk, size):
    got = {(r.start, tuple(r["values"])) for r in windows.windows(walk, 40, 3, size).collect()}
    want = {(r.start, tuple(r["values"])) for r in windows.windows(walk, 40, 3).collect()}
    assert got == want and len(got) == (900 - 40) // 3 + 1
    q = search.last_windows(walk, 40)
    pick = lambda s: [(r.start, round(r.score, 9)) for r in search.analogues(walk, q, 40, 5, size=s).orderBy("rank").collect()]
    assert pick(size) == pick(4096)
    v = lambda s: sorted((r.pos, round(r.vol, 9)) for r in regimes.volatility_regime(walk, size=s).collect())
    assert v(size) == v(1 << 16)


def test_planted_copy_is_found_and_own_span_is_not(walk):
    best = search.analogues(walk, search.last_windows(walk, 40), 40, 3).orderBy("rank").collect()
    assert best[0].start == 200 and best[0].score == pytest.approx(1.0)
    assert all(r.start + 40 <= 860 for r in best)


def test_flat_windows(spark):
    flat = windows.normalised(windows.windows(line(spark, [5] * 10), 4, 4), "zscore").collect()
    assert all(set(r.normal) == {0.0} for r in flat)
    mixed = line(spark, [5] * 20 + list(range(20)))
    top = search.analogues(mixed, search.last_windows(mixed, 10), 10, 50, {"pearson": 1.0}).filter("start + 10 <= 20").collect()
    assert all(r.score == 0 for r in top)


def test_empty_series(spark):
    none = spark.createDataFrame([], "series_id string, pos long, value double")
    assert windows.windows(none, 4).count() == 0
    assert search.analogues(none, search.last_windows(none, 4), 4, 3).count() == 0


def test_resolve_lists_columns():
    assert series.resolve(["Close", "x"], "close") == "Close"
    with pytest.raises(KeyError, match="available: a, b"):
        series.resolve(["a", "b"], "close")


def test_bad_last_duplicate_removes_its_stamp(spark):
    raw = spark.createDataFrame([("a", "2024-01-01", "1", 1), ("a", "2024-01-01", "bad", 2), ("a", "2024-01-02", "3", 3)], "symbol string, Timestamp string, x string, k int")
    raw = raw.select("symbol", "Timestamp", *[F.col("x").alias(c) for c in ("Open", "High", "Low", "Close")], "k")
    out = bars.canonical(raw, ["symbol"], ["k"]).collect()
    assert [(r.close, r.volume) for r in out] == [(3.0, 0.0)]
    with pytest.raises(KeyError):
        bars.canonical(raw.drop("High"), ["symbol"], ["k"])


def test_timeframes():
    assert candles.timeframe_seconds("15m") == 900
    for bad in ("m", "0h", "5x"):
        with pytest.raises(ValueError):
            candles.timeframe_seconds(bad)
    with pytest.raises(ValueError):
        candles.coarser(None, "1h", "90m")


def test_pair_alignment(spark):
    leg = lambda rows: spark.createDataFrame(rows, "ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    a, b = leg([("2024-01-01", 1.0), ("2024-01-05", 2.0)]), leg([("2024-01-02", 7.0), ("2024-01-05", 8.0)])
    rows = lambda how: [(r["left"], r["right"]) for r in warehouse.align_pair(a, b, how).orderBy("ts").collect()]
    assert rows("intersection") == [(2.0, 8.0)]
    assert rows("union") == [(1.0, None), (None, 7.0), (2.0, 8.0)]
    assert rows("left_anchor") == [(1.0, None), (2.0, 8.0)]
    assert rows("right_anchor") == [(1.0, 7.0), (2.0, 8.0)]


def test_hurst_of_noise_and_trend(spark):
    rng = np.random.default_rng(1)
    rows = [("noise", [float(x) for x in 100 * np.exp(np.cumsum(rng.normal(size=2000) * 0.01))]), ("short", [1.0, 2.0])]
    got = {r.k: r.hurst for r in regimes.with_hurst(spark.createDataFrame(rows, "k string, values array<double>")).collect()}
    assert 0.4 < got["noise"] < 0.6 and got["short"] == 0.5


def test_streams_replay_batches(spark, sf_dir, tmp_path):
    rows = ticks(spark, sf_dir)
    src = str(tmp_path / "in")
    rows.orderBy("ts").coalesce(1).write.parquet(src)

    def replay(name, make, mode="append"):
        q = make(spark.readStream.schema(rows.schema).parquet(src)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {tuple(r) for r in spark.table(name).collect()}

    batch = {tuple(r) for r in jobs.candles(rows, "6 hours").collect()}
    live = replay("live_candles", lambda s: jobs.candles(s, "6 hours"))
    assert live <= batch and len(live) >= len(batch) - 10  # the last windows stay open
    lists = rows.select(F.col("series_id").alias("watchlist_id")).distinct().withColumns({"threshold": F.lit(40.0), "cooldown_seconds": F.lit(21600.0), "enabled": F.lit(True)})
    scores = lambda s: s.select(F.col("series_id").alias("watchlist_id"), "ts", F.col("value").alias("score"))
    assert replay("live_alerts", lambda s: jobs.alerts(scores(s), lists)) == {tuple(r) for r in jobs.alerts(scores(rows), lists).collect()}


def test_bar_table_keeps_the_last_arrival(spark, tmp_path):
    row = lambda price: spark.createDataFrame([("a", "2024-01-01", price)], "symbol string, timestamp string, x double").select("symbol", "timestamp", *[F.col("x").alias(c) for c in ("open", "high", "low", "close")])
    t = jobs.BarTable(["symbol"], str(tmp_path / "bars"))
    t(row(1.0), 0)
    t(row(2.0), 1)
    t(row(9.0), 1)
    assert [r.close for r in BarStore(spark, t.path, ["symbol"]).read().collect()] == [2.0]


def test_warping_matches_brute_force():
    from pastcast.operators.trials import warping_distances

    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(20, 12)), rng.normal(size=(20, 12))

    def brute(x, y, r):
        d = np.full((13, 13), np.inf)
        d[0, 0] = 0
        for i in range(12):
            for j in range(12):
                if abs(i - j) < r:
                    d[i + 1, j + 1] = (x[i] - y[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
        return np.sqrt(d[12, 12])

    for r in (1, 3, 12):
        assert np.allclose(warping_distances(a, b, r), [brute(x, y, r) for x, y in zip(a, b, strict=True)])


def test_overlaps_go_best_first(spark):
    from pastcast.operators.trials import without_overlaps

    rows = [("q", "s", 0, 10, 0.9), ("q", "s", 4, 14, 0.8), ("q", "s", 6, 16, 0.7), ("q", "t", 30, 40, 0.1)]
    got = without_overlaps(spark.createDataFrame(rows, "query_id string, source string, start long, end long, score double"), 2).collect()
    assert sorted(r.start for r in got) == [0, 6]


def test_any_number_of_queries(spark, walk):
    s = walk.union(line(spark, np.cumsum(np.random.default_rng(8).normal(size=300)) + 50, "b"))
    q = windows.windows(s, 40, 20).select(F.concat_ws("@", "series_id", "start").alias("query_id"), "series_id", F.col("start").alias("q_start"), (F.col("start") + 700).alias("cut"), "values")
    key = lambda df: sorted((r.query_id, r.rank, r.series_id, r.start, round(r.score, 9)) for r in df.collect())
    for own in (False, True):
        want = key(search.analogues(s, q, 40, 3, size=64, own=own))
        assert key(search.analogues(s, q, 40, 3, size=64, own=own, most=7)) == want and len({w[0] for w in want}) > 50


def test_nearest_of_many_queries(spark):
    x = np.random.default_rng(5).normal(size=(1500, 4))
    x[700] = x[3]
    v = spark.createDataFrame([(k, [float(y) for y in r]) for k, r in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in relations.nearest(v, v.filter("id < 1100").select(F.col("id").alias("query_id"), "vec"), 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(z @ z.T, 9)
    np.fill_diagonal(c, -2)
    want = {k: [(i + 1, int(j)) for i, j in enumerate(np.lexsort((np.arange(1500), -c[k]))[:3])] for k in range(1100)}
    assert {k: sorted(g) for k, g in got.items()} == want


def test_paired_bootstrap_draws_with_replacement(spark):
    rng = np.random.default_rng(11)
    x = {"a": rng.normal(0.05, 1, 500), "b": rng.exponential(1, 401) - 1}
    rows = spark.createDataFrame([(i, k, float(v)) for i, d in x.items() for k, v in enumerate(d)], "id string, k long, delta double")
    for r in copies.paired_bootstrap(rows).collect():
        d = x[r.id]
        want = np.quantile([rng.choice(d, len(d)).mean() for _ in range(4000)], [0.025, 0.975])
        assert r.mean == pytest.approx(d.mean()) and r.low < r.mean < r.high
        assert r.high - r.low == pytest.approx(want[1] - want[0], rel=0.25)
        assert 0 < r.p <= 1


def test_watched_stream_finds_what_the_batch_finds(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(s, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), i, float(v)) for s in "ab" for i, v in enumerate(np.cumsum(rng.normal(size=93)))]
    ddl = "series_id string, ts timestamp, event_id long, value double"
    watches = spark.createDataFrame([(f"w{k}", s, [float(x) for x in rng.normal(size=8)], 80.0) for k, s in enumerate("aab")], "watch_id string, series_id string, query array<double>, threshold double")
    for k in range(3):
        spark.createDataFrame([r for r in rows if k * 31 <= r[2] < (k + 1) * 31], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.watch(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), watches, most=30)
    run = stream.writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    key = lambda df: sorted((r.watch_id, r.n, r.ts, round(r.score, 9), r.kind) for r in df.collect())
    batch = key(jobs.watch(spark.createDataFrame(rows, ddl), watches, most=30))
    assert len(batch) == 3 * 17 and {k[4] for k in batch} == {"scan", "alert"}
    assert key(spark.table("watched")) == batch


def test_entries_need_trust_and_a_clear_tail(spark):
    from pastcast.operators import evaluation

    rows = [(0, 1, 0.1, 0.5, True), (1, 1, -0.1, 0.5, True), (2, -1, -0.4, -0.1, True), (3, -1, -0.4, 0.1, True), (4, 0, None, None, True), (5, 1, None, 0.2, True), (6, 1, 0.1, 0.5, False), (7, 1, 0.1, 0.5, None)]
    df = spark.createDataFrame(rows, "id int, side int, tail_low double, tail_high double, trusted boolean").selectExpr("*", "0.5D AS trust", "80.0D AS confidence")
    got = {r.id: (r.side, r.met, round(r.size, 9)) for r in evaluation.entered(df, 0.05, 0.1, 0.6).collect()}
    assert got == {0: (1, True, 0.3), 1: (0, False, 0), 2: (-1, True, 0.3), 3: (0, False, 0), 4: (0, True, 0), 5: (0, False, 0), 6: (0, True, 0), 7: (0, True, 0)}


def test_ensemble_gives_the_regime_share_to_the_plain_cone_where_nothing_fits(spark):
    from pastcast.operators import projection, sampling

    rows = [(q, r, b, 0.01 * r * (b + 1), 1.0 + r, "high_vol", "low_vol" if q == "none" or r % 2 else "high_vol") for q in ("none", "some") for r in range(6) for b in range(3)]
    p = spark.createDataFrame(rows, "query_id string, rank int, bar int, ret double, weight double, query_regime string, regime string")
    value = lambda df: {(r.query_id, r.bar, r.pct): r.value for r in df.collect()}
    plain, drawn, got = value(projection.cone(p, ["query_id"])), value(sampling.monte_carlo(p, ["query_id"], draws=50)), value(sampling.ensemble(p, ["query_id"], draws=50))
    half = p.withColumn("weight", projection.regime_weight(p.weight, p.query_regime, p.regime))
    fit = value(projection.cone(half, ["query_id"]))
    for k in got:
        regime = plain[k] if k[0] == "none" else fit[k]
        assert abs(got[k] - (0.4 * plain[k] + 0.3 * drawn[k] + 0.3 * regime)) < 1e-9
    assert any(abs(fit[k] - plain[k]) > 1e-6 for k in fit)


def test_ensemble_report_counts(spark):
    from pastcast.operators import trials

    df = spark.createDataFrame([("a", 0.1, 0.2, -0.1, 0.0, 0.3), ("a", -0.1, -0.2, -0.1, 0.0, 0.3), ("a", 0.4, 0.1, 0.1, 0.0, 0.3)], "k string, actual double, basic double, p50 double, lower double, upper double")
    r = trials.ensemble_report(df, ["k"]).first()
    assert (r.n, round(r.basic_hit_rate, 9), round(r.hit_rate, 9), round(r.coverage, 9)) == (3, 1.0, round(2 / 3, 9), round(1 / 3, 9))
