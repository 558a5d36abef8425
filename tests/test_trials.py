"""Trials with reasons, retrieval metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastcast.operators import trials


def line(spark, name, values):
    return spark.createDataFrame([(name, i, None if v is None else float(v)) for i, v in enumerate(values)], "series_id string, pos long, value double")


def test_every_trial_is_accounted_for(spark):
    rng = np.random.default_rng(2)
    walk = np.abs(100 + np.cumsum(rng.normal(size=260)))
    zeros = walk.copy()
    zeros[rng.random(260) < 0.35] = 0.0
    dead = np.where(np.arange(260) < 200, 0.0, walk)  # every match has a zero anchor
    rows = line(spark, "walk", walk).union(line(spark, "zeros", zeros)).union(line(spark, "dead", dead))
    width, bars, k = 10, 5, 3
    drawn = trials.drawn_positions(rows, width, bars, 40)
    curves, account = trials.accounted(rows, drawn, width, bars, k, {"pearson": 1.0})
    got = account.collect()
    asked = {r.query_id: r for r in drawn.collect()}
    assert {r.query_id for r in got} == set(asked) and len(got) == 120
    answered = {r.query_id for r in curves.select("query_id").distinct().collect()}
    assert answered == {r.query_id for r in got if r.reason is None}
    reasons = {s: {r.reason for r in got if r.series_id == s} for s in ("walk", "zeros", "dead")}
    assert reasons["walk"] == {None} and {None, "anchor value is zero"} <= reasons["zeros"] and "no valid forward paths" in reasons["dead"]
    of = {"walk": walk, "zeros": zeros, "dead": dead}
    for r in got:
        v, at = of[r.series_id], r.q_start
        zero = v[at + width - 1] == 0
        assert (r.reason == "anchor value is zero") == zero
        if zero:
            assert (r.n_matches, r.n_paths, r.hit) == (0, 0, None)
            continue
        q = v[at : at + width]
        score = []
        for s in range(at - width - bars + 1):
            w = v[s : s + width]
            c = np.corrcoef(q, w)[0, 1] if q.std() > 1e-10 and w.std() > 1e-10 else -1.0
            score.append((-round((c + 1) / 2, 12), s))
        best = [s for _, s in sorted(score)[:k]]
        rets = [(v[s + width + bars - 1] - v[s + width - 1]) / v[s + width - 1] for s in best if v[s + width - 1] != 0]
        assert (r.n_matches, r.n_paths) == (len(best), len(rets))
        assert r.mean_match == (pytest.approx(np.mean(rets)) if rets else None)


def test_input_checks(spark):
    rows = line(spark, "short", [1.0] * 44).union(line(spark, "fits", [1.0] * 45)).union(line(spark, "null", [None] + [1.0] * 60)).union(line(spark, "nan", [float("nan")] + [1.0] * 60)).union(line(spark, "inf", [float("inf")] + [1.0] * 60))
    got = {r.series_id: r.reason for r in trials.input_checks(rows, 10, 5, 3).collect()}
    assert got == {"short": "history too short", "fits": None, "null": "values that are not finite", "nan": "values that are not finite", "inf": "values that are not finite"}
    for bad in ((0, 5, 3), (10, 0, 3), (10, 5, 0)):
        with pytest.raises(ValueError):
            trials.input_checks(rows, *bad)


def test_empirical_crps_is_the_integral(spark):
    rng, levels = np.random.default_rng(4), [0.1, 0.25, 0.5, 0.75, 0.9]
    cases = [(float(rng.normal()), sorted(float(x) for x in rng.normal(size=5))) for _ in range(40)] + [(0.3, [0.3] * 5), (5.0, [0.0, 0.0, 1.0, 1.0, 2.0]), (-5.0, [0.0, 0.0, 1.0, 1.0, 2.0])]
    df = spark.createDataFrame([(k, y, q) for k, (y, q) in enumerate(cases)], "k long, y double, q array<double>")
    got = {r.k: r.c for r in df.select("k", trials.empirical_crps(F.col("y"), F.col("q"), levels).alias("c")).collect()}
    for k, (y, q) in enumerate(cases):
        x = np.linspace(min(y, q[0]) - 0.01, max(y, q[-1]) + 0.01, 400_001)
        f = np.select([x < q[0], x >= q[-1]], [0.0, 1.0], np.array([*levels, 1.0])[np.clip(np.searchsorted(q, x, "right") - 1, 0, 4)])
        assert got[k] == pytest.approx(((f - (x >= y)) ** 2).sum() * (x[1] - x[0]), abs=2e-4)


def test_runtimes(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(101)] + [("b", 3.0)], "arm string, runtime double")
    got = {r.arm: (r.rt_median, r.rt_mean, r.rt_p95) for r in trials.runtimes(df).collect()}
    assert got == {"a": (50.0, 50.0, 95.0), "b": (3.0, 3.0, 3.0)}


def test_cross_timeframe(spark):
    rng = np.random.default_rng(6)
    v = 100 + np.cumsum(rng.normal(size=400))
    at = np.datetime64("2024-01-01") + np.arange(400) * np.timedelta64(10, "m")
    rows = spark.createDataFrame([("s", i, str(at[i]).replace("T", " "), float(v[i])) for i in range(400)], "series_id string, pos long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    q = [float(x) for x in np.sin(np.arange(40) / 5)]
    asked = spark.createDataFrame([("q", q)], "query_id string, values array<double>")
    got = sorted((r.source, r.start, r.end, round(r.score, 9)) for r in trials.cross_timeframe(rows, asked, ["10m", "20m", "1h", "1d"], 40, 6, {"pearson": 1.0}, 0, 5).collect())
    every = []
    for frame, step in (("10m", 1), ("20m", 2), ("1h", 6)):  # a day leaves too few values
        slow = v[step - 1 :: step] if len(v) % step == 0 else np.append(v[step - 1 :: step], v[-1])
        size = round(40 * len(slow) / 400)
        drawn = np.interp(np.linspace(0, 1, size), np.linspace(0, 1, 40), q)
        score = [((np.corrcoef(drawn, slow[i : i + size])[0, 1] + 1) / 2, i) for i in range(len(slow) - size + 1)]
        every += [(-s, f"s:{frame}", i, i + size) for s, i in sorted(score, key=lambda x: (-x[0], x[1]))[:6]]
    kept = []
    for s, source, a, b in sorted(every):
        if len(kept) < 6 and all(min(b, d) - max(a, c) <= 0.5 * (b - a) for _, _, c, d in kept):
            kept.append((s, source, a, b))
    assert got == sorted((source, a, b, round(-s, 9)) for s, source, a, b in kept)
