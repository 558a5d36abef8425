"""Copies: regime blocks, copula, partial autocorrelation against numpy."""

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pytest

from pastcast.operators import copies, relations


def uniform(*parts):
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)


def normal(*parts):
    return math.sqrt(-2 * math.log(uniform(*parts, "a"))) * math.cos(2 * math.pi * uniform(*parts, "b"))


def test_copula_is_that_of_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    data = np.stack([x, np.round(x * 2 + rng.normal(size=400)), np.where(rng.random(400) < 0.4, 5.0, rng.exponential(size=400)), np.full(400, 7.0)], axis=1)
    names = ["a", "b", "c", "k"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data] + [(None, 1.0, 1.0, 7.0)], "a double, b double, c double, k double")
    shares = [[(v, (data[:, i] <= v).sum() / 401) for v in np.unique(data[:, i])] for i in range(3)]
    scores = np.stack([[NormalDist().inv_cdf(dict(shares[i])[v]) for v in data[:, i]] for i in range(3)])
    root = copies.root_of(np.corrcoef(scores))
    assert np.allclose(root @ root.T, np.corrcoef(scores))
    n = 11_000  # three buckets
    got = {r.id: r for r in copies.copula(df, names, n).collect()}
    assert sorted(got) == list(range(n))
    for i in range(0, n, 61):
        z = root @ [normal(i, k, 1) for k in range(3)]
        want = [np.interp(NormalDist().cdf(z[k]), [s for _, s in shares[k]], [v for v, _ in shares[k]]) for k in range(3)]
        assert np.allclose([got[i].a, got[i].b, got[i].c, got[i].k], [*want, 7.0], atol=1e-6)
    flat = copies.copula(spark.createDataFrame([(2.0,), (2.0,)], "a double"), ["a"], 3).collect()
    assert [tuple(r) for r in sorted(flat)] == [(0, 2.0), (1, 2.0), (2, 2.0)]
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    a = copies.root_of(bad)
    assert np.allclose(np.diag(a @ a.T), 1) and np.linalg.eigvalsh(a @ a.T).min() > -1e-9


def test_autocorrelations_of_columns_placed_once(spark):
    rng = np.random.default_rng(6)
    x = np.stack([np.cumsum(rng.normal(size=500)), rng.normal(size=500), np.full(500, 2.0)], axis=1)
    rows = [(k, *(None if i == 1 and k % 50 == 7 else float(v) for i, v in enumerate(r))) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "pos long, a double, b double, c double").repartition(3)
    out = relations.column_autocorrelations(df, ["a", "b", "c"], [1, 5])
    got = {(r.series_id, r.lag): r.acf for r in out.collect()}
    long = df.selectExpr("pos", "stack(3, 'a', a, 'b', b, 'c', c) AS (series_id, value)")
    want = {(r.series_id, r.lag): r.acf for r in relations.autocorrelation(long, [1, 5]).collect()}
    assert got == {k: pytest.approx(v, rel=1e-9) if v is not None else None for k, v in want.items()} and len(got) == 6 and got["c", 1] is None
    m = x[:, 0] - x[:, 0].mean()
    assert got["a", 5] == pytest.approx((m[5:] * m[:-5]).sum() / (m * m).sum())


def test_copula_by_broadcast_and_by_buckets(spark):
    rng = np.random.default_rng(4)
    data = np.stack([rng.normal(size=300), rng.integers(0, 9, 300) / 4.0, -rng.integers(0, 2, 300) * 0.0], axis=1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, k double")
    got = []
    for points, shuffled in ((0, True), (20, True), (copies.POINTS, False)):
        out = copies.copula(df, ["a", "b", "k"], 10_500, points=points)
        assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == shuffled  # made rows stay where they are made
        got.append(np.array(sorted(tuple(r) for r in out.collect())))
    assert got[0].shape == (10_500, 4) and all(np.allclose(got[0], x, atol=1e-6) for x in got[1:])


def test_pure_starts_for_any_chunk_and_a_regime_without_any(spark):
    rng = np.random.default_rng(5)
    label = [bool(x) for x in np.repeat(rng.random(40) < 0.5, 7)] + [True, False] * 10
    df = spark.createDataFrame([("s", i, float(i), v) for i, v in enumerate(label)], "series_id string, pos long, value double, label boolean")
    want = {}
    for i in range(len(label) - 5):
        if len(set(label[i : i + 6])) == 1:
            want.setdefault(label[i], []).append(i)
    for size in (1 << 16, 16):
        got = {(r.label, r.at): r.start for r in copies.pure_starts(df, 6, size).collect()}
        assert got == {(v, k): s for v, starts in want.items() for k, s in enumerate(starts)}
    made = copies.regime_bootstrap(df, 6).orderBy("pos").collect()
    assert [r.pos for r in made] == list(range(len(label))) and all(label[int(r.value)] == r.label for r in made)
    odd = spark.createDataFrame([("s", i, float(i), i % 2 == 0) for i in range(30)], "series_id string, pos long, value double, label boolean")
    assert copies.regime_bootstrap(odd, 6).count() == 30


def test_partial_autocorrelation_solves_the_same_equations(spark):
    rng = np.random.default_rng(2)
    series = {"a": np.cumsum(rng.normal(size=120)), "b": rng.normal(size=80), "flat": np.ones(30), "short": rng.normal(size=6)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "series_id string, pos long, value double")
    got = {(r.series_id, r.lag): (r.acf, r.pacf) for r in relations.partial_autocorrelation(df, [1, 5, 10]).collect()}
    for name in "ab":
        x = series[name] - series[name].mean()
        r = np.array([1.0] + [x[:-k] @ x[k:] / (x @ x) for k in range(1, 11)])
        for lag in (1, 5, 10):
            phi = np.linalg.solve([[r[abs(i - j)] for j in range(lag)] for i in range(lag)], r[1 : lag + 1])
            assert np.allclose(got[name, lag], (r[lag], phi[-1]))
    assert got["flat", 1] == (None, None) and got["short", 10] == (None, None) and got["short", 5][0] is not None
    same = relations.temporal_fidelity(df, df, [1, 5]).collect()
    assert all(abs(r.acf or 0) < 1e-12 and abs(r.pacf or 0) < 1e-12 for r in same) and sum(r.lag == 0 for r in same) == 4


def test_normal_scores_and_shares_by_table():
    z = np.concatenate([np.random.default_rng(1).normal(size=5000) * 2, np.linspace(-8.9, 8.9, 1001), [0.0]])
    want = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
    assert np.abs(copies.share_of(z) - want).max() < 1e-12 and np.abs(copies.share_of(z) / want - 1).max() < 1e-8
    u = np.concatenate([np.random.default_rng(2).random(5000), 10.0 ** -np.arange(1, 12), 1 - 10.0 ** -np.arange(1, 12), [0.0, 0.5, 1.0]])
    assert np.abs(copies.score_of(u) - [NormalDist().inv_cdf(min(max(x, 1e-10), 1 - 1e-10)) for x in u]).max() < 1e-8
    assert copies.share_of(np.array([-40.0, 40.0])) == pytest.approx([0, 1]) and len(copies.score_of(np.array([]))) == 0


def test_blocks_are_never_broadcast(spark):
    rows = spark.createDataFrame([("a", i, float(i), i % 40 < 20) for i in range(500)], "series_id string, pos long, value double, label boolean")
    for made in (copies.block_bootstrap(rows, 25), copies.regime_bootstrap(rows, 10)):
        assert made.count() == 500
        made.collect()
        last = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "Broadcast" not in last.split("SortMergeJoin")[0] and "SortMergeJoin" in last  # the last join, of every row
