"""Exact quantiles by narrowing and exact neighbours by pivots, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastcast.operators import order_stats, privacy, relations
from pastcast.operators.neighbours import DIRECT_BYTES, Neighbours, best_pairs, boxed_pairs, boxes_of, merged, pairs_within, places, take_in

PS = [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(0)
    return {
        "normal": rng.normal(size=3000), "mostly one": np.r_[np.zeros(900), rng.normal(size=100)], "one": np.ones(700), "many decades": 10.0 ** rng.uniform(-300, 300, 2000), "few": rng.integers(0, 5, 1500).astype(float),
        None: rng.exponential(size=800), "single": np.array([3.0]), "two": np.array([2.0, 4.0]), "negative": -np.arange(1000.0),
    }


@pytest.mark.parametrize("few, steps", [(20, 50), (order_stats.FEW, order_stats.STEPS)])
def test_quantiles(spark, values, few, steps):
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("normal", None), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    got = {(r.k, r.p): r.value for r in order_stats.quantiles(df, ["k"], "x", PS, few, steps).collect()}
    want = {(k, p): float(np.quantile(v, p)) for k, v in values.items() for p in PS}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-12, abs=0) for k in want)


def test_quantiles_without_keys(spark, values):
    df = spark.createDataFrame([(float(x),) for x in values["normal"]], "x double")
    row = order_stats.one_row(df, "x", {"m": 0.5, "low": 0.05}, 30).first()
    assert (row.m, row.low) == tuple(pytest.approx(np.quantile(values["normal"], p), rel=1e-12) for p in (0.5, 0.05))
    assert order_stats.one_row(df.filter("false"), "x", {"m": 0.5}).first().m is None


N, KINDS = 1200, 3


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    centres = 4 * rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, N)] + 0.3 * rng.normal(size=(N, 8))
    x[100:160], x[7], x[8] = x[100], 0, 0  # copies and zero vectors
    kind = rng.integers(0, KINDS, N)
    rows = [(i, f"k{kind[i]}", [float(v) for v in x[i]]) for i in range(N)]
    return x, kind, spark.createDataFrame(rows, "id long, kind string, vec array<double>").repartition(4)


def distances(x, i, metric):
    if metric == "euclidean":
        return np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 9)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    return np.round(1 - u @ u[i], 9)


@pytest.mark.parametrize("direct", [0, DIRECT_BYTES])
@pytest.mark.parametrize("metric, radius", [("euclidean", 0.5), ("cosine", 0.05)])
def test_neighbours(cloud, metric, radius, direct):
    x, _, df = cloud
    search = Neighbours(df, metric, block=64, direct=direct)
    got = sorted((r.id, r.other, r["rank"]) for r in search.nearest(df, 5).collect())
    want = []
    for i in range(N):
        d = distances(x, i, metric)
        want += [(i, j, k + 1) for k, j in enumerate(sorted((j for j in range(N) if j != i), key=lambda j: (d[j], j))[:5])]
    assert got == sorted(want)
    assert direct or search.met[0] < 0.25 * search.met[1]  # rows meet few of the blocks
    asked = df.filter("id % 50 = 0")
    got = sorted((r.id, r.other) for r in search.within(asked, radius).collect())
    assert got == [(i, j) for i in range(0, N, 50) for j in range(N) if j != i and distances(x, i, metric)[j] <= radius]
    assert direct or search.met[0] < 0.25 * search.met[1]


@pytest.mark.parametrize("direct", [0, DIRECT_BYTES])
def test_neighbours_of_other_kinds(cloud, direct):
    x, kind, df = cloud
    got = sorted((r.id, r.to, r.other, r["rank"]) for r in Neighbours(df, "cosine", "kind", 64, direct=direct).nearest(df, 2).collect())
    want = []
    for i in range(N):
        d = distances(x, i, "cosine")
        for g in (g for g in range(KINDS) if g != kind[i]):
            want += [(i, f"k{g}", j, k + 1) for k, j in enumerate(sorted(np.flatnonzero(kind == g), key=lambda j: (d[j], j))[:2])]
    assert got == sorted(want)


@pytest.mark.parametrize("direct", [-1, DIRECT_BYTES])
def test_neighbours_of_little(spark, cloud, direct):
    df = cloud[2]
    few = df.filter("id < 3")
    made = lambda x: Neighbours(x, direct=direct)
    assert made(df.filter("false")).nearest(few, 3).count() == 0 and made(df).nearest(df.filter("false"), 3).count() == 0
    assert made(few).nearest(few, 5).count() == 6
    text = few.withColumn("id", F.concat(F.lit("n"), "id"))
    assert {(r.id, r.other) for r in made(text).nearest(text, 1).collect()} <= {(f"n{a}", f"n{b}") for a in range(3) for b in range(3) if a != b}


@pytest.mark.parametrize("width, k", [(1, 1), (2, 1), (2, 5), (5, 3)])
def test_boxes_give_the_same_neighbours(width, k):
    rng = np.random.default_rng(9)
    y = np.round(rng.normal(size=(3000, width)), 2)
    y[:300], y[300:310], y[310] = y[0], 50.0, np.nan  # copies, some far off, one that is no place
    x = np.r_[y[:700], rng.normal(size=(200, width)) * 30, np.full((1, width), np.inf)]
    ids, others, limit = np.r_[np.arange(700), np.arange(5000, 5201)], np.arange(3000), np.full(901, np.inf)
    far = np.where(np.isnan(y), 1e4, y)
    want = sorted((int(i), int(j), round(float(d), 9)) for _, found in best_pairs(x[:-1], far, ids[:-1], others, limit, k, 9, False) for i, j, d in zip(*found, strict=True))
    got = sorted((int(i), int(j), round(float(d), 9)) for found in boxed_pairs(x, y, ids, others, limit, k, 9, boxes_of(y, 32), 16) for i, j, d in zip(*found, strict=True))
    assert got == want and len(want) == 899 * k


def test_flat_vectors_in_boxes(spark):
    y = np.round(np.random.default_rng(10).normal(size=(1500, 2)), 2)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "id long, vec array<double>").repartition(3)
    search = Neighbours(df)
    assert search.small[3][0] is not None
    got = sorted((r.id, r["rank"], r.other) for r in search.nearest(df, 2).collect())
    assert got == [(i, n + 1, j) for i in range(1500) for n, j in enumerate(sorted((j for j in range(1500) if j != i), key=lambda j, d=distances(y, i, "euclidean"): (d[j], j))[:2])]


def test_rows_of_one_part_ask_in_many_tasks(spark, cloud):
    near = Neighbours(cloud[2]).nearest(cloud[2].coalesce(1), 1)
    assert near.count() == N and near.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_copies_of_records_ask_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    some, asked = np.round(rng.normal(size=(40, 2)), 1), []
    some[5], some[6] = np.nan, some[7]
    real, fake = np.tile(some, (3, 1))[:110], np.tile(rng.normal(size=(30, 2)), (4, 1))

    class Counted(Neighbours):
        def nearest(self, left, k, digits=9):
            asked.append(left.count())
            return super().nearest(left, k, digits)

    monkeypatch.setattr(privacy, "Neighbours", Counted)
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in r], i) for i, r in enumerate(m)], "id long, vec array<double>, pos long")
    got = privacy.record_privacy(frame(real), frame(fake).drop("pos")).first()
    assert max(asked) <= 40
    known = real[~np.isnan(real).any(axis=1)]
    gap = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    own = gap(known, known)
    np.fill_diagonal(own, np.inf)
    assert got.records == 120 and got.base_p05 == pytest.approx(np.percentile(own.min(axis=1), 5)) and got.dcr_median == pytest.approx(np.median(gap(fake, known).min(axis=1)))


def test_distances_held_at_a_time_are_bounded():
    x = np.random.default_rng(11).normal(size=(600, 4))
    y = np.tile(x, (20, 1)) + np.arange(20).repeat(600)[:, None]
    steps = [some.stop - some.start for some, _ in best_pairs(x, y, np.arange(600), np.arange(12000), np.full(600, np.inf), 2, 9, False)]
    assert sum(steps) == 600 and max(steps) * len(y) <= 1 << 21


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("scale, off", [(1.0, 0.0), (1e-30, 0.0), (1.0, 1e6), (1e20, 0.0)])
def test_pairs_within_a_cap(cosine, scale, off):
    rng = np.random.default_rng(13)
    x, y = (scale * rng.normal(size=(n, 16)) + off for n in (300, 500))
    if cosine:
        x, y = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (x, y))
        x[3] = y[4] = 0
    d = 1 - x @ y.T if cosine else np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    cap = np.quantile(d, 0.02, axis=1)
    cap[5] = np.inf
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for i, j, got in pairs_within(x, y, cap * (1 + 1e-9), cosine):
        assert np.allclose(got, d[i, j], rtol=1e-9, atol=1e-12)
        found = merged(found, (i, j, got), 4, 9)
    if scale >= 1:
        assert set(zip(found[0], found[1])) == {(i, j) for i in range(300) for j in sorted(range(500), key=lambda j, i=i: (np.round(d[i, j], 9), j))[:4]}
    assert (np.bincount(found[0], minlength=300) == 4).all()


def test_rows_are_not_sent_to_blocks_one_by_one(cloud, monkeypatch):
    df = cloud[2]
    want = {(r.id, r.other) for r in Neighbours(df).nearest(df, 5).collect()}
    monkeypatch.setattr(Neighbours, "_further_meetings", None)  # a row for each block that a row asks
    search = Neighbours(df, block=64, direct=0)
    near = search.nearest(df, 5)
    assert {(r.id, r.other) for r in near.collect()} == want
    packs = search._blocks()
    assert packs.count() == len(search.low) and packs.agg(F.sum(F.size("r_ids"))).first()[0] == N


def test_packs_hold_rows_of_many_first_blocks(cloud, monkeypatch):
    x, _, df = cloud
    packs, meet = [], Neighbours._packs_meet

    def counted(self, some, *more):
        packs.extend(len(r.ids) for r in some.collect())
        return meet(self, some, *more)

    monkeypatch.setattr(Neighbours, "_packs_meet", counted)
    search = Neighbours(df, block=12, direct=0)
    got = {(r.id, r.other) for r in search.nearest(df, 5).collect()}
    assert got == {(i, j) for i in range(N) for j in sorted((j for j in range(N) if j != i), key=lambda j, d=distances(x, i, "euclidean"): (d[j], j))[:5]}
    assert sum(packs) == N and 2 * len(packs) < len(search.low)  # each pack is sent with every bundle that it asks
    assert 3 * search._bundles().count() < len(search.low)
    assert search.met[0] < 0.25 * search.met[1]


def test_pairs_of_a_block_come_together():
    rng = np.random.default_rng(14)
    x, y = rng.normal(size=(5000, 8)), rng.normal(size=(1001, 8))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    found = list(pairs_within(x, y, np.full(5000, 0.9), False))
    assert len(found) == 1 and {(a, b) for a, b in np.argwhere(d <= 0.9)} <= set(zip(found[0][0], found[0][1], strict=True))


def test_places_of_few_and_many():
    rng = np.random.default_rng(15)
    for shape in ((3, 5), (7, 8), (1, 1), (0, 4), (33, 101)):
        for share in (0, 0.02, 1):
            true = rng.random(shape) < share
            assert (places(true) == np.flatnonzero(true)).all()


def test_pairs_taken_in_by_and_by_are_the_best():
    rng = np.random.default_rng(16)
    i, j, d = rng.integers(0, 30, 900), rng.permutation(900), np.round(rng.random(900), 1)  # many ties
    near, who, held = np.zeros((40, 4)), np.empty((40, 4), np.int64), np.zeros(40, np.int64)
    for a in range(0, 900, 70):
        take_in(near, who, held, (i[a : a + 70], j[a : a + 70], d[a : a + 70]), 9)
    for row in range(40):
        want = sorted(zip(d[i == row], j[i == row], strict=True))[:4]
        assert list(zip(near[row], who[row], strict=True))[: held[row]] == want


def test_tails_of_every_column(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(500, 2)), rng.exponential(size=(400, 2))
    frame = lambda m: spark.createDataFrame([tuple(map(float, r)) for r in m], "x double, y double")
    got = {r.column: r for r in relations.tails(frame(a), frame(b), ["x", "y"], few=40).collect()}
    for k, c in enumerate("xy"):
        q = [[np.quantile(m[:, k], p) for p in (0.01, 0.99, 0.05, 0.95)] for m in (a, b)]
        low, high = ([m[:, k][m[:, k] <= w[2]].mean() for m, w in zip((a, b), q)], [m[:, k][m[:, k] >= w[3]].mean() for m, w in zip((a, b), q)])
        want = (q[1][0] / q[0][0], q[1][1] / q[0][1], abs(low[0] - low[1]), abs(high[0] - high[1]))
        assert (got[c].p01, got[c].p99, got[c].low_cvar, got[c].high_cvar) == pytest.approx(want, rel=1e-9)
