"""Tracks, transitions, periods and paths: results don't depend on how the work is cut."""

import datetime
import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastcast.operators import regimes, relations, tracks


def test_tracks_in_stretches(spark):
    r, rows = random.Random(1), []
    for track, n in (("a", 900), ("b", 9), ("c", 300), ("few", 12)):
        for i in range(n):
            known = track == "b" or (i in (100, 200) or 140 < i < 150 if track == "c" else r.random() < (0.05 if track == "few" else 0.4))
            wind = float(r.randint(0, 99)) if known else None
            rows.append((track, i, r.uniform(10, 30), r.uniform(-80, -40), wind))
    df = spark.createDataFrame(rows, "track_id string, idx long, lat double, lon double, wind double")
    got = {s: sorted((x[0], x[1], *(round(v, 9) for v in x[2:])) for x in tracks.prepared(df, size=s).collect()) for s in (7, 64, 1 << 16)}
    assert got[7] == got[64] == got[1 << 16] and {x[0] for x in got[7]} == {"a", "b", "c"}
    for track in "abc":
        w = [(i, x) for t, i, _, _, x in rows if t == track and x is not None]
        n = sum(t == track for t, *_ in rows)
        want = np.interp(np.arange(n), [i for i, _ in w], [x for _, x in w])
        assert [x[4] / 5 for x in got[7] if x[0] == track] == pytest.approx(list(want))


def test_transitions_over_ranges(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["hot"] * 9 + ["b", None]), [r.random(), r.random()], i * 3) for i in range(500)] + [(900, "alone", [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "id long, k string, vec array<double>, o long").repartition(5)
    want = []
    for k in {x[1] for x in rows}:
        mine = sorted((x for x in rows if x[1] == k), key=lambda x: x[3])
        want += [(k, a[0], b[0], round(float(np.linalg.norm(np.subtract(a[2], b[2]))), 9)) for a, b in zip(mine, mine[1:])]
    for parts in (1, 7, None):
        got = [(x[0], x["from"], x["to"], round(x.distance, 9)) for x in relations.transitions(df, "k", "o", parts).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("days", [1, 3, 30])
def test_periods_by_day_sums(spark, days):
    r, start = random.Random(3), datetime.datetime(2024, 1, 1, 5)
    rows = [(start + datetime.timedelta(seconds=r.choice([r.randint(0, 40 * 86400), 86400 * r.randint(0, 40)])), [r.gauss(0, 1) for _ in range(3)]) for _ in range(80)]
    rows = [x for x in rows if not 10 <= (x[0] - start).days < 15]  # days without events
    df = spark.createDataFrame(rows, "ts timestamp_ntz, vec array<double>")
    query, first, last = [1.0, -0.5, 0.2], min(x[0] for x in rows), max(x[0] for x in rows) + datetime.timedelta(days=1)
    want, s = [], 0
    while first + datetime.timedelta(days=s + days) <= last:
        a = first + datetime.timedelta(days=s)
        v = [x[1] for x in rows if a <= x[0] < a + datetime.timedelta(days=days)]
        if v:
            m = np.mean(v, axis=0)
            want.append((-round(float(m @ query / np.linalg.norm(m) / np.linalg.norm(query)), 9), s, len(v)))
        s += 1
    got = [(-x.similarity, x.start, x.n) for x in relations.best_periods(df, query, 5, days).collect()]
    assert [g[1:] for g in got] == [w[1:] for w in sorted(want)[:5]] and [g[0] for g in got] == pytest.approx([w[0] for w in sorted(want)[:5]])
    assert relations.best_periods(df.filter("false"), query, 5, days).count() == 0


def test_paths_with_a_frontier(spark):
    r = random.Random(4)
    chain = [(i, i + 1, 0.0 if i % 7 == 0 else 1.0) for i in range(60)]
    edges = chain + [(r.randint(0, 60), r.randint(0, 60), r.uniform(5, 40)) for _ in range(60)] + [(100, 101, 1.0)]
    df = spark.createDataFrame(edges, "u long, v long, w double")
    near, best, heap = {}, {0: 0.0}, [(0.0, 0)]
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    while heap:
        c, u = heapq.heappop(heap)
        for v, w in near[u] if c == best[u] else []:
            if c + w < best.get(v, np.inf):
                best[v] = c + w
                heapq.heappush(heap, (c + w, v))
    cost, relaxed = relations._relaxed(df, 0)
    assert {x.node: x.cost for x in cost.collect()} == pytest.approx(best)
    assert relaxed[-1] < max(relaxed) and sum(relaxed) < len(best) * len(relaxed) / 2
    path = sorted((x.step, x.node, x.cost) for x in relations.shortest_path(df, 0, 60).collect())
    assert path[0] == (0, 0, 0.0) and path[-1][1] == 60 and path[-1][2] == pytest.approx(best[60]) and [p[0] for p in path] == list(range(len(path)))
    for a, b in zip(path, path[1:]):
        assert any(v == b[1] and abs(a[2] + w - b[2]) < 1e-9 for v, w in near[a[1]])
    assert relations.shortest_path(df, 0, 101).count() == 0 and [tuple(x) for x in relations.shortest_path(df, 0, 0).collect()] == [(0, 0, 0.0)]


def test_components_of_a_long_chain_in_few_rounds(spark):
    nodes = list(range(400))
    random.Random(5).shuffle(nodes)
    edges = list(zip(nodes, nodes[1:])) + [(500, 501), (501, 502), (502, 500), (600, 600), (500, 500), (None, 7)]
    got = dict(relations.components(spark.createDataFrame(edges, "u long, v long"), max_rounds=16).collect())
    assert got == {**dict.fromkeys(range(400), 0), 500: 500, 501: 500, 502: 500, 600: 600}
    assert relations.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_path_along_a_long_ring(spark):
    n = 50
    nodes = list(range(n))
    random.Random(6).shuffle(nodes)
    edges = [(nodes[i], nodes[(i + 1) % n], float(1 + i % 5)) for i in range(n)] + [(nodes[9], 1000, 2.0), (1000, 1001, 3.0)]
    df = spark.createDataFrame(edges, "u long, v long, w double")
    place = np.cumsum([0.0] + [e[2] for e in edges[:n]])
    want = {nodes[i]: min(place[i], place[n] - place[i]) for i in range(n)} | {1000: place[9] + 2, 1001: place[9] + 5}
    core, gone = relations._without_chains(df, nodes[0])
    assert core.count() == 0 and len(gone) < 16
    near = {nodes[i]: c for i, c in ((i, min(place[i], place[n] - place[i])) for i in (*range(13), *range(n - 12, n)))} | {1000: place[9] + 2, 1001: place[9] + 5}
    assert {r.node: r.cost for r in relations.shortest_paths(df, nodes[0], 12).collect()} == near
    path = sorted(tuple(r) for r in relations.shortest_path(df, nodes[0]).collect())
    assert path[-1][2] == max(want.values()) and [p[0] for p in path] == list(range(len(path))) and all(want[p[1]] == p[2] for p in path)


def test_counts_around_anchors_meet_no_pairs(spark):
    r = random.Random(7)
    start, day = datetime.datetime(1969, 12, 25), 86_400_000_000
    times = [r.choice([r.randrange(20 * day), r.randrange(20) * day, 7 * day]) for _ in range(400)]
    df = spark.createDataFrame([(i, start + datetime.timedelta(microseconds=t)) for i, t in enumerate(times)] + [(400, None)], "id long, ts timestamp_ntz")
    a = df.filter("id % 9 = 0").select(F.col("id").alias("anchor"), "ts").union(spark.createDataFrame([(1000, datetime.datetime(2000, 1, 1))], "anchor long, ts timestamp_ntz"))
    for days in (1, 2):
        want = {i: (len(x), min(x), max(x)) for i in range(0, 400, 9) if (x := [j for j, t in enumerate(times) if abs(t - times[i]) <= days * day])}
        got = relations.around_counts(df, a, days)
        assert {x.anchor: (x.n, x.first_id, x.last_id) for x in got.collect()} == want


def test_flat_windows_are_zeros_to_the_last_digit(spark):
    from pastcast.operators import windows

    df = spark.createDataFrame([([0.1] * 30,), ([1e6 / 3] * 30,), ([1.0, 2.0, 3.0],)], "values array<double>")
    got = [r.normal for r in windows.normalised(df, "zscore").collect()]
    assert got[0] == got[1] == [0.0] * 30 and got[2] == pytest.approx([-np.sqrt(1.5), 0.0, np.sqrt(1.5)])


def test_delays_are_those_of_pairs(spark):
    rng = np.random.default_rng(14)
    series = {"wave": np.sin(np.arange(400) / 3) + 0.1 * rng.normal(size=400), "noise": rng.normal(size=300), "walk": np.cumsum(rng.normal(size=250)), "short": rng.normal(size=6), "flat": np.ones(50), "one": np.ones(1)}
    df = spark.createDataFrame([(s, k, float(x)) for s, v in series.items() for k, x in enumerate(v)], "series_id string, pos long, value double").repartition(3)
    out = regimes.delays(df, 8)
    plan = out._jdf.queryExecution().toString()
    assert "_p#" not in plan and "sequence(" not in plan  # a row doesn't travel once for each lag
    got = {r.series_id: r.lag for r in out.collect()}

    def cells(v, bins):
        return np.zeros(len(v), int) if v.max() == v.min() else np.minimum(np.floor((v - v.min()) / (v.max() - v.min()) * bins), bins - 1).astype(int)

    def delay(v):
        n, bins = len(v), max(4, int(np.sqrt(len(v) / 5)))
        upper, mi, acf = max(1, min(8, n // 4)), [], []
        for k in range(1, upper + 1):
            x, y = v[:-k], v[k:]
            c = np.zeros((bins, bins))
            np.add.at(c, (cells(x, bins), cells(y, bins)), 1)
            p = c / c.sum()
            at = p > 0
            mi.append((p[at] * np.log(p[at] / np.outer(p.sum(axis=1), p.sum(axis=0))[at])).sum())
            acf.append(((x - v.mean()) * (y - v.mean())).sum())
        low = [k + 1 for k in range(1, upper - 1) if mi[k] < mi[k - 1] and mi[k] <= mi[k + 1]]
        return low[0] if low else next((k + 1 for k, a in enumerate(acf) if a <= 0), upper)

    assert got == {s: delay(v) for s, v in series.items() if len(v) > 1} and len(set(got.values())) > 2
