"""Curves: spacing, bends, corpus and analogues against loops."""

import math

import numpy as np

from pastcast.operators import curves


def helix(n, r=1.0, c=0.5, step=0.1, noise=0.0, seed=0):
    t = np.arange(n) * step
    p = np.stack([r * np.cos(t), r * np.sin(t), c * t], axis=1)
    return p + noise * np.random.default_rng(seed).normal(size=p.shape)


def frame(spark, tracks):
    rows = [(k, i, *map(float, p)) for k, t in tracks.items() for i, p in enumerate(t)]
    return spark.createDataFrame(rows, "track_id long, idx long, x double, y double, z double")


def by_loops(points):
    """Curvature and torsion of one curve, point by point."""
    n = len(points)
    step = np.mean([np.linalg.norm(points[i + 1] - points[i]) for i in range(n - 1)])
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-12 else v * 0
    t = [unit(points[i + 1] - points[i]) for i in range(n - 1)]
    k = [np.linalg.norm(t[i + 1] - t[i]) / step for i in range(n - 2)]
    b = [np.cross(t[i], t[i + 1]) for i in range(n - 2)]
    tau = [0.0 if np.linalg.norm(b[i]) < curves.STRAIGHT else -(unit(b[i + 1]) - unit(b[i])) @ unit(t[i + 1] - t[i]) / step for i in range(n - 3)]
    return np.array(k + k[-1:] * 2), np.array(tau + tau[-1:] * 3)


def warped(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = math.dist(a[i], b[j]) + min(d[i, j + 1], d[i + 1, j], d[i, j])
    return d[-1, -1]


def test_bends_are_those_of_loops_and_of_the_helix():
    p = helix(60, 2.0, 1.0, noise=0.02)
    k, t = curves.bends(p[None])
    want = by_loops(p)
    assert np.allclose(k[0], want[0]) and np.allclose(t[0], want[1])
    k, t = curves.bends(helix(200, 2.0, 1.0, 0.05)[None])
    assert np.allclose(k, 2 / 5, rtol=0.01) and np.allclose(np.abs(t), 1 / 5, rtol=0.02)
    k, t = curves.bends(np.outer(np.arange(10.0), [1, 2, 3])[None])
    assert np.allclose(k, 0) and np.allclose(t, 0)


def test_smoothing_mirrors_and_keeps_constants():
    assert np.allclose(curves.smoothed(np.full((1, 20), 3.0), 16.0), 3.0)
    x = np.random.default_rng(1).normal(size=(1, 30))
    wide = np.concatenate([x[0][::-1], x[0], x[0][::-1]])
    w = np.exp(-0.5 * (np.arange(-4, 5) / 1.0) ** 2)
    assert np.allclose(curves.smoothed(x, 1.0)[0], [(wide[30 + i - 4 : 30 + i + 5] * w).sum() / w.sum() for i in range(30)])


def test_resampled_is_interpolation_for_any_chunk(spark):
    tracks = {1: helix(37, noise=0.3), 2: np.zeros((5, 3)), 3: helix(1), 4: np.repeat(helix(6), 2, axis=0)}
    for size in (1 << 16, 4):
        got = {}
        for r in curves.resampled(frame(spark, tracks), 11, size).collect():
            got.setdefault(r.track_id, {})[r.j] = (r.x, r.y, r.z)
        assert sorted(got) == [1, 4]
        for k in got:
            p = tracks[k]
            along = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))])
            at = np.linspace(0, along[-1], 11)
            want = np.stack([np.interp(at, along, p[:, a]) for a in range(3)], axis=1)
            assert sorted(got[k]) == list(range(11)) and np.allclose([got[k][j] for j in range(11)], want)


def test_corpus_and_analogues_are_those_of_brute_force(spark):
    tracks = {k: helix(95 + k, 1 + k % 3, 0.3 * (k % 4), 0.15, 0.05, k) for k in range(9)}
    tracks[9] = np.zeros((100, 3))
    df = frame(spark, tracks)
    rows = {(r.track_id, r.start): r for r in curves.corpus(df, size=20).collect()}
    assert set(rows) == {(k, s) for k in range(9) for s in range(0, len(tracks[k]) - 69, 5)}
    assert {k: r.symbols for k, r in rows.items()} == {(r.track_id, r.start): r.symbols for r in curves.corpus(df).collect()}
    for (k, s), r in list(rows.items())[::9]:
        even, good = curves._evened(tracks[k][s : s + 50][None])
        want = by_loops(curves.smoothed(even, 2.0)[0])
        assert good.all() and np.allclose(r.curvature, curves.smoothed(want[0][None], 1.5)[0]) and np.allclose(r.torsion, curves.smoothed(want[1][None], 1.5)[0])
    queries = curves.last_curves(df)
    own = {r.query_id: r for r in queries.collect()}
    assert sorted(own) == list(range(9)) and all(own[k].start == len(tracks[k]) - 50 for k in own)
    want = []
    for q, r in own.items():
        gap = lambda w: sum(abs(a - b) for a, b in zip(w.symbols, r.symbols))
        short = sorted((gap(w), *key) for key, w in rows.items() if key[0] != q)[:32]
        ends = [(round(warped(list(zip(r.curvature, r.torsion)), list(zip(rows[t, s].curvature, rows[t, s].torsion))), 9), n, t, s) for n, (_, t, s) in enumerate(short)]
        want += [(q, i + 1, t, s) for i, (_, _, t, s) in enumerate(sorted(ends)[:3])]
    got = curves.curve_analogues(queries, curves.corpus(df), 3).collect()
    assert sorted((r.query_id, r.rank, r.track_id, r.start) for r in got) == sorted(want)
    assert all(math.isclose(r.similarity, math.exp(-r.distance / 50)) for r in got)
    assert curves.curve_analogues(queries.limit(0), curves.corpus(df)).count() == 0
