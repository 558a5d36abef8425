"""The full search, sampled and adaptive cones, narratives, vectors and privacy against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastcast.operators import copies, dynamics, evaluation, matching, narrative, privacy, sampling, search


def line(spark, values, name="a"):
    return spark.createDataFrame([(name, k, float(v)) for k, v in enumerate(values)], "series_id string, pos long, value double")


def test_stretched_copy_is_found_and_reranked(spark):
    rng = np.random.default_rng(4)
    x = 100 + np.cumsum(rng.normal(size=700))
    end = x[640:700]
    x[200:290] = np.interp(np.linspace(0, 59, 90), np.arange(60), end)  # the end, half as slow again
    s = line(spark, x)
    got = matching.matches(s, search.last_windows(s, 60), 60, k=30, ahead=10, keep=200, rerank=20).orderBy("rank").collect()
    best = max(got, key=lambda r: r.dtw)
    assert (best.start, best.end, best.scale) == (200, 290, 1.5) and best.dtw > 0.98 and best.pearson_warped > 0.99
    weights = {m: search.WEIGHTS[m] for m in ("dtw", "pearson_warped", "koopman", "wavelet_spectrum", "transfer_entropy")}
    a, b = np.diff(np.log(end)), np.diff(np.log(x[200:290]))
    assert best.koopman == pytest.approx(dynamics.koopman_score(a, b)) and best.wavelet_spectrum == pytest.approx(dynamics.wavelet_score(a, b))
    assert best.transfer_entropy == pytest.approx(dynamics.flow(x[200:290], x[290:300]))
    for r in got:
        low, high = (v[-1] / v[0] - 1 for v in (end, x[r.start : r.end]))
        raw = sum(r[m] * w for m, w in weights.items()) / sum(weights.values())
        if r.dtw >= 0.94 and r.pearson_warped <= 0.62 and r.transfer_entropy <= 0.24:
            raw *= 0.84 if r.wavelet_spectrum <= 0.08 else 0.88
        if r.koopman >= 0.86 and r.transfer_entropy >= 0.30:
            raw *= 1.08 if r.pearson_warped >= 0.63 else 1.06
        keep = 0.92 if abs(low) >= 0.02 and abs(high) >= 0.02 and np.sign(low) != np.sign(high) else 1
        assert r.confidence == pytest.approx(100 * min(1, raw) * keep)
    assert [r.confidence for r in got] == sorted((r.confidence for r in got), reverse=True)
    assert sum(r.wavelet_spectrum > 0 for r in got) <= 20 and all(r.end <= 640 for r in got)


def test_scaled_windows_are_drawn_like_numpy():
    x = np.random.default_rng(1).normal(size=(3, 45))
    want = [np.interp(np.linspace(0, 44, 30), np.arange(45), r) for r in x]
    assert np.allclose(x @ search._drawing(45, 30), want)


def test_koopman():
    t = np.arange(200)
    wave = 10 + np.sin(t / 5)
    assert dynamics.koopman_score(wave, wave) == pytest.approx(1) and dynamics.koopman_score(wave[:49], wave) == 0 and dynamics.koopman_score(np.ones(60), wave) == 0
    assert dynamics.koopman_score(wave, 10 + np.sin(t / 5 + 1)) > dynamics.koopman_score(wave, np.random.default_rng(0).normal(size=200))
    moves, spread = dynamics.evolved(wave, 20)
    assert np.allclose(moves, (10 + np.sin(np.arange(200, 220) / 5)) / wave[-1] - 1, atol=1e-6) and (np.diff(spread) >= 0).all()
    assert dynamics.evolved(wave[:40], 5) is None
    cost = np.random.default_rng(2).random((5, 5))
    from itertools import permutations

    assert dynamics.least_matching(cost) == pytest.approx(min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(5))))


def test_wavelets():
    x = np.cumsum(np.random.default_rng(3).normal(size=300))
    low = np.array(dynamics.DB4)
    assert low.sum() == pytest.approx(np.sqrt(2)) and (low**2).sum() == pytest.approx(1)
    sizes = [len(v) for v in dynamics.leaders(x)]
    want, n = [], 300
    for _ in range(5):
        n = (n + 7) // 2
        want.append(n)
    assert sizes == want[::-1]  # floor((n + 7) / 2) details a level
    cubic = np.arange(64.0) ** 3
    assert dynamics.leaders(cubic)[-1][6:-6].max() < 1e-6  # four vanishing moments
    assert dynamics.wavelet_score(x, x) == 1 and dynamics.wavelet_score(x[:10], x) == 0.5 and 0 <= dynamics.wavelet_score(x, x[::-1] * 2) <= 1


def brute_quantile(x, w, q):
    o = np.argsort(x, kind="stable")
    x, w = np.asarray(x)[o], np.asarray(w)[o] / np.sum(w)
    return float(np.interp(q, np.cumsum(w) - w / 2, x))


@pytest.mark.parametrize("aware", [False, True])
def test_adaptive_edges_fold_like_a_loop(spark, aware):
    rng = np.random.default_rng(7)
    ret = np.cumsum(rng.normal(size=(12, 4)), axis=1)
    ret[8:] *= 6
    w = rng.uniform(0.5, 1, 12)
    rows = spark.createDataFrame([("q", k, b, float(ret[k, b]), float(w[k])) for k in range(12) for b in range(4)], "query_id string, rank int, bar int, ret double, weight double")
    got = sampling.adaptive_edges(rows, ["query_id"], aware=aware).collect()
    curve = {(b, p): brute_quantile(ret[:, b], w, p / 100) for b in range(4) for p in (10, 25, 50, 75, 90)}
    r = np.abs(ret[:, 3] - curve[3, 50])
    age = np.ones(12)
    if aware and np.var(r[-4:]) / np.var(r) > 1.5:
        age = 0.95 ** np.arange(12)[::-1]
    alpha = 0.2
    for k in range(1, 12):
        alpha = np.clip(alpha + 0.05 * (0.2 - (r[k] > brute_quantile(r[:k], age[:k], 1 - alpha))), 1e-3, 1 - 1e-3)
    half = np.mean([abs(curve[b, 90] - curve[b, 10]) / 2 for b in range(4)])
    scale = np.clip(brute_quantile(r, age, 1 - alpha) / half, 0.5, 3)
    for g in got:
        m = curve[g.bar, 50]
        want = m + (curve[g.bar, g.pct] - m) * (scale if g.pct in (10, 90) else 1)
        assert (g.alpha, g.scale, g.value) == pytest.approx((alpha, scale, want))


def test_draws_are_uniform_and_normal(spark):
    x = spark.range(20_000).select(sampling.uniform("id", F.lit(1)).alias("u"), sampling.normal("id", F.lit(2)).alias("n"), copies.hashed(F.lit(7), "id").alias("k")).toPandas()
    assert abs(x.u.mean() - 0.5) < 0.01 and abs(np.quantile(x.u, 0.9) - 0.9) < 0.01
    assert abs(x.n.mean()) < 0.03 and abs(x.n.std() - 1) < 0.03 and abs((x.n < 1.2815).mean() - 0.9) < 0.01
    assert (np.bincount(x.k.astype(int)) / 20_000 == pytest.approx(np.full(7, 1 / 7), abs=0.01))


def test_every_gate_counts(spark):
    gates = spark.range(1500).select(F.concat(F.lit("m"), "id").alias("metric"), F.lit(0.0).alias("least_delta"), (F.col("id") < 1200).alias("required"))
    d = spark.createDataFrame([(1, "m3", 1.0), (1, "m4", -1.0), (2, "other", 1.0), (3, "m3", None)], "id long, metric string, delta double")
    assert {(r.id, r.keep, r.failed) for r in evaluation.gated(d, gates).collect()} == {(1, False, 1499), (2, False, 1500), (3, False, 1500)}
    assert evaluation.gated(d.filter("id = 1"), gates.filter("metric = 'm3'")).first().keep
    assert evaluation.gated(d, gates.filter("false")).filter("keep and failed = 0").count() == 3


def test_one_look_finds_what_a_family_names(spark):
    every = [w for _, words in narrative.FAMILIES for w in words]
    said = [x for w in every for x in (w, f"the {w}, again", f"x{w}", f"{w}s", f"é{w}", f"re-{w}", w[:-1])]
    df = spark.createDataFrame([(x,) for x in said], "s string")
    rows = df.select("s", narrative.names_any(F.col("s")).alias("any"), narrative.family(F.col("s")).isNotNull().alias("named")).collect()
    assert all(r["any"] == r.named for r in rows) and 0 < sum(r.named for r in rows) < len(rows)
    plan = narrative.tagged(df.selectExpr("1L AS doc_id", "s AS text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") > 1 and "Filter" in plan[plan.index("Generate") :]  # texts that name nothing are never split


def test_narratives(spark):
    text = "The market crashed sharply for 3 days; then it drifted sideways. Nothing here\nPrices rallied a bit and fell over time, lasting 12 weeks. Flatten the bank."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "It BROKE OUT historically")], "doc_id long, text string")
    got = {(r.id, r.place): (r.family, r.intensity, r.duration, r.previous, r.sharpness) for r in narrative.tagged(docs).collect()}
    assert got == {(1, 0): ("crash", 0.8, 3, None, None), (1, 1): ("consolidation", 0.5, 1, "crash", 0.5), (1, 3): ("rally", 0.3, 12, "consolidation", 0.3), (4, 0): ("breakout", 0.9, 1, None, None)}
    e = spark.createDataFrame([(1, 0, "rate_hike", 0.8, 20, "down"), (1, 1, "pandemic", 0.9, 30, "down"), (2, 0, "x", None, 900, "up")], "id long, place int, type string, intensity double, duration int, direction string")
    v = {r.id: r.vector for r in narrative.narrative_vector(e).collect()}
    assert v[1] == pytest.approx([0, 0, 0, 0, 0, 0.5, 0, 0.5, 0, 0, 0.85, 0.125, 0.5, -1, 0.05]) and v[2] == pytest.approx([0] * 10 + [0, 1, 0, 1, 0.9])


def distances(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))


def test_nearest_in_blocks_and_privacy(spark):
    rng = np.random.default_rng(5)
    real, fake = rng.normal(size=(150, 3)), rng.normal(size=(90, 3))
    fake[0], fake[1] = real[7], real[9] + 1e-4
    frame = lambda x: spark.createDataFrame([(k, [float(v) for v in r], k) for k, r in enumerate(x)], "id long, vec array<double>, pos long")
    own = distances(real, real)
    np.fill_diagonal(own, np.inf)
    near = {}
    for r in privacy.nearest_blocks(frame(real), frame(real), 3, block=32).collect():
        near.setdefault(r.id, {})[r["rank"]] = r.other
    assert all([near[k][j] for j in (1, 2, 3)] == list(np.argsort(own[k])[:3]) for k in range(150))
    got = privacy.record_privacy(frame(real), frame(fake).drop("pos"), block=40).first()
    dcr, base = distances(fake, real).min(axis=1), own.min(axis=1)
    back = distances(real, fake).min(axis=1)
    a, b = back[:75], back[75:]
    auc = np.mean((a[:, None] < b[None]) + 0.5 * (a[:, None] == b[None]))
    cut = np.percentile(base, 5)
    tail = ((real <= np.percentile(real, 1, axis=0)) | (real >= np.percentile(real, 99, axis=0))).any(axis=1)
    want = [np.median(dcr), np.percentile(dcr, 5), cut, 1, 2, auc, np.median(distances(fake, real[:120]).min(axis=1)), np.median(distances(fake, real[120:]).min(axis=1)), tail.sum(), (back[tail] <= cut).sum()]
    assert [got[c] for c in ("dcr_median", "dcr_p05", "base_p05", "exact", "near", "auc", "train_median", "holdout_median", "tail_records", "exposed")] == pytest.approx(want)
    score = privacy.privacy_score(privacy.record_privacy(frame(real), frame(fake), block=40)).first()
    assert score.memory_risk == 1 and score.score == 0 and not score.passed


def test_principal_components(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 5)) * [5, 3, 1, 0.5, 0.1]
    frame = lambda v: spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(v)], "id long, vec array<double>")
    got = np.array([r.point for r in privacy.components_2d(frame(x)).orderBy("id").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ (vt[:2] * np.sign(vt[[0, 1], np.abs(vt[:2]).argmax(axis=1)])[:, None]).T
    assert np.allclose(got, want)
    flat = np.array([r.point for r in privacy.components_2d(frame(np.outer(np.arange(4.0), [1, 2, 3])), 3).collect()])
    assert flat.shape == (4, 3) and np.allclose(flat[:, 1:], 0)


def test_ridge_matches_numpy(spark):
    x = np.cumsum(np.random.default_rng(2).normal(size=200))
    rows = privacy.lag_rows(line(spark, x), 5)
    w, c = privacy.ridge(rows, 5)
    a = np.stack([x[k : k + 195] for k in range(5)], axis=1)
    y, m = x[5:], a.mean(axis=0)
    want = np.linalg.solve((a - m).T @ (a - m) + np.eye(5), (a - m).T @ (y - y.mean()))
    assert np.allclose(w, want) and c == pytest.approx(y.mean() - want @ m)


def test_target_follows_source(spark):
    rng = np.random.default_rng(0)
    x = 50 + np.cumsum(rng.normal(size=400))
    y = np.concatenate([x[:2], x[:-2]])  # two bars later
    rows = line(spark, x, "x").union(line(spark, y, "y"))
    ends = [60, 140, 230, 395]
    got = sampling.target_response(spark.createDataFrame([("x", "y", e) for e in ends], "source string, target string, end long"), rows, 12).first()
    f = lambda v: np.mean([(v[e : e + 12] - v[e - 1]) / abs(v[e - 1]) for e in ends[:3]], axis=0)
    a, b = f(x), f(y)
    lags = [abs(np.corrcoef(a[: 12 - k], b[k:])[0, 1]) for k in range(7)]
    assert got.n == 3 and got.correlation == pytest.approx(np.corrcoef(a, b)[0, 1]) and got.lag == int(np.argmax(lags)) and 0 <= got.te <= 1


def test_sweep_is_the_sum_of_its_settings(spark):
    from pastcast.operators import trials

    s = line(spark, 100 + np.cumsum(np.random.default_rng(3).normal(size=600)))
    both = {(r.width, r.seed, r.n, r.hit_rate, r.crps, r.trust) for r in trials.swept(s, (20, 30), 5, 4, 25, {"pearson": 1.0}, (1, 2)).collect()}
    one = {(r.width, r.seed, r.n, r.hit_rate, r.crps, r.trust) for w in (20, 30) for z in (1, 2) for r in trials.swept(s, (w,), 5, 4, 25, {"pearson": 1.0}, (z,)).collect()}
    assert both == one and len(both) == 4
    assert all(t == round(h * (1 - min(c, 1)), 4) for _, _, _, h, c, t in both)
