"""The light analogue and drawn trials against brute force."""

import numpy as np
import pytest

from pastcast.operators import light, search, trials


def best_of(x, width, ahead, lookback, stride, separation):
    """Best window by plain loops: (score, scale, end)."""
    shape = lambda v: (lambda r: (r - r.mean()) / r.std() if r.std() > 0 else r * 0)(np.diff(np.log(v)))
    q, found = x[-width:], []
    for k, scale in enumerate((0.75, 1.0, 1.25, 1.5)):
        w = max(8, round(width * scale))
        for end in range(len(x)):
            ago = len(x) - 1 - end
            if end - w + 1 < 0 or ago < width + separation + ahead or (ago - width - separation - ahead) % stride or ago > lookback:
                continue
            c = np.interp(np.linspace(0, w - 1, width), np.arange(w), x[end - w + 1 : end + 1])
            a, b = shape(q), shape(c)
            gap = abs(np.log(q[-1] / q[0]) - np.log(c[-1] / c[0]))
            score = 100 * (0.65 * max(0, ((a * b).mean() + 1) / 2) + 0.2 * np.exp(-np.abs(a - b).mean()) + 0.15 * np.exp(-2 * gap))
            found.append((round(score, 9), -k, end, scale))
    return max(found)


@pytest.mark.parametrize("lookback", [None, 150])
def test_light_analogues(spark, lookback):
    rng, rows, series = np.random.default_rng(8), [], {}
    for name, n in (("a", 400), ("b", 331), ("short", 61), ("least", 63)):
        series[name] = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    series["flat"] = np.full(200, 5.0)
    for name, x in series.items():
        rows += [(name, k, float(v)) for k, v in enumerate(x)]
    s = spark.createDataFrame(rows, "series_id string, pos long, value double")
    got = {r.series_id: r for r in light.light_analogues(s, 30, 10, lookback).collect()}
    assert "short" not in got and "least" not in got  # too few values, and none left for a window
    assert set(got) == {"a", "b", "flat"}
    for name, r in got.items():
        x = series[name]
        score, _, end, scale = best_of(x, 30, 10, lookback or len(x), 5, 20)
        assert (r.scale, r.end) == (scale, end) and r.score == pytest.approx(score, abs=1e-7)
        moves = x[end + 1 : end + 11] / x[end] - 1
        assert r.prices == pytest.approx(list(x[-1] * (1 + moves)))
        assert (r.end_return, r.min_return, r.max_return) == pytest.approx((moves[-1], moves.min(), moves.max()))
    assert light.light_analogues(s.limit(0), 30, 10).collect() == []


def test_drawn_positions(spark):
    s = spark.createDataFrame([("a", k, float(k)) for k in range(300)] + [("b", k, float(k)) for k in range(70)], "series_id string, pos long, value double")
    got = trials.drawn_positions(s, 10, 5, 40).collect()
    of = {n: sorted(r.q_start for r in got if r.series_id == n) for n in "ab"}
    assert len(set(of["a"])) == 40 and 30 <= of["a"][0] and of["a"][-1] <= 285
    assert of["b"] == list(range(30, 56))
    assert all(r["values"] == [float(r.q_start + k) for k in range(10)] for r in got)
    assert 110 < np.mean(of["a"]) < 205
    assert of["a"] != sorted(r.q_start for r in trials.drawn_positions(s, 10, 5, 40, seed=2).collect() if r.series_id == "a")


def test_scan_keeps_short_series(spark):
    rng, series = np.random.default_rng(5), {}
    for name, n in (("a", 120), ("b", 90), ("short", 19)):
        series[name] = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    s = spark.createDataFrame([(n, k, float(v)) for n, x in series.items() for k, v in enumerate(x)], "series_id string, pos long, value double")
    asked = search.last_windows(s, 15).filter("query_id = 'a'")
    got = {r.instrument: r for r in trials.scanned(s, asked, 15, 1, {"pearson": 1.0}, 5).collect()}
    assert set(got) == {"a", "b", "short"}
    assert got["short"].note == "insufficient history" and got["short"].query_id is None and got["short"].p50 is None
    x, q = series["b"], series["a"][-15:]
    corr = [np.corrcoef(q, x[k : k + 15])[0, 1] for k in range(90 - 20 + 1)]
    r = got["b"]
    assert r.start == int(np.argmax(corr)) and r.score == pytest.approx((max(corr) + 1) / 2) and r.n_matches == 1 and r.note is None
    move = x[r.start + 19] / x[r.start + 14] - 1  # one match: every percentile is its return
    assert (r.p10, r.p50, r.p90) == pytest.approx((move, move, move))


def test_light_scores_of_many_windows_at_once():
    rng = np.random.default_rng(12)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 200)))
    past = np.lib.stride_tricks.sliding_window_view(x, 24)
    c = light.resampled_rows(past, 20)
    assert c == pytest.approx(np.array([np.interp(np.linspace(0, 23, 20), np.arange(24), r) for r in past]))
    z = lambda v: (lambda r: (r - r.mean()) / r.std())(np.diff(np.log(v)))
    q = x[-20:]
    want = [100 * (0.65 * max(0, ((z(q) * z(r)).mean() + 1) / 2) + 0.2 * np.exp(-np.abs(z(q) - z(r)).mean()) + 0.15 * np.exp(-2 * abs(np.log(q[-1] / q[0]) - np.log(r[-1] / r[0])))) for r in c]
    assert light.light_scores(q, c) == pytest.approx(want)
    assert light.light_scores(np.full(20, 5.0), np.full((1, 20), 7.0)) == pytest.approx([67.5])  # flat shapes are zeros
