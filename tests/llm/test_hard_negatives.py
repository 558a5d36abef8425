"""Operator 12: hard negatives by a vertical scan with bounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastcast.llm import hard_negatives, queries


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95, scale=256.0):
    fine = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(x * scale) for x in v]
        fine[i] = min(fine.get(i, (label, v)), (label, v))
    out = []
    for a, (label, q) in fine.items():
        if not is_anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (_, v) in fine.items() if i != a}
        first = lambda ids: sorted(ids, key=lambda i: (-score[i], i))
        for p in first([i for i in score if fine[i][0] == label])[:positives]:
            for k, n in enumerate(first([i for i in score if fine[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]])[:negatives]):
                out.append((a, p, k + 1, n, score[p], score[n]))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def made(n, dims, labels, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    return [(i, int(rng.integers(labels)), [float(x) for x in (centres[i % 4] + 0.5 * rng.normal(size=dims)) * scale]) for i in range(n)]


def test_sql(spark, sf_dir, same_as_sql):
    same_as_sql(queries.QUERIES["op12_bond_negatives"](spark, sf_dir), queries.ORACLES["op12_bond_negatives"], sf_dir)


@pytest.mark.parametrize("rows, most", [
    (made(600, 20, 3, 1), {}),
    (made(300, 3, 5, 2, 0.01), {"scale": 16.0, "positives": 9, "negatives": 7, "low": 20, "high": 100}),  # many ties
    (made(120, 7, 2, 3, 1e6), {}),  # sums beyond 2^53
], ids=["clusters", "ties", "large"])
def test_equals_brute_force(spark, monkeypatch, rows, most):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 37)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 900)
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>").repartition(3)
    assert rows_of(hard_negatives.mine(df, F.col("id") % 10 == 0, **most)) == brute(rows, lambda i: i % 10 == 0, **most)


def test_odd_rows(spark):
    one = [0.5, 0.25, 1.0]
    rows = [
        (0, 1, one), (1, 1, one), (1, 1, one), (2, 2, one), (2, 2, [0.4, 0.2, 0.9]), (3, 2, [0.4, 0.2, 0.9]), (4, 2, None), (5, None, one), (None, 2, one),
        (6, 2, [0.5, None, 1.0]), (7, 2, [0.5, float("nan"), 1.0]), (8, 2, [float("inf"), 0.1, 0.1]), (9, 2, [0.45, 0.2]), (10, 2, []), (11, 2, [0.4, 0.2, 0.9, 5.0]), (20, 3, [-1.0, 0.0, 0.0]), (30, 3, [1.0, 0.0, 0.0]), (40, 9, [0.0, 0.0, 0.0]), (50, 9, [0.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>").withColumns({"score": F.lit("clash"), "v": F.lit(1), "rank": F.lit(2), "anchor_id": F.lit(3)})
    got = rows_of(hard_negatives.mine(df, F.col("id") % 10 == 0))
    assert got == brute([(i, g, None if v is None else v + [0.0] * (4 - len(v))) for i, g, v in rows], lambda i: i % 10 == 0)
    assert {r[0] for r in got} >= {0, 40, 50} and rows_of(hard_negatives.mine(df.filter("false"), F.col("id") % 10 == 0)) == []
    assert rows_of(hard_negatives.mine(df, F.lit(False))) == []


def test_bounds_rule_rows_out(monkeypatch):
    rng = np.random.default_rng(4)
    columns = np.floor(256 * rng.normal(size=(64, 4000)) * np.where(np.arange(64) < 8, 1.0, 0.05)[:, None])
    scan, read = hard_negatives.Scan(np.arange(4000), columns), []
    q = columns[:, 5]
    whole = q @ columns
    floor = np.sort(whole)[-6]

    def may_stay(lower, upper):
        read.append(len(upper))
        return upper >= floor

    rows, scores = scan.survivors(q, may_stay)
    assert sorted(rows) == sorted(np.flatnonzero(whole >= floor)) and (scores == whole[rows]).all()
    assert sum(read[1:]) < 0.2 * 64 / 8 * 4000
