"""Rule strategies with stops and targets against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from pastcast.operators import evaluation as ev


def expected(kind, c, regime, p, price, least):
    """(rule, side, stop, target) by hand."""
    side = 0
    if c is not None and c >= least and None not in p.values():
        if kind == "momentum":
            side = 1 if p["p50"] > 0.02 and regime == "trending_up" else -1 if p["p50"] < -0.02 and regime == "trending_down" else 0
        elif kind == "reversion" and regime == "mean_reverting" and p["p90"] - p["p10"] > 0.03:
            side = 1 if p["p50"] < -0.03 else -1 if p["p50"] > 0.03 else 0
        elif kind == "breakout" and regime == "high_vol":
            side = 1 if p["p75"] > 0 else -1 if p["p25"] < 0 else 0
    if not side:
        return None, 0, None, None
    stop, target = (p["p10"], p["p75"]) if side > 0 else (p["p90"], p["p25"])
    return f"{kind}_{'long' if side > 0 else 'short'}", side, price * (1 + stop), price * (1 + target)


def test_signals(spark):
    draw, rows = random.Random(3), []
    for k in range(400):
        cone = sorted(draw.gauss(draw.choice([-0.06, 0, 0.06]), 0.03) for _ in range(5))
        cone = [None] * 5 if k % 40 == 0 else cone
        rows.append((k, None if k % 37 == 0 else draw.uniform(50, 100), draw.choice(["trending_up", "trending_down", "mean_reverting", "high_vol", None]), draw.uniform(1, 9), *cone))
    names = ["p10", "p25", "p50", "p75", "p90"]
    df = spark.createDataFrame(rows, "id long, confidence double, regime string, price double, " + ", ".join(f"{p} double" for p in names)).coalesce(2)
    for kind, rules, least in (("momentum", ev.momentum(), 70.0), ("reversion", ev.reversion(), 65.0), ("breakout", ev.breakout(), 75.0)):
        got = ev.signals(df, rules, least).orderBy("id").collect()
        assert {r.side for r in got} == {-1, 0, 1}
        for r, row in zip(got, rows, strict=True):
            rule, side, stop, target = expected(kind, row[1], row[2], dict(zip(names, row[4:])), row[3], least)
            assert (r.rule, r.side) == (rule, side) and r.entry == (row[3] if side else None)
            assert r.stop == (stop and pytest.approx(stop)) and r.target == (target and pytest.approx(target))
    assert ev.signals(df.filter(F.lit(False)), ev.breakout(), 75.0).collect() == []
