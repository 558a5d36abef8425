"""Volatility, slope, Hurst exponent and regimes of windows; delays; macro regimes; training windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.functions.common import pair_sum, total
from pastcast.operators import order_stats
from pastcast.operators.windows import deviation, log_returns, mean, scaled, slope
from pastcast.session import ship, stored
from pastcast.sources.series import chunked, framed, in_chunk

#: Fixed labels and next-step probabilities, rows from and columns to each label in this order.
LABELS = ["trending_up", "trending_down", "mean_reverting", "high_vol", "low_vol"]
TRANSITIONS = [
    [0.62, 0.04, 0.16, 0.12, 0.06],
    [0.04, 0.62, 0.16, 0.12, 0.06],
    [0.12, 0.12, 0.52, 0.08, 0.16],
    [0.12, 0.12, 0.16, 0.50, 0.10],
    [0.14, 0.10, 0.28, 0.06, 0.42],
]


def _dfa(profiles: np.ndarray) -> np.ndarray:
    """Hurst exponents of equally long integrated profiles by detrended fluctuation, all rows at once."""
    n = profiles.shape[1]
    top = max(5, n // 4)
    sizes = np.unique(np.logspace(math.log10(4), math.log10(top), num=20).astype(int))
    found = []
    for s in sizes:
        box = profiles[:, : n // s * s].reshape(len(profiles), -1, s)
        t = np.arange(s) - (s - 1) / 2
        fit = (box @ t / (t @ t))[..., None] * t + box.mean(axis=2, keepdims=True)
        found.append(np.sqrt(((box - fit) ** 2).mean(axis=2)).mean(axis=1))
    f = np.stack(found, axis=1)
    out = np.full(len(f), 0.5)
    x = np.log(sizes)
    for k, row in enumerate(f):
        ok = row > 0
        if ok.sum() >= 2:
            out[k] = np.clip(np.polyfit(x[ok], np.log(row[ok]), 1)[0], 0, 1)
    return out


def with_hurst(df: DataFrame, values: str = "values") -> DataFrame:
    """Adds hurst of each window; 0.5 for fewer than 9 values."""
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def hurst(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in column:
            out = np.full(len(s), 0.5)
            size = s.map(len).to_numpy()
            for n in np.unique(size[size >= 9]):
                x = np.diff(np.log(np.maximum(np.stack(s[size == n].to_list()), 1e-12)), axis=1)
                out[size == n] = _dfa(np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1))
            yield pd.Series(out)

    return df.withColumn("hurst", hurst(values))


def with_moves(df: DataFrame, values: str = "values") -> DataFrame:
    """Adds vol (population deviation of log returns x sqrt 252) and slope of the z-scored window."""
    v = F.col(values)
    df = df.withColumns({"_r": log_returns(v), "_m": mean(v), "_s": deviation(v)})
    z = scaled(v, F.col("_m"), F.col("_s"))
    return df.withColumns({"vol": deviation(F.col("_r")) * math.sqrt(252), "slope": F.when(F.col("_s") == 0, 0.0).otherwise(slope(z))}).drop("_r", "_m", "_s")


def hard_label(vol: Column, slope_: Column, hurst: Column, n: Column) -> Column:
    """One of LABELS by fixed thresholds; windows of fewer than 10 values are low_vol."""
    # fixed values: the thresholds below
    trend = F.when(slope_ > 0, "trending_up").otherwise("trending_down")
    return (
        F.when((n < 10) | (vol == 0), "low_vol").when(vol > 0.4, "high_vol").when(vol < 0.1, "low_vol").when(hurst < 0.4, "mean_reverting").when((hurst > 0.6) | (F.abs(slope_) > 0.01), trend).otherwise("mean_reverting")
    )


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))


def soft_regime(df: DataFrame) -> DataFrame:
    """Adds p and next (arrays in the order of LABELS) from vol, slope and hurst."""
    # fixed values: middles, widths and shares below
    high, low = _sigmoid((F.col("vol") - 0.32) / 0.07), _sigmoid((0.12 - F.col("vol")) / 0.035)
    lasting, turning = _sigmoid((F.col("hurst") - 0.56) / 0.06), _sigmoid((0.44 - F.col("hurst")) / 0.06)
    up, down = _sigmoid((F.col("slope") - 0.006) / 0.012), _sigmoid((-F.col("slope") - 0.006) / 0.012)
    raw = [lasting * up * (1 - 0.45 * high), lasting * down * (1 - 0.45 * high), turning * (1 - 0.35 * high), high, low]
    df = df.withColumn("_raw", F.array(*[F.greatest(x, F.lit(1e-8)) for x in raw]))
    df = df.withColumn("_t", total(F.col("_raw"))).withColumn("p", F.transform("_raw", lambda x: x / F.col("_t"))).drop("_raw", "_t")
    step = [sum((F.get("p", F.lit(i)) * TRANSITIONS[i][j] for i in range(5)), F.lit(0.0)) for j in range(5)]
    df = df.withColumn("_n", F.array(*step)).withColumn("_t", total(F.col("_n")))
    return df.withColumn("next", F.transform("_n", lambda x: x / F.col("_t"))).drop("_n", "_t")


def soft_similarity(a: Column, b: Column) -> Column:
    """Cosine of two distributions, 0 for a zero one."""
    d = F.sqrt(pair_sum(a, a) * pair_sum(b, b))
    return F.when(d <= 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), pair_sum(a, b) / d)))


def discount(score: Column, similarity: Column, weight: float = 0.25) -> Column:
    return score * (1 - weight + weight * similarity)


def volatility_regime(rows: DataFrame, width: int = 20, quantile: float = 0.5, size: int = 1 << 16, few: int = order_stats.FEW) -> DataFrame:
    """Adds vol (trailing deviation of first differences, the first being 0) and high: whether it is at or above its series' quantile."""
    w = in_chunk()
    near = chunked(rows, before=width, size=size).withColumn("d", F.col("value") - F.lag("value").over(w))
    near = near.withColumn("d", F.when(F.col("pos") == 0, 0.0).otherwise(F.col("d")))
    near = near.withColumn("vol", F.stddev_pop("d").over(w.rowsBetween(-width + 1, 0))).filter("core").drop("chunk", "core", "d")
    near = stored(near)
    cut = order_stats.per_key(near, ["series_id"], "vol", {"cut": quantile}, few)
    return near.join(cut, "series_id").withColumn("high", F.col("vol") >= F.col("cut")).drop("cut")


def delays(rows: DataFrame, max_lag: int) -> DataFrame:
    """(series_id, lag): the first local minimum of mutual information between a series and itself so much later, else the
    first lag whose autocorrelation is not positive, else the longest.

    Pairs are frames over stretches of positions, made once; what is shuffled of them are counts per cell. Bins are max(4, floor(sqrt(n / 5))) equal
    parts of each side's range.
    """
    rows = rows.select("series_id", "pos", F.col("value").cast("double").alias("value"))
    size = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    upper = F.greatest(F.lit(1), F.least(F.lit(max_lag), F.floor(F.col("n") / 4)))
    size = stored(size.withColumns({"upper": upper, "bins": F.greatest(F.lit(4), F.floor(F.sqrt(F.col("n") / 5)))}))
    lags = range(1, max_lag + 1)
    last = {f"_b{k}": F.lag("value", k).over(in_chunk()) for k in lags}  # the earlier side of each pair; a row is the later one
    back = stored(framed(rows, last, before=max_lag).select("series_id", F.col("value").alias("y"), "pos", *last))
    pair = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"_b{k}").alias("x")) for k in lags])).alias("p")
    both = back.join(size, "series_id").select("series_id", "m", "upper", "bins", "y", "pos", pair).select("*", "p.lag", "p.x").drop("p").filter("lag <= pos and lag <= upper")
    key = ["series_id", "lag"]
    edge = stored(both.groupBy(*key).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum((F.col("x") - F.col("m")) * (F.col("y") - F.col("m"))).alias("acf"), F.first("upper").alias("upper")))
    place = lambda v, lo, hi: F.when(F.col(hi) == F.col(lo), 0).otherwise(F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * F.col("bins")), F.col("bins") - 1))
    cell = both.select(*key, "bins", "x", "y").join(edge.drop("acf", "upper"), key).groupBy(*key, place("x", "x0", "x1").alias("bx"), place("y", "y0", "y1").alias("by")).agg(F.count("*").alias("c"))
    part = lambda *k: Window.partitionBy(*key, *k)
    cell = cell.withColumns({"cx": F.sum("c").over(part("bx")), "cy": F.sum("c").over(part("by")), "all": F.sum("c").over(part())})
    mi = cell.groupBy(*key).agg(F.sum(F.col("c") / F.col("all") * F.log(F.col("c") * F.col("all") / (F.col("cx") * F.col("cy")))).alias("mi"))
    order = Window.partitionBy("series_id").orderBy("lag")  # max_lag rows
    mi = mi.join(edge.select(*key, "acf", "upper"), key).withColumns({"before": F.lag("mi").over(order), "after": F.lead("mi").over(order)})
    return mi.groupBy("series_id").agg(F.coalesce(F.min(F.when((F.col("lag") < F.col("upper")) & (F.col("mi") < F.col("before")) & (F.col("mi") <= F.col("after")), F.col("lag"))), F.min(F.when(F.col("acf") <= 0, F.col("lag"))), F.max("upper")).alias("lag"))


def macro_regimes(rows: DataFrame) -> DataFrame:
    """(ts, label) from growth, inflation, vix and rate against their trailing means (2, 5 and 1 years) by time range frames."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    year = 365 * 86400
    w = lambda years: Window.partitionBy("region").orderBy(at).rangeBetween(-years * year, 0)
    rows = rows.withColumns({"g": F.avg("growth").over(w(2)), "i": F.avg("inflation").over(w(5)), "v": F.avg("vix").over(w(1)), "change": F.col("rate") - F.lag("rate").over(Window.partitionBy("region").orderBy("ts"))})
    up = lambda c, m, name: F.when(F.col(c) >= F.col(m), f"{name}_up").otherwise(f"{name}_down")
    liquidity = F.when(F.col("change").isNull(), None).when(F.col("change") >= 0, "liquidity_down").otherwise("liquidity_up")
    return rows.select("region", "ts", up("growth", "g", "growth").alias("growth"), up("inflation", "i", "inflation").alias("inflation"), up("vix", "v", "vix").alias("vix"), liquidity.alias("liquidity"))


def training_windows(rows: DataFrame, width: int = 32, stride: int = 32, size: int = 1 << 14) -> DataFrame:
    """(series_id, start, part, returns, vols, volumes): z-scored channels of windows, split 70/15/15 in time order.

    rows has (series_id, pos, value, volume). Channels: log return, its 20-row trailing deviation, volume.
    """
    w = in_chunk()
    rows = framed(rows, {"r": F.log(F.greatest("value", F.lit(1e-12))) - F.lag(F.log(F.greatest("value", F.lit(1e-12)))).over(w)}, before=1, size=size)
    rows = framed(rows.filter("r is not null"), {"sd": F.stddev_pop("r").over(w.rowsBetween(-19, 0))}, before=20, size=size)
    part = chunked(rows, after=width - 1, size=max(size // stride, 1) * stride)
    stretch = max(size // stride, 1) * stride
    some = part.groupBy("series_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "r", "sd", "volume"))).alias("s"))
    some = some.withColumn("at", F.explode(F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (F.get(F.col("s"), i).pos % stride == 0) & (F.get(F.col("s"), i).pos < (F.col("chunk") + 1) * stretch) & (i + width <= F.size("s")))))
    some = some.select("series_id", F.slice("s", F.col("at") + 1, width).alias("s")).withColumn("start", F.col("s")[0]["pos"])
    for name, out in (("r", "returns"), ("sd", "vols"), ("volume", "volumes")):
        some = some.withColumn("_v", F.col(f"s.{name}")).withColumns({"_m": mean(F.col("_v")), "_d": deviation(F.col("_v"))}).withColumn(out, scaled(F.col("_v"), F.col("_m"), F.col("_d")))
    ends = some.groupBy("series_id").agg(F.count("*").alias("n"))
    share = (F.col("start") - F.lit(0)) / stride
    some = some.join(ends, "series_id").withColumn("share", share / F.col("n"))
    return some.select("series_id", "start", F.when(F.col("share") < 0.7, "train").when(F.col("share") < 0.85, "valid").otherwise("test").alias("part"), "returns", "vols", "volumes")


