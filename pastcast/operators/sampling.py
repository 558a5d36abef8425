"""Forecast cones by repeatable draws, adaptive conformal edges, scores over whole paths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.operators.projection import COMPATIBLE, PERCENTILES, blended, cone, regime_weight


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) that the parts' text determines, by 48 bits of its MD5 digest: any engine can draw it again."""
    key = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(*parts: Column | str) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(*parts, F.lit("a")))) * F.cos(2 * math.pi * uniform(*parts, F.lit("b")))


def _spread(paths: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Adds p (share of a path's weight), up (its share and those before it), sd (weighted deviation of its bar) and bars."""
    bar = Window.partitionBy(*keys, "bar")
    rows = paths.withColumn("_t", F.sum("weight").over(bar)).withColumn("p", F.when(F.col("_t") > 0, F.col("weight") / F.col("_t")).otherwise(1 / F.count("*").over(bar)))
    rows = rows.withColumn("_m", F.sum(F.col("p") * F.col("ret")).over(bar))
    rows = rows.withColumns({"up": F.sum("p").over(bar.orderBy(path).rowsBetween(Window.unboundedPreceding, 0)), "sd": F.sqrt(F.sum(F.col("p") * (F.col("ret") - F.col("_m")) ** 2).over(bar))})
    return rows.withColumn("bars", F.max("bar").over(Window.partitionBy(*keys)) + 1).drop("_t", "_m")


def _drawn(paths: DataFrame, keys: list[str], path: str, draws: int, seed: int) -> DataFrame:
    """(keys, sim, bar, ret, sd, bars): ``draws`` paths per key, picked by weight. A key has a few paths, so they meet its draws in one group."""
    rows = _spread(paths, keys, path)
    picks = rows.select(*keys).distinct().withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = picks.withColumn("_u", uniform(*keys, "sim", F.lit(seed)))
    last = F.col("up") >= F.max("up").over(Window.partitionBy(*keys, "bar"))
    rows = rows.withColumn("_last", last).withColumn("_lo", F.col("up") - F.col("p"))
    met = picks.join(rows, keys).filter((F.col("_u") > F.col("_lo")) & ((F.col("_u") <= F.col("up")) | F.col("_last")))
    return met.select(*keys, "sim", "bar", "ret", "sd", "bars")


def monte_carlo(paths: DataFrame, keys: list[str], path: str = "rank", draws: int = 1000, seed: int = 42, percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(keys, bar, pct, value, mean, std): paths (keys, path, bar, ret, weight) drawn by weight, with normal noise for each bar that grows
    with the root of the bar's share of the horizon; a deviation is at least 1e-8."""
    sims = _drawn(paths, keys, path, draws, seed)
    noise = F.greatest("sd", F.lit(1e-8)) * F.sqrt((F.col("bar") + 1) / F.col("bars")) * normal(*keys, "sim", "bar", F.lit(seed))
    return _summary(sims.withColumn("x", F.col("ret") + noise), keys, percentiles)


def joint_paths(paths: DataFrame, keys: list[str], path: str = "rank", draws: int = 1000, seed: int = 42, share: float = 0.25, percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(keys, bar, pct, value, mean, std): as ``monte_carlo``, with one normal number for a whole path and a share of the deviation; a curve is
    never below one of a lower percentile."""
    sims = _drawn(paths, keys, path, draws, seed)
    noise = share * F.greatest("sd", F.lit(1e-6)) * F.sqrt((F.col("bar") + 1) / F.col("bars")) * normal(*keys, "sim", F.lit(seed))
    out = _summary(sims.withColumn("x", F.col("ret") + noise), keys, percentiles)
    return out.withColumn("value", F.max("value").over(Window.partitionBy(*keys, "bar").orderBy("pct")))


def ensemble(paths: DataFrame, keys: list[str], path: str = "rank", draws: int = 1000, shares: tuple[float, float, float] = (0.4, 0.3, 0.3), soft: float = 0.5) -> DataFrame:
    """(keys, bar, pct, value): the weighted mean of the plain cone, the sampled one and the one of fitting regimes.

    paths: (keys, path, bar, ret, weight, query_regime, regime). Where no path fits the query's regime, the plain cone has that share too.
    """
    fits = F.lit(False)
    for name, others in COMPATIBLE.items():
        fits = fits | ((F.col("query_regime") == name) & F.col("regime").isin(others))
    some = F.max(F.coalesce(fits, F.lit(False))).over(Window.partitionBy(*keys))
    fitted = F.when(some, regime_weight(F.col("weight"), F.col("query_regime"), F.col("regime"), soft)).otherwise(F.col("weight"))
    plain = paths.select(*keys, path, "bar", "ret", "weight")
    by_regime = paths.withColumn("weight", fitted).select(*keys, path, "bar", "ret", "weight")
    parts = [(cone(plain, keys), shares[0]), (monte_carlo(plain, keys, path, draws), shares[1]), (cone(by_regime, keys), shares[2])]
    return blended([(c.select(*keys, "bar", "pct", "value"), w) for c, w in parts], keys)


def _summary(sims: DataFrame, keys: list[str], percentiles: tuple[int, ...]) -> DataFrame:
    """Exact percentiles of a fixed number of draws per key and bar."""
    level = F.array(*[F.lit(p / 100) for p in percentiles])
    out = sims.groupBy(*keys, "bar").agg(F.percentile("x", level).alias("v"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return out.select(*keys, "bar", F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in percentiles]).alias("pct"), F.col("v").alias("value"))).alias("c"), "mean", "std").select(*keys, "bar", "c.pct", "c.value", "mean", "std")


def _quantile(items: Column, level: Column) -> Column:
    """Weighted quantile of structs (x, w): at the middle of each weight in the sorted running sum, interpolated, held at the ends."""
    ordered = F.array_sort(items)
    whole = F.aggregate(items, F.lit(0.0), lambda a, i: a + i.w)
    run = F.aggregate(
        ordered,
        F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("got")),
        lambda a, i: F.struct(
            (a["sum"] + i.w / whole).alias("sum"),
            (a["sum"] + i.w / whole / 2).alias("c"),
            i.x.alias("x"),
            F.coalesce(
                a.got,
                F.when(level <= a["sum"] + i.w / whole / 2, F.when(a.c.isNull(), i.x).otherwise(a.x + (level - a.c) / (a["sum"] + i.w / whole / 2 - a.c) * (i.x - a.x))),
            ).alias("got"),
        ),
    )
    return F.coalesce(run.got, run.x)


def adaptive_edges(paths: DataFrame, keys: list[str], path: str = "rank", target: float = 0.2, rate: float = 0.05, aware: bool = False, decay: float = 0.95, jump: float = 1.5) -> DataFrame:
    """(keys, bar, pct, value, alpha, scale): the cone of the paths with its 10 and 90 curves' distance from the median times ``scale``.

    The paths' terminal distances from the median, in the order of ``path``, are folded one after another: alpha grows by
    rate x (target - miss), a miss being a distance above the quantile at 1 - alpha of those before it. With ``aware``, distances
    decay with age where the last third varies more than ``jump`` times as much as all. Scale is the quantile of all distances at
    1 - alpha over the mean half width of the cone, in 0.5 to 3. The fold is one expression over a key's few paths.
    """
    base = cone(paths, keys)
    bars = F.max("bar").over(Window.partitionBy(*keys))
    ends = base.withColumn("_b", bars).filter((F.col("bar") == F.col("_b")) & (F.col("pct") == 50)).select(*keys, F.col("value").alias("_mid"))
    half = base.groupBy(*keys, "bar").agg((F.max(F.when(F.col("pct") == 90, F.col("value"))) - F.max(F.when(F.col("pct") == 10, F.col("value")))).alias("w")).groupBy(*keys).agg(F.avg(F.abs("w") / 2).alias("half"))
    last = paths.withColumn("_b", bars).filter(F.col("bar") == F.col("_b")).join(ends, keys)
    fold = last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(path, F.abs(F.col("ret") - F.col("_mid")).alias("r")))).alias("s")).withColumn("r", F.col("s.r")).join(half, keys)
    n = F.size("r")
    variance = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a) - F.pow(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a), 2)
    recent = F.slice("r", n - F.greatest(F.lit(1), F.floor(n / 3).cast("int")) + 1, F.greatest(F.lit(1), F.floor(n / 3).cast("int")))
    old = F.lit(aware) & (n >= 6) & ((variance(recent) + 1e-12) / (variance(F.col("r")) + 1e-12) > jump)
    items = F.transform("r", lambda x, i: F.struct(x.alias("x"), F.when(old, F.pow(F.lit(decay), n - 1 - i)).otherwise(1.0).alias("w")))
    fold = fold.withColumn("items", items)
    clip = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))

    def step(alpha: Column, i: Column) -> Column:
        bound = _quantile(F.slice("items", 1, i), 1 - alpha)
        return clip(alpha + rate * (target - F.when(F.get(F.col("items"), i).x > bound, 1.0).otherwise(0.0)), 1e-3, 1 - 1e-3)

    places = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    fold = fold.withColumn("alpha", F.aggregate(places, F.lit(target), step))
    wide = fold.withColumn("_q", _quantile(F.col("items"), 1 - F.col("alpha")))
    scale = F.when((F.col("half") > 0) & (F.col("_q") > 0), clip(F.col("_q") / F.col("half"), 0.5, 3.0)).otherwise(1.0)
    out = base.join(wide.select(*keys, "alpha", scale.alias("scale")), keys)
    mid = F.max(F.when(F.col("pct") == 50, F.col("value"))).over(Window.partitionBy(*keys, "bar"))
    return out.withColumn("_m", mid).withColumn("value", F.when(F.col("pct").isin(10, 90), F.col("_m") + (F.col("value") - F.col("_m")) * F.col("scale")).otherwise(F.col("value"))).drop("_m")


def blended_median(cone_: DataFrame, moves: DataFrame, keys: list[str], weight: float) -> DataFrame:
    """The cone with its median drawn towards other moves (keys, bar, move) by ``weight``; where there are none it stays."""
    both = cone_.join(moves, [*keys, "bar"], "left")
    return both.withColumn("value", F.when((F.col("pct") == 50) & F.col("move").isNotNull(), (1 - weight) * F.col("value") + weight * F.col("move")).otherwise(F.col("value"))).drop("move")


def joint_crps(trial_bars: DataFrame) -> DataFrame:
    """One row (n, crps) of trials (query_id, bar, pct, value, actual): the squared gap of outcome and level, meant over levels, then bars, then trials."""
    gap = F.pow((F.col("actual") <= F.col("value")).cast("double") - F.col("pct") / 100, 2)
    bar = trial_bars.groupBy("query_id", "bar").agg(F.avg(gap).alias("g"))
    return bar.groupBy("query_id").agg(F.avg("g").alias("g")).agg(F.count("*").alias("n"), F.avg("g").alias("crps"))


def calibration_block(ends: DataFrame, curves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, coverage, crps, hit_rate, dispersion, drift, grade, reliability) of matches' terminal returns (keys, ret) against the terminal
    curves (keys, pct, value) of their forecast. Fewer than three matches are graded unknown, with zeros."""
    c = curves.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pct", "value")))).alias("c"))
    met = ends.join(c, keys)
    at = lambda p: F.col("c")[p]
    below = F.transform(F.map_entries("c"), lambda e: F.struct((e.key / 100.0).alias("level"), (F.col("ret") <= e.value).cast("double").alias("below")))
    met = met.withColumns({"inside": F.col("ret").between(at(10), at(90)).cast("double"), "hit": ((at(50) != 0) & (F.signum("ret") == F.signum(at(50)))).cast("double"), "below": below})
    met = met.withColumn("crps", F.aggregate("below", F.lit(0.0), lambda s, b: s + F.pow(b.below - b.level, 2)) / F.size("below"))
    out = met.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("inside").alias("coverage"), F.avg("crps").alias("crps"), F.avg("hit").alias("hit_rate"), F.stddev_pop("ret").alias("dispersion"))
    level = met.select(*keys, F.explode("below").alias("b")).groupBy(*keys, "b.level").agg(F.avg("b.below").alias("seen")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("level"), F.col("seen")))).alias("reliability"))
    out = out.join(level, keys)
    gap = F.abs(F.col("coverage") - 0.8)
    grade = (
        F.when((gap <= 0.05) & (F.col("crps") <= 0.05) & (F.col("hit_rate") >= 0.58), "A").when((gap <= 0.10) & (F.col("crps") <= 0.08) & (F.col("hit_rate") >= 0.54), "B")
        .when((gap <= 0.15) & (F.col("crps") <= 0.12) & (F.col("hit_rate") >= 0.52), "C").when((gap <= 0.20) | (F.col("crps") <= 0.20), "D").otherwise("F")
    )
    few = F.col("n") < 3
    drift = F.when(F.col("dispersion") < 0.03, "low").when(F.col("dispersion") < 0.07, "elevated").otherwise("high")
    out = out.withColumns({"grade": F.when(few, "unknown").otherwise(grade), "drift": F.when(few, "unknown").otherwise(drift)})
    out = out.withColumn("reliability", F.when(few, F.array().cast("array<struct<level:double,seen:double>>")).otherwise(F.col("reliability")))
    return out.withColumns({x: F.when(few, 0.0).otherwise(F.col(x)) for x in ("coverage", "crps", "hit_rate", "dispersion")})


def target_response(ends: DataFrame, rows: DataFrame, bars: int, most_lag: int = 20) -> DataFrame:
    """(source, target, n, correlation, te, lag): what a target series does after matches (source, target, end) in a source series.

    Both sides' forward moves are matched by position and meant over matches. lag: the first shift of the target with the largest absolute
    correlation of the mean curves; te: transfer entropy of all matches' moves, one match after another.
    """
    from pastcast.operators.search import transfer_entropy

    at = ends.select("source", "target", "end").withColumn("bar", F.explode(F.sequence(F.lit(0), F.lit(bars)))).withColumn("pos", F.col("end") - 1 + F.col("bar"))
    side = lambda name, out: rows.select(F.col("series_id").alias(name), "pos", F.col("value").alias(out))
    at = at.join(side("source", "x"), ["source", "pos"]).join(side("target", "y"), ["target", "pos"])
    whole = Window.partitionBy("source", "target", "end")
    at = at.withColumns({"x0": F.max(F.when(F.col("bar") == 0, F.col("x"))).over(whole), "y0": F.max(F.when(F.col("bar") == 0, F.col("y"))).over(whole), "_n": F.count("*").over(whole)})
    at = at.filter((F.col("_n") == bars + 1) & (F.abs("x0") >= 1e-12) & (F.abs("y0") >= 1e-12) & (F.col("bar") > 0))
    at = at.select("source", "target", "end", (F.col("bar") - 1).alias("bar"), ((F.col("x") - F.col("x0")) / F.abs("x0")).alias("x"), ((F.col("y") - F.col("y0")) / F.abs("y0")).alias("y"))
    key = ["source", "target"]
    mean = at.groupBy(*key, "bar").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    lags = F.explode(F.sequence(F.lit(0), F.lit(max(0, min(most_lag, bars // 2, bars - 2)))))
    shifted = mean.select(*key, "bar", "x").withColumn("lag", lags).withColumn("_b", F.col("bar") + F.col("lag"))
    met = shifted.join(mean.select(*key, F.col("bar").alias("_b"), "y"), [*key, "_b"])
    c = met.groupBy(*key, "lag").agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.corr("x", "y").alias("c")).filter((F.col("n") >= 2) & (F.col("sx") >= 1e-12) & (F.col("sy") >= 1e-12))
    best = c.groupBy(*key).agg(F.max(F.struct(F.round(F.abs("c"), 12).alias("a"), (-F.col("lag")).alias("l"))).alias("b"), F.max(F.when(F.col("lag") == 0, F.col("c"))).alias("correlation"))
    count = at.groupBy(*key).agg(F.countDistinct("end").alias("n"))
    order = at.select(*key, (F.col("end") * bars + F.col("bar")).alias("o"), F.col("x").alias("source_"), F.col("y").alias("target_"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("o"))  # matches x bars of one pair
    te = transfer_entropy(order.select(*key, place.alias("i"), F.col("source_").alias("_x"), F.col("target_").alias("_y")).toDF("a", "b", "i", "source", "target"), ["a", "b"]).toDF("source", "target", "te")
    return count.join(best, key, "left").join(te, key, "left").select(*key, "n", F.coalesce("correlation", F.lit(0.0)).alias("correlation"), F.coalesce("te", F.lit(0.0)).alias("te"), F.coalesce(-F.col("b.l"), F.lit(0)).alias("lag"))
