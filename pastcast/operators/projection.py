"""What followed the matches: forward paths, weighted quantile cones, baselines."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.sources.series import framed, in_chunk

PERCENTILES = (10, 25, 50, 75, 90)
#: Fixed regime tables.
COMPATIBLE = {"trending_up": ["trending_up"], "trending_down": ["trending_down"], "mean_reverting": ["mean_reverting", "low_vol"], "high_vol": ["high_vol"], "low_vol": ["low_vol", "mean_reverting"]}
MULTIPLIERS = {"trending_up": 0.9, "trending_down": 0.9, "mean_reverting": 0.85, "high_vol": 1.4, "low_vol": 0.8, "unknown": 1.0}


def forward_paths(matches: DataFrame, rows: DataFrame, bars: int) -> DataFrame:
    """(the columns of matches, bar, ret): returns of the bars after each match against its last value.

    matches has series_id and end (exclusive). Bars are exploded on the small side, then joined by position; a match without all
    its bars, or with a zero anchor, is dropped.
    """
    keys = matches.columns
    at = matches.withColumn("bar", F.explode(F.sequence(F.lit(0), F.lit(bars)))).withColumn("pos", F.col("end") - 1 + F.col("bar"))
    at = at.join(rows.select("series_id", "pos", "value"), ["series_id", "pos"])
    whole = Window.partitionBy(*keys)
    at = at.withColumns({"anchor": F.max(F.when(F.col("bar") == 0, F.col("value"))).over(whole), "n": F.count("*").over(whole)})
    return at.filter((F.col("n") == bars + 1) & (F.col("anchor") != 0) & (F.col("bar") > 0)).select(*keys, (F.col("bar") - 1).alias("bar"), ((F.col("value") - F.col("anchor")) / F.col("anchor")).alias("ret"))


def cone(paths: DataFrame, keys: list[str], weight: str = "weight", value: str = "ret", percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(keys, bar, pct, value): weighted quantiles of each bar.

    Sorted values stand at the middle of their weight in the running sum; a quantile is interpolated between neighbours and held at
    the ends. Weights are normalised per bar, equal if all are 0. Equal values stand in the order of their rank, where paths have one, else by weight.
    """
    group = [*keys, "bar"]
    w = Window.partitionBy(*group)
    order = w.orderBy(value, "rank" if "rank" in paths.columns and "rank" not in group else weight, "_id")
    rows = paths.withColumn("_id", F.xxhash64(*[c for c in paths.columns if c not in group])).withColumns({"_t": F.sum(weight).over(w), "_n": F.count("*").over(w)})
    rows = rows.withColumn("_w", F.when(F.col("_t") > 0, F.col(weight) / F.col("_t")).otherwise(1 / F.col("_n")))
    rows = rows.withColumn("_c", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w") / 2)
    rows = rows.withColumns({"_k": F.row_number().over(order), "_c2": F.lead("_c").over(order), "_v2": F.lead(value).over(order)})
    p = F.col("pct") / 100.0
    rows = rows.withColumn("pct", F.explode(F.array(*[F.lit(x) for x in percentiles])))
    got = (
        F.when((F.col("_k") == 1) & (p <= F.col("_c")), F.col(value))
        .when(F.col("_c2").isNull() & (p >= F.col("_c")), F.col(value))
        .when((p > F.col("_c")) & (p <= F.col("_c2")), F.col(value) + (p - F.col("_c")) / (F.col("_c2") - F.col("_c")) * (F.col("_v2") - F.col(value)))
    )
    return rows.groupBy(*group, "pct").agg(F.max(got).alias("value"))


def around_median(cone_: DataFrame, keys: list[str], factor: Column) -> DataFrame:
    """The cone with each curve's distance from the median times the factor."""
    mid = F.max(F.when(F.col("pct") == 50, F.col("value"))).over(Window.partitionBy(*keys, "bar"))
    return cone_.withColumn("_m", mid).withColumn("value", F.when(F.col("pct") == 50, F.col("value")).otherwise(F.col("_m") + (F.col("value") - F.col("_m")) * factor)).drop("_m")


def widened(cone_: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """Uncertainty that grows with the bar."""
    return around_median(cone_, keys, 1 + rate * F.col("bar"))


def regime_multiplier(regime: Column) -> Column:
    out = F.lit(MULTIPLIERS["unknown"])
    for name, m in MULTIPLIERS.items():
        out = F.when(regime == name, m).otherwise(out)
    return out


def regime_weight(weight: Column, query: Column, match: Column, soft: float = 0.5) -> Column:
    """Weight of a path: whole if its regime fits the query's, else less by the soft share."""
    fits = F.lit(False)
    for name, others in COMPATIBLE.items():
        fits = fits | ((query == name) & match.isin(others))
    return F.when(F.coalesce(fits, F.lit(False)), weight).otherwise(weight * (1 - soft))


def adverse(paths: DataFrame, keys: list[str], path: list[str], bars: int, radius: float = 1.5) -> DataFrame:
    """Adds tilt: weights times exp(radius x standardised adverse terminal return), so that paths against the median count more."""
    last = paths.filter(F.col("bar") == bars - 1)
    mid = cone(last.select(*keys, *path, "bar", "ret", "weight"), keys, percentiles=(50,)).select(*keys, F.when(F.col("value") >= 0, 1).otherwise(-1).alias("_d"))
    w = Window.partitionBy(*keys)
    end = last.join(mid, keys).withColumn("_a", -F.col("_d") * F.col("ret")).withColumns({"_m": F.avg("_a").over(w), "_s": F.stddev_pop("_a").over(w)})
    end = end.select(*keys, *path, F.exp(radius * F.when(F.col("_s") > 1e-12, (F.col("_a") - F.col("_m")) / F.col("_s")).otherwise(0.0)).alias("_f"))
    return paths.join(end, [*keys, *path]).withColumn("tilt", F.col("weight") * F.col("_f")).drop("_f")


def conformal(paths: DataFrame, keys: list[str], path: list[str], coverage: float = 0.9, base: DataFrame | None = None) -> DataFrame:
    """(keys, bar, lower, upper) around the mean path, or the given base (keys, bar, base): per bar the quantile of deviations at min(ceil((n + 1) c) / n, 1), but half the
    quantile of the paths' largest deviations at least."""
    w = Window.partitionBy(*keys, "bar")
    rows = paths.withColumn("base", F.avg("ret").over(w)) if base is None else paths.join(base, [*keys, "bar"])
    rows = rows.withColumn("dev", F.abs(F.col("ret") - F.col("base")))
    most = rows.groupBy(*keys, *path).agg(F.max("dev").alias("most"))
    level = lambda n: F.least(F.ceil((n + 1) * coverage) / n, F.lit(1.0))
    # percentile() takes a constant level, so the sorted array is interpolated here; one entry per path
    at = lambda c, n: F.sort_array(F.collect_list(c)).alias("s")
    quantile = lambda s: F.expr(f"element_at({s}, cast(floor(lv * (size({s}) - 1)) as int) + 1) + (lv * (size({s}) - 1) - floor(lv * (size({s}) - 1))) * (element_at({s}, least(cast(floor(lv * (size({s}) - 1)) as int) + 2, size({s}))) - element_at({s}, cast(floor(lv * (size({s}) - 1)) as int) + 1))")
    q = most.groupBy(*keys).agg(at("most", None), F.count("*").alias("n")).withColumn("lv", level(F.col("n"))).select(*keys, quantile("s").alias("q"))
    b = rows.groupBy(*keys, "bar").agg(at("dev", None), F.count("*").alias("n"), F.first("base").alias("base")).withColumn("lv", level(F.col("n"))).select(*keys, "bar", "base", quantile("s").alias("d"))
    b = b.join(q, keys).withColumn("width", F.greatest("d", 0.5 * F.col("q")))
    return b.select(*keys, "bar", (F.col("base") - F.col("width")).alias("lower"), (F.col("base") + F.col("width")).alias("upper"))


def blended(cones: list[tuple[DataFrame, float]], keys: list[str]) -> DataFrame:
    """Weighted mean of cones on (keys, bar, pct), weights renormalised over those given."""
    whole, out = sum(w for _, w in cones), None
    for c, w in cones:
        some = c.select(*keys, "bar", "pct", (F.col("value") * (w / whole)).alias("value"))
        out = some if out is None else out.unionByName(some)
    return out.groupBy(*keys, "bar", "pct").agg(F.sum("value").alias("value"))


def seasonal_naive(rows: DataFrame, season: int, horizon: int) -> DataFrame:
    """(series_id, bar, p10, p50, p90): the last cycle repeated, with a band of 1.2815515655446004 seasonal deviations; season 1 for short series."""
    end = rows.groupBy("series_id").agg((F.max("pos") + 1).alias("n")).withColumn("m", F.when(F.col("n") >= 2 * season, season).otherwise(1))
    w = in_chunk()
    gaps = framed(rows, {"g": F.col("value") - F.lag("value", season).over(w), "g1": F.col("value") - F.lag("value", 1).over(w)}, before=season)
    sd = gaps.join(end, "series_id").groupBy("series_id").agg(F.coalesce(F.stddev_pop(F.when(F.col("m") == season, F.col("g")).otherwise(F.col("g1"))), F.lit(0.0)).alias("sd"))
    bars = end.withColumn("bar", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))).withColumn("pos", F.col("n") - F.col("m") + F.col("bar") % F.col("m"))
    out = bars.join(rows.select("series_id", "pos", "value"), ["series_id", "pos"]).join(sd, "series_id")
    band = 1.2815515655446004 * F.col("sd")
    return out.select("series_id", "bar", (F.col("value") - band).alias("p10"), F.col("value").alias("p50"), (F.col("value") + band).alias("p90"))


def motif_continuation(matches: DataFrame, rows: DataFrame, bars: int) -> DataFrame:
    """(query_id, bar, p10, p50, p90) of the values that followed the nearest windows."""
    at = matches.select("query_id", "series_id", F.col("end").alias("end"), F.explode(F.sequence(F.lit(0), F.lit(bars - 1))).alias("bar")).withColumn("pos", F.col("end") + F.col("bar"))
    at = at.join(rows.select("series_id", "pos", "value"), ["series_id", "pos"])
    return at.groupBy("query_id", "bar").agg(*[F.percentile("value", F.lit(q / 100)).alias(f"p{q}") for q in (10, 50, 90)])


def ar1_cone(rows: DataFrame, bars: int, percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(series_id, bar, pct, value): the closed form for log returns that follow a first-order autoregression."""
    w = in_chunk()
    r = framed(rows, {"r": F.log("value") - F.lag(F.log("value")).over(w)}, before=1).filter("r is not null")
    xy = framed(r, {"x": F.lag("r").over(w)}, before=1)
    both = F.col("x").isNotNull()
    fit = xy.groupBy("series_id").agg(
        F.count("*").alias("n"), F.stddev_pop("r").alias("sr"), F.avg(F.when(both, F.col("r"))).alias("my"), F.avg("x").alias("mx"), F.covar_pop("r", "x").alias("c"), F.var_pop(F.when(both, F.col("x"))).alias("vx"), F.var_pop(F.when(both, F.col("r"))).alias("vy")
    )
    phi = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("c") / F.col("vx")))
    fit = fit.withColumn("phi", F.when((F.col("n") < 5) | (F.col("vx") == 0), 0.0).otherwise(phi))
    fit = fit.withColumn("mean", F.when(F.col("n") < 5, 0.0).otherwise(F.when(F.col("vx") == 0, F.col("my")).otherwise(F.col("my"))))
    left = F.sqrt(F.greatest(F.lit(0.0), F.col("vy") - 2 * F.col("phi") * F.col("c") + F.col("phi") ** 2 * F.col("vx")))
    fit = fit.withColumn("sigma", F.when(F.col("n") < 5, F.col("sr")).when(left == 0, F.col("sr")).otherwise(left))
    out = fit.withColumn("bar", F.explode(F.sequence(F.lit(0), F.lit(bars - 1)))).withColumn("pct", F.explode(F.array(*[F.lit(p) for p in percentiles])))
    grow = F.when(F.col("bar") == 0, 1.0).otherwise((1 - F.col("phi") ** (F.col("bar") + 1)) / (1 - F.col("phi")))
    z = F.lit(0.0)
    for p in percentiles:
        z = F.when(F.col("pct") == p, NormalDist().inv_cdf(p / 100)).otherwise(z)
    return out.select("series_id", "bar", "pct", (F.exp(F.col("mean") * (F.col("bar") + 1) + z * F.col("sigma") * grow) - 1).alias("value"))
