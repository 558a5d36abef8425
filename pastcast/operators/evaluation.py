"""Scores of trials and forecasts, comparisons, gates and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.operators import order_stats
from pastcast.session import stored
from pastcast.sources.series import framed, in_chunk


def trial_metrics(trials: DataFrame, keys: list[str], alpha: float = 0.2, size: int = 1 << 16) -> DataFrame:
    """Per key: hit rate, MAE, calibration, CRPS, interval score, coverage, profit factor, largest drawdown, Sharpe.

    trials: (keys, pos, actual, p10, p50, p90), the terminal values of each trial in order. A hit is p50 > 0 where actual > 0 or neither;
    a trade earns sign(p50) x actual. The drawdown of the running sum is found inside chunks of positions and then over one row per chunk.
    """
    y = F.col("actual")
    trade = F.signum("p50") * y
    hit = (F.col("p50") > 0) == (y > 0)
    under = lambda c: (y <= F.col(c)).cast("double")
    crps = sum(((under(f"p{p}") - p / 100) ** 2 for p in (10, 50, 90)), F.lit(0.0)) / 3
    interval = F.col("p90") - F.col("p10") + 2 / alpha * (F.greatest(F.lit(0.0), F.col("p10") - y) + F.greatest(F.lit(0.0), y - F.col("p90")))
    main = trials.groupBy(*keys).agg(
        F.avg(hit.cast("double")).alias("hit_rate"), F.avg(F.abs(F.col("p50") - y)).alias("mae"), *[F.avg(under(f"p{p}")).alias(f"below_p{p}") for p in (10, 50, 90)], F.avg(crps).alias("crps"), F.avg(interval).alias("interval_score"),
        F.avg(y.between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage"), (F.sum(F.when(hit, F.abs(y))) / F.sum(F.when(~hit, F.abs(y)))).alias("profit_factor"), (F.avg(trade) / F.stddev_pop(trade) * F.sqrt(F.lit(252.0))).alias("sharpe"),
    )
    w = Window.partitionBy(*keys, "_k").orderBy("pos")
    run = trials.withColumns({"_k": F.floor(F.col("pos") / size), "_t": trade}).withColumn("_e", F.sum("_t").over(w))
    run = run.withColumn("_p", F.max("_e").over(w))
    part = run.groupBy(*keys, "_k").agg(F.max(F.col("_p") - F.col("_e")).alias("dd"), F.max("_e").alias("hi"), F.min("_e").alias("lo"), F.max_by("_e", "pos").alias("end"))
    over = Window.partitionBy(*keys).orderBy("_k")
    part = part.withColumn("base", F.sum("end").over(over) - F.col("end"))
    part = part.withColumn("peak", F.max(F.col("base") + F.col("hi")).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    deep = part.groupBy(*keys).agg(F.max(F.greatest("dd", F.coalesce(F.col("peak") - F.col("base") - F.col("lo"), F.lit(0.0)))).alias("max_drawdown"))
    return main.join(deep, keys)


def accuracy(forecast: DataFrame, train: DataFrame, season: int) -> DataFrame:
    """Per series: MAE, sMAPE, MASE (null for a zero scale), coverage, CRPS of three curves. forecast: (series_id, step, actual, p10, p50, p90)."""
    gap = framed(train, {"g": F.abs(F.col("value") - F.lag("value", season).over(in_chunk()))}, before=season)
    scale = gap.groupBy("series_id").agg(F.avg("g").alias("scale"))
    size = F.abs("actual") + F.abs("p50")
    out = forecast.groupBy("series_id").agg(
        F.avg(F.abs(F.col("actual") - F.col("p50"))).alias("mae"), F.avg(F.when(size == 0, 0.0).otherwise(2 * F.abs(F.col("actual") - F.col("p50")) / size)).alias("smape"), F.avg(F.col("actual").between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage"),
        F.avg(sum((((F.col("actual") <= F.col(f"p{p}")).cast("double") - p / 100) ** 2 for p in (10, 50, 90)), F.lit(0.0)) / 3).alias("crps"),
    )
    return out.join(scale, "series_id").withColumn("mase", F.when(F.col("scale") != 0, F.col("mae") / F.col("scale"))).drop("scale")


def report(results: DataFrame, keys: list[str], system: str, metrics: list[str], target: float = 0.8, few: int = order_stats.FEW) -> DataFrame:
    """Mean, median and largest of each metric per key and system, NaN left out, and whether the mean is the best: the smallest, for coverage the one nearest the target."""
    item = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics]))
    rows = results.select(*keys, system, item.alias("i")).select(*keys, system, "i.*").filter(F.col("x").isNotNull() & ~F.isnan("x"))
    rows, by = stored(rows), [*keys, system, "metric"]
    middle = order_stats.per_key(rows, by, "x", {"median": 0.5}, few).toDF(*[f"_{c}" for c in by], "median")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    out = rows.groupBy(*by).agg(F.avg("x").alias("mean"), F.max("x").alias("largest")).join(middle, same).select(*by, "mean", "median", "largest")
    far = F.when(F.col("metric") == "coverage", F.abs(F.col("mean") - target)).otherwise(F.col("mean"))
    return out.withColumn("best", F.rank().over(Window.partitionBy(*keys, "metric").orderBy(far)) == 1)


def deltas(base: DataFrame, new: DataFrame, lower_better: list[str]) -> DataFrame:
    """(id, metric, before, after, delta, direction) of two metric tables (id, metric, value)."""
    both = base.select("id", "metric", F.col("value").alias("before")).join(new.select("id", "metric", F.col("value").alias("after")), ["id", "metric"], "full_outer")
    d = F.col("after") - F.col("before")
    better = F.when(F.col("metric").isin(lower_better), d < 0).otherwise(d > 0)
    return both.withColumns({"delta": d, "direction": F.when(d.isNull(), "missing").when(d == 0, "same").when(better, "better").otherwise("worse")})


def gated(deltas_: DataFrame, gates: DataFrame) -> DataFrame:
    """(id, keep, failed): keep if every required gate (metric, least_delta, required) passes; a missing metric fails.

    Gates that pass are counted against how many there are, so any number of gates is one join on the metric.
    """
    whole = gates.agg(F.count("*").alias("_n"), F.count_if("required").alias("_must"))  # one row
    met = deltas_.join(gates, "metric").filter(F.col("delta") >= F.col("least_delta"))
    met = met.groupBy("id").agg(F.count("*").alias("_ok"), F.count_if("required").alias("_done"))
    rows = deltas_.select("id").distinct().join(met, "id", "left").crossJoin(F.broadcast(whole))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return rows.select("id", (zero("_done") == F.col("_must")).alias("keep"), (F.col("_n") - zero("_ok")).alias("failed"))


def by_regime(returns: DataFrame) -> DataFrame:
    """(label, n, sharpe): mean over population deviation per label; fewer than two or flat returns give null, a null label is skipped."""
    return returns.filter("label is not null").groupBy("label").agg(F.count("*").alias("n"), F.when((F.count("*") >= 2) & (F.stddev_pop("ret") > 0), F.avg("ret") / F.stddev_pop("ret")).alias("sharpe"))


def risk_flags(runs: DataFrame) -> DataFrame:
    """Adds flags and grade from n_trials, skip_rate, calibration, hit_rate, max_drawdown, coverage and crps."""
    rules = [("few_trials", F.col("n_trials") < 20), ("many_skips", F.col("skip_rate") > 0.3), ("miscalibrated", F.col("calibration") > 0.15), ("weak_direction", F.col("hit_rate") < 0.5), ("deep_drawdown", F.col("max_drawdown") > 0.3), ("low_coverage", F.col("coverage") < 0.7), ("high_crps", F.col("crps") > 0.5)]
    flags = F.array_compact(F.array(*[F.when(test, name) for name, test in rules]))
    return runs.withColumn("flags", flags).withColumn("grade", F.when(F.size("flags") == 0, "A").when(F.size("flags") <= 2, "B").when(F.size("flags") <= 4, "C").otherwise("D"))


def strategy(matches: DataFrame, rules: list[tuple[str, Column, int]]) -> DataFrame:
    """Adds rule and side: the first rule (name, condition, side) that holds; no rule gives null and 0."""
    name, side = F.lit(None).cast("string"), F.lit(0)
    for rule, test, s in reversed(rules):
        name, side = F.when(test, rule).otherwise(name), F.when(test, s).otherwise(side)
    return matches.withColumns({"rule": name, "side": side})


def momentum(threshold: float = 0.02) -> list[tuple[str, Column, int]]:
    """With the trend: the median beyond a threshold in a regime of the same direction."""
    up, down = (F.col("p50") > threshold) & (F.col("regime") == "trending_up"), (F.col("p50") < -threshold) & (F.col("regime") == "trending_down")
    return [("momentum_long", up, 1), ("momentum_short", down, -1)]


def reversion(threshold: float = 0.03) -> list[tuple[str, Column, int]]:
    """Against the median, where it and the spread of the cone are wide in a mean-reverting regime: a low median is bought."""
    wide = (F.col("p90") - F.col("p10") > threshold) & (F.col("regime") == "mean_reverting")
    return [("reversion_long", wide & (F.col("p50") < -threshold), 1), ("reversion_short", wide & (F.col("p50") > threshold), -1)]


def breakout() -> list[tuple[str, Column, int]]:
    """With the outer quartile in a regime of high volatility; long where both quartiles allow a trade."""
    high = F.col("regime") == "high_vol"
    return [("breakout_long", high & (F.col("p75") > 0), 1), ("breakout_short", high & (F.col("p25") < 0), -1)]


def signals(matches: DataFrame, rules: list[tuple[str, Column, int]], least: float) -> DataFrame:
    """Adds rule, side, entry, stop and target to matches with confidence, regime, price and the cone's last p10 to p90.

    A match below ``least`` or without a rule that holds (nulls hold nowhere) has null and 0. Stops are the cone's p10 (short: p90),
    targets its p75 (short: p25), as prices; a missing percentile gives null.
    """
    sure = F.coalesce(F.col("confidence") >= least, F.lit(False))
    out = strategy(matches, [(name, sure & test, side) for name, test, side in rules])
    level = lambda long, short: F.when(F.col("side") > 0, F.col("price") * (1 + F.col(long))).when(F.col("side") < 0, F.col("price") * (1 + F.col(short)))
    return out.withColumns({"entry": F.when(F.col("side") != 0, F.col("price")), "stop": level("p10", "p90"), "target": level("p75", "p25")})


def strategy_results(trades: DataFrame) -> DataFrame:
    """(rule, n, win_rate, mean_return, sharpe) of trades with rule, side and ret; sample deviation."""
    gain = F.col("side") * F.col("ret")
    return trades.filter("rule is not null").groupBy("rule").agg(F.count("*").alias("n"), F.avg((gain > 0).cast("double")).alias("win_rate"), F.avg(gain).alias("mean_return"), (F.avg(gain) / F.stddev_samp(gain)).alias("sharpe"))


def sized(decisions: DataFrame, sizes: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0), aversion: float = 2.0) -> DataFrame:
    """Adds size: of those given the one with the largest mean x size - aversion x variance x size squared; the smaller one of equals. No veto passes."""
    item = lambda s: F.struct(F.round(F.col("mean") * s - aversion * F.col("variance") * s * s, 12).alias("u"), F.lit(-s).alias("o"))
    best = F.array_max(F.array(*[item(s) for s in sizes]))
    return decisions.withColumn("size", F.when(F.col("veto"), 0.0).otherwise(-best["o"]))


def entered(decisions: DataFrame, threshold: float = 0.0, least: float = 0.0, most: float = 1.0) -> DataFrame:
    """Replaces side and adds met and size: an entry stands if it is trusted and its adverse tail clears the threshold.

    decisions: (side -1, 0 or 1, tail_low, tail_high, trusted, trust in 0 to 1, confidence in 0 to 100). A long entry is judged by
    tail_low, a short one by tail_high; a missing tail fails. What fails is flat with size 0; the rest grow with trust and confidence.
    """
    tail = F.when(F.col("side") > 0, F.col("tail_low") >= threshold).when(F.col("side") < 0, -F.col("tail_high") >= threshold).otherwise(True)
    rows = decisions.withColumn("met", F.coalesce(tail, F.lit(False)))
    stands = F.col("met") & F.coalesce("trusted", F.lit(False))
    size = F.when(stands & (F.col("side") != 0), least + (most - least) * F.col("trust") * F.col("confidence") / 100).otherwise(0.0)
    return rows.withColumns({"size": size, "side": F.when(stands, F.col("side")).otherwise(0)})
