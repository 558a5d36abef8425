"""Walk-forward trials, their cones and outcomes; banded warping distances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.operators import candles, order_stats, projection, regimes, sampling, search
from pastcast.operators.windows import resampled, windows
from pastcast.session import ship, stored
from pastcast.sources import series


def positions(rows: DataFrame, width: int, ahead: int, stride: int) -> DataFrame:
    """(query_id, series_id, q_start, cut, values): trial windows at multiples of the stride that leave three widths before and ``ahead`` values after.

    The look-back ends where the query begins: ``cut`` is its start.
    """
    end = rows.groupBy("series_id").agg((F.max("pos") + 1).alias("n"))
    w = windows(rows, width, stride).join(end, "series_id").filter((F.col("start") >= 3 * width) & (F.col("start") <= F.col("n") - width - ahead))
    return w.select(F.concat_ws("@", "series_id", F.col("start").cast("string")).alias("query_id"), "series_id", F.col("start").alias("q_start"), F.col("start").alias("cut"), "values")


def drawn_positions(rows: DataFrame, width: int, ahead: int, n: int, seed: int = 1) -> DataFrame:
    """Like ``positions``, but for ``n`` places a series, drawn without replacement by hash; all of a series that has fewer.

    The ranking keeps at most ``n`` places a series in each task before the shuffle.
    """
    end = rows.groupBy("series_id").agg((F.max("pos") + 1).alias("n"))
    key = F.md5(F.concat_ws("|", "series_id", F.col("pos").cast("string"), F.lit(str(seed))))
    places = rows.select("series_id", "pos").join(end, "series_id").filter((F.col("pos") >= 3 * width) & (F.col("pos") <= F.col("n") - width - ahead))
    drawn = places.withColumn("k", F.row_number().over(Window.partitionBy("series_id").orderBy(key, "pos"))).filter(F.col("k") <= n)
    w = windows(rows, width).join(drawn.select("series_id", F.col("pos").alias("start")), ["series_id", "start"])
    return w.select(F.concat_ws("@", "series_id", F.col("start").cast("string")).alias("query_id"), "series_id", F.col("start").alias("q_start"), F.col("start").alias("cut"), "values")


def input_checks(rows: DataFrame, width: int, bars: int, n: int) -> DataFrame:
    """(series_id, n, reason): why a series can't be walked, null if it can: too short for three widths, a query and its outcome, or values that are null or not finite.

    Raises ValueError for settings that no series can meet.
    """
    for name, value in (("width", width), ("bars", bars), ("n", n)):
        if value <= 0:
            raise ValueError(f"{name} must be positive, got {value}")
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    out = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return out.select("series_id", "n", F.when(F.col("bad") > 0, "values that are not finite").when(F.col("n") < 4 * width + bars, "history too short").alias("reason"))


def accounted(rows: DataFrame, trials: DataFrame, width: int, bars: int, k: int, methods: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(curves, account) of trials (query_id, series_id, q_start, cut, values).

    curves are those of ``walk_forward``. account has one row for each trial, answered or not: (query_id, series_id, q_start, n_matches, n_paths,
    top_score, mean_match, hit, p50_error, reason). A trial without a result says why: its anchor (the query's last value) is zero, no window of its look-back
    could be matched, or no match has a path (its anchor is zero). hit and p50_error compare the last bar's median with the outcome; mean_match is the mean
    of the matches' returns there.
    """
    anchored = trials.withColumn("_anchor", F.element_at("values", -1))
    found = search.candidates(rows, trials, width, k, methods, ahead=bars, own=True)
    best = stored(search.top(found, k).select("query_id", "rank", F.col("score").alias("weight"), "series_id", (F.col("start") + width).alias("end")))
    paths = stored(projection.forward_paths(best, rows, bars))
    real = projection.forward_paths(trials.select("query_id", "series_id", (F.col("q_start") + width).alias("end")), rows, bars).select("query_id", "bar", F.col("ret").alias("actual"))
    matched = best.groupBy("query_id").agg(F.count("*").alias("n_matches"), F.max("weight").alias("top_score"))
    curves = stored(projection.cone(paths, ["query_id"]).join(real, ["query_id", "bar"]).join(matched.select("query_id", "n_matches"), "query_id"))
    last = F.col("bar") == bars - 1
    ends = paths.filter(last).groupBy("query_id").agg(F.count("*").alias("n_paths"), F.avg("ret").alias("mean_match"))
    mid = curves.filter(last & (F.col("pct") == 50)).select("query_id", ((F.col("value") > 0) == (F.col("actual") > 0)).alias("hit"), F.abs(F.col("value") - F.col("actual")).alias("p50_error"))
    out = anchored.select("query_id", "series_id", "q_start", "_anchor").join(matched, "query_id", "left").join(ends, "query_id", "left").join(mid, "query_id", "left")
    reason = F.when(F.col("_anchor") == 0, "anchor value is zero").when(F.col("n_matches").isNull(), "no matches found").when(F.col("n_paths").isNull(), "no valid forward paths")
    none = F.col("_anchor") == 0  # such a trial isn't searched for
    count = lambda c: F.when(none, 0).otherwise(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    kept = lambda c: F.when(~none, F.col(c)).alias(c)
    return curves, out.select("query_id", "series_id", "q_start", count("n_matches"), count("n_paths"), kept("top_score"), kept("mean_match"), "hit", "p50_error", reason.alias("reason"))


def walk_forward(rows: DataFrame, trials: DataFrame, width: int, bars: int, k: int, methods: dict[str, float]) -> DataFrame:
    """(query_id, bar, pct, value, actual, n_matches): the cone of each trial from matches in its series before it, beside what happened.

    One pass over the series serves all trials. A trial without matches, or with a zero anchor, has no rows.
    """
    found = search.candidates(rows, trials, width, k, methods, ahead=bars, own=True)
    best = search.top(found, k).select("query_id", "rank", F.col("score").alias("weight"), "series_id", (F.col("start") + width).alias("end"))
    cone = projection.cone(projection.forward_paths(best, rows, bars), ["query_id"])
    real = projection.forward_paths(trials.select("query_id", "series_id", (F.col("q_start") + width).alias("end")), rows, bars).select("query_id", "bar", F.col("ret").alias("actual"))
    return cone.join(real, ["query_id", "bar"]).join(best.groupBy("query_id").agg(F.count("*").alias("n_matches")), "query_id")


def ensemble_walk_forward(rows: DataFrame, trials: DataFrame, width: int, bars: int, k: int, methods: dict[str, float], draws: int = 500, coverage: float = 0.9) -> DataFrame:
    """(query_id, actual, basic, p50, lower, upper): the last bar of each trial by the plain cone, the blended one and the conformal interval about it.

    The regimes are those of the trial's window and of the matched windows. A trial without matches, or with a zero anchor, has no row.
    """
    found = search.candidates(rows, trials, width, k, methods, ahead=bars, own=True)
    best = search.top(found, k).select("query_id", "rank", F.col("score").alias("weight"), "series_id", "start")
    best = with_regime(best.join(windows(rows, width), ["series_id", "start"]))
    asked = with_regime(trials.select("query_id", "values")).withColumnRenamed("regime", "query_regime")
    best = stored(best.join(asked, "query_id").withColumn("end", F.col("start") + width).drop("start"))
    paths = stored(projection.forward_paths(best, rows, bars))
    real = projection.forward_paths(trials.select("query_id", "series_id", (F.col("q_start") + width).alias("end")), rows, bars)
    last = F.col("bar") == bars - 1
    mid = lambda c, name: c.filter(last & (F.col("pct") == 50)).select("query_id", F.col("value").alias(name))
    blend = stored(sampling.ensemble(paths, ["query_id"], draws=draws))
    base = blend.filter("pct = 50").select("query_id", "bar", F.col("value").alias("base"))
    band = projection.conformal(paths, ["query_id"], ["rank"], coverage, base).filter(last).drop("bar")
    out = real.filter(last).select("query_id", F.col("ret").alias("actual"))
    return out.join(mid(projection.cone(paths, ["query_id"]), "basic"), "query_id").join(mid(blend, "p50"), "query_id").join(band, "query_id")


def with_regime(df: DataFrame) -> DataFrame:
    """Adds the hard regime of each row's values, which are dropped."""
    df = regimes.with_hurst(regimes.with_moves(df))
    return df.withColumn("regime", regimes.hard_label(F.col("vol"), F.col("slope"), F.col("hurst"), F.size("values"))).drop("values", "vol", "slope", "hurst")


def scanned(rows: DataFrame, queries: DataFrame, width: int, k: int, methods: dict[str, float], ahead: int, top_n: int = 10) -> DataFrame:
    """(query_id, instrument, n_matches, start, score, p10, p50, p90, note, overall): each setup's best windows in every series, as a last bar's cone.

    ``start`` and ``score`` are those of the best window; ``overall`` is the place of the setup's ``top_n`` best series by it (ties by name), null beyond. A series of fewer than ``width + ahead`` values has one row with a note and nulls.
    """
    best = stored(search.top(search.candidates(rows, queries, width, k, methods, ahead=ahead), k, "query_id", "series_id"))
    weighed = best.select("query_id", F.col("series_id").alias("instrument"), "rank", F.col("score").alias("weight"), "series_id", (F.col("start") + width).alias("end"))
    cone = projection.cone(projection.forward_paths(weighed, rows, ahead), ["query_id", "instrument"]).filter(F.col("bar") == ahead - 1)
    keys = ["query_id", F.col("series_id").alias("instrument")]
    first = F.col("rank") == 1
    tops = best.groupBy(*keys).agg(F.count("*").alias("n_matches"), F.max(F.when(first, F.col("start"))).alias("start"), F.max(F.when(first, F.col("score"))).alias("score"))
    ends = cone.groupBy("query_id", "instrument").agg(*[F.max(F.when(F.col("pct") == p, F.col("value"))).alias(f"p{p}") for p in (10, 50, 90)])
    short = rows.groupBy(F.col("series_id").alias("instrument")).agg(F.count("*").alias("n")).filter(F.col("n") < width + ahead)
    notes = short.select("instrument", F.lit("insufficient history").alias("note"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "instrument"))
    first = tops.select("query_id", "instrument", place.alias("overall")).filter(F.col("overall") <= top_n)
    out = tops.join(ends, ["query_id", "instrument"], "left").join(first, ["query_id", "instrument"], "left")
    return out.withColumn("note", F.lit(None).cast("string")).unionByName(notes, allowMissingColumns=True)


def cross_timeframe(rows: DataFrame, queries: DataFrame, frames: list[str], width: int, k: int, methods: dict[str, float], ahead: int = 0, least: int = 10, share: float = 0.5) -> DataFrame:
    """(query_id, source, start, end, score): each query's best windows at several timeframes, overlaps removed best first; at most k per query.

    queries: (query_id, values) of ``width``. At each frame a series has the last value of each period, and the query is drawn to the width times the
    share of rows that are left; a frame at which that is less than ``least`` is left out. Places are those of the frame named as source.
    """
    n, out = rows.count(), None
    for frame in frames:  # a few
        slow = stored(series.positions(candles.downsampled(rows, frame)))
        size = max(1, round(width * slow.count() / n)) if n else 0
        if size < least:
            continue
        asked = queries.select("query_id", F.lit("").alias("series_id"), F.lit(0).cast("long").alias("q_start"), F.lit(0).cast("long").alias("cut"), (resampled(F.col("values"), size) if size != width else F.col("values")).alias("values"))
        found = search.top(search.candidates(slow, asked, size, k, methods, ahead=ahead), k)
        some = found.select("query_id", F.concat_ws(":", "series_id", F.lit(frame)).alias("source"), "start", (F.col("start") + size).alias("end"), "score")
        out = some if out is None else out.unionByName(some)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id string, source string, start long, end long, score double")
    return without_overlaps(out, k, share)


def ensemble_report(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, basic_hit_rate, hit_rate, coverage): how often each median has the outcome's sign, or both are not positive, and the interval holds it."""
    hit = lambda c: F.avg(((F.col(c) > 0) == (F.col("actual") > 0)).cast("double"))
    return ends.groupBy(*keys).agg(F.count("*").alias("n"), hit("basic").alias("basic_hit_rate"), hit("p50").alias("hit_rate"), F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"))


def swept(rows: DataFrame, widths: tuple[int, ...], bars: int, k: int, n: int, methods: dict[str, float], seeds: tuple[int, ...] = (1,)) -> DataFrame:
    """(series_id, width, seed, n, hit_rate, crps, trust): walk-forward trials of every series at every width and seed; trust is the hit rate times one less the CRPS.

    Each seed draws ``n`` trials a series. Those of one width, of all seeds, share one pass over all series; a hit and the CRPS are those of the last bar.
    """
    out = None
    for width in widths:  # a grid of a few settings
        tries = [drawn_positions(rows, width, bars, n, seed).withColumn("query_id", F.concat_ws("@", "query_id", F.lit(str(seed)))) for seed in seeds]
        ends = terminal(walk_forward(rows, stored(reduce(DataFrame.unionByName, tries)), width, bars, k, methods), bars)
        some = ends.select(F.substring_index("query_id", "@", 1).alias("series_id"), F.lit(width).alias("width"), F.substring_index("query_id", "@", -1).cast("int").alias("seed"), "actual", "p10", "p50", "p90")
        out = some if out is None else out.unionByName(some)
    crps = sum((F.pow((F.col("actual") <= F.col(f"p{p}")).cast("double") - p / 100, 2) for p in (10, 50, 90)), F.lit(0.0)) / 3
    hit = ((F.col("p50") > 0) == (F.col("actual") > 0)).cast("double")
    out = out.groupBy("series_id", "width", "seed").agg(F.count("*").alias("n"), F.avg(hit).alias("hit_rate"), F.avg(crps).alias("crps"))
    return out.withColumn("trust", F.round(F.round(F.col("hit_rate") * (1 - F.least(F.col("crps"), F.lit(1.0))), 9), 4))  # a half in the fourth digit goes up, however the sum came about


def bar_calibration(trial_bars: DataFrame) -> DataFrame:
    """(pct, error): mean over bars of the distance between how often the outcome lies below a curve and its level."""
    per = trial_bars.groupBy("pct", "bar").agg(F.avg((F.col("actual") <= F.col("value")).cast("double")).alias("below"))
    return per.groupBy("pct").agg(F.avg(F.abs(F.col("below") - F.col("pct") / 100)).alias("error"))


def terminal(trial_bars: DataFrame, bars: int) -> DataFrame:
    """(query_id, actual, p10, p50, p90): the last bar of each trial."""
    last = trial_bars.filter(F.col("bar") == bars - 1)
    return last.groupBy("query_id").agg(F.first("actual").alias("actual"), *[F.max(F.when(F.col("pct") == p, F.col("value"))).alias(f"p{p}") for p in (10, 50, 90)])


def empirical_crps(actual: Column, values: Column, levels: list[float]) -> Column:
    """The integral of the squared distance of a forecast's distribution and the outcome's step.

    ``values`` are its quantiles at the levels, ascending. Between two of them the distribution stays at the lower one's level; below
    the first it is 0, above the last 1.
    """
    at = lambda i: F.get(values, F.lit(i))
    out = F.greatest(at(0) - actual, F.lit(0.0)) + F.greatest(actual - at(len(levels) - 1), F.lit(0.0))
    for i, level in enumerate(levels[:-1]):
        width = F.greatest(at(i + 1) - at(i), F.lit(0.0))
        left = F.least(F.greatest(actual - at(i), F.lit(0.0)), width)  # of the stretch, where the step is still 0
        out = out + level**2 * left + (level - 1) ** 2 * (width - left)
    return out


def runtimes(trials: DataFrame, few: int = order_stats.FEW) -> DataFrame:
    """(arm, rt_median, rt_mean, rt_p95) of measured trials (arm, runtime)."""
    middle = order_stats.per_key(trials, ["arm"], "runtime", {"rt_median": 0.5, "rt_p95": 0.95}, few)
    return middle.join(trials.groupBy("arm").agg(F.avg("runtime").alias("rt_mean")), "arm").select("arm", "rt_median", "rt_mean", "rt_p95")


def retrieval_metrics(found: DataFrame) -> DataFrame:
    """(arm, n, correlation, [crps,] calibration_error, hit_rate) from trials (arm, mean_match, actual, p10, p90[, crps]); a flat side or fewer than three give 0."""
    flat = (F.count("*") < 3) | (F.stddev_pop("mean_match") == 0) | (F.stddev_pop("actual") == 0)
    return found.groupBy("arm").agg(
        F.count("*").alias("n"), F.when(flat, 0.0).otherwise(F.corr("mean_match", "actual")).alias("correlation"), *([F.avg("crps").alias("crps")] if "crps" in found.columns else []), F.abs(F.avg(F.col("actual").between(F.col("p10"), F.col("p90")).cast("double")) - 0.8).alias("calibration_error"), F.avg((F.signum("mean_match") == F.signum("actual")).cast("double")).alias("hit_rate")
    )


def trust(groups: DataFrame) -> DataFrame:
    """Adds trust in 0 to 1 from n, mae, mean, sd and regime_share: sample size .35, calibration .25, agreement .15, regime .25."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    agree = F.when(F.col("mean") == 0, 0.0).otherwise(1 / (1 + F.col("sd") / F.abs("mean")))
    return groups.withColumn("trust", 0.35 * F.col("n") / (F.col("n") + 5) + 0.25 * clip(1 - F.col("mae") / 0.3) + 0.15 * agree + 0.25 * clip(F.col("regime_share")))


def warping_distances(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Banded warping distances of the rows of a and b (equal shapes): all pairs of rows advance together along the table's rows.

    A cell (i, j) is inside the band when abs(i - j) < radius, and always on the diagonal.
    """
    n, m = a.shape
    before = np.full((n, m + 1), np.inf)
    before[:, 0] = 0
    for i in range(m):
        now = np.full((n, m + 1), np.inf)
        for j in range(max(0, i - max(radius, 1) + 1), min(m, i + max(radius, 1))):
            now[:, j + 1] = (a[:, i] - b[:, j]) ** 2 + np.minimum(np.minimum(before[:, j], before[:, j + 1]), now[:, j])
        before = now
    return np.sqrt(before[:, m])


def with_warping(pairs: DataFrame, a: str, b: str, radius: int | None = None) -> DataFrame:
    """Adds dtw = exp(-distance / length) of two array columns of one length, z-scored; the band's default is a tenth of the length."""
    ship(pairs.sparkSession)

    @F.pandas_udf("double")
    def score(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in columns:
            out, size = np.zeros(len(x)), x.map(len).to_numpy()
            for m in np.unique(size):
                at = np.flatnonzero(size == m)
                p, q = (np.stack(s.iloc[at].to_list()).astype(float) for s in (x, y))
                p, q = ((v - v.mean(axis=1, keepdims=True)) / np.where(v.std(axis=1, keepdims=True) == 0, 1, v.std(axis=1, keepdims=True)) for v in (p, q))
                out[at] = np.exp(-warping_distances(p, q, radius or max(1, m // 10)) / m)
            yield pd.Series(out)

    return pairs.withColumn("dtw", score(a, b))


def without_overlaps(found: DataFrame, k: int, share: float = 0.5) -> DataFrame:
    """Best first, a match is dropped when it overlaps one that is kept by more than the share of its own length; at most k per query.

    found: (query_id, source, start, end, score), a few hundred rows per query.
    """
    schema = found.schema

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for row in pdf.sort_values(["score", "source", "start"], ascending=[False, True, True]).itertuples():
            if len(kept) < k and all(min(row.end, o.end) - max(row.start, o.start) <= share * (row.end - row.start) for o in kept):
                kept.append(row)
        return pdf.loc[[r.Index for r in kept]]

    return found.groupBy("query_id").applyInPandas(greedy, schema)


def latest_regimes(rows: DataFrame, last: int = 60) -> DataFrame:
    """(series_id, values) of each series' last bars, for a regime snapshot."""
    q = search.last_windows(rows, last)
    return q.select("series_id", "values")


def ranked_generators(scores: DataFrame) -> DataFrame:
    """Adds place: rows with an error last, then fidelity downwards, utility gap upwards, name."""
    w = Window.orderBy(F.col("error").isNotNull(), F.desc("fidelity"), F.asc("gap"), "name")  # one row per generator
    return scores.withColumn("place", F.row_number().over(w))


def promoted(promotions: DataFrame, runs: DataFrame) -> DataFrame:
    """(name, run_id, dangling): the run that each dataset name points to, the last one promoted; dangling if there is no such run."""
    last = promotions.groupBy("name").agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id"))
    known = runs.select("run_id").distinct().withColumn("_known", F.lit(True))
    return last.join(known, "run_id", "left").select("name", "run_id", F.col("_known").isNull().alias("dangling"))
