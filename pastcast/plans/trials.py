"""Queries of walk-forward trials and what else needs the search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastcast.functions.common import rounded
from pastcast.operators import evaluation, projection, regimes, relations, search, trials, windows
from pastcast.plans.data import SERIES, event_series
from pastcast.plans.evaluation import _COS, _edges, _EDGES, vectors
from pastcast.plans.registry import registry
from pastcast.plans.search import _MATCHES, _WINS, _Z, BARS, TIER, TOP, WIDTH, _cone, matches
from pastcast.session import stored, table

QUERIES, ORACLES, query = registry()
#: Trials drawn per series (K1).
DRAWN = 40


def trial_sql(settings: list[tuple[int, int]] = [(WIDTH, 1)], series: str = SERIES, tagged: bool = False) -> str:  # noqa: B006
    """CTEs of drawn trials of (width, seed) settings: w windows, tr trials, m matches, paths, cone, act outcomes, tb cone beside outcome."""
    widths = sorted({w for w, _ in settings})
    wins = ", ".join(f"""v{w} AS (SELECT series_id, pos AS start, list(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS v, {w} AS width FROM series)""" for w in widths)
    whole = " UNION ALL ".join(f"SELECT * FROM v{w} WHERE len(v) = {w}" for w in widths)
    name = "series_id || '@' || start" + (" || '@' || width || '@' || seed" if tagged else "")
    return f"""{series}, ends AS (SELECT series_id, max(pos) + 1 AS n FROM series GROUP BY 1), {wins}, w AS (SELECT series_id, start, v, width, {_Z} AS z FROM ({whole})), cfg(width, seed) AS (VALUES {", ".join(map(str, settings))}),
  tr AS (SELECT {name} AS query_id, * FROM (SELECT w.*, seed, row_number() OVER (PARTITION BY w.series_id, w.width, seed ORDER BY md5(concat_ws('|', w.series_id, w.start, seed)), w.start) AS k FROM w JOIN ends USING (series_id) JOIN cfg USING (width) WHERE w.start >= 3 * w.width AND w.start <= n - w.width - {BARS}) WHERE k <= {DRAWN}),
  s AS (SELECT t.query_id, t.series_id, t.start AS q_start, t.width, c.start, (list_inner_product(c.z, t.z) / t.width + 1) / 2 * (list_stddev_pop(c.v) > 1e-10 AND list_stddev_pop(t.v) > 1e-10)::INT AS score FROM tr t JOIN w c ON c.series_id = t.series_id AND c.width = t.width AND c.start + t.width + {BARS} <= t.start),
  m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, start) AS rank FROM s) WHERE rank <= {TOP}),
  paths AS (SELECT m.query_id, m.rank, m.score AS weight, b.bar, (f.value - a.value) / a.value AS ret FROM m JOIN range(0, {BARS}) b(bar) ON true JOIN series a ON a.series_id = m.series_id AND a.pos = m.start + m.width - 1 AND a.value <> 0 JOIN series f ON f.series_id = m.series_id AND f.pos = m.start + m.width + b.bar), {_cone()},
  act AS (SELECT t.query_id, b.bar, (f.value - a.value) / a.value AS actual FROM tr t JOIN range(0, {BARS}) b(bar) ON true JOIN series a ON a.series_id = t.series_id AND a.pos = t.start + t.width - 1 AND a.value <> 0 JOIN series f ON f.series_id = t.series_id AND f.pos = t.start + t.width + b.bar),
  tb AS (SELECT cone.*, actual FROM cone JOIN act USING (query_id, bar))"""


_TRIAL = trial_sql()


def drawn(s: DataFrame) -> DataFrame:
    return trials.drawn_positions(s, WIDTH, BARS, DRAWN)


def trial_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_series(spark, sf_dir)
    return trials.walk_forward(s, drawn(s), WIDTH, BARS, TOP, {"pearson": 1.0})


@query(f"""WITH {_WINS}, d AS (SELECT w.*, row_number() OVER (PARTITION BY w.series_id ORDER BY md5(concat_ws('|', w.series_id, w.start, 1)), w.start) AS k FROM w JOIN ends USING (series_id) WHERE w.start >= {3 * WIDTH} AND w.start <= n - {WIDTH + BARS})
  SELECT series_id || '@' || start AS query_id, start AS q_start, v[1] AS first_value, v[{WIDTH}] AS last_value FROM d WHERE k <= 50""")
def k1_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty trial places a series, drawn by hash (K1)."""
    t = trials.drawn_positions(event_series(spark, sf_dir), WIDTH, BARS, 50)
    return t.select("query_id", "q_start", F.get("values", F.lit(0)).alias("first_value"), F.element_at("values", -1).alias("last_value"))


@query(f"""WITH {_TRIAL} SELECT query_id, bar, pct, round(value, 6) + 0.0 AS value, round(actual, 6) + 0.0 AS actual FROM tb""")
def k2_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn trials (K1), searched strictly before themselves, projected and set beside the outcome."""
    return trial_bars(spark, sf_dir).select("query_id", "bar", "pct", rounded("value").alias("value"), rounded("actual").alias("actual"))


@query(f"""WITH {_TRIAL}, p AS (SELECT pct, bar, avg((round(actual - value, 12) <= 0)::INT) AS below FROM tb GROUP BY 1, 2) SELECT pct, round(avg(abs(below - pct / 100.0)), 6) AS error FROM p GROUP BY 1""")
def k4_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.bar_calibration(trial_bars(spark, sf_dir)).select("pct", F.round("error", 6).alias("error"))


_GAPS = SERIES.replace("greatest(value, 0.01) AS value", "CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE greatest(value, 0.01) END AS value")


@query(f"""WITH {trial_sql(series=_GAPS)}, n AS (SELECT query_id, count(*) AS n_matches, max(score) AS top_score FROM m GROUP BY 1), p AS (SELECT query_id, count(*) AS n_paths, avg(ret) AS mean_match FROM paths WHERE bar = {BARS - 1} GROUP BY 1),
  c AS (SELECT query_id, (value > 0) = (actual > 0) AS hit, abs(value - actual) AS e FROM tb WHERE bar = {BARS - 1} AND pct = 50), z AS (SELECT query_id, series_id, start AS q_start, v[{WIDTH}] = 0 AS zero FROM tr)
  SELECT query_id, q_start, CASE WHEN zero THEN 0 ELSE coalesce(n_matches, 0) END AS n_matches, CASE WHEN zero THEN 0 ELSE coalesce(n_paths, 0) END AS n_paths, CASE WHEN NOT zero THEN round(top_score, 6) END AS top_score, CASE WHEN NOT zero THEN round(mean_match, 6) + 0.0 END AS mean_match, hit, round(e, 6) AS p50_error,
  CASE WHEN zero THEN 'anchor value is zero' WHEN n_matches IS NULL THEN 'no matches found' WHEN n_paths IS NULL THEN 'no valid forward paths' END AS reason FROM z LEFT JOIN n USING (query_id) LEFT JOIN p USING (query_id) LEFT JOIN c USING (query_id)""")
def k2_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn trial with its result or the reason why it has none, over series in which every seventh event is a zero."""
    s = event_series(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("value")))
    fit = trials.input_checks(s, WIDTH, BARS, DRAWN).filter("reason is null").select("series_id")
    s = stored(s.join(fit, "series_id", "left_semi"))
    _, account = trials.accounted(s, drawn(s), WIDTH, BARS, TOP, {"pearson": 1.0})
    return account.select("query_id", "q_start", "n_matches", "n_paths", F.round("top_score", 6).alias("top_score"), rounded("mean_match").alias("mean_match"), "hit", F.round("p50_error", 6).alias("p50_error"), "reason")


_LEVELS = [p / 100 for p in projection.PERCENTILES]
_CRPS = f"greatest(q[1] - actual, 0) + greatest(actual - q[{len(_LEVELS)}], 0) + " + " + ".join(f"{p * p} * least(greatest(actual - q[{i + 1}], 0), q[{i + 2}] - q[{i + 1}]) + {(p - 1) ** 2} * (q[{i + 2}] - q[{i + 1}] - least(greatest(actual - q[{i + 1}], 0), q[{i + 2}] - q[{i + 1}]))" for i, p in enumerate(_LEVELS[:-1]))


@query(f"""WITH {_TRIAL}, l AS (SELECT query_id, any_value(actual) AS actual, list(value ORDER BY pct) AS q FROM tb WHERE bar = {BARS - 1} GROUP BY 1), p AS (SELECT query_id, avg(ret) AS mm FROM paths WHERE bar = {BARS - 1} GROUP BY 1), x AS (SELECT split_part(query_id, '@', 1) AS arm, *, {_CRPS} AS crps FROM l JOIN p USING (query_id))
  SELECT arm, count(*) AS n, CASE WHEN count(*) < 3 OR stddev_pop(mm) = 0 OR stddev_pop(actual) = 0 THEN 0.0 ELSE round(corr(mm, actual), 5) + 0.0 END AS correlation, round(avg(crps), 6) AS crps, round(abs(avg((actual BETWEEN q[1] AND q[{len(_LEVELS)}])::INT) - 0.8), 6) AS calibration_error, round(avg((sign(mm) = sign(actual))::INT), 6) AS hit_rate FROM x GROUP BY 1""")
def k10_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval metrics per series as arm, over the trials' last bars: the mean of the matches' returns and the cone's distribution against what happened."""
    s = event_series(spark, sf_dir)
    curves, account = trials.accounted(s, drawn(s), WIDTH, BARS, TOP, {"pearson": 1.0})
    last = curves.filter(F.col("bar") == BARS - 1).groupBy("query_id").agg(F.first("actual").alias("actual"), F.sort_array(F.collect_list(F.struct("pct", "value"))).alias("_q"))  # a few curves
    t = last.withColumn("_q", F.transform("_q", lambda x: x.value)).join(account.filter("reason is null").select("query_id", F.col("series_id").alias("arm"), "mean_match"), "query_id")
    t = t.withColumns({"p10": F.element_at("_q", 1), "p90": F.element_at("_q", -1), "crps": trials.empirical_crps(F.col("actual"), F.col("_q"), _LEVELS)})
    out = trials.retrieval_metrics(t)
    return out.select("arm", "n", (F.round("correlation", 5) + 0.0).alias("correlation"), F.round("crps", 6).alias("crps"), F.round("calibration_error", 6).alias("calibration_error"), F.round("hit_rate", 6).alias("hit_rate"))


@query()
def k17_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rule strategies over the trials' best windows, with entry, stop and target from the trial's cone; the regime is the matched window's.

    The confidence is the score in hundredths.
    """
    s = event_series(spark, sf_dir)
    asked = stored(drawn(s))
    best = stored(search.top(search.candidates(s, asked, WIDTH, TOP, {"pearson": 1.0}, ahead=BARS, own=True), TOP))
    seen = trials.with_regime(best.select("query_id", "rank", "series_id", "start", (F.col("score") * 100).alias("confidence")).join(windows.windows(s, WIDTH), ["series_id", "start"]))
    weighed = best.select("query_id", "rank", F.col("score").alias("weight"), "series_id", (F.col("start") + WIDTH).alias("end"))
    cone = projection.cone(projection.forward_paths(weighed, s, BARS), ["query_id"]).filter(F.col("bar") == BARS - 1)
    ends = cone.groupBy("query_id").agg(*[F.max(F.when(F.col("pct") == p, F.col("value"))).alias(f"p{p}") for p in (10, 25, 50, 75, 90)])
    rows = stored(seen.select("query_id", "rank", "confidence", "regime").join(ends, "query_id").join(asked.select("query_id", F.element_at("values", -1).alias("price")), "query_id"))
    out = None
    for name, rules, least in (("momentum", evaluation.momentum(), 70.0), ("reversion", evaluation.reversion(), 65.0), ("breakout", evaluation.breakout(), 75.0)):
        some = evaluation.signals(rows, rules, least).withColumn("strategy", F.lit(name))
        out = some if out is None else out.unionByName(some)
    return out.select("strategy", "query_id", "rank", "regime", "rule", "side", *[F.round(c, 6).alias(c) for c in ("entry", "stop", "target")])


@query()
def m16_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series scanned for every setup, with cones and notes of short histories."""
    s = event_series(spark, sf_dir)
    out = trials.scanned(s, search.last_windows(s, WIDTH), WIDTH, TOP, TIER, BARS, 3)
    return out.select("query_id", "instrument", "n_matches", "start", *[rounded(c).alias(c) for c in ("score", "p10", "p50", "p90")], "note", "overall")


@query("""WITH g AS (SELECT o_custkey AS id, count(*) AS n, avg(o_totalprice) / 1e6 AS mae, avg(o_totalprice - 150000) AS mean, stddev_pop(o_totalprice) AS sd, avg((o_orderstatus = 'F')::INT) AS regime_share FROM orders GROUP BY 1)
  SELECT id, round(0.35 * n / (n + 5) + 0.25 * greatest(0.0, least(1.0, 1 - mae / 0.3)) + 0.15 / (1 + sd / abs(mean)) + 0.25 * regime_share, 6) AS trust FROM g""")
def k19_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 1e6).alias("mae"), F.avg(F.col("o_totalprice") - 150000).alias("mean"), F.stddev_pop("o_totalprice").alias("sd"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("regime_share"))
    return trials.trust(g).select("id", F.round("trust", 6).alias("trust"))


@query()
def m5_warping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banded warping score of the best matches of each query; held against brute force in the tests."""
    s, m = matches(spark, sf_dir)
    w = windows.windows(s, WIDTH)
    q = search.last_windows(s, WIDTH).select("query_id", F.col("values").alias("q"))
    pairs = m.join(w, ["series_id", "start"]).join(q, "query_id")
    return trials.with_warping(pairs, "q", "values").select("query_id", "rank", F.round("dtw", 6).alias("dtw"))


@query(f"""WITH {_MATCHES}, f AS (SELECT m.query_id, m.rank, (b.value - a.value) / a.value AS ret FROM m JOIN series a ON a.series_id = m.series_id AND a.pos = m.start + {WIDTH - 1} JOIN series b ON b.series_id = m.series_id AND b.pos = m.start + {WIDTH + BARS - 1}) SELECT query_id, round(avg(abs(ret)), 6) AS mean_move FROM f GROUP BY 1""")
def m21_forward_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pastcast.plans.search import paths

    return paths(spark, sf_dir).filter(F.col("bar") == BARS - 1).groupBy("query_id").agg(F.round(F.avg(F.abs("ret")), 6).alias("mean_move"))


@query()
def m15_cross_timeframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches at the event spacing and at 2 hours, overlaps removed best first."""
    from pastcast.operators import candles
    from pastcast.sources.series import positions

    s = event_series(spark, sf_dir)
    slow = positions(candles.downsampled(s, "2h"))
    fine = search.analogues(s, search.last_windows(s, WIDTH), WIDTH, TOP, ahead=BARS).withColumns({"source": F.lit("fine"), "end": F.col("start") + WIDTH})
    half = search.analogues(slow, search.last_windows(slow, WIDTH // 2), WIDTH // 2, TOP, ahead=BARS // 2).withColumns({"source": F.lit("2h"), "end": F.col("start") + WIDTH // 2})
    cols = ["query_id", "source", "start", "end", "score"]
    return trials.without_overlaps(fine.select(*cols).union(half.select(*cols)), TOP).withColumn("score", F.round("score", 6))


@query()
def m15_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' last window searched at three frames of all series (M15); held against numpy in the tests."""
    s = event_series(spark, sf_dir)
    out = trials.cross_timeframe(s, search.last_windows(s, WIDTH), ["1m", "5m", "15m"], WIDTH, TOP, {"pearson": 1.0}, BARS, 5)
    return out.withColumn("score", F.round("score", 6))


@query()
def c2_regime_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime of each series' last 60 bars, the most volatile first."""
    w = regimes.with_hurst(regimes.with_moves(trials.latest_regimes(event_series(spark, sf_dir))))
    out = w.withColumn("label", regimes.hard_label(F.col("vol"), F.col("slope"), F.col("hurst"), F.size("values")))
    return out.select("series_id", F.round("vol", 6).alias("vol"), rounded("slope").alias("slope"), F.round("hurst", 6).alias("hurst"), "label").orderBy(F.desc("vol"))


@query(f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings), q AS (SELECT * FROM v WHERE id % 100 = 0) SELECT q.id AS query_id, v.id, round(1 - {_COS.format(a="v.vec", b="q.vec")}, 6) AS distance FROM v JOIN q ON v.id <> q.id WHERE round(1 - {_COS.format(a="v.vec", b="q.vec")}, 9) <= 0.7""")
def v2_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors within a cosine distance of the stated queries (every hundredth id)."""
    v = vectors(spark, sf_dir)
    q = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vec")
    return relations.within(v, q, 0.7).select("query_id", "id", F.round("distance", 6).alias("distance"))


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges), r(node, root) AS (SELECT u, u FROM b UNION SELECT b.v, r.root FROM r JOIN b ON r.node = b.u) SELECT node, min(root) AS component FROM r GROUP BY 1""")
def v5_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.components(_edges(spark, sf_dir))


@query(f"""WITH {SERIES}, m AS (SELECT series_id, avg(value) AS m, var_pop(value) * count(*) AS v FROM series GROUP BY 1) SELECT a.series_id, l.lag, round(sum((a.value - m) * (b.value - m)) / any_value(v), 6) + 0.0 AS acf FROM series a JOIN m USING (series_id) JOIN (SELECT unnest([1, 5, 10]) AS lag) l ON true JOIN series b ON b.series_id = a.series_id AND b.pos = a.pos + l.lag GROUP BY 1, 2""")
def y5_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relations.autocorrelation(event_series(spark, sf_dir), [1, 5, 10])
    return out.select("series_id", "lag", rounded("acf").alias("acf"))


@query("""WITH c AS (SELECT l_suppkey % 20 AS name, avg(l_discount) AS fidelity, avg(l_tax) AS gap, CASE WHEN l_suppkey % 20 % 7 = 0 THEN 'failed' END AS error FROM lineitem GROUP BY 1, 4) SELECT name, row_number() OVER (ORDER BY error IS NOT NULL, round(fidelity, 9) DESC, round(gap, 9), name) AS place FROM c""")
def y14_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy((F.col("l_suppkey") % 20).alias("name")).agg(F.round(F.avg("l_discount"), 9).alias("fidelity"), F.round(F.avg("l_tax"), 9).alias("gap")).withColumn("error", F.when(F.col("name") % 7 == 0, "failed"))
    return trials.ranked_generators(g).select("name", F.col("place").cast("long").alias("place"))


@query("""SELECT o_orderpriority AS dataset, o_orderstatus AS system, count(*) AS n FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) GROUP BY 1, 2""")
def s13_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that has no result yet."""
    o = table(spark, sf_dir, "orders")
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(done, "o_orderkey", "left_anti").groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("system")).agg(F.count("*").alias("n"))


@query(f"""WITH {_MATCHES} SELECT query_id, count(*) AS matches, min(rank) AS first_rank, max(rank) AS last_rank FROM m GROUP BY 1""")
def s14_serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each query as one JSON text, read back."""
    m = matches(spark, sf_dir)[1].select("query_id", "rank", "series_id", "start", "score")
    text = m.groupBy("query_id").agg(F.to_json(F.struct("query_id", F.sort_array(F.collect_list(F.struct("rank", "series_id", "start", "score"))).alias("matches"))).alias("j"))
    back = text.select(F.from_json("j", "query_id string, matches array<struct<rank:long,series_id:string,start:long,score:double>>").alias("r"))
    return back.select("r.query_id", F.size("r.matches").cast("long").alias("matches"), F.array_min("r.matches.rank").alias("first_rank"), F.array_max("r.matches.rank").alias("last_rank"))



def ensemble_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_series(spark, sf_dir)
    return trials.ensemble_walk_forward(s, stored(drawn(s)), WIDTH, BARS, TOP, {"pearson": 1.0}, draws=200)


@query()
def k6_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain cone, ensemble and conformal interval over K2's trials; held against arithmetic in the tests."""
    out = trials.ensemble_report(ensemble_ends(spark, sf_dir).withColumn("series_id", F.substring_index("query_id", "@", 1)), ["series_id"])
    return out.select("series_id", "n", *[F.round(c, 6).alias(c) for c in ("basic_hit_rate", "hit_rate", "coverage")])


@query(f"""WITH {_TRIAL}, l AS (SELECT query_id, any_value(actual) AS actual, max(value) FILTER (pct = 10) AS p10, max(value) FILTER (pct = 50) AS p50, max(value) FILTER (pct = 90) AS p90 FROM tb WHERE bar = {BARS - 1} GROUP BY 1),
  g AS (SELECT split_part(query_id, '@', 1) AS series_id, count(*) AS n, avg(abs(p50 - actual)) AS mae, avg(p50) AS mean, stddev_pop(p50) AS sd, avg(((p50 > 0) = (actual > 0))::INT) AS regime_share FROM l GROUP BY 1),
  t AS (SELECT series_id, 0.35 * n / (n + 5) + 0.25 * greatest(0.0, least(1.0, 1 - mae / 0.3)) + 0.15 * CASE WHEN mean = 0 THEN 0.0 ELSE 1 / (1 + sd / abs(mean)) END + 0.25 * regime_share AS trust FROM g),
  d AS (SELECT l.*, trust, sign(round(p50, 9))::INT AS s, 100 * greatest(0.0, 1 - (p90 - p10)) AS confidence FROM l JOIN t ON t.series_id = split_part(query_id, '@', 1)), mt AS (SELECT *, CASE WHEN s > 0 THEN round(p10, 9) >= -0.5 WHEN s < 0 THEN -round(p90, 9) >= -0.5 ELSE true END AS met FROM d)
  SELECT query_id, CASE WHEN met AND trust >= 0.4 THEN s ELSE 0 END AS side, met, round(CASE WHEN met AND trust >= 0.4 AND s <> 0 THEN trust * confidence / 100 ELSE 0.0 END, 6) AS size FROM mt""")
def k20_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of K2's trials whose adverse tail stays above minus a half, sized by the trust in their series (K19) and the cone's width."""
    ends = trials.terminal(trial_bars(spark, sf_dir), BARS).withColumn("series_id", F.substring_index("query_id", "@", 1))
    miss, hit = F.abs(F.col("p50") - F.col("actual")), ((F.col("p50") > 0) == (F.col("actual") > 0)).cast("double")
    g = ends.groupBy("series_id").agg(F.count("*").alias("n"), F.avg(miss).alias("mae"), F.avg("p50").alias("mean"), F.stddev_pop("p50").alias("sd"), F.avg(hit).alias("regime_share"))
    t = trials.trust(g).select("series_id", "trust", (F.col("trust") >= 0.4).alias("trusted"))
    d = ends.join(t, "series_id").withColumns({"side": F.signum(F.round("p50", 9)).cast("int"), "tail_low": F.round("p10", 9), "tail_high": F.round("p90", 9), "confidence": 100 * F.greatest(F.lit(0.0), 1 - (F.col("p90") - F.col("p10")))})
    return evaluation.entered(d, -0.5).select("query_id", "side", "met", F.round("size", 6).alias("size"))


@query()
def p8_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, sampled and regime cones of each series' last window (P2, P4, P5, P8), regimes of the windows themselves; held against its parts in the tests."""
    from pastcast.operators import projection, sampling

    s, m = matches(spark, sf_dir)
    m = m.select("query_id", "rank", F.col("score").alias("weight"), "series_id", "start")
    m = trials.with_regime(m.join(windows.windows(s, WIDTH), ["series_id", "start"])).withColumn("end", F.col("start") + WIDTH).drop("start")
    asked = trials.with_regime(search.last_windows(s, WIDTH).select("query_id", "values")).withColumnRenamed("regime", "query_regime")
    p = stored(projection.forward_paths(m.join(asked, "query_id"), s, BARS))
    return sampling.ensemble(p, ["query_id"], draws=200).select("query_id", "bar", "pct", rounded("value").alias("value"))
