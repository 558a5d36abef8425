"""Queries of the full search, sampled forecasts, calibration, narratives, vectors, privacy and utility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastcast.functions.common import rounded
from pastcast.operators import dynamics, matching, narrative, privacy, projection, relations, sampling, search
from pastcast.operators import trials as walk
from pastcast.plans.data import event_series
from pastcast.plans.evaluation import vectors
from pastcast.plans.registry import registry
from pastcast.plans.search import _PATHS, BARS, TOP, WIDTH, _cone, paths
from pastcast.plans.trials import _TRIAL, DRAWN, trial_bars, trial_sql
from pastcast.session import stored, table

QUERIES, ORACLES, query = registry()
_DRAWS = 200
_LONG = 60  # a width that the Koopman score needs


def _u(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)"


def _n(*parts: str) -> str:
    a, b = _u(*parts, "'a'"), _u(*parts, "'b'")
    return f"(sqrt(-2 * ln({a})) * cos(2 * pi() * {b}))"


def full_matches(spark: SparkSession, sf_dir: str, k: int = TOP) -> tuple[DataFrame, DataFrame]:
    s = event_series(spark, sf_dir)
    return s, matching.matches(s, search.last_windows(s, _LONG), _LONG, k, ahead=BARS)


@query()
def m10_full_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of five scales against each series' last sixty values (M6, M10, M12-M14); held against brute force in the tests."""
    out = full_matches(spark, sf_dir)[1]
    return out.select("query_id", "rank", "series_id", "start", "end", "scale", *[F.round(c, 6).alias(c) for c in ("confidence", "dtw", "pearson_warped", "koopman", "wavelet_spectrum", "transfer_entropy")], "start_ts", "end_ts")


@query()
def p12_koopman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Koopman evolution of each series' last sixty values, and the cone's median drawn to it by three tenths."""
    s = event_series(spark, sf_dir)
    q = dynamics.with_evolution(search.last_windows(s, _LONG), "values", BARS)
    moves = q.select("query_id", F.posexplode("moves").alias("bar", "move"))
    out = sampling.blended_median(projection.cone(paths(spark, sf_dir), ["query_id"]), moves, ["query_id"], 0.3)
    return out.select("query_id", "bar", "pct", rounded("value").alias("value"))


_SHARES = f"""{_PATHS}, sh AS (SELECT query_id, rank, bar, ret, weight / sum(weight) OVER b AS p FROM paths WINDOW b AS (PARTITION BY query_id, bar)), sm AS (SELECT *, sum(p * ret) OVER (PARTITION BY query_id, bar) AS m FROM sh),
  sd AS (SELECT *, sum(p) OVER (PARTITION BY query_id, bar ORDER BY rank ROWS UNBOUNDED PRECEDING) AS up, sqrt(sum(p * (ret - m) ** 2) OVER (PARTITION BY query_id, bar)) AS sd FROM sm),
  tops AS (SELECT query_id, bar, max(up) AS top FROM sd GROUP BY 1, 2), dr AS (SELECT q.query_id, k.sim, {_u("q.query_id", "k.sim", "42")} AS u FROM (SELECT DISTINCT query_id FROM paths) q JOIN range(0, {_DRAWS}) k(sim) ON true),
  pk AS (SELECT dr.query_id, dr.sim, sd.bar, sd.ret, sd.sd FROM dr JOIN sd USING (query_id) JOIN tops t ON t.query_id = sd.query_id AND t.bar = sd.bar WHERE u > up - p AND (u <= up OR up >= top))"""
_LEVELS = "[0.1, 0.25, 0.5, 0.75, 0.9]"
_CURVES = f"c AS (SELECT query_id, bar, quantile_cont(x, {_LEVELS}) AS v, avg(x) AS mean, stddev_pop(x) AS std FROM x GROUP BY 1, 2), l AS (SELECT query_id, bar, unnest([10, 25, 50, 75, 90]) AS pct, unnest(v) AS value, mean, std FROM c)"


@query(f"""WITH {_SHARES}, x AS (SELECT query_id, bar, ret + greatest(sd, 1e-8) * sqrt((bar + 1) / {BARS}.0) * {_n("query_id", "sim", "bar", "42")} AS x FROM pk), {_CURVES}
  SELECT query_id, bar, pct, round(value, 6) + 0.0 AS value, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std FROM l""")
def p4_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.monte_carlo(paths(spark, sf_dir), ["query_id"], draws=_DRAWS)
    return out.select("query_id", F.col("bar").cast("long").alias("bar"), "pct", rounded("value").alias("value"), rounded("mean").alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {_SHARES}, x AS (SELECT query_id, bar, ret + 0.25 * greatest(sd, 1e-6) * sqrt((bar + 1) / {BARS}.0) * {_n("query_id", "sim", "42")} AS x FROM pk), {_CURVES}
  SELECT query_id, bar, pct, round(max(value) OVER (PARTITION BY query_id, bar ORDER BY pct), 6) + 0.0 AS value FROM l""")
def p10_joint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.joint_paths(paths(spark, sf_dir), ["query_id"], draws=_DRAWS)
    return out.select("query_id", F.col("bar").cast("long").alias("bar"), "pct", rounded("value").alias("value"))


@query()
def p9_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive conformal edges, aware of change; held against a sequential fold in the tests."""
    out = sampling.adaptive_edges(paths(spark, sf_dir), ["query_id"], aware=True)
    return out.select("query_id", "bar", "pct", rounded("value").alias("value"), F.round("alpha", 9).alias("alpha"), F.round("scale", 6).alias("scale"))


@query(f"""WITH {_TRIAL}, g AS (SELECT query_id, bar, avg(((actual <= value)::INT - pct / 100.0) ** 2) AS g FROM tb GROUP BY 1, 2), t AS (SELECT query_id, avg(g) AS g FROM g GROUP BY 1) SELECT count(*) AS n, round(avg(g), 4) AS crps FROM t""")
def k5_joint_crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.joint_crps(trial_bars(spark, sf_dir)).select("n", F.round("crps", 4).alias("crps"))


@query(f"""WITH {_PATHS}, {_cone()}, ke AS (SELECT query_id, ret FROM paths WHERE bar = {BARS - 1}), kt AS (SELECT query_id, pct, value FROM cone WHERE bar = {BARS - 1}), kw AS (SELECT query_id, max(value) FILTER (pct = 10) AS lo, max(value) FILTER (pct = 50) AS mid, max(value) FILTER (pct = 90) AS hi FROM kt GROUP BY 1),
  km AS (SELECT query_id, count(*) AS n, avg((ret BETWEEN lo AND hi)::INT) AS coverage, avg((mid <> 0 AND sign(mid) = sign(ret))::INT) AS hit_rate, stddev_pop(ret) AS dispersion FROM ke JOIN kw USING (query_id) GROUP BY 1), kc AS (SELECT query_id, avg(((ret <= value)::INT - pct / 100.0) ** 2) AS crps FROM ke JOIN kt USING (query_id) GROUP BY 1)
  SELECT query_id, n, round(coverage, 6) AS coverage, round(crps, 6) AS crps, round(hit_rate, 6) AS hit_rate, round(dispersion, 6) AS dispersion, CASE WHEN dispersion < 0.03 THEN 'low' WHEN dispersion < 0.07 THEN 'elevated' ELSE 'high' END AS drift,
  CASE WHEN abs(coverage - 0.8) <= 0.05 AND crps <= 0.05 AND hit_rate >= 0.58 THEN 'A' WHEN abs(coverage - 0.8) <= 0.10 AND crps <= 0.08 AND hit_rate >= 0.54 THEN 'B' WHEN abs(coverage - 0.8) <= 0.15 AND crps <= 0.12 AND hit_rate >= 0.52 THEN 'C' WHEN abs(coverage - 0.8) <= 0.20 OR crps <= 0.20 THEN 'D' ELSE 'F' END AS grade FROM km JOIN kc USING (query_id)""")
def k15_calibration_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a forecast's own matches fall into its cone at the last bar."""
    p = paths(spark, sf_dir)
    last = F.col("bar") == BARS - 1
    out = sampling.calibration_block(p.filter(last).select("query_id", "ret"), projection.cone(p, ["query_id"]).filter(last), ["query_id"])
    return out.select("query_id", "n", *[F.round(c, 6).alias(c) for c in ("coverage", "crps", "hit_rate", "dispersion")], "drift", "grade")


@query()
def c1_target_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every other series did after the matches of each series in its own history; held against numpy in the tests."""
    s = event_series(spark, sf_dir)
    m = search.analogues(s, search.last_windows(s, WIDTH), WIDTH, TOP, {"pearson": 1.0}, ahead=BARS, own=True)
    names = s.select("series_id").distinct()
    ends = m.select(F.col("series_id").alias("source"), (F.col("start") + WIDTH).alias("end"))
    pairs = ends.join(names.withColumnRenamed("series_id", "target"), F.col("source") != F.col("target"))  # a few matches a series by all series
    out = sampling.target_response(pairs, s, BARS)
    return out.select("source", "target", "n", rounded("correlation").alias("correlation"), F.round("te", 6).alias("te"), "lag")


_FAMILY = " ".join(f"WHEN regexp_matches(lower(s), '{'|'.join([chr(92) + 'b(' + '|'.join(w for w in words if ' ' not in w) + ')' + chr(92) + 'b', *[w for w in words if ' ' in w]])}') THEN '{name}'" for name, words in narrative.FAMILIES)


def _first_strong(words: dict[str, float]) -> str:
    order = sorted(words.items(), key=lambda x: -abs(round(x[1] - 0.5, 9)))
    return "CASE " + " ".join(f"WHEN contains(lower(s), '{w}') THEN {v}" for w, v in order if v != 0.5) + " ELSE 0.5 END"


_TAGGED = f"""p AS (SELECT doc_id AS id, generate_subscripts(a, 1) - 1 AS place, unnest(a) AS s FROM (SELECT doc_id, regexp_split_to_array(replace(replace(text, ';', '.'), chr(10), '.'), '[.]') AS a FROM documents WHERE text IS NOT NULL)),
  f AS (SELECT *, CASE {_FAMILY} END AS family FROM p), t AS (SELECT id, place, family, {_first_strong(narrative.INTENSITY)} AS intensity, greatest(1, coalesce(try_cast(nullif(regexp_extract(s, '{narrative.DURATION}', 1), '') AS INT), 1)) AS duration, lag(family) OVER (PARTITION BY id ORDER BY place) AS previous, {_first_strong(narrative.SHARPNESS)} AS sharp FROM f WHERE family IS NOT NULL)"""


@query(f"""WITH {_TAGGED} SELECT id, place::INT AS place, family, intensity::DOUBLE AS intensity, duration, previous, CASE WHEN previous IS NOT NULL THEN sharp END::DOUBLE AS sharpness FROM t""")
def e7_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents that name a move; invented prose names few, so the tests plant some."""
    return narrative.tagged(table(spark, sf_dir, "documents"))


_ET = ["view", "click", "purchase", "signup", "error"]


@query(f"""WITH e AS (SELECT user_id AS id, event_id AS place, event_type AS type, least(value, 100) / 100 AS intensity, 1 + event_id % 30 AS duration, CASE WHEN value > 20 THEN 1 ELSE -1 END AS way, coalesce((lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type)::INT, 0) AS step FROM events),
  g AS (SELECT id, count(*) AS n, {", ".join(f"count(*) FILTER (type = '{t}') AS t{k}" for k, t in enumerate(_ET))}, avg(intensity) AS i, avg(duration) AS d, sum(duration) AS w, sum(step) AS s, sum(way) AS v FROM e GROUP BY 1), k AS (SELECT *, {" + ".join(f"t{k}" for k in range(5))} AS known FROM g)
  SELECT id, round(list_sum(list_transform([{", ".join(f"CASE WHEN known > 0 THEN t{k} / known ELSE 0.0 END" for k in range(5))}, i, least(d / 200, 1.0), s / n, sign(v), least(w / 1000, 1.0)], lambda x, j: x * j)), 6) AS weighted FROM k""")
def e8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of users' events as narratives."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("place"), F.col("event_type").alias("type"), (F.least("value", F.lit(100.0)) / 100).alias("intensity"), (1 + F.col("event_id") % 30).alias("duration"), F.when(F.col("value") > 20, "up").otherwise("down").alias("direction"))
    v = narrative.narrative_vector(e, _ET)
    return v.select("id", F.round(F.aggregate(F.transform("vector", lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("weighted"))


_V = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS vec FROM embeddings), d AS (SELECT a.id, b.id AS other, a.label, b.label AS olabel, {d} AS distance FROM v a JOIN v b ON a.id <> b.id)"
_EUC = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.vec[i] - b.vec[i]) ** 2)))"


@query(f"""WITH {_V.format(d=_EUC)}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), other) AS rank FROM d) SELECT least(id, other) AS u, greatest(id, other) AS v, round(min(distance), 6) AS distance FROM n WHERE rank <= 5 GROUP BY 1, 2""")
def v3_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.neighbour_graph(vectors(spark, sf_dir).select("id", "vec"), 5).select("u", "v", F.round("distance", 6).alias("distance"))


@query()
def v7_across_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of each other label, by cosine; held against numpy in the tests."""
    out = privacy.across_kinds(vectors(spark, sf_dir).filter("label is not null").select("id", (F.col("label") % 3).alias("kind"), "vec"), 2)
    return out.select("kind", "other_kind", "id", "other", F.round("distance", 6).alias("distance"), "rank")


@query()
def v8_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two principal components of all vectors; held against numpy in the tests."""
    return privacy.components_2d(vectors(spark, sf_dir).select("id", "vec")).select("id", F.transform("point", lambda x: F.round(x, 6)).alias("point"))


@query("""SELECT o_orderkey AS id, list_transform([o_custkey % 13 / 10.0, o_orderkey % 7 / 9.0, NULL, o_custkey % 9 / 9.0, o_orderkey % 6], lambda x, i: round(CASE WHEN x IS NULL THEN 0.5 WHEN i = 5 THEN greatest(0.0, least(4.0, x)) / 4 ELSE greatest(0.0, least(1.0, x)) END, 9)) AS state FROM orders""")
def v9_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    parts = {"hit_rate": c % 13 / 10.0, "crps": k % 7 / 9.0, "trust_score": c % 9 / 9.0, "calibration_grade_numeric": (k % 6).cast("double")}
    summary = F.create_map(*[x for n, v in parts.items() for x in (F.lit(n), v.cast("double"))])
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.transform(privacy.state_vector(F.lit("finance"), summary), lambda x: F.round(x, 9)).alias("state"))


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as real records and customers as synthetic ones, by two numbers each."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array((F.col("s_acctbal") / 1000).cast("double"), F.col("s_nationkey").cast("double")).alias("vec"), (F.col("s_suppkey") - 1).alias("pos"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array((F.col("c_acctbal") / 1000).cast("double"), F.col("c_nationkey").cast("double")).alias("vec"))
    return s, c


@query()
def y9_y12_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest records, copies, membership, holdout, tails and the score (Y9, Y10, Y12); held against numpy in the tests."""
    return privacy.privacy_score(privacy.record_privacy(*_records(spark, sf_dir)))


@query()
def y8_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall fidelity of two halves of the line items, from Y4, Y5, Y6 and Y7."""
    from pastcast.plans.evaluation import _COLS, _halves

    a, b = _halves(spark, sf_dir)
    ks = relations.marginal_fidelity(a, b, _COLS).agg(F.avg("ks").alias("mean_ks"))
    s = stored(event_series(spark, sf_dir))
    half = lambda k: relations.autocorrelation(s.filter(F.col("pos") % 2 == k).withColumn("pos", F.floor(F.col("pos") / 2)), [1, 5, 10])
    acf = half(0).join(half(1).withColumnRenamed("acf", "other"), ["series_id", "lag"]).agg(F.avg(F.abs(F.col("acf") - F.col("other"))).alias("acf"))
    gap = relations.correlation_gap(a, b, _COLS)
    tail = relations.tail_fidelity(a, b, "l_extendedprice").select(((F.abs(F.col("p01") - 1) + F.abs(F.col("p99") - 1)) / 2).alias("tail"))
    return privacy.fidelity_score(ks.crossJoin(acf).crossJoin(gap).crossJoin(tail))  # one row each


@query()
def y11_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well trees trained on one half of the line items tell the other half's columns."""
    from pastcast.plans.evaluation import _COLS, _halves

    return privacy.inferred_columns(*_halves(spark, sf_dir), _COLS)


@query()
def y13_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge forecasts trained on series and on their block copies; held against numpy in the tests."""
    from pastcast.operators import copies

    s = event_series(spark, sf_dir).select("series_id", "pos", "value")
    return privacy.utility(s, stored(copies.block_bootstrap(s, 25)))


_GRID = [(w, seed) for w in (20, WIDTH) for seed in (1, 2)]


@query(f"""WITH {trial_sql(_GRID, tagged=True)}, l AS (SELECT query_id, any_value(actual) AS actual, max(value) FILTER (pct = 10) AS p10, max(value) FILTER (pct = 50) AS p50, max(value) FILTER (pct = 90) AS p90 FROM tb WHERE bar = {BARS - 1} GROUP BY 1),
  g AS (SELECT split_part(query_id, '@', 1) AS series_id, split_part(query_id, '@', 3)::INT AS width, split_part(query_id, '@', 4)::INT AS seed, count(*) AS n, avg(((p50 > 0) = (actual > 0))::INT) AS hit_rate, avg((((actual <= p10)::INT - 0.1) ** 2 + ((actual <= p50)::INT - 0.5) ** 2 + ((actual <= p90)::INT - 0.9) ** 2) / 3) AS crps FROM l GROUP BY 1, 2, 3)
  SELECT series_id, width, seed, n, round(hit_rate, 6) AS hit_rate, round(crps, 6) AS crps, round(round(hit_rate * (1 - least(crps, 1.0)), 9), 4) AS trust FROM g""")
def k7_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep over widths and seeds of every series."""
    out = walk.swept(event_series(spark, sf_dir), (20, WIDTH), BARS, TOP, DRAWN, {"pearson": 1.0}, (1, 2))
    return out.select("series_id", "width", "seed", "n", F.round("hit_rate", 6).alias("hit_rate"), F.round("crps", 6).alias("crps"), "trust")


@query("""WITH p AS (SELECT o_custkey AS name, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders GROUP BY 1) SELECT name, run_id, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = run_id AND l_quantity > 45) AS dangling FROM p""")
def y15_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order as the run promoted; runs are the orders with a large line."""
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("at"))
    return walk.promoted(p, table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("run_id")))
