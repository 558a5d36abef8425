"""Queries of the analogue search and of what follows its matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastcast.functions.common import rounded
from pastcast.operators import light, projection, regimes, relations, search, windows
from pastcast.plans.data import SERIES, event_series
from pastcast.plans.registry import registry

QUERIES, ORACLES, query = registry()
WIDTH, BARS, TOP = 30, 10, 5
TIER = {"sax": 0.4, "profile": 0.4, "pearson": 0.2}

_CUTS = "[" + ", ".join(map(repr, search.breakpoints(8))) + "]"
_PAA = "[" + ", ".join(f"list_avg(z[{a + 1}:{b}])" for a, b in search.segments(WIDTH, 16)) + "]"
_Z = "list_transform(v, lambda y: CASE WHEN list_stddev_pop(v) > 1e-10 THEN (y - list_avg(v)) / list_stddev_pop(v) ELSE 0.0 END)"
_GAP = f"list_sum(list_transform(range(1, 17), lambda i: CASE WHEN abs(c.word[i] - q.word[i]) <= 1 THEN 0.0 ELSE ({_CUTS}[greatest(c.word[i], q.word[i])] - {_CUTS}[least(c.word[i], q.word[i]) + 1]) ** 2 END))"
_WINS = f"""{SERIES}, ends AS (SELECT series_id, max(pos) + 1 AS n FROM series GROUP BY 1),
  w0 AS (SELECT series_id, pos AS start, list(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING) AS v FROM series),
  w1 AS (SELECT series_id, start, v, {_Z} AS z FROM w0 WHERE len(v) = {WIDTH}), w AS (SELECT *, list_transform({_PAA}, lambda p: len(list_filter({_CUTS}, lambda c: c < p))) AS word FROM w1),
  q AS (SELECT w.*, ends.n FROM w JOIN ends USING (series_id) WHERE start = n - {WIDTH})"""


def _pairs(ahead: int) -> str:
    return f"""{_WINS}, s AS (SELECT q.series_id AS query_id, c.series_id, c.start, list_inner_product(c.z, q.z) / {WIDTH} AS corr, exp(-sqrt({WIDTH} / 16.0) * sqrt({_GAP}) / {WIDTH}) AS sax FROM w c JOIN q ON true JOIN ends e ON e.series_id = c.series_id
  WHERE c.start + {WIDTH + ahead} <= e.n AND NOT (c.series_id = q.series_id AND c.start < q.start + {WIDTH} AND c.start + {WIDTH} > q.start)),
  t AS (SELECT *, exp(-sqrt(greatest(0, 2 * (1 - corr)))) AS profile, (corr + 1) / 2 AS pearson FROM s)"""


def _topk(score: str, ahead: int = BARS, k: int = TOP) -> str:
    return f"""{_pairs(ahead)}, m AS (SELECT query_id, series_id, start, score, corr, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, series_id, start) AS rank FROM (SELECT *, {score} AS score FROM t)) WHERE rank <= {k})"""


_MATCHES = _topk("0.4 * sax + 0.4 * profile + 0.2 * pearson")


def matches(spark: SparkSession, sf_dir: str, methods: dict[str, float] = TIER, k: int = TOP) -> tuple[DataFrame, DataFrame]:
    s = event_series(spark, sf_dir)
    return s, search.analogues(s, search.last_windows(s, WIDTH), WIDTH, k, methods, ahead=BARS)


@query(f"""WITH {_MATCHES} SELECT query_id, rank, series_id, start, round(score, 6) AS score, round(corr, 6) + 0.0 AS correlation FROM m""")
def m10_analogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search itself: windows, SAX, profile and Pearson scores, self-exclusion and two-stage top k (M3, M4, M6, M11); of M10 without scales, DTW, rerank and confidence."""
    return matches(spark, sf_dir)[1].select("query_id", "rank", "series_id", "start", F.round("score", 6).alias("score"), rounded("correlation").alias("correlation"))


@query(f"""WITH {_WINS} SELECT series_id, start, array_to_string(word, '') AS word FROM w""")
def m1_sax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, 1)


def _words(spark: SparkSession, sf_dir: str, stride: int) -> DataFrame:
    w = windows.normalised(windows.windows(event_series(spark, sf_dir), WIDTH, stride), "zscore")
    return w.select("series_id", "start", F.array_join(search.sax(F.col("normal"), WIDTH).cast("array<string>"), "").alias("word"))


@query(f"""WITH {_WINS} SELECT c.series_id, c.start, q.series_id AS query_id, round(sqrt({WIDTH} / 16.0) * sqrt({_GAP}), 6) AS mindist, round(exp(-sqrt({WIDTH} / 16.0) * sqrt({_GAP}) / {WIDTH}), 6) AS score FROM w c JOIN q ON true""")
def m2_mindist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mindists(spark, sf_dir, 1)


def _mindists(spark: SparkSession, sf_dir: str, stride: int) -> DataFrame:
    s = event_series(spark, sf_dir)
    w = windows.normalised(windows.windows(s, WIDTH, stride), "zscore").select("series_id", "start", search.sax(F.col("normal"), WIDTH).alias("a"))
    q = windows.normalised(search.last_windows(s, WIDTH), "zscore").select("query_id", search.sax(F.col("normal"), WIDTH).alias("b"))
    d = relations.met(w, q, ["series_id", "start"])[0].withColumn("d", search.mindist(F.col("a"), F.col("b"), WIDTH))  # a stated query set of one row per series, broadcast after a count
    return d.select("series_id", "start", "query_id", F.round("d", 6).alias("mindist"), F.round(F.exp(-F.col("d") / WIDTH), 6).alias("score"))


@query(f"""WITH {_topk("profile", 0, 3)} SELECT query_id, rank, series_id, start, round(sqrt(greatest(0, 2 * {WIDTH} * (1 - corr))), 6) AS distance, round(score, 6) AS score FROM m""")
def m3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_series(spark, sf_dir)
    m = search.analogues(s, search.last_windows(s, WIDTH), WIDTH, 3, {"profile": 1.0})
    return m.select("query_id", "rank", "series_id", "start", F.round(F.sqrt(F.greatest(F.lit(0.0), 2 * WIDTH * (1 - F.col("correlation")))), 6).alias("distance"), F.round("score", 6).alias("score"))


@query(f"""WITH {_WINS}, p AS (SELECT c.series_id, c.start, q.series_id AS query_id, list_inner_product(c.z, q.z) / {WIDTH} AS corr FROM w c JOIN q USING (series_id)) SELECT series_id, start, round((corr + 1) / 2, 6) AS score FROM p""")
def m4_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlations(spark, sf_dir, 1)


def _correlations(spark: SparkSession, sf_dir: str, stride: int) -> DataFrame:
    s = event_series(spark, sf_dir)
    w = windows.windows(s, WIDTH, stride).join(search.last_windows(s, WIDTH).select("series_id", F.col("values").alias("q")), "series_id")
    c = search.correlation(F.col("values"), F.col("q"))
    return w.select("series_id", "start", F.round(F.when(c.isNull(), 0.0).otherwise((c + 1) / 2), 6).alias("score"))


_FAKE = "(event_id * {a} % 1000) / 999.0"
_SC = ", ".join(f"{_FAKE.format(a=a)} AS {k}" for k, a in {"koopman": 7, "wavelet_spectrum": 13, "dtw": 17, "pearson_warped": 29, "transfer_entropy": 31}.items())


@query(f"""WITH {SERIES}, s AS (SELECT event_id, {_SC} FROM series), r AS (SELECT *, (0.2 * koopman + 0.15 * wavelet_spectrum + 0.07 * dtw + 0.05 * pearson_warped + 0.05 * transfer_entropy) / 0.52 AS raw FROM s),
  a AS (SELECT *, CASE WHEN dtw >= 0.94 AND pearson_warped <= 0.62 AND transfer_entropy <= 0.24 THEN raw * (1 - CASE WHEN wavelet_spectrum <= 0.08 THEN 0.16 ELSE 0.12 END) ELSE raw END AS x FROM r),
  b AS (SELECT *, CASE WHEN koopman >= 0.86 AND transfer_entropy >= 0.30 THEN x * (1 + CASE WHEN pearson_warped >= 0.63 THEN 0.08 ELSE 0.06 END) ELSE x END AS y FROM a)
  SELECT event_id, round(greatest(0.0, least(1.0, y)) * 100, 5) AS confidence, round(greatest(0.0, least(1.0, y)) * 100 * (1 - 0.25 + 0.25 * dtw), 5) AS discounted, CASE WHEN abs(koopman - 0.5) >= 0.02 AND abs(dtw - 0.5) >= 0.02 AND sign(koopman - 0.5) <> sign(dtw - 0.5) THEN 0.92 ELSE 1.0 END AS keep FROM b""")
def m7_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite confidence, its rules, the soft-regime discount and the direction rule (M7, M8, M9)."""
    score = lambda a: (F.col("event_id") * a % 1000) / 999.0
    s = {k: score(a) for k, a in {"koopman": 7, "wavelet_spectrum": 13, "dtw": 17, "pearson_warped": 29, "transfer_entropy": 31}.items()}
    out = event_series(spark, sf_dir).withColumn("c", search.confidence(s))
    return out.select("event_id", F.round("c", 5).alias("confidence"), F.round(regimes.discount(F.col("c"), s["dtw"]), 5).alias("discounted"), search.direction_keep(s["koopman"] - 0.5, s["dtw"] - 0.5).alias("keep"))


_TE = """n AS (SELECT g, i, source, target, min(source) OVER w AS s0, max(source) OVER w AS s1, min(target) OVER w AS t0, max(target) OVER w AS t1 FROM pairs WINDOW w AS (PARTITION BY g)),
  b AS (SELECT g, i, least(floor((source - s0) / (s1 - s0) * 8), 7) AS xp, least(floor((target - t0) / (t1 - t0) * 8), 7) AS yp FROM n), c AS (SELECT b.g, f.yp AS yf, b.yp, b.xp, count(*) AS c FROM b JOIN b f ON f.g = b.g AND f.i = b.i + 1 GROUP BY 1, 2, 3, 4),
  d AS (SELECT g, yf, yp, xp, c, sum(c) OVER (PARTITION BY g) AS n FROM c),
  h AS (SELECT g, (SELECT 1) AS one FROM d GROUP BY g),
  h1 AS (SELECT g, sum(-c / n * log2(c / n)) AS h FROM (SELECT g, yf, n, sum(c) AS c FROM d GROUP BY 1, 2, 3) GROUP BY 1), h2 AS (SELECT g, sum(-c / n * log2(c / n)) AS h FROM (SELECT g, yf, yp, n, sum(c) AS c FROM d GROUP BY 1, 2, 3, 4) GROUP BY 1),
  h3 AS (SELECT g, sum(-c / n * log2(c / n)) AS h FROM (SELECT g, yp, n, sum(c) AS c FROM d GROUP BY 1, 2, 3) GROUP BY 1), h4 AS (SELECT g, sum(-c / n * log2(c / n)) AS h FROM (SELECT g, yp, xp, n, sum(c) AS c FROM d GROUP BY 1, 2, 3, 4) GROUP BY 1), h5 AS (SELECT g, sum(-c / n * log2(c / n)) AS h FROM d GROUP BY 1),
  te AS (SELECT h1.g, CASE WHEN h1.h < 1e-12 THEN 0.0 ELSE least(1.0, greatest(0.0, h2.h + h4.h - h3.h - h5.h) / h1.h) END AS te FROM h1 JOIN h2 USING (g) JOIN h3 USING (g) JOIN h4 USING (g) JOIN h5 USING (g))"""


@query(f"""WITH {SERIES}, pairs AS (SELECT a.series_id || '/' || (a.pos // 120) AS g, a.pos % 120 AS i, a.value AS source, b.value AS target FROM series a JOIN series b ON a.series_id = b.series_id AND b.pos = a.pos + 120), {_TE} SELECT g, round(te, 6) AS te FROM te""")
def m14_transfer_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each stretch of 120 bars tells of the next 120."""
    s = event_series(spark, sf_dir)
    ahead = s.select("series_id", (F.col("pos") - 120).alias("pos"), F.col("value").alias("target"))
    pairs = s.join(ahead, ["series_id", "pos"]).select(F.concat_ws("/", "series_id", F.floor(F.col("pos") / 120).cast("string")).alias("g"), (F.col("pos") % 120).alias("i"), F.col("value").alias("source"), "target")
    return search.transfer_entropy(pairs, ["g"]).select("g", F.round("te", 6).alias("te"))


@query(f"""WITH {_pairs(BARS)}, g AS (SELECT query_id, series_id AS instrument, start, 0.4 * sax + 0.4 * profile + 0.2 * pearson AS score FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, instrument ORDER BY round(score, 12) DESC, start) AS k FROM g),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, instrument, start) AS overall FROM r WHERE k <= 3) SELECT query_id, instrument, k AS rank, overall, start, round(score, 6) AS score FROM o""")
def m16_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every instrument's best three windows per setup, and their place among all."""
    s = event_series(spark, sf_dir)
    c = search.candidates(s, search.last_windows(s, WIDTH), WIDTH, 3, TIER, ahead=BARS)
    best = search.top(c, 3, "query_id", "series_id").withColumnRenamed("rank", "k")
    out = search.top(best, 10**9)
    return out.select("query_id", F.col("series_id").alias("instrument"), F.col("k").alias("rank"), F.col("rank").alias("overall"), "start", F.round("score", 6).alias("score"))


_LIGHT = """100 * (0.65 * greatest(0.0, (coalesce(list_inner_product(qz, cz) / 29, 0) + 1) / 2) + 0.2 * exp(-list_avg(list_transform(range(1, 30), lambda i: abs(qz[i] - cz[i])))) + 0.15 * exp(-2 * abs(ln(qv[30] / qv[1]) - ln(cv[30] / cv[1]))))"""
_RZ = "list_transform(range(1, 30), lambda i: ({r}[i] - list_avg({r})) / list_stddev_pop({r}))"
_LR = "list_transform(range(1, 30), lambda i: ln({v}[i + 1]) - ln({v}[i]))"


@query(f"""WITH {_WINS}, a AS (SELECT c.series_id, c.start, c.v AS cv, q.v AS qv, {_LR.format(v="c.v")} AS cr, {_LR.format(v="q.v")} AS qr FROM w c JOIN q USING (series_id) WHERE c.start % 5 = 0 AND c.start + {WIDTH + BARS} <= q.start),
  b AS (SELECT *, {_RZ.format(r="cr")} AS cz, {_RZ.format(r="qr")} AS qz FROM a), s AS (SELECT series_id, start, greatest(0.0, least(100.0, {_LIGHT})) AS score FROM b)
  SELECT series_id, start, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(score, 9) DESC, start) AS k FROM s) WHERE k = 1""")
def m17_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best light analogue of each series' last window inside its own history."""
    s = event_series(spark, sf_dir)
    q = search.last_windows(s, WIDTH).select("series_id", "q_start", F.col("values").alias("q"))
    w = windows.windows(s, WIDTH, 5).join(q, "series_id").filter(F.col("start") + WIDTH + BARS <= F.col("q_start"))
    w = search.with_light_score(w, "q", "values")
    best = w.groupBy("series_id").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("start")).alias("o"))).alias("b"))
    return best.select("series_id", (-F.col("b.o")).alias("start"), F.round("b.s", 5).alias("score"))


@query()
def m17_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17 in full: four scales, separation, first best, projected prices and returns; held against brute force in the tests."""
    found = light.light_analogues(event_series(spark, sf_dir), WIDTH, BARS)
    returns = [rounded(f"{k}_return").alias(f"{k}_return") for k in ("end", "min", "max")]
    return found.select("series_id", "scale", "start", "end", F.round("score", 5).alias("score"), F.transform("prices", lambda x: F.round(x, 6)).alias("prices"), *returns)


@query(f"""WITH {_topk("pearson", 0, 4)} SELECT query_id, rank, series_id, start, round(corr, 6) + 0.0 AS correlation FROM m""")
def m18_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_series(spark, sf_dir)
    m = search.analogues(s, search.last_windows(s, WIDTH), WIDTH, 4, {"pearson": 1.0})
    return m.select("query_id", "rank", "series_id", "start", rounded("correlation").alias("correlation"))


_E = "SELECT query_id, rank, '{k}' AS method, {k} AS score, {k} * {w} AS contribution FROM e"


@query(f"""WITH {_topk("0.4 * sax + 0.4 * profile + 0.2 * pearson").replace("SELECT query_id, series_id, start, score, corr, rank FROM (SELECT *", "SELECT query_id, series_id, start, score, corr, rank, sax, profile, pearson FROM (SELECT *")}, e AS (SELECT * FROM m),
  x AS ({_E.format(k="profile", w=2 / 3)} UNION ALL {_E.format(k="pearson", w=1 / 3)}) SELECT query_id, rank, method, round(score, 6) AS score, round(contribution, 6) AS contribution, CASE WHEN score >= 0.7 THEN 'strong' WHEN score >= 0.4 THEN 'moderate' WHEN score >= 0.15 THEN 'weak' ELSE 'negligible' END AS verdict FROM x""")
def m19_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)[1].withColumns({"pearson": (F.col("correlation") + 1) / 2, "profile": F.exp(-F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - F.col("correlation")))))})
    out = search.explained(m, {"profile": 0.4, "pearson": 0.2})
    return out.select("query_id", "rank", "method", F.round("score", 6).alias("score"), F.round("contribution", 6).alias("contribution"), "verdict")


_SCORED = _topk("0.4 * sax + 0.4 * profile + 0.2 * pearson").replace("SELECT query_id, series_id, start, score, corr, rank FROM (SELECT *", "SELECT query_id, series_id, start, score, corr, rank, sax, profile, pearson FROM (SELECT *")


@query(f"""WITH {_SCORED}, e AS (SELECT * FROM m), x AS ({" UNION ALL ".join(_E.format(k=k, w=w) for k, w in TIER.items())})
  SELECT query_id, rank, method, round(score, 6) AS score, round(contribution, 6) AS contribution, CASE WHEN score >= 0.7 THEN 'strong' WHEN score >= 0.4 THEN 'moderate' WHEN score >= 0.15 THEN 'weak' ELSE 'negligible' END AS verdict FROM x""")
def m19_all_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the three methods adds to every match's score."""
    s, m = matches(spark, sf_dir)
    word = lambda w, name: windows.normalised(w, "zscore").withColumn(name, search.sax(F.col("normal"), WIDTH))
    m = m.join(word(windows.windows(s, WIDTH), "_a").select("series_id", "start", "_a"), ["series_id", "start"]).join(word(search.last_windows(s, WIDTH), "_b").select("query_id", "_b"), "query_id")
    far = F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - F.col("correlation"))))
    m = m.withColumns({"pearson": (F.col("correlation") + 1) / 2, "profile": F.exp(-far), "sax": F.exp(-search.mindist(F.col("_a"), F.col("_b"), WIDTH) / WIDTH)})
    return search.explained(m, TIER).select("query_id", "rank", "method", F.round("score", 6).alias("score"), F.round("contribution", 6).alias("contribution"), "verdict")


@query(f"""WITH {_topk("0.4 * sax + 0.4 * profile + 0.2 * pearson", BARS, 10)}, a AS (SELECT * FROM m), b AS (SELECT query_id, series_id, start, row_number() OVER (PARTITION BY query_id ORDER BY round(pearson, 12) DESC, series_id, start) AS rank FROM t QUALIFY rank <= 10),
  j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.rank AS ra, b.rank AS rb FROM a FULL JOIN b ON a.query_id = b.query_id AND a.series_id = b.series_id AND a.start = b.start)
  SELECT query_id, round(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / count(*), 6) AS jaccard, round(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / count(ra), 6) AS recall, round(avg(coalesce(ra, 11) - coalesce(rb, 11)), 6) + 0.0 AS lift,
  CASE WHEN count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) > 2 THEN round(corr(ra, rb), 6) END AS spearman FROM j GROUP BY 1""")
def m20_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two retrievers' top tens against each other."""
    a, b = matches(spark, sf_dir, k=10)[1], matches(spark, sf_dir, {"pearson": 1.0}, 10)[1]
    out = search.compared(a, b, 10)
    return out.select("query_id", F.round("jaccard", 6).alias("jaccard"), F.round("recall", 6).alias("recall"), rounded("lift").alias("lift"), F.round("spearman", 6).alias("spearman"))


_PATHS = f"""{_MATCHES}, paths AS (SELECT m.query_id, m.rank, m.score AS weight, b.bar, (f.value - a.value) / a.value AS ret FROM m JOIN range(0, {BARS}) b(bar) ON true JOIN series a ON a.series_id = m.series_id AND a.pos = m.start + {WIDTH - 1} JOIN series f ON f.series_id = m.series_id AND f.pos = m.start + {WIDTH} + b.bar)"""


def _cone(weight: str = "weight", source: str = "paths", name: str = "cone", pcts: str = "10, 25, 50, 75, 90") -> str:
    return f"""{name}_w AS (SELECT query_id, rank, bar, ret, {weight} / sum({weight}) OVER (PARTITION BY query_id, bar) AS w FROM {source}), {name}_c AS (SELECT *, sum(w) OVER o - w / 2 AS c FROM {name}_w WINDOW o AS (PARTITION BY query_id, bar ORDER BY ret, rank ROWS UNBOUNDED PRECEDING)),
  {name}_n AS (SELECT *, row_number() OVER o AS k, lead(c) OVER o AS c2, lead(ret) OVER o AS r2 FROM {name}_c WINDOW o AS (PARTITION BY query_id, bar ORDER BY ret, rank)),
  {name} AS (SELECT query_id, bar, p.pct, max(CASE WHEN k = 1 AND pct / 100.0 <= c THEN ret WHEN c2 IS NULL AND pct / 100.0 >= c THEN ret WHEN pct / 100.0 > c AND pct / 100.0 <= c2 THEN ret + (pct / 100.0 - c) / (c2 - c) * (r2 - ret) END) AS value FROM {name}_n JOIN (SELECT unnest([{pcts}]) AS pct) p ON true GROUP BY 1, 2, 3)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m = matches(spark, sf_dir)
    m = m.select("query_id", "rank", F.col("score").alias("weight"), "series_id", (F.col("start") + WIDTH).alias("end"))
    return projection.forward_paths(m, s, BARS)


@query(f"""WITH {_PATHS} SELECT query_id, rank, bar, round(ret, 6) + 0.0 AS ret FROM paths""")
def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("query_id", "rank", "bar", rounded("ret").alias("ret"))


@query(f"""WITH {_PATHS}, {_cone()} SELECT query_id, bar, pct, round(value, 6) + 0.0 AS value FROM cone""")
def p2_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: search, project, weighted quantile cone."""
    return projection.cone(paths(spark, sf_dir), ["query_id"]).select("query_id", "bar", "pct", rounded("value").alias("value"))


@query(f"""WITH {_PATHS}, {_cone()}, m50 AS (SELECT query_id, bar, value AS mid FROM cone WHERE pct = 50) SELECT query_id, bar, pct, round(mid + (value - mid) * (1 + 0.05 * bar), 6) + 0.0 AS value FROM cone JOIN m50 USING (query_id, bar)""")
def p3_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = projection.cone(paths(spark, sf_dir), ["query_id"])
    return projection.widened(c, ["query_id"], 0.05).select("query_id", "bar", "pct", rounded("value").alias("value"))


_REG = "CASE rank % 3 WHEN 0 THEN 'high_vol' WHEN 1 THEN 'low_vol' ELSE 'mean_reverting' END"


@query(f"""WITH {_PATHS}, rp AS (SELECT query_id, rank, bar, ret, weight * CASE WHEN {_REG} IN ('low_vol', 'mean_reverting') THEN 1 ELSE 0.5 END AS weight FROM paths), {_cone(source="rp")} SELECT query_id, bar, pct, round(value, 6) + 0.0 AS value FROM cone""")
def p5_regime_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cone whose paths count in full when their regime fits that of the query (low_vol here)."""
    match = F.when(F.col("rank") % 3 == 0, "high_vol").when(F.col("rank") % 3 == 1, "low_vol").otherwise("mean_reverting")
    p = paths(spark, sf_dir).withColumn("weight", projection.regime_weight(F.col("weight"), F.lit("low_vol"), match))
    return projection.cone(p, ["query_id"]).select("query_id", "bar", "pct", rounded("value").alias("value"))


@query(f"""WITH {_PATHS}, last AS (SELECT * FROM paths WHERE bar = {BARS - 1}), {_cone(source="last", name="mid", pcts="50")}, ad AS (SELECT l.query_id, l.rank, CASE WHEN m.value >= 0 THEN -ret ELSE ret END AS a FROM last l JOIN mid m USING (query_id)),
  f AS (SELECT query_id, rank, exp(1.5 * (a - avg(a) OVER (PARTITION BY query_id)) / stddev_pop(a) OVER (PARTITION BY query_id)) AS f FROM ad), tp AS (SELECT p.query_id, p.rank, p.bar, p.ret, p.weight * f AS weight FROM paths p JOIN f USING (query_id, rank)), {_cone(source="tp")} SELECT query_id, bar, pct, round(value, 6) + 0.0 AS value FROM cone""")
def p6_adverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projection.adverse(paths(spark, sf_dir).drop("series_id", "end"), ["query_id"], ["rank"], BARS).drop("weight").withColumnRenamed("tilt", "weight")
    return projection.cone(p, ["query_id"]).select("query_id", "bar", "pct", rounded("value").alias("value"))


@query(f"""WITH {_PATHS}, d AS (SELECT *, avg(ret) OVER (PARTITION BY query_id, bar) AS base FROM paths), e AS (SELECT *, abs(ret - base) AS dev FROM d), n AS (SELECT query_id, rank, max(dev) AS most FROM e GROUP BY 1, 2),
  qq AS (SELECT query_id, quantile_cont(most, 1.0) AS q FROM n GROUP BY 1), b AS (SELECT query_id, bar, any_value(base) AS base, quantile_cont(dev, 1.0) AS d FROM e GROUP BY 1, 2)
  SELECT query_id, bar, round(base - greatest(d, 0.5 * q), 6) + 0.0 AS lower, round(base + greatest(d, 0.5 * q), 6) + 0.0 AS upper FROM b JOIN qq USING (query_id)""")
def p7_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With five paths the level is 1."""
    out = projection.conformal(paths(spark, sf_dir), ["query_id"], ["rank"])
    return out.select("query_id", "bar", rounded("lower").alias("lower"), rounded("upper").alias("upper"))


@query(f"""WITH {_PATHS}, {_cone()}, eq AS (SELECT query_id, rank, bar, ret, 1.0 AS weight FROM paths), {_cone(source="eq", name="flat")} SELECT query_id, bar, pct, round(cone.value * 4 / 7 + flat.value * 3 / 7, 6) + 0.0 AS value FROM cone JOIN flat USING (query_id, bar, pct)""")
def p8_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    a, b = projection.cone(p, ["query_id"]), projection.cone(p.withColumn("weight", F.lit(1.0)), ["query_id"])
    return projection.blended([(a, 0.4), (b, 0.3)], ["query_id"]).select("query_id", "bar", "pct", rounded("value").alias("value"))


@query(f"""WITH {_PATHS}, {_cone()}, m50 AS (SELECT query_id, bar, value AS mid FROM cone WHERE pct = 50) SELECT query_id, bar, pct, round(mid + (value - mid) * CASE WHEN query_id < 'p' THEN 1.4 ELSE 0.85 END, 6) + 0.0 AS value FROM cone JOIN m50 USING (query_id, bar)""")
def p11_regime_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = projection.cone(paths(spark, sf_dir), ["query_id"]).withColumn("regime", F.when(F.col("query_id") < "p", "high_vol").otherwise("mean_reverting"))
    return projection.around_median(c, ["query_id"], projection.regime_multiplier(F.col("regime"))).select("query_id", "bar", "pct", rounded("value").alias("value"))


@query(f"""WITH {SERIES}, n AS (SELECT series_id, count(*) AS n FROM series GROUP BY 1), g AS (SELECT series_id, value - lag(value, 7) OVER (PARTITION BY series_id ORDER BY pos) AS g FROM series), sd AS (SELECT series_id, stddev_pop(g) AS sd FROM g GROUP BY 1)
  SELECT series_id, b.bar, round(value - 1.2815515655446004 * sd, 5) AS p10, value AS p50, round(value + 1.2815515655446004 * sd, 5) AS p90 FROM n JOIN range(0, 20) b(bar) ON true JOIN series s USING (series_id) JOIN sd USING (series_id) WHERE s.pos = n.n - 7 + b.bar % 7""")
def p13_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = projection.seasonal_naive(event_series(spark, sf_dir), 7, 20)
    return out.select("series_id", F.col("bar").cast("long").alias("bar"), F.round("p10", 5).alias("p10"), "p50", F.round("p90", 5).alias("p90"))


@query(f"""WITH {_topk("profile")} SELECT query_id, b.bar, round(quantile_cont(s.value, 0.1), 6) AS p10, round(quantile_cont(s.value, 0.5), 6) AS p50, round(quantile_cont(s.value, 0.9), 6) AS p90 FROM m JOIN range(0, {BARS}) b(bar) ON true JOIN series s ON s.series_id = m.series_id AND s.pos = m.start + {WIDTH} + b.bar GROUP BY 1, 2""")
def p14_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m = matches(spark, sf_dir, {"profile": 1.0})
    out = projection.motif_continuation(m.withColumn("end", F.col("start") + WIDTH), s, BARS)
    return out.select("query_id", F.col("bar").cast("long").alias("bar"), *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


@query(f"""WITH {SERIES}, r AS (SELECT *, ln(value) - lag(ln(value)) OVER (PARTITION BY series_id ORDER BY pos) AS r FROM series), x AS (SELECT *, lag(r) OVER (PARTITION BY series_id ORDER BY pos) AS x FROM r WHERE r IS NOT NULL),
  f AS (SELECT series_id, regr_slope(r, x) AS phi, avg(r) FILTER (x IS NOT NULL) AS my, sqrt(greatest(0, var_pop(r) FILTER (x IS NOT NULL) - 2 * regr_slope(r, x) * covar_pop(r, x) + regr_slope(r, x) ** 2 * var_pop(x))) AS sigma FROM x GROUP BY 1)
  SELECT series_id, b.bar, z.pct, round(exp(my * (b.bar + 1) + z.z * sigma * (1 - phi ** (b.bar + 1)) / (1 - phi)) - 1, 6) + 0.0 AS value FROM f JOIN range(0, 10) b(bar) ON true JOIN (VALUES (10, -1.2815515655446008), (50, 0.0), (90, 1.2815515655446008)) z(pct, z) ON true""")
def p15_ar1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = projection.ar1_cone(event_series(spark, sf_dir), 10, (10, 50, 90))
    return out.select("series_id", F.col("bar").cast("long").alias("bar"), "pct", rounded("value").alias("value"))
