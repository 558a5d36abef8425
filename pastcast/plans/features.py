"""Queries of windows, features and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastcast.functions.common import rounded, total
from pastcast.operators import regimes, windows
from pastcast.plans.data import SERIES, event_series
from pastcast.plans.registry import registry
from pastcast.session import table

QUERIES, ORACLES, query = registry()


def _win(width: int, stride: int) -> str:
    return f"""{SERIES}, win AS (SELECT s.series_id, s.pos AS start, list(x.value ORDER BY x.pos) AS v FROM series s JOIN series x ON x.series_id = s.series_id AND x.pos >= s.pos AND x.pos < s.pos + {width}
  WHERE s.pos % {stride} = 0 GROUP BY 1, 2 HAVING count(*) = {width})"""


_R = "list_transform(range(1, len(v)), lambda i: ln(greatest(v[i + 1], 1e-12)) - ln(greatest(v[i], 1e-12)))"


def _z(x: str) -> str:
    return f"CASE WHEN list_stddev_pop({x}) = 0 THEN list_transform({x}, lambda y: 0.0) ELSE list_transform({x}, lambda y: (y - list_avg({x})) / list_stddev_pop({x})) END"


@query(f"""WITH {_win(64, 40)}, n AS (SELECT series_id, start, v, {_R} AS r FROM win), m AS (
  SELECT series_id, start, 'zscore' AS method, {_z("v")} AS x FROM n UNION ALL SELECT series_id, start, 'minmax', list_transform(v, lambda y: (y - list_min(v)) / (list_max(v) - list_min(v))) FROM n
  UNION ALL SELECT series_id, start, 'logreturn', r FROM n UNION ALL SELECT series_id, start, 'logreturn_zscore', {_z("r")} FROM n)
  SELECT series_id, start, method, len(x) AS n, round(x[4], 6) + 0.0 AS fourth, round(list_sum(list_transform(x, lambda y: abs(y))), 6) AS size FROM m""")
def b5_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, out = windows.windows(event_series(spark, sf_dir), 64, 40), None
    for m in ("zscore", "minmax", "logreturn", "logreturn_zscore"):
        x = F.col("normal")
        some = windows.normalised(w, m).select("series_id", "start", F.lit(m).alias("method"), F.size(x).alias("n"), rounded(F.get(x, F.lit(3))).alias("fourth"), F.round(total(F.transform(x, F.abs)), 6).alias("size"))
        out = some if out is None else out.union(some)
    return out


@query(f"""WITH {SERIES}, w AS (SELECT unnest([10, 15, 20, 30, 40]) AS width) SELECT s.series_id, w.width, s.pos AS start, count(*) AS n, round(sum(x.value), 6) AS total FROM series s, w JOIN series x ON x.series_id = s.series_id AND x.pos >= s.pos AND x.pos < s.pos + w.width
  WHERE s.pos % 50 = 0 GROUP BY 1, 2, 3 HAVING count(*) = w.width""")
def b6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.multi_scale(event_series(spark, sf_dir), 20, 50)
    return w.select("series_id", "width", "start", F.size("values").alias("n"), F.round(total(F.col("values")), 6).alias("total"))


@query(f"""WITH {_win(64, 40)}, j AS (SELECT series_id, start, v, unnest(range(48)) AS j FROM win), k AS (SELECT *, j * 63 / 47.0 AS x FROM j)
  SELECT series_id, start, round(sum((v[floor(x)::INT + 1] + (x - floor(x)) * (v[least(floor(x)::INT + 1, 63) + 1] - v[floor(x)::INT + 1])) * (j + 1)), 5) AS weighted FROM k GROUP BY 1, 2""")
def b7_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.windows(event_series(spark, sf_dir), 64, 40).withColumn("r", windows.resampled(F.col("values"), 48))
    return w.select("series_id", "start", F.round(F.aggregate(F.transform("r", lambda x, j: x * (j + 1)), F.lit(0.0), lambda s, x: s + x), 5).alias("weighted"))


@query(f"""WITH {_win(64, 40)}, e AS (SELECT series_id, start, v, unnest(range(6, 64)) AS i FROM win) SELECT series_id, start, i, v[i + 1] AS newest, v[i - 2] AS middle, v[i - 5] AS oldest FROM e""")
def b8_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.windows(event_series(spark, sf_dir), 64, 40).select("series_id", "start", F.posexplode(windows.embedded(F.col("values"), 3, 3)).alias("i", "row"))
    return w.select("series_id", "start", (F.col("i") + 6).alias("i"), F.col("row")[0].alias("newest"), F.col("row")[1].alias("middle"), F.col("row")[2].alias("oldest"))


@query(f"""WITH {SERIES}, n AS (SELECT series_id, count(*) AS n, avg(value) AS m, greatest(4, floor(sqrt(count(*) / 5.0)))::INT AS bins, greatest(1, least(12, count(*) // 4)) AS upper FROM series GROUP BY 1),
  p AS (SELECT a.series_id, l.lag, a.value AS x, b.value AS y, n.m, n.bins, n.upper FROM series a JOIN n USING (series_id), range(1, 13) l(lag), series b WHERE b.series_id = a.series_id AND b.pos = a.pos + l.lag AND l.lag <= n.upper),
  g AS (SELECT series_id, lag, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, sum((x - m) * (y - m)) AS acf, any_value(upper) AS upper FROM p GROUP BY 1, 2),
  c AS (SELECT p.series_id, p.lag, least(floor((x - x0) / (x1 - x0) * bins), bins - 1) AS bx, least(floor((y - y0) / (y1 - y0) * bins), bins - 1) AS y_, count(*) AS c FROM p JOIN g USING (series_id, lag) GROUP BY 1, 2, 3, 4),
  d AS (SELECT *, sum(c) OVER (PARTITION BY series_id, lag, bx) AS cx, sum(c) OVER (PARTITION BY series_id, lag, y_) AS cy, sum(c) OVER (PARTITION BY series_id, lag) AS t FROM c),
  m AS (SELECT series_id, lag, sum(c / t * ln(c * t / (cx * cy))) AS mi FROM d GROUP BY 1, 2),
  o AS (SELECT m.*, acf, upper, lag(mi) OVER w AS before, lead(mi) OVER w AS after FROM m JOIN g USING (series_id, lag) WINDOW w AS (PARTITION BY series_id ORDER BY m.lag))
  SELECT series_id, coalesce(min(lag) FILTER (lag < upper AND mi < before AND mi <= after), min(lag) FILTER (acf <= 0), max(upper)) AS lag FROM o GROUP BY 1""")
def b9_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.delays(event_series(spark, sf_dir), 12)


_SLOPE = "(64 * list_sum(list_transform(range(64), lambda i: i * x[i + 1])) - 2016 * list_sum(x)) / (64 * 85344 - 2016 * 2016)"


@query(f"""WITH {_win(64, 40)}, z AS (SELECT series_id, start, list_stddev_pop({_R}) * sqrt(252) AS vol, {_z("v")} AS x FROM win) SELECT series_id, start, round(vol, 6) AS vol, round({_SLOPE}, 6) + 0.0 AS slope,
  CASE WHEN vol > 0.4 THEN 'high_vol' WHEN vol < 0.1 THEN 'low_vol' WHEN abs({_SLOPE}) > 0.01 THEN CASE WHEN {_SLOPE} > 0 THEN 'trending_up' ELSE 'trending_down' END ELSE 'mean_reverting' END AS label_at_half FROM z""")
def b10_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = regimes.with_moves(windows.windows(event_series(spark, sf_dir), 64, 40))
    label = regimes.hard_label(F.col("vol"), F.col("slope"), F.lit(0.5), F.size("values"))
    return w.select("series_id", "start", F.round("vol", 6).alias("vol"), rounded("slope").alias("slope"), label.alias("label_at_half"))


_BOXES = "4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15"  # 20 even steps in the logarithm from 4 to 63 // 4, whole numbers


@query(f"""WITH {_win(64, 40)}, z AS (SELECT series_id, start, list_stddev_pop({_R}) * sqrt(252) AS vol, {_z("v")} AS x, {_R} AS r FROM win), m AS (SELECT series_id, start, vol, {_SLOPE} AS slope FROM z),
  e AS (SELECT series_id, start, unnest(r) AS r, unnest(range(63)) AS i, list_avg(r) AS mean FROM z), y AS (SELECT series_id, start, i, sum(r - mean) OVER (PARTITION BY series_id, start ORDER BY i) AS y FROM e),
  b AS (SELECT series_id, start, s, sqrt(greatest(0.0, var_pop(y) - covar_pop(i, y) ** 2 / var_pop(i))) AS f FROM y JOIN (SELECT unnest([{_BOXES}]) AS s) ON i < 63 // s * s GROUP BY series_id, start, s, i // s),
  f AS (SELECT series_id, start, s, avg(f) AS f FROM b GROUP BY 1, 2, 3), h AS (SELECT series_id, start, CASE WHEN count(*) FILTER (f > 0) < 2 THEN 0.5 ELSE least(1.0, greatest(0.0, regr_slope(ln(f), ln(s)) FILTER (f > 0))) END AS hurst FROM f GROUP BY 1, 2)
  SELECT series_id, start, round(hurst, 6) AS hurst, CASE WHEN vol = 0 THEN 'low_vol' WHEN vol > 0.4 THEN 'high_vol' WHEN vol < 0.1 THEN 'low_vol' WHEN hurst < 0.4 THEN 'mean_reverting'
  WHEN hurst > 0.6 OR abs(slope) > 0.01 THEN CASE WHEN slope > 0 THEN 'trending_up' ELSE 'trending_down' END ELSE 'mean_reverting' END AS label FROM h JOIN m USING (series_id, start)""")
def b10_hurst(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = regimes.with_hurst(regimes.with_moves(windows.windows(event_series(spark, sf_dir), 64, 40)))
    label = regimes.hard_label(F.col("vol"), F.col("slope"), F.col("hurst"), F.size("values"))
    return w.select("series_id", "start", F.round("hurst", 6).alias("hurst"), label.alias("label"))


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-greatest(-40.0, least(40.0, {x})))))"


_P = [
    f"{_sig('(0.5 - 0.56) / 0.06')} * {_sig('(slope - 0.006) / 0.012')} * (1 - 0.45 * {_sig('(vol - 0.32) / 0.07')})",
    f"{_sig('(0.5 - 0.56) / 0.06')} * {_sig('(-slope - 0.006) / 0.012')} * (1 - 0.45 * {_sig('(vol - 0.32) / 0.07')})",
    f"{_sig('(0.44 - 0.5) / 0.06')} * (1 - 0.35 * {_sig('(vol - 0.32) / 0.07')})",
    _sig("(vol - 0.32) / 0.07"),
    _sig("(0.12 - vol) / 0.035"),
]
_T = "[" + ", ".join("[" + ", ".join(map(str, [row[j] for row in regimes.TRANSITIONS])) + "]" for j in range(5)) + "]"


@query(f"""WITH {_win(64, 40)}, z AS (SELECT series_id, start, list_stddev_pop({_R}) * sqrt(252) / 20 AS vol, {_z("v")} AS x FROM win), s AS (SELECT series_id, start, vol, {_SLOPE} AS slope FROM z),
  r AS (SELECT series_id, start, list_transform([{", ".join(_P)}], lambda y: greatest(y, 1e-8)) AS raw FROM s), p AS (SELECT series_id, start, list_transform(raw, lambda y: y / list_sum(raw)) AS p FROM r),
  q AS (SELECT series_id, start, p, list_transform({_T}, lambda c: list_inner_product(c, p)) AS nx FROM p)
  SELECT series_id, start, round(p[1], 6) AS p_up, round(p[3], 6) AS p_revert, round(nx[4], 6) AS next_high, round(list_inner_product(p, nx) / sqrt(list_inner_product(p, p) * list_inner_product(nx, nx)), 6) AS similarity FROM q""")
def b11_soft_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = regimes.with_moves(windows.windows(event_series(spark, sf_dir), 64, 40)).withColumns({"vol": F.col("vol") / 20, "hurst": F.lit(0.5)})
    w = regimes.soft_regime(w)
    return w.select("series_id", "start", F.round(F.col("p")[0], 6).alias("p_up"), F.round(F.col("p")[2], 6).alias("p_revert"), F.round(F.col("next")[3], 6).alias("next_high"), F.round(regimes.soft_similarity(F.col("p"), F.col("next")), 6).alias("similarity"))


@query(f"""WITH {_win(64, 40)}, a AS (SELECT series_id, start, v, v AS x, list_avg(v) AS m, list_transform(range(1, 64), lambda i: v[i + 1] - v[i] >= 0) AS up FROM win),
  f AS (SELECT series_id, start, m AS mean, list_stddev_pop(v) AS sd, {_SLOPE} AS slope, (list_position(v, list_max(v)) - 1) / 64.0 AS peak, len(list_filter(range(1, 63), lambda i: up[i + 1] <> up[i])) / 64.0 AS zc,
  list_sum(list_transform(range(10, 64), lambda i: (v[i + 1] - m) * (v[i - 9] - m))) / 54 AS ac, greatest(0.0, least(1.0, 0.5 * ln((list_sum(list_transform(range(30, 64), lambda i: (v[i + 1] - v[i - 29]) ** 2)) + 1e-6) / (list_sum(list_transform(range(5, 64), lambda i: (v[i + 1] - v[i - 4]) ** 2)) + 1e-6)) / ln(6))) AS hurst, list_max(v) - list_min(v) AS range_ FROM a),
  d AS (SELECT f.*, sqrt(((f.slope - g.slope) * 2) ** 2 + (f.peak - g.peak) ** 2 + (f.zc - g.zc) ** 2 + ((f.hurst - g.hurst) * 1.5) ** 2 + ((f.sd - g.sd) * 0.8) ** 2 + ((f.ac - g.ac) * 0.02) ** 2) AS d FROM f JOIN f g ON g.series_id = f.series_id AND g.start = 0)
  SELECT series_id, start, round(mean, 8) AS mean, round(sd, 6) AS sd, round(slope, 6) + 0.0 AS slope, round(peak, 6) AS peak, round(zc, 6) AS zc, round(ac, 6) + 0.0 AS ac, round(hurst, 6) AS hurst, round(range_, 6) AS range_, round(greatest(0.0, least(1.0, 1 - d / 3)), 6) AS similarity,
  CASE WHEN hurst > 0.58 THEN 'Trending' WHEN hurst < 0.42 THEN 'Mean-rev' ELSE 'Random' END AS label FROM d""")
def b12_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["mean", "sd", "slope", "peak", "zc", "ac", "hurst", "range"]
    f = windows.descriptor(windows.windows(event_series(spark, sf_dir), 64, 40)).select("series_id", "start", F.struct(*cols).alias("f"))
    first = f.filter("start = 0").select("series_id", F.col("f").alias("g"))
    d = f.join(first, "series_id").withColumn("d", windows.descriptor_distance("f", "g"))
    out = [rounded(f"f.{c}", 8 if c == "mean" else 6).alias("range_" if c == "range" else c) for c in cols]
    return d.select("series_id", "start", *out, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("d") / 3)), 6).alias("similarity"), windows.descriptor_label(F.col("f.hurst")).alias("label"))


@query(f"""WITH {SERIES}, d AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY series_id ORDER BY pos), 0) AS d FROM series), v AS (SELECT *, stddev_pop(d) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol FROM d),
  c AS (SELECT series_id, quantile_cont(vol, 0.5) AS cut FROM v GROUP BY 1) SELECT series_id, (pos // 100)::BIGINT AS stretch, count(*) FILTER (round(vol - cut, 9) >= 0) AS high, round(sum(vol), 5) AS vols FROM v JOIN c USING (series_id) GROUP BY 1, 2""")
def b13_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = regimes.volatility_regime(event_series(spark, sf_dir), size=300)
    return v.groupBy("series_id", F.floor(F.col("pos") / 100).alias("stretch")).agg(F.count_if("high").alias("high"), F.round(F.sum("vol"), 5).alias("vols"))


@query(f"""WITH {SERIES}, r AS (SELECT *, ln(value) - ln(lag(value) OVER (PARTITION BY series_id ORDER BY pos)) AS r FROM series), s AS (SELECT *, stddev_pop(r) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd FROM r WHERE r IS NOT NULL),
  w AS (SELECT a.series_id, a.pos AS start, list(b.r ORDER BY b.pos) AS v, list(b.sd ORDER BY b.pos) AS sd FROM s a JOIN s b ON a.series_id = b.series_id AND b.pos >= a.pos AND b.pos < a.pos + 32 WHERE a.pos % 32 = 0 GROUP BY 1, 2 HAVING count(*) = 32),
  n AS (SELECT *, start / 32.0 / count(*) OVER (PARTITION BY series_id) AS share FROM w) SELECT series_id, start, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.85 THEN 'valid' ELSE 'test' END AS part, round((v[1] - list_avg(v)) / list_stddev_pop(v), 6) + 0.0 AS first_return, round((sd[32] - list_avg(sd)) / list_stddev_pop(sd), 6) + 0.0 AS last_vol FROM n""")
def b14_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = regimes.training_windows(event_series(spark, sf_dir).withColumn("volume", F.lit(1.0)), 32, 32, 640)
    return w.select("series_id", "start", "part", rounded(F.col("returns")[0]).alias("first_return"), rounded(F.col("vols")[31]).alias("last_vol"))


@query("""WITH m AS (SELECT o_orderpriority AS region, o_orderdate AS ts, avg(o_totalprice) AS growth, avg(o_custkey) AS inflation, stddev_pop(o_totalprice) AS vix, avg(o_orderkey % 100) AS rate FROM orders GROUP BY 1, 2),
  w AS (SELECT *, epoch(ts)::BIGINT AS e, rate - lag(rate) OVER (PARTITION BY region ORDER BY ts) AS change FROM m),
  a AS (SELECT *, avg(growth) OVER (PARTITION BY region ORDER BY e RANGE BETWEEN 63072000 PRECEDING AND CURRENT ROW) AS g, avg(inflation) OVER (PARTITION BY region ORDER BY e RANGE BETWEEN 157680000 PRECEDING AND CURRENT ROW) AS i, avg(vix) OVER (PARTITION BY region ORDER BY e RANGE BETWEEN 31536000 PRECEDING AND CURRENT ROW) AS v FROM w)
  SELECT region, strftime(ts, '%Y-%m') AS "month", count(*) FILTER (round(growth - g, 6) >= 0) AS growth_up, count(*) FILTER (round(inflation - i, 6) >= 0) AS inflation_up, count(*) FILTER (round(vix - v, 6) >= 0) AS vix_up, count(*) FILTER (change >= 0) AS liquidity_down FROM a GROUP BY 1, 2""")
def b15_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(F.col("o_orderpriority").alias("region"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.avg("o_totalprice").alias("growth"), F.avg("o_custkey").alias("inflation"), F.stddev_pop("o_totalprice").alias("vix"), F.avg(F.col("o_orderkey") % 100).alias("rate"))
    out = regimes.macro_regimes(m)
    n = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return out.groupBy("region", F.date_format(F.col("ts").cast("date"), "yyyy-MM").alias("month")).agg(n("growth", "growth_up"), n("inflation", "inflation_up"), n("vix", "vix_up"), n("liquidity", "liquidity_down"))


