"""Queries of records in files, of sentences made from events, and of scores over all parts of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastcast.functions.common import rounded
from pastcast.operators import narrative, privacy, projection, relations, search, trials, windows
from pastcast.plans.deep import _TAGGED, _records
from pastcast.plans.registry import registry
from pastcast.plans.search import _MATCHES, _PATHS, BARS, WIDTH, _cone, matches
from pastcast.session import scratch, stored, table
from pastcast.sources import text
from pastcast.sources.series import positions

QUERIES, ORACLES, query = registry()


def _ledger(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Entries written as JSON lines, a malformed and a blank line after about each hundredth, and read back."""
    path = scratch(spark)
    line = F.to_json(F.struct(*rows.columns))
    lines = F.when(F.xxhash64(line) % 100 == 0, F.array(line, F.substring(line, 1, 20), F.lit(""))).otherwise(F.array(line))
    rows.select(F.explode(lines).alias("value")).write.text(path)
    return text.read_ledger(spark, path)


@query("SELECT o_custkey::VARCHAR AS lane_id, count(*) AS entries, arg_max(o_orderkey, (o_orderdate, o_orderkey))::VARCHAR AS run_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1")
def r4_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of all orders as JSON lines with bad ones between: entries per lane and the latest of each."""
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), stamp.alias("timestamp"), F.col("o_custkey").cast("string").alias("lane_id"), F.col("o_orderstatus").alias("status"))
    return text.latest_runs(_ledger(spark, o)).select("lane_id", "entries", "run_id", "status")


@query("""WITH m AS (SELECT l_returnflag || l_linestatus AS f, 's' || l_suppkey % (CASE WHEN l_returnflag = 'A' THEN 40 ELSE 30 END) AS metric, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), a AS (SELECT metric, v FROM m WHERE f = 'AF'), b AS (SELECT metric, v FROM m WHERE f = 'NO')
  SELECT metric, a.v AS a, b.v AS b, b.v - a.v AS delta FROM a FULL JOIN b USING (metric)""")
def r4_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a ledger set against each other."""
    flag, most = F.concat("l_returnflag", "l_linestatus"), F.when(F.col("l_returnflag") == "A", 40).otherwise(30)
    m = table(spark, sf_dir, "lineitem").groupBy(flag.alias("run_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % most).cast("string")).alias("k")).agg(F.sum("l_quantity").alias("v"))
    runs = m.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metrics_after"))  # 40 keys a run at most
    return text.compared_runs(_ledger(spark, runs), "AF", "NO")


@query(f"WITH {_MATCHES} SELECT query_id, rank, series_id, start, round(score, 6) AS score FROM m")
def s14_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each query as nested JSON lines in a file, read back and taken apart."""
    path = scratch(spark)
    m = matches(spark, sf_dir)[1].select("query_id", "rank", "series_id", "start", F.round("score", 6).alias("score"))
    m.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "series_id", "start", "score"))).alias("matches")).write.json(path)  # a few matches a query
    back = spark.read.schema("query_id string, matches array<struct<rank:int,series_id:string,start:long,score:double>>").json(path)
    return back.select("query_id", F.explode("matches").alias("m")).select("query_id", "m.rank", "m.series_id", "m.start", "m.score")


@query("SELECT o_orderpriority AS dataset, o_orderkey AS series, o_orderstatus AS system, CASE WHEN o_orderkey % 3 = 0 THEN 'first' ELSE 'resumed' END AS run, o_totalprice AS mae FROM orders")
def s13_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results kept as JSON lines: a run that ended after a third, then one that reads them and appends what is missing."""
    path, keys = scratch(spark), ["dataset", "series", "system"]
    work = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").alias("series"), F.col("o_orderstatus").alias("system"), F.col("o_totalprice").alias("mae"))
    text.resumed(work.filter("series % 3 = 0"), path, keys, lambda df: df.withColumn("run", F.lit("first")))
    return text.resumed(work, path, keys, lambda df: df.withColumn("run", F.lit("resumed"))).select(*keys, "run", "mae")


_KIND = {"view": "earnings", "click": "policy", "purchase": "market_crash", "signup": "geopolitical"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KIND.items()) + " ELSE 'other' END"


@query(f"""SELECT event_id AS id, list_concat([{", ".join(f"({_CASE} = '{t}')::INT::DOUBLE" for t in relations.EVENT_TYPES)}],
  list_transform([sin((month(ts) - 1) * 2 * pi() / 12), cos((month(ts) - 1) * 2 * pi() / 12), sin((isodow(ts) - 1) * 2 * pi() / 7), cos((isodow(ts) - 1) * 2 * pi() / 7), greatest(0.0, least(1.0, value / 50)), CASE WHEN value > 20 THEN 1.0 ELSE -1.0 END], lambda x: round(x, 9) + 0.0)) AS vec FROM events""")
def e1_eight_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event vectors with the eight fixed types; a type that isn't one of them is the last."""
    kind = F.lit("unheard of")
    for a, b in _KIND.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    v = relations.event_vector(kind, F.col("ts").cast("timestamp_ntz"), F.col("value") / 50, F.when(F.col("value") > 20, 1).otherwise(-1))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.transform(v, lambda x: F.round(x, 9) + 0.0).alias("vec"))


#: Sentences of each event type: before and after the modifier, after the number.
_MOVES = [
    ("view", "Prices ", "sharply", " crashed for ", " days"), ("click", "The index ", "gradually", " drifted sideways over ", " weeks"), ("purchase", "Then shares ", "dramatically", " rallied; lasting ", " sessions"),
    ("signup", "Bonds broke out ", "suddenly", " for ", " days"), ("error", "Nothing ", "slightly", " happened for ", " days"),
]
_SAID = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{a}' || CASE WHEN event_id % 3 = 0 THEN '{how}' ELSE 'again' END || '{b}' || (event_id % 40) || '{c}'" for k, a, how, b, c in _MOVES) + " END"
_TEXTS = f"(SELECT user_id AS doc_id, string_agg({_SAID}, '. ' ORDER BY ts, event_id) AS text FROM events GROUP BY 1)"


@query(f"WITH {_TAGGED.replace('FROM documents WHERE', f'FROM {_TEXTS} WHERE')} SELECT id, place::INT AS place, family, intensity::DOUBLE AS intensity, duration, previous, CASE WHEN previous IS NOT NULL THEN sharp END::DOUBLE AS sharpness FROM t")
def e7_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that name moves, made of each user's events."""
    said = F.lit(None).cast("string")
    for kind, a, how, b, c in _MOVES:
        line = F.concat(F.lit(a), F.when(F.col("event_id") % 3 == 0, how).otherwise("again"), F.lit(b), (F.col("event_id") % 40).cast("string"), F.lit(c))
        said = F.when(F.col("event_type") == kind, line).otherwise(said)
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", said.alias("s")).alias("e"))
    docs = e.groupBy(F.col("user_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x.s), ". ").alias("text"))  # one text per user
    return narrative.tagged(docs)


_HALF = "r AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1), s AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0)"
_TAILED = ["l_quantity", "l_extendedprice", "l_partkey"]


def _q(c: str, t: str, p: float) -> str:
    return f"(SELECT quantile_cont({c}, {p}) FROM {t})"


def _tail_sql(c: str) -> str:
    low, high = (f"abs((SELECT avg({c}) FROM r WHERE {c} {op} {_q(c, 'r', p)}) - (SELECT avg({c}) FROM s WHERE {c} {op} {_q(c, 's', p)}))" for op, p in (("<=", 0.05), (">=", 0.95)))
    return f"SELECT '{c}' AS col, {_q(c, 's', 0.01)} / {_q(c, 'r', 0.01)} AS p01, {_q(c, 's', 0.99)} / {_q(c, 'r', 0.99)} AS p99, {low} AS lo, {high} AS hi"


@query(f"""WITH {_HALF}, u AS ({" UNION ALL ".join(map(_tail_sql, _TAILED))}), v AS (SELECT * FROM u UNION ALL SELECT 'mean', avg(p01), avg(p99), avg(lo), avg(hi) FROM u)
  SELECT col AS "column", round(p01, 6) AS p01, round(p99, 6) AS p99, round(lo, 4) AS low_cvar, round(hi, 4) AS high_cvar FROM v""")
def y7_every_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tails of several columns and their means."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *_TAILED)
    out = stored(relations.tails(li.filter("l_orderkey % 2 = 1"), li.filter("l_orderkey % 2 = 0"), _TAILED))
    out = out.unionByName(out.agg(F.lit("mean").alias("column"), *[F.avg(c).alias(c) for c in ("p01", "p99", "low_cvar", "high_cvar")]))
    return out.select("column", F.round("p01", 6).alias("p01"), F.round("p99", 6).alias("p99"), F.round("low_cvar", 4).alias("low_cvar"), F.round("high_cvar", 4).alias("high_cvar"))


_PARTS = ["l_quantity", "l_extendedprice"]


def _fidelity_sql() -> str:
    made = [_HALF]
    for c in _PARTS:
        made.append(f"{c}_v AS (SELECT x, sum(a) AS a, sum(b) AS b FROM (SELECT {c} AS x, 1 AS a, 0 AS b FROM r UNION ALL SELECT {c}, 0, 1 FROM s) GROUP BY 1)")
        made.append(f"{c}_g AS (SELECT sum(a) OVER w / (SELECT count(*) FROM r) AS a, sum(b) OVER w / (SELECT count(*) FROM s) AS b FROM {c}_v WINDOW w AS (ORDER BY x))")
        for t in "rs":
            made.append(f"{c}_{t}p AS (SELECT {c} AS v, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS p FROM {t})")
            made.append(f"{c}_{t}m AS (SELECT avg(v) AS m, var_pop(v) * count(*) AS s FROM {c}_{t}p)")
            made.append(f"{c}_{t}a AS (SELECT k, sum((a.v - m) * (b.v - m)) / any_value(z.s) AS acf FROM {c}_{t}p a JOIN (SELECT unnest([1, 5, 10]) AS k) ON true JOIN {c}_{t}p b ON b.p = a.p + k JOIN {c}_{t}m z ON true GROUP BY 1)")
    ks = " + ".join(f"(SELECT max(abs(a - b)) FROM {c}_g)" for c in _PARTS)
    acf = " UNION ALL ".join(f"SELECT abs(x.acf - y.acf) AS d FROM {c}_ra x JOIN {c}_sa y USING (k)" for c in _PARTS)
    tail = " + ".join(f"(abs({_q(c, 's', 0.01)} / {_q(c, 'r', 0.01)} - 1) + abs({_q(c, 's', 0.99)} / {_q(c, 'r', 0.99)} - 1)) / 2" for c in _PARTS)
    corr = "sqrt(2) * abs((SELECT corr(l_quantity, l_extendedprice) FROM r) - (SELECT corr(l_quantity, l_extendedprice) FROM s))"
    return f"""WITH {", ".join(made)}, f AS (SELECT ({ks}) / {len(_PARTS)} AS mean_ks, (SELECT avg(d) FROM ({acf})) AS acf, {corr} AS frobenius, ({tail}) / {len(_PARTS)} AS tail)
  SELECT round(mean_ks, 6) AS mean_ks, round(acf, 6) AS acf, round(frobenius, 6) AS frobenius, round(tail, 6) AS tail, round((1 - mean_ks + exp(-2 * acf) + exp(-0.5 * frobenius) + exp(-tail)) / 4, 6) AS score FROM f"""


@query(_fidelity_sql())
def y8_one_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall fidelity of two halves of the line items in the order of shipping: all parts over the same columns, every column's tails."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), *_PARTS)
    a, b = (stored(li.filter(F.col("l_orderkey") % 2 == k)) for k in (1, 0))
    ks = relations.marginal_fidelity(a, b, _PARTS).agg(F.avg("ks").alias("mean_ks"))
    order = ["ts", "l_orderkey", "l_linenumber", *_PARTS]  # line numbers repeat
    line = lambda df: relations.column_autocorrelations(positions(df.select(F.lit("").alias("series_id"), *order), *order[1:]), _PARTS, [1, 5, 10])
    acf = line(a).join(line(b).withColumnRenamed("acf", "other"), ["series_id", "lag"]).agg(F.avg(F.abs(F.col("acf") - F.col("other"))).alias("acf"))
    tail = relations.tails(a, b, _PARTS).agg(F.avg((F.abs(F.col("p01") - 1) + F.abs(F.col("p99") - 1)) / 2).alias("tail"))
    out = privacy.fidelity_score(ks.crossJoin(acf).crossJoin(relations.correlation_gap(a, b, _PARTS)).crossJoin(tail))  # one row each
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean_ks", "acf", "frobenius", "tail", "score")])


@query()
def y12_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The privacy score with the attribute risk of the same records (Y11, Y12): that of the most telling column."""
    real, fake = (stored(x) for x in _records(spark, sf_dir))
    wide = lambda df: df.select(F.get("vec", F.lit(0)).alias("c0"), F.get("vec", F.lit(1)).alias("c1"))
    worst = privacy.inferred_columns(wide(real), wide(fake), ["c0", "c1"]).agg(F.max("risk").alias("r")).first().r or 0.0
    return privacy.privacy_score(privacy.record_privacy(real, fake), F.lit(float(worst)))


_VOL = "list_stddev_pop(list_transform(range(1, 30), lambda i: ln({v}[i + 1]) - ln({v}[i]))) * sqrt(252)"
#: Right where every window's volatility is above 0.4, as in these tables: then no label needs a Hurst exponent.
_HIGH = f"mv AS (SELECT m.query_id, m.rank, {_VOL.format(v='w.v')} > 0.4 AS high FROM m JOIN w USING (series_id, start)), qv AS (SELECT series_id AS query_id, {_VOL.format(v='v')} > 0.4 AS high FROM q)"


def _with_regimes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(paths of the matches with the regime of each matched window, regime of each query's window)."""
    s, m = matches(spark, sf_dir)
    m = m.select("query_id", "rank", F.col("score").alias("weight"), "series_id", "start")
    m = trials.with_regime(m.join(windows.windows(s, WIDTH), ["series_id", "start"])).withColumn("end", F.col("start") + WIDTH).drop("start")
    asked = trials.with_regime(search.last_windows(s, WIDTH).select("query_id", "values")).withColumnRenamed("regime", "query_regime")
    return stored(projection.forward_paths(m, s, BARS)), asked


@query(f"""WITH {_PATHS}, {_HIGH}, rp AS (SELECT query_id, rank, bar, ret, weight * CASE WHEN mv.high AND qv.high THEN 1 ELSE 0.5 END AS weight FROM paths JOIN mv USING (query_id, rank) JOIN qv USING (query_id)), {_cone(source="rp")} SELECT query_id, bar, pct, round(value, 6) + 0.0 AS value FROM cone""")
def p5_window_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cone whose paths count in full when the matched window's own regime (B10) fits that of the query's window (P5)."""
    p, asked = _with_regimes(spark, sf_dir)
    p = p.join(asked, "query_id").withColumn("weight", projection.regime_weight(F.col("weight"), F.col("query_regime"), F.col("regime")))
    return projection.cone(p.select("query_id", "rank", "bar", "ret", "weight"), ["query_id"]).select("query_id", "bar", "pct", rounded("value").alias("value"))


@query(f"""WITH {_PATHS}, {_HIGH}, {_cone()}, m50 AS (SELECT query_id, bar, value AS mid FROM cone WHERE pct = 50) SELECT query_id, bar, pct, round(mid + (value - mid) * CASE WHEN high THEN 1.4 END, 6) + 0.0 AS value FROM cone JOIN m50 USING (query_id, bar) JOIN qv USING (query_id)""")
def p11_window_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cone as wide as the regime (B10) of the query's own window says."""
    p, asked = _with_regimes(spark, sf_dir)
    c = projection.cone(p.select("query_id", "rank", "bar", "ret", "weight"), ["query_id"]).join(asked, "query_id")
    return projection.around_median(c, ["query_id"], projection.regime_multiplier(F.col("query_regime"))).select("query_id", "bar", "pct", rounded("value").alias("value"))
