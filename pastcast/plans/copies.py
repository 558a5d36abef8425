"""Queries of block copies, paired resampling and arm comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastcast.functions.common import rounded
from pastcast.operators import copies, regimes, relations
from pastcast.plans.data import SERIES, event_series
from pastcast.plans.registry import registry
from pastcast.session import stored, table

QUERIES, ORACLES, query = registry()


@query(f"""WITH {SERIES}, z AS (SELECT series_id, count(*) AS n FROM series GROUP BY 1), b AS (SELECT z.series_id, n, k.k, ('0x' || substr(md5(concat_ws('|', z.series_id, k.k, 1)), 1, 12))::BIGINT % greatest(n - 24, 1) AS start FROM z JOIN range(0, 1000000) k(k) ON k.k < ceil(n / 25.0)), a AS (SELECT series_id, k * 25 + j.j AS pos, start + j.j AS at, n FROM b JOIN range(0, 25) j(j) ON true)
  SELECT a.series_id, a.pos, s.value FROM a JOIN series s ON s.series_id = a.series_id AND s.pos = a.at WHERE a.pos < n""")
def y1_block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.block_bootstrap(event_series(spark, sf_dir), 25)


def _daily_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pastcast.sources.series import positions

    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts")).agg((F.avg("o_totalprice") / 1000 - 250).alias("delta"))
    return positions(o, series="id").select("id", F.col("pos").alias("k"), "delta")


@query("""WITH d AS (SELECT o_orderpriority AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) - 1 AS k, avg(o_totalprice) / 1000 - 250 AS delta FROM orders GROUP BY o_orderpriority, o_orderdate), n AS (SELECT id, count(*) AS n, avg(delta) AS mean FROM d GROUP BY 1),
  p AS (SELECT d.id, r.r, n.mean, ('0x' || substr(md5(concat_ws('|', d.id, d.k, r.r, 1)), 1, 12))::BIGINT % n.n AS k FROM d JOIN n USING (id) JOIN range(0, 200) r(r) ON true), m AS (SELECT p.id, r, mean, avg(delta) AS m FROM p JOIN d USING (id, k) GROUP BY 1, 2, 3)
  SELECT id, round(mean, 6) + 0.0 AS mean, round(list_sort(list(m))[5], 6) + 0.0 AS low, round(list_sort(list(m))[195], 6) + 0.0 AS high, round(least(1.0, 2 * least(avg((m <= 0)::INT), 1 - avg((m <= 0)::INT))), 6) AS p FROM m GROUP BY id, mean""")
def k13_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired bootstrap over 200 resamples drawn with replacement."""
    out = copies.paired_bootstrap(_daily_deltas(spark, sf_dir))
    return out.select("id", *[rounded(c).alias(c) for c in ("mean", "low", "high")], F.round("p", 6).alias("p"))


@query("""WITH r AS (SELECT l_suppkey % 50 AS slice_id, l_returnflag AS arm_id, round(avg(l_discount), 9) AS crps, round(avg(l_tax), 9) AS hit_rate, round(avg(l_quantity), 9) AS rt FROM lineitem GROUP BY 1, 2)
  SELECT a.slice_id, round(b.crps - a.crps, 6) + 0.0 AS crps_delta, round(b.hit_rate - a.hit_rate, 6) + 0.0 AS hit_delta, round(b.rt / a.rt, 6) AS runtime_ratio, b.crps - a.crps > 0.001 AS crps_flag, b.rt / a.rt > 1.02 AS slow_flag, NOT (b.crps - a.crps > 0.001) AND NOT (b.rt / a.rt > 1.02) AS keep FROM r a JOIN r b USING (slice_id) WHERE a.arm_id = 'A' AND b.arm_id = 'R'""")
def k11_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    r = li.groupBy((F.col("l_suppkey") % 50).alias("slice_id"), F.col("l_returnflag").alias("arm_id")).agg(*[F.round(F.avg(c), 9).alias(n) for c, n in (("l_discount", "crps"), ("l_tax", "hit_rate"), ("l_quantity", "rt_median"))])
    out = copies.compared_arms(r, "A", "R", 0.001, 1.02)
    return out.withColumns({c: rounded(c) for c in ("crps_delta", "hit_delta", "runtime_ratio")})


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.volatility_regime(event_series(spark, sf_dir)).select("series_id", "pos", "value", F.col("high").alias("label"))


_BLOCK = 10
_PICK = "('0x' || substr(md5(concat_ws('|', {parts})), 1, 12))::BIGINT"


@query(f"""WITH {SERIES}, d AS (SELECT series_id, pos, value, coalesce(value - lag(value) OVER (PARTITION BY series_id ORDER BY pos), 0.0) AS d FROM series),
  v AS (SELECT series_id, pos, value, stddev_pop(d) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol FROM d), cut AS (SELECT series_id, quantile_cont(vol, 0.5) AS cut FROM v GROUP BY 1),
  lb AS (SELECT series_id, pos, value, vol >= cut AS label FROM v JOIN cut USING (series_id)), fr AS (SELECT *, min(label::INT) OVER f AS lo, max(label::INT) OVER f AS hi, count(*) OVER f AS n FROM lb WINDOW f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {_BLOCK - 1} FOLLOWING)),
  st AS (SELECT series_id, label, pos AS start, row_number() OVER (PARTITION BY series_id, label ORDER BY pos) - 1 AS nth FROM fr WHERE n = {_BLOCK} AND lo = hi), pool AS (SELECT series_id, label, count(*) AS pool FROM st GROUP BY 1, 2),
  z AS (SELECT series_id, count(*) AS n, count(*) FILTER (label) AS high FROM lb GROUP BY 1), b AS (SELECT z.series_id, n, k.k, {_PICK.format(parts="z.series_id, k.k, 1, 'r'")} % n < high AS label FROM z JOIN range(0, 10000000) k(k) ON k.k < ceil(n / {_BLOCK}.0)),
  c AS (SELECT b.*, {_PICK.format(parts="b.series_id, b.k, 1")} % coalesce(pool, greatest(n - {_BLOCK - 1}, 1)) AS nth FROM b LEFT JOIN pool USING (series_id, label)), s AS (SELECT c.*, coalesce(st.start, c.nth) AS start FROM c LEFT JOIN st USING (series_id, label, nth))
  SELECT s.series_id, k * {_BLOCK} + j.j AS pos, r.value, s.label FROM s JOIN range(0, {_BLOCK}) j(j) ON k * {_BLOCK} + j.j < n JOIN series r ON r.series_id = s.series_id AND r.pos = s.start + j.j""")
def y2_regime_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies by blocks of one volatility regime each."""
    return copies.regime_bootstrap(stored(_labelled(spark, sf_dir)), _BLOCK)


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query()
def y3_copula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many made rows as lineitem has; held against numpy in the tests."""
    li = table(spark, sf_dir, "lineitem")
    return copies.copula(li, _COLUMNS, li.count()).select("id", *[F.round(c, 6).alias(c) for c in _COLUMNS])


@query()
def y5_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block copies (Y1) against their series: (partial) autocorrelations at lags 1, 5 and 10; held against numpy in the tests."""
    s = event_series(spark, sf_dir)
    out = relations.temporal_fidelity(s, copies.block_bootstrap(s, 25), [1, 5, 10])
    return out.select("series_id", "lag", F.round("acf", 6).alias("acf"), F.round("pacf", 6).alias("pacf"))
