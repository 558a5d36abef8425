"""Queries of tracks, with users' days standing in for storms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastcast.functions.common import rounded
from pastcast.operators import curves, tracks
from pastcast.plans.registry import registry
from pastcast.session import stored, table
from pastcast.sources.series import positions

QUERIES, ORACLES, query = registry()

_FIX = """fix AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, 20 + event_id % 17 AS lat, -60 - event_id % 23 AS lon, CASE WHEN event_id % 4 > 0 THEN value END AS wind FROM events),
  en AS (SELECT track_id, avg(lat) AS lat0, avg(lon) AS lon0 FROM fix GROUP BY 1 HAVING count(wind) >= 8),
  g AS (SELECT *, last_value(wind IGNORE NULLS) OVER b AS w0, last_value(CASE WHEN wind IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i0, first_value(wind IGNORE NULLS) OVER a AS w1, first_value(CASE WHEN wind IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS i1 FROM fix JOIN en USING (track_id)
    WINDOW b AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  t AS (SELECT track_id, idx, (lon - lon0) * 111.32 * cos(radians(lat0)) AS x, (lat - lat0) * 111.32 AS y, 5 * CASE WHEN wind IS NOT NULL THEN wind WHEN w0 IS NULL THEN w1 WHEN w1 IS NULL THEN w0 ELSE w0 + (w1 - w0) * (idx - i0) / (i1 - i0) END AS z FROM g)"""


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = positions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "event_id", series="user_id")  # a track is one user's rows
    k = F.col("event_id")
    return e.select(F.col("user_id").alias("track_id"), F.col("pos").alias("idx"), (20 + k % 17).alias("lat"), (-60 - k % 23).alias("lon"), F.when(k % 4 > 0, F.col("value")).alias("wind"))


@query(f"""WITH {_FIX} SELECT track_id, idx, round(x, 8) + 0.0 AS x, round(y, 8) + 0.0 AS y, round(z, 5) AS z FROM t""")
def t1_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracks.prepared(fixes(spark, sf_dir))
    return out.select("track_id", F.col("idx").cast("long").alias("idx"), rounded("x", 8).alias("x"), rounded("y", 8).alias("y"), F.round("z", 5).alias("z"))


@query(f"""WITH {_FIX}, m AS (SELECT DISTINCT track_id % 3 AS q, track_id, 4 AS e, 1.0 + track_id % 5 AS weight FROM t), l AS (SELECT q, track_id, weight, 'x' AS axis, idx, x AS v FROM m JOIN t USING (track_id) UNION ALL SELECT q, track_id, weight, 'y', idx, y FROM m JOIN t USING (track_id) UNION ALL SELECT q, track_id, weight, 'z', idx, z FROM m JOIN t USING (track_id)),
  p AS (SELECT b.q, b.axis, b.track_id, b.weight, b.idx - 4 AS bar, round(b.v - a.v, 9) AS ret FROM l a JOIN l b ON a.track_id = b.track_id AND a.axis = b.axis AND a.idx = 3 AND b.idx BETWEEN 4 AND 7 WHERE b.track_id IN (SELECT track_id FROM t GROUP BY 1 HAVING max(idx) >= 7)),
  w AS (SELECT *, weight / sum(weight) OVER (PARTITION BY q, axis, bar) AS w FROM p), c AS (SELECT *, sum(w) OVER (PARTITION BY q, axis, bar ORDER BY ret, weight, track_id ROWS UNBOUNDED PRECEDING) - w / 2 AS c FROM w),
  n AS (SELECT *, row_number() OVER o AS k, lead(c) OVER o AS c2, lead(ret) OVER o AS r2 FROM c WINDOW o AS (PARTITION BY q, axis, bar ORDER BY ret, weight, track_id))
  SELECT q, axis, bar, pct.p AS pct, round(max(CASE WHEN k = 1 AND pct.p / 100.0 <= c THEN ret WHEN c2 IS NULL AND pct.p / 100.0 >= c THEN ret WHEN pct.p / 100.0 > c AND pct.p / 100.0 <= c2 THEN ret + (pct.p / 100.0 - c) / (c2 - c) * (r2 - ret) END), 8) + 0.0 AS value FROM n JOIN (SELECT unnest([10, 50, 90]) AS p) pct ON true GROUP BY ALL""")
def t6_axis_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks.prepared(fixes(spark, sf_dir))
    m = t.select((F.col("track_id") % 3).alias("q"), "track_id", F.lit(4).alias("end"), (F.lit(1.0) + F.col("track_id") % 5).alias("weight")).distinct()
    return tracks.axis_cone(m, t, 4, ["q"]).select("q", "axis", F.col("bar").cast("long").alias("bar"), "pct", rounded("value", 8).alias("value"))


_POINTS = 50


_ALONG = f"""l AS (SELECT *, lag(x) OVER o AS x0, lag(y) OVER o AS y0, lag(z) OVER o AS z0 FROM t WINDOW o AS (PARTITION BY track_id ORDER BY idx)),
  d AS (SELECT *, coalesce(sqrt((x - x0) ** 2 + (y - y0) ** 2 + (z - z0) ** 2), 0.0) AS d FROM l),
  c AS (SELECT *, sum(d) OVER (PARTITION BY track_id ORDER BY idx) AS c, sum(d) OVER (PARTITION BY track_id) / {_POINTS - 1} AS step FROM d),
  j AS (SELECT *, floor(round(c / step, 9)) AS upto, CASE WHEN round((c - d) / step, 9) <= 0 THEN 0 ELSE floor(round((c - d) / step, 9)) + 1 END AS lo FROM c WHERE step > 0 AND d > 0),
  r AS (SELECT j.*, k.j, greatest(0.0, least(1.0, (k.j * step - (c - d)) / d)) AS f FROM j JOIN range(0, {_POINTS}) k(j) ON k.j >= lo AND k.j <= upto)"""


@query(f"""WITH {_FIX}, {_ALONG}
  SELECT track_id, j, round(x0 + f * (x - x0), 4) + 0.0 AS x, round(y0 + f * (y - y0), 4) + 0.0 AS y, round(z0 + f * (z - z0), 4) + 0.0 AS z FROM r""")
def t2_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curves.resampled(tracks.prepared(fixes(spark, sf_dir)), _POINTS)
    return out.select("track_id", "j", rounded("x", 4).alias("x"), rounded("y", 4).alias("y"), rounded("z", 4).alias("z"))


@query(f"""WITH {_FIX}, {_ALONG}, q AS (SELECT track_id, j, x0 + f * (x - x0) AS x, y0 + f * (y - y0) AS y, z0 + f * (z - z0) AS z FROM r),
  s AS (SELECT track_id, j, lead(x) OVER o - x AS dx, lead(y) OVER o - y AS dy, lead(z) OVER o - z AS dz FROM q WINDOW o AS (PARTITION BY track_id ORDER BY j)),
  n AS (SELECT *, sqrt(dx ** 2 + dy ** 2 + dz ** 2) AS n FROM s WHERE dx IS NOT NULL),
  u AS (SELECT track_id, j, avg(n) OVER (PARTITION BY track_id) AS step, CASE WHEN n > 1e-12 THEN dx / n ELSE 0.0 END AS ax, CASE WHEN n > 1e-12 THEN dy / n ELSE 0.0 END AS ay, CASE WHEN n > 1e-12 THEN dz / n ELSE 0.0 END AS az FROM n),
  v AS (SELECT *, lead(ax) OVER o AS bx, lead(ay) OVER o AS by_, lead(az) OVER o AS bz FROM u WINDOW o AS (PARTITION BY track_id ORDER BY j)),
  w AS (SELECT track_id, j, CASE WHEN step > 0 THEN step ELSE 1 END AS step, bx - ax AS ix, by_ - ay AS iy, bz - az AS iz, ay * bz - az * by_ AS cx, az * bx - ax * bz AS cy, ax * by_ - ay * bx AS cz FROM v WHERE bx IS NOT NULL),
  a AS (SELECT *, sqrt(ix ** 2 + iy ** 2 + iz ** 2) AS turn, sqrt(cx ** 2 + cy ** 2 + cz ** 2) AS sine FROM w),
  tw AS (SELECT track_id, j, step, turn, sine, CASE WHEN turn > 1e-12 THEN ix / turn ELSE 0.0 END AS ix, CASE WHEN turn > 1e-12 THEN iy / turn ELSE 0.0 END AS iy, CASE WHEN turn > 1e-12 THEN iz / turn ELSE 0.0 END AS iz, CASE WHEN sine > 1e-12 THEN cx / sine ELSE 0.0 END AS cx, CASE WHEN sine > 1e-12 THEN cy / sine ELSE 0.0 END AS cy, CASE WHEN sine > 1e-12 THEN cz / sine ELSE 0.0 END AS cz FROM a),
  k AS (SELECT track_id, j, turn / step AS curvature, CASE WHEN sine < 0.02 THEN 0.0 ELSE -((lead(cx) OVER o - cx) * ix + (lead(cy) OVER o - cy) * iy + (lead(cz) OVER o - cz) * iz) / step END AS torsion FROM tw WINDOW o AS (PARTITION BY track_id ORDER BY j)),
  ga AS (SELECT s.sigma, i.i AS j, CASE WHEN m.m < {_POINTS} THEN m.m ELSE {2 * _POINTS - 1} - m.m END AS p, sum(exp(-0.5 * (o.o / s.sigma) ** 2)) AS w FROM (SELECT unnest([1.0, 4.0, 16.0])::DOUBLE AS sigma) s JOIN range(0, {_POINTS}) i(i) ON true JOIN range(-64, 65) o(o) ON abs(o.o) <= 4 * s.sigma,
    LATERAL (SELECT (i.i + o.o + {4 * _POINTS}) % {2 * _POINTS} AS m) m GROUP BY 1, 2, 3),
  h AS (SELECT sigma, j, p, w / sum(w) OVER (PARTITION BY sigma, j) AS w FROM ga)
  SELECT kc.track_id, sigma, h.j::INT AS j, round(sum(h.w * kc.curvature), 6) + 0.0 AS curvature, round(sum(h.w * kt.torsion), 6) + 0.0 AS torsion FROM h JOIN k kc ON kc.j = least(h.p, {_POINTS - 3}) JOIN k kt ON kt.track_id = kc.track_id AND kt.j = least(h.p, {_POINTS - 4}) GROUP BY 1, 2, 3""")
def t3_bends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curvature and torsion of every track at three scales; the numbers are held against loops in the tests."""
    out = curves.multiscale(curves.resampled(tracks.prepared(fixes(spark, sf_dir)), _POINTS))
    return out.select("track_id", "sigma", F.posexplode(F.arrays_zip("curvature", "torsion")).alias("j", "b")).select("track_id", "sigma", "j", F.round("b.curvature", 6).alias("curvature"), rounded("b.torsion").alias("torsion"))


@query()
def t4_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of fifty fixes at every fifth start that twenty fixes follow, with their symbols."""
    out = curves.corpus(tracks.prepared(fixes(spark, sf_dir)))
    return out.select("track_id", "start", "symbols", F.round(F.array_max("curvature"), 6).alias("sharpest"))


@query()
def t5_track_analogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest windows of other tracks to the last fifty fixes of every hundredth track; held against brute force in the tests."""
    t = stored(tracks.prepared(fixes(spark, sf_dir)))
    out = curves.curve_analogues(stored(curves.last_curves(t.filter("track_id % 100 = 0"))), stored(curves.corpus(t)))
    return out.withColumns({c: F.round(c, 6) for c in ("distance", "similarity")})
