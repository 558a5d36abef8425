"""Storm tracks: gaps filled, local kilometres, three-axis cones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastcast.operators.projection import cone
from pastcast.sources.series import known_around

KM_PER_DEGREE = 111.32


def prepared(fixes: DataFrame, least: int = 8, wind_scale: float = 5.0, size: int = 1 << 16) -> DataFrame:
    """(track_id, idx, x, y, z) of tracks with enough winds: winds interpolated by index, ends held, then kilometres about the track's mean place.

    fixes: (track_id, idx, lat, lon, wind). A track of any length is worked on in stretches of ``size`` fixes.
    """
    enough = fixes.groupBy("track_id").agg(F.count("wind").alias("n"), F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0")).filter(F.col("n") >= least)
    rows = known_around(fixes.join(enough, "track_id"), "track_id", "idx", "wind", size)
    w0, i0, w1, i1 = F.col("before.value"), F.col("before.at"), F.col("after.value"), F.col("after.at")
    mid = w0 + (w1 - w0) * (F.col("idx") - i0) / (i1 - i0)
    wind = F.when(F.col("wind").isNotNull(), F.col("wind")).when(w0.isNull(), w1).when(w1.isNull(), w0).otherwise(mid)
    x = (F.col("lon") - F.col("lon0")) * KM_PER_DEGREE * F.cos(F.radians("lat0"))
    return rows.select("track_id", "idx", x.alias("x"), ((F.col("lat") - F.col("lat0")) * KM_PER_DEGREE).alias("y"), (wind * wind_scale).alias("z"))


def axis_cone(matches: DataFrame, tracks: DataFrame, bars: int, keys: list[str], percentiles: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """(keys, axis, bar, pct, value): weighted quantiles of how far each axis moved after the matches (keys, track_id, end, weight)."""
    at = matches.withColumn("bar", F.explode(F.sequence(F.lit(0), F.lit(bars)))).withColumn("idx", F.col("end") - 1 + F.col("bar"))
    met = at.join(tracks, ["track_id", "idx"])
    axis = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v")) for c in "xyz"]))
    long = met.select(*keys, "track_id", "end", "weight", "bar", axis.alias("a")).select(*keys, "track_id", "end", "weight", "bar", "a.*")
    whole = Window.partitionBy(*keys, "track_id", "end", "axis")
    long = long.withColumns({"v0": F.max(F.when(F.col("bar") == 0, F.col("v"))).over(whole), "n": F.count("*").over(whole)})
    moved = long.filter((F.col("n") == bars + 1) & (F.col("bar") > 0)).select(*keys, "axis", "track_id", "end", "weight", (F.col("bar") - 1).alias("bar"), F.round(F.col("v") - F.col("v0"), 9).alias("ret"))
    return cone(moved, [*keys, "axis"], percentiles=percentiles)
