"""Connected components of an edge table by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastcast.session import checkpointed


def _nearest(edges: DataFrame) -> DataFrame:
    """u with the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of undirected edges (u, v); component is its smallest node.

    Each round hangs larger neighbours on the smallest neighbour (large star), then
    smaller ones (small star), so a component becomes one star in a number of rounds
    that grows with the logarithm of its diameter. A round is two aggregations
    with map-side combine and two joins on the node, so a hub is spread by skew joins
    and never gathered into one row. Self loops give single nodes; null ends are ignored.
    Raises RuntimeError if max_rounds don't suffice.
    """
    edges = edges.select("u", "v").filter("u is not null and v is not null")
    star = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").filter("v > u or (v = u and m = u)").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _nearest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        star = checkpointed(small.filter("u >= v").distinct())
        now = star.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            return star.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
