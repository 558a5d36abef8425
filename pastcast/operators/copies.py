"""Copies of series by blocks, paired resampling, comparison of arms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pastcast.operators.sampling import normal
from pastcast.session import ship, stored
from pastcast.sources.series import framed, in_chunk


def hashed(n: Column, *parts: Column | str) -> Column:
    """A repeatable pick from 0 to n - 1 by 48 bits of the MD5 digest of the parts' text: any engine can draw it again."""
    key = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long"), n)


def _numbered(size: DataFrame, block: int) -> DataFrame:
    """A row per block of each series (series_id, n, ...), numbered k from 0, dealt to tasks."""
    return size.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1))).repartition("series_id", "k")


def block_bootstrap(rows: DataFrame, block: int, seed: int = 1) -> DataFrame:
    """(series_id, pos, value): each series rebuilt from blocks of its own values at hashed starts, as long as the original.

    Blocks are exploded from one row each and joined to the values by position, never by a broadcast: Spark takes exploded rows for as
    few as they come from.
    """
    size = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    blocks = _numbered(size, block)
    blocks = blocks.withColumn("start", hashed(F.greatest(F.col("n") - block + 1, F.lit(1)), "series_id", "k", F.lit(seed)))
    at = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).select("series_id", "n", (F.col("k") * block + F.col("j")).alias("to"), (F.col("start") + F.col("j")).alias("pos")).filter("to < n")
    return at.hint("merge").join(rows.select("series_id", "pos", "value"), ["series_id", "pos"]).select("series_id", F.col("to").alias("pos"), "value")


def pure_starts(labelled: DataFrame, block: int, size: int = 1 << 16) -> DataFrame:
    """(series_id, label, at, start): the starts of blocks whose rows all have one label, numbered from 0 per series and label.

    labelled: (series_id, pos, label). Blocks are frames ahead inside chunks; numbers are ranks inside a chunk and offsets of chunks.
    """
    ahead = in_chunk().rowsBetween(0, block - 1)
    cols = {"_lo": F.min("label").over(ahead), "_hi": F.max("label").over(ahead), "_n": F.count("label").over(ahead)}
    pure = framed(labelled.select("series_id", "pos", "label"), cols, after=block - 1, size=size).filter((F.col("_n") == block) & (F.col("_lo") == F.col("_hi")))
    pure = pure.select("series_id", "label", F.col("pos").alias("start"), F.floor(F.col("pos") / size).alias("_c"))
    n = pure.groupBy("series_id", "label", "_c").agg(F.count("*").alias("_n"))
    n = n.withColumn("_skip", F.sum("_n").over(Window.partitionBy("series_id", "label").orderBy("_c")) - F.col("_n")).drop("_n")
    k = F.row_number().over(Window.partitionBy("series_id", "label", "_c").orderBy("start"))
    return pure.withColumn("_k", k).join(n, ["series_id", "label", "_c"]).select("series_id", "label", (F.col("_skip") + F.col("_k") - 1).alias("at"), "start")


def regime_bootstrap(labelled: DataFrame, block: int, seed: int = 1) -> DataFrame:
    """(series_id, pos, value, label): each series rebuilt from blocks of one regime each, as long as the original.

    labelled: (series_id, pos, value, label), label boolean. A block's regime is drawn as often as it occurs, then one of its pure starts;
    a regime without any takes a start of the whole series. Label is the regime drawn.
    """
    size = labelled.groupBy("series_id").agg(F.count("*").alias("n"), F.count_if("label").alias("high"))
    starts = pure_starts(labelled, block)
    pool = starts.groupBy("series_id", "label").agg(F.count("*").alias("pool"))
    blocks = _numbered(size, block)
    blocks = blocks.withColumn("label", hashed(F.col("n"), "series_id", "k", F.lit(seed), F.lit("r")) < F.col("high")).join(pool, ["series_id", "label"], "left")
    blocks = blocks.withColumn("at", hashed(F.coalesce("pool", F.greatest(F.col("n") - block + 1, F.lit(1))), "series_id", "k", F.lit(seed)))
    blocks = blocks.join(starts, ["series_id", "label", "at"], "left").withColumn("start", F.coalesce("start", "at"))
    at = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).select("series_id", "n", "label", (F.col("k") * block + F.col("j")).alias("to"), (F.col("start") + F.col("j")).alias("pos")).filter("to < n")
    return at.hint("merge").join(labelled.select("series_id", "pos", "value"), ["series_id", "pos"]).select("series_id", F.col("to").alias("pos"), "value", "label")


_STEP = 1 / 256
_AT = np.arange(-9 * 256, 1) * _STEP
_BELOW = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in _AT])


def _density(z: np.ndarray) -> np.ndarray:
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def share_of(z: np.ndarray) -> np.ndarray:
    """Shares of the standard normal below z, by cubic pieces through a table's values and slopes; the upper half mirrors the lower.

    Below -9 the share of -9 (1e-19).
    """
    low = np.maximum(-np.abs(z), _AT[0])
    k = np.minimum(((low - _AT[0]) / _STEP).astype(int), len(_AT) - 2)
    t = (low - _AT[k]) / _STEP
    ends = _BELOW[k] * (1 + 2 * t) * (1 - t) ** 2 + _BELOW[k + 1] * t * t * (3 - 2 * t)
    p = ends + _STEP * t * (1 - t) * (_density(_AT[k]) * (1 - t) - _density(_AT[k + 1]) * t)
    return np.where(z > 0, 1 - p, p)


def score_of(u: np.ndarray) -> np.ndarray:
    """The z with a share u below it, u held in 1e-10 to 1 - 1e-10: the table's point, polished by Newton's steps."""
    u = np.clip(u, 1e-10, 1 - 1e-10)
    p = np.minimum(u, 1 - u)
    z = np.interp(p, _BELOW, _AT)
    for _ in range(3):
        z = z - (share_of(z) - p) / _density(z)
    return np.where(u > 0.5, -z, z)


@F.pandas_udf(DoubleType())
def _score(u: pd.Series) -> pd.Series:
    """Normal scores of shares."""
    return pd.Series(score_of(u.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _share(z: pd.Series) -> pd.Series:
    """Shares of normal scores."""
    return pd.Series(share_of(z.to_numpy(float)))


def distribution(rows: DataFrame, columns: list[str], cuts: int = 255) -> DataFrame:
    """(column, value, share): of each distinct value, the rows at or below it over one more than all rows.

    Equal values are counted before they meet; running sums are taken between approximate quantiles and then over one row per stretch.
    """
    item = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("i")
    count = rows.select(item).select("i.*").groupBy("column", "value").agg(F.count("*").alias("n"))
    edge = count.groupBy("column").agg(F.percentile_approx("value", [k / (cuts + 1) for k in range(1, cuts + 1)]).alias("e"), F.sum("n").alias("whole"))
    count = count.join(F.broadcast(edge), "column").withColumn("b", F.size(F.filter("e", lambda x: x < F.col("value")))).drop("e")  # a row per column
    part = count.groupBy("column", "b").agg(F.sum("n").alias("_s"))
    part = part.withColumn("_skip", F.sum("_s").over(Window.partitionBy("column").orderBy("b")) - F.col("_s")).drop("_s")
    inside = F.sum("n").over(Window.partitionBy("column", "b").orderBy("value"))
    return count.withColumn("_c", inside).join(part, ["column", "b"]).select("column", "value", ((F.col("_skip") + F.col("_c")) / (F.col("whole") + 1)).alias("share"))


def root_of(correlation: np.ndarray) -> np.ndarray:
    """A with A A' the nearest correlation matrix without negative eigenvalues."""
    value, vector = np.linalg.eigh(correlation)
    a = vector * np.sqrt(np.maximum(value, 1e-10))
    return a / np.linalg.norm(a, axis=1, keepdims=True)


#: Points of all columns' distributions, counted, that are broadcast.
POINTS = 1 << 21


def _curves(curve: DataFrame, columns: list[str], most: int) -> dict[str, tuple[np.ndarray, ...]]:
    """(value, share, score) of the columns with the fewest points, of at most so many together."""
    size = {r.column: r["count"] for r in curve.groupBy("column").count().collect()}  # a row per column
    order = sorted(columns, key=lambda c: size[c])
    few = [c for c, n in zip(order, np.cumsum([size[c] for c in order]), strict=True) if n <= most]
    if not few:
        return {}
    got = curve.filter(F.col("column").isin(few)).select(F.array_position(F.array(*map(F.lit, few)), F.col("column")).cast("int").alias("c"), "value", "share", "score").toArrow()
    at, *parts = (got.column(c).to_numpy() for c in ("c", "value", "share", "score"))
    order = np.lexsort((parts[0], at))
    cuts = np.searchsorted(at[order], np.arange(1, len(few) + 2))
    return {c: tuple(p[order[cuts[k] : cuts[k + 1]]] for p in parts) for k, c in enumerate(few)}


def copula(rows: DataFrame, columns: list[str], n: int, seed: int = 1, points: int = POINTS) -> DataFrame:
    """(id, columns): n made rows, id from 0, with the columns' own distributions and the correlation of their normal scores.

    Rows with a null in a column are left out; a column of one value keeps it. Scores are made once per distinct value; only the
    matrix of the columns' correlations and distributions of at most ``points`` points together reach the driver; those are broadcast,
    and neither rows nor made rows are shuffled for them. Made shares of other columns meet their distribution's points in buckets that
    hold the nearest point on either side too, so a bucket interpolates alone.
    """
    ship(rows.sparkSession)
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    ends = rows.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in columns]).first()
    alive = [c for c in columns if ends[c][0] != ends[c][1]]
    ids = rows.sparkSession.range(n)
    fixed = [F.lit(ends[c][0]).cast("double").alias(c) for c in columns if c not in alive]
    if not alive:
        return ids.select("id", *fixed)
    curve = stored(distribution(rows, alive).withColumn("score", _score("share")))
    known = _curves(curve, alive, points)
    few, many, shared = [c for c in alive if c in known], [c for c in alive if c not in known], rows.sparkSession.sparkContext.broadcast(known)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, c in enumerate(few):
                value, _, score = shared.value[c]
                found.append(pa.array(score[np.searchsorted(value, batch.column(k).to_numpy())]))
            yield pa.RecordBatch.from_arrays([*found, *batch.columns[len(few) :]], ["_" + c for c in few] + many)

    wide = rows.select(*few, *many).mapInArrow(scored, ", ".join([f"`_{c}` double" for c in few] + [f"`{c}` double" for c in many])) if few else rows
    for c in many:
        wide = wide.join(curve.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("score").alias("_" + c)), c)
    pairs = [(a, b) for a in range(len(alive)) for b in range(a)]
    found = wide.agg(F.count("*"), *[F.corr("_" + alive[a], "_" + alive[b]).alias(f"{a}_{b}") for a, b in pairs]).first()
    matrix = np.eye(len(alive))
    for a, b in pairs:
        matrix[a, b] = matrix[b, a] = found[f"{a}_{b}"]
    root = root_of(matrix)
    drawn = ids.withColumns({f"g{k}": normal("id", F.lit(k), F.lit(seed)) for k in range(len(alive))})
    z = [sum((F.col(f"g{k}") * float(root[i, k]) for k in range(len(alive))), F.lit(0.0)) for i in range(len(alive))]
    z = dict(zip(alive, z, strict=True))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array(np.interp(share_of(batch.column(k + 1).to_numpy()), shared.value[c][1], shared.value[c][0])) for k, c in enumerate(few)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], ["id", *few])

    direct = drawn.select("id", *[z[c].alias(c) for c in few]).mapInArrow(valued, ", ".join(["id long", *[f"`{c}` double" for c in few]]))
    if not many:
        return direct.select("id", *few, *fixed).select("id", *columns)
    curve = curve.filter(F.col("column").isin(many))
    made = drawn.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), z[c].alias("z")) for c in many])).alias("i")).select("id", "i.column", _share("i.z").alias("u"))
    buckets = min(max(n // 5000, 1), 1 << 16)
    bucket = lambda u: F.least(F.floor(F.col(u) * buckets), F.lit(buckets - 1)).cast("int").alias("b")
    points = curve.select("column", bucket("share"), F.struct("share", "value").alias("p"))
    side = points.groupBy("column", "b").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    grid = curve.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"), F.explode(F.array(*[F.lit(c) for c in many])).alias("column"))
    w = Window.partitionBy("column").orderBy("b")
    near = {"_lo": F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_hi": F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing))}
    grid = grid.join(side, ["column", "b"], "left").withColumns(near).select("column", "b", F.explode(F.array_compact(F.array("_lo", "_hi"))).alias("p"))
    points = points.unionByName(grid).select("column", "b", "p.share", "p.value")

    def draw(some: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values("share")
        value = np.interp(some["u"], near["share"], near["value"]) if len(some) else []
        return some[["id", "column"]].assign(value=value)

    out = made.withColumn("b", bucket("u")).groupBy("column", "b").cogroup(points.groupBy("column", "b")).applyInPandas(draw, "id long, column string, value double")
    out = out.groupBy("id").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in many])
    return (out.join(direct, "id") if few else out).select("id", *alive, *fixed).select("id", *columns)


def paired_bootstrap(deltas: DataFrame, resamples: int = 200, seed: int = 1) -> DataFrame:
    """(id, mean, low, high, p) of paired differences (id, k, delta), k from 0: percentile interval and two-sided p of the mean over hashed resamples.

    Picks are joined back by (id, k) and summed by map-side combine per resample.
    """
    size = deltas.groupBy("id").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"))
    picks = deltas.select("id", "k").join(size, "id").withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    picks = picks.select("id", "r", "mean", hashed(F.col("n"), "id", "k", "r", F.lit(seed)).alias("k"))
    means = picks.join(deltas, ["id", "k"]).groupBy("id", "r", "mean").agg(F.avg("delta").alias("m"))
    at = lambda q: F.get(F.sort_array(F.collect_list("m")), F.lit(int(q * resamples - 1) if q * resamples >= 1 else 0))
    low = F.avg((F.col("m") <= 0).cast("double"))
    return means.groupBy("id", "mean").agg(at(0.025).alias("low"), at(0.975).alias("high"), F.least(F.lit(1.0), 2 * F.least(low, 1 - low)).alias("p"))


def compared_arms(reports: DataFrame, base: str, new: str, worse: float = 0.02, slower: float = 2.0) -> DataFrame:
    """(slice_id, crps_delta, hit_delta, runtime_ratio, crps_flag, slow_flag, keep) of two arms' reports (slice_id, arm_id, crps, hit_rate, rt_median)."""
    side = lambda arm, s: reports.filter(F.col("arm_id") == arm).select("slice_id", *[F.col(c).alias(c + s) for c in ("crps", "hit_rate", "rt_median")])
    both = side(base, "_a").join(side(new, "_b"), "slice_id")
    out = both.select("slice_id", (F.col("crps_b") - F.col("crps_a")).alias("crps_delta"), (F.col("hit_rate_b") - F.col("hit_rate_a")).alias("hit_delta"), F.when(F.col("rt_median_a") > 0, F.col("rt_median_b") / F.col("rt_median_a")).alias("runtime_ratio"))
    out = out.withColumns({"crps_flag": F.col("crps_delta") > worse, "slow_flag": F.coalesce(F.col("runtime_ratio") > slower, F.lit(False))})
    return out.withColumn("keep", ~F.col("crps_flag") & ~F.col("slow_flag"))
