"""Curves in space: even spacing, curvature and torsion, a corpus of windows and their analogues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastcast.functions.common import total
from pastcast.operators.relations import met
from pastcast.operators.search import sax
from pastcast.session import ship, with_fields
from pastcast.sources.series import chunked

#: Sine of the turn between two steps below which a curve counts as straight and has no torsion.
STRAIGHT = 0.02
_TINY = 1e-12


def resampled(tracks: DataFrame, n: int, size: int = 1 << 16) -> DataFrame:
    """(track_id, j, x, y, z): n points evenly spaced along each track (track_id, idx, x, y, z), both ends included.

    Lengths are summed inside chunks of positions and then over one row per chunk; each segment makes the points that fall on it.
    A track of one point, or of no length, has no rows. idx is 0, 1, ... without gaps.
    """
    inside = Window.partitionBy("track_id", "chunk").orderBy("pos")
    rows = chunked(tracks.withColumnRenamed("idx", "pos"), before=1, size=size).withColumns({c + "0": F.lag(c).over(inside) for c in "xyz"}).filter("core")
    d = F.coalesce(F.sqrt(sum(((F.col(c) - F.col(c + "0")) ** 2 for c in "xyz"), F.lit(0.0))), F.lit(0.0))
    rows = rows.withColumn("d", d).withColumn("c", F.sum("d").over(inside))
    part = rows.groupBy("track_id", "chunk").agg(F.sum("d").alias("_s"), F.max("pos").alias("_last"))
    w = Window.partitionBy("track_id")
    part = part.withColumns({"base": F.sum("_s").over(w.orderBy("chunk")) - F.col("_s"), "whole": F.sum("_s").over(w), "last": F.max("_last").over(w)}).drop("_s", "_last")
    rows = rows.join(part, ["track_id", "chunk"]).filter((F.col("whole") > 0) & (F.col("d") > 0)).withColumn("c", F.col("base") + F.col("c"))
    step = F.col("whole") / (n - 1)
    upto = lambda c: F.floor(F.round(c / step, 9))
    prior = F.col("c") - F.col("d")
    first = F.when(F.round(prior / step, 9) <= 0, 0).otherwise(upto(prior) + 1)
    made = rows.withColumn("_to", F.least(upto(F.col("c")), F.lit(n - 1))).withColumn("_from", first).filter("_from <= _to")
    made = made.withColumn("j", F.explode(F.sequence("_from", "_to")))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("j") * step - prior) / F.col("d")))
    return made.select("track_id", "j", *[(F.col(c + "0") + t * (F.col(c) - F.col(c + "0"))).alias(c) for c in "xyz"])


def _evened(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (m, n, 3) redrawn to n even steps along their length, and which of them have a length and finite values."""
    length = np.linalg.norm(np.diff(points, axis=1), axis=2)
    along = np.concatenate([np.zeros((len(points), 1)), np.cumsum(length, axis=1)], axis=1)
    good = np.isfinite(along[:, -1]) & (along[:, -1] > 0)
    out = np.zeros_like(points)
    for k in np.flatnonzero(good):
        at = np.linspace(0.0, along[k, -1], points.shape[1])
        out[k] = np.stack([np.interp(at, along[k], points[k, :, a]) for a in range(3)], axis=1)
    return out, good


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over axis 1, cut at four deviations, mirrored at the ends with the end value repeated."""
    if sigma <= 0:
        return x
    reach = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    wide = np.pad(x, [(0, 0), (reach, reach)] + [(0, 0)] * (x.ndim - 2), mode="symmetric")
    return np.lib.stride_tricks.sliding_window_view(wide, len(k), axis=1) @ (k / k.sum())


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.linalg.norm(v, axis=2)
    return np.divide(v, size[..., None], out=np.zeros_like(v), where=size[..., None] > _TINY), size


def bends(points: np.ndarray, sigma: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Curvature and torsion (m, n) of windows (m, n, 3) of at least four evenly spaced points; the last values are repeated to the end."""
    steps = np.diff(points, axis=1)
    along, size = _unit(steps)
    step = size.mean(axis=1, keepdims=True)
    step = np.where(step > 0, step, 1.0)
    inward, turn = _unit(np.diff(along, axis=1))
    across, sine = _unit(np.cross(along[:, :-1], along[:, 1:]))
    twist = -(np.diff(across, axis=1) * inward[:, :-1]).sum(axis=2) / step
    twist[sine[:, :-1] < STRAIGHT] = 0.0
    n = points.shape[1]
    fill = lambda v: np.pad(v, [(0, 0), (0, n - v.shape[1])], mode="edge")
    return smoothed(fill(turn / step), sigma), smoothed(fill(twist), sigma)


def multiscale(points: DataFrame, sigmas: tuple[float, ...] = (1.0, 4.0, 16.0)) -> DataFrame:
    """(track_id, sigma, curvature, torsion) of resampled tracks (track_id, j, x, y, z) of the same number of points, at least four."""
    ship(points.sparkSession)
    curves = points.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("j", F.array("x", "y", "z").alias("p")))).alias("s"))  # n points each
    curves = curves.select("track_id", F.col("s.p").alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            xyz = np.array([np.stack(p) for p in pdf["p"]])
            for sigma in sigmas:
                k, t = bends(xyz, sigma)
                yield pd.DataFrame({"track_id": pdf["track_id"], "sigma": sigma, "curvature": list(k), "torsion": list(t)})

    return curves.mapInPandas(run, with_fields(curves.select("track_id"), "sigma double, curvature array<double>, torsion array<double>"))


def corpus(tracks: DataFrame, width: int = 50, stride: int = 5, ahead: int = 20, sigma: float = 1.5, sigma_points: float = 2.0, parts: int = 8, alphabet: int = 4, size: int = 4096) -> DataFrame:
    """(track_id, start, curvature, torsion, symbols) of every window at multiples of the stride that ``ahead`` fixes follow.

    Windows are evened by length, smoothed and described; the symbols are those of curvature plus the torsion's size, z-scored. A
    task holds a stretch of a track with the fixes that its last windows need. Windows without length or with missing values are left out.
    """
    ship(tracks.sparkSession)
    size = max(-(-size // stride) * stride, -(-(width + ahead) // stride) * stride)
    parted = chunked(tracks.select("track_id", F.col("idx").alias("pos"), "x", "y", "z"), after=width + ahead - 1, size=size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        at = np.arange(0, min(size, len(pdf) - width - ahead + 1), stride)
        none = pd.DataFrame(columns=["track_id", "start", "curvature", "torsion", "proxy"], dtype=object)
        if not len(at):
            return none
        xyz = pdf[["x", "y", "z"]].to_numpy(dtype=float)
        even, good = _evened(np.lib.stride_tricks.sliding_window_view(xyz, width, axis=0)[at].transpose(0, 2, 1))
        if not good.any():
            return none
        k, t = bends(smoothed(even[good], sigma_points), sigma)
        proxy = k + np.abs(t)
        d = proxy.std(axis=1, keepdims=True)
        z = np.divide(proxy - proxy.mean(axis=1, keepdims=True), d, out=np.zeros_like(proxy), where=d >= 1e-9)
        return pd.DataFrame({"track_id": pdf["track_id"].iloc[0], "start": pdf["pos"].iloc[0] + at[good], "curvature": list(k), "torsion": list(t), "proxy": list(z)})

    made = parted.groupBy("track_id", "chunk").applyInPandas(run, with_fields(tracks.select("track_id"), "start long, curvature array<double>, torsion array<double>, proxy array<double>"))
    return made.withColumn("symbols", sax(F.col("proxy"), width, parts, alphabet)).drop("proxy")


def last_curves(tracks: DataFrame, width: int = 50, **settings) -> DataFrame:
    """(query_id, track_id, start, curvature, torsion, symbols): the last ``width`` fixes of each track, described as the corpus is."""
    end = tracks.groupBy("track_id").agg(F.max("idx").alias("_end"))
    tail = tracks.join(end, "track_id").withColumn("idx", F.col("idx") - (F.col("_end") - width + 1)).filter("idx >= 0")
    made = corpus(tail.drop("_end"), width, ahead=0, **settings).filter("start = 0").join(end, "track_id")
    return made.select(F.col("track_id").alias("query_id"), "track_id", (F.col("_end") - width + 1).alias("start"), "curvature", "torsion", "symbols")


def _warped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Warping distances of pairs of sequences (m, n, 2), all pairs at once, row by row."""
    cost = np.sqrt(((a[:, :, None] - b[:, None]) ** 2).sum(axis=3))
    row = np.cumsum(cost[:, 0], axis=1)
    for i in range(1, cost.shape[1]):
        best = np.minimum(row, np.concatenate([np.full((len(row), 1), np.inf), row[:, :-1]], axis=1))
        new = np.empty_like(row)
        left = np.full(len(row), np.inf)
        for j in range(row.shape[1]):
            left = new[:, j] = cost[:, i, j] + np.minimum(best[:, j], left)
        row = new
    return row[:, -1]


def curve_analogues(queries: DataFrame, windows: DataFrame, k: int = 10, shortlist: int | None = None) -> DataFrame:
    """(query_id, rank, track_id, start, distance, similarity): the k windows of other tracks nearest each query's curvature and torsion.

    The windows whose symbols differ least (ties by track and start) are warped, max(4k, 32) unless said otherwise; similarity is
    exp(-distance / width). Ranking by symbols moves no sequences. Queries meet windows as in ``relations.nearest``.
    """
    ship(queries.sparkSession)
    most = shortlist or max(4 * k, 32)
    q = queries.select("query_id", F.col("track_id").alias("_own"), F.col("symbols").alias("_s"))
    pairs, keys = met(windows.select("track_id", "start", "symbols"), q, ["track_id", "start"])
    pairs = pairs.filter(F.col("track_id") != F.col("_own")).withColumn("gap", total(F.zip_with("symbols", "_s", lambda x, y: F.abs(x - y).cast("double"))))
    for by in dict.fromkeys([tuple(keys), ("query_id",)]):
        pairs = pairs.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("gap", "track_id", "start"))).filter(F.col("place") <= most)
    short = pairs.select("query_id", "track_id", "start", "place").join(windows.drop("symbols"), ["track_id", "start"])
    both = short.join(queries.select("query_id", F.col("curvature").alias("_k"), F.col("torsion").alias("_t")), "query_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            side = lambda u, v: np.stack([np.stack(pdf[u].to_list()), np.stack(pdf[v].to_list())], axis=2)
            a, b = side("_k", "_t"), side("curvature", "torsion")
            d = np.concatenate([_warped(a[i : i + 256], b[i : i + 256]) for i in range(0, len(pdf), 256)])
            yield pdf[["query_id", "track_id", "start", "place"]].assign(distance=d, similarity=np.exp(-d / a.shape[1]))

    out = both.mapInPandas(run, with_fields(both.select("query_id", "track_id", "start", "place"), "distance double, similarity double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "place"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "track_id", "start", "distance", "similarity")
