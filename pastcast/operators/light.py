"""The light analogue of a series' last window, at several scales, with what followed it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastcast.operators.search import last_windows
from pastcast.operators.windows import chunk_arrays, scaled_widths
from pastcast.session import ship, with_fields


def _shapes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Z-scored log returns of each row, zeros where they are equal, and its whole log return."""
    logs = np.log(np.maximum(v, 1e-12))
    r = np.diff(logs, axis=1)
    r = r - r.mean(axis=1, keepdims=True)
    sd = np.sqrt((r * r).mean(axis=1, keepdims=True))
    return r / np.where(sd == 0, 1, sd), logs[:, -1] - logs[:, 0]


def light_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``search.with_light_score`` of one window against each row of c."""
    (a, whole), (b, moved) = _shapes(q[None]), _shapes(c)
    score = 100 * (0.65 * np.maximum(0, ((a * b).mean(axis=1) + 1) / 2) + 0.2 * np.exp(-np.abs(a - b).mean(axis=1)) + 0.15 * np.exp(-2 * np.abs(whole - moved)))
    return np.clip(score, 0, 100)


def resampled_rows(v: np.ndarray, n: int) -> np.ndarray:
    """Each row at n even places, linearly."""
    x = np.arange(n) * (v.shape[1] - 1) / float(n - 1)
    k = np.minimum(np.floor(x).astype(int), v.shape[1] - 1)
    a, b = v[:, k], v[:, np.minimum(k + 1, v.shape[1] - 1)]
    return a + (x - k) * (b - a)


def light_analogues(
    rows: DataFrame, width: int, ahead: int, lookback: int | None = None, stride: int = 5, separation: int = 20, scales: tuple[float, ...] = (0.75, 1.0, 1.25, 1.5)
) -> DataFrame:
    """(series_id, scale, start, end, score, prices, end_return, min_return, max_return): each series' best window before its last one.

    Windows of ``width`` times each scale (8 at least) are resampled to ``width`` and scored. They end at least ``width + separation + ahead``
    values before the last value, at multiples of ``stride`` from there, and at most ``lookback`` values before it (all, if None). Of equal
    scores the smaller scale wins, then the later window. ``end`` is the window's last position; ``prices`` are the ``ahead`` values after it,
    moved to the series' last value. Each stretch of a series gives its best window. A series of fewer than ``width + separation + ahead + 2`` values, or without a window, has no row.
    """
    nearest = width + separation + ahead
    q = last_windows(rows, width).select("series_id", F.col("values").alias("q"), (F.col("q_start") + width).alias("n")).filter(F.col("n") >= nearest + 2)
    sizes = [max(8, w) for w in scaled_widths(width, scales)]
    ship(rows.sparkSession)

    def best_of(first: int, size: int, n: int, v: np.ndarray, q: np.ndarray) -> tuple | None:
        """The best window that starts in a stretch of the series."""
        found = []
        for k, w in enumerate(sizes):
            starts = np.arange(max(min(size, len(v) - w - ahead + 1), 0))
            ago = n - (first + starts) - w
            starts = starts[(ago >= nearest) & ((ago - nearest) % stride == 0) & (ago <= (n if lookback is None else lookback))]
            if len(starts):
                past = np.lib.stride_tricks.sliding_window_view(v, w)[starts]
                score = light_scores(q, resampled_rows(past, width))
                place = np.round(score, 9)
                if np.isfinite(place).any():
                    at = np.flatnonzero(place == np.nanmax(place))[-1]
                    found.append((place[at], -k, int(starts[at]), float(score[at])))
        if not found:
            return None
        _, k, start, score = max(found)
        end = start + sizes[-k]
        return -k, float(scales[-k]), first + start, first + end - 1, score, float(q[-1]), float(v[end - 1]), v[end : end + ahead].tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(r.series_id, *b) for r in pdf.itertuples() if (b := best_of(r.first, r.size_, r.n, np.asarray(r.values_, float), np.asarray(r.q, float)))]
            yield pd.DataFrame(got, columns=["series_id", "k", "scale", "start", "end", "score", "price", "anchor", "after"])

    parts = chunk_arrays(rows, max(sizes) + ahead).join(q, "series_id").select("series_id", "first", F.col("size").cast("long").alias("size_"), "n", F.col("values").cast("array<double>").alias("values_"), "q")
    scored = parts.mapInPandas(run, with_fields(parts.select("series_id"), "k int, scale double, start long, end long, score double, price double, anchor double, after array<double>"))
    order = F.struct(F.round("score", 9).alias("score"), (-F.col("k")).alias("k"), F.col("end"))
    best = scored.groupBy("series_id").agg(F.max(F.struct(order.alias("o"), "scale", "start", "price", "anchor", "after")).alias("b"))
    base = F.greatest(F.col("b.anchor"), F.lit(1e-12))
    best = best.withColumn("r", F.transform("b.after", lambda v: v / base - 1))
    return best.select(
        "series_id", "b.scale", "b.start", "b.o.end", "b.o.score", F.transform("r", lambda x: F.col("b.price") * (1 + x)).alias("prices"),
        F.element_at("r", -1).alias("end_return"), F.array_min("r").alias("min_return"), F.array_max("r").alias("max_return"),
    )
