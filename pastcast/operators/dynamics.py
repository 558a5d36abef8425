"""Scores of reranked matches from their dynamics: Koopman spectra, wavelet leaders, transfer entropy; forward evolution."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastcast.session import ship

#: The low-pass decomposition filter of the Daubechies wavelet with four vanishing moments.
DB4 = [-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523]
#: Delay rows and their lag, modes, values that a window needs.
DIMS, LAG, MODES, LEAST = 8, 3, 8, 50


def delay_rows(x: np.ndarray, dims: int = DIMS, lag: int = LAG) -> np.ndarray:
    """Rows (x[i + (dims - 1) lag], ..., x[i]), the newest value first."""
    n = len(x) - (dims - 1) * lag
    return np.stack([x[k * lag : k * lag + n] for k in range(dims - 1, -1, -1)], axis=1)


def koopman_operator(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(operator, basis, delay rows) by a truncated SVD of successive delay rows; None for fewer than 50 values or flat ones."""
    if len(x) < LEAST or np.ptp(x) < 1e-12:
        return None
    rows = delay_rows(np.asarray(x, float))
    u, s, vt = np.linalg.svd(rows[:-1].T, full_matrices=False)
    k = int((s[:MODES] > 1e-12).sum())
    return (u[:, :k].T @ rows[1:].T @ vt[:k].T / s[:k], u[:, :k], rows) if k else None


def least_matching(cost: np.ndarray) -> float:
    """The least total of a one-to-one matching of the rows and columns of a small square table, over subsets of columns."""
    best = {0: 0.0}
    for row in cost:
        step: dict[int, float] = {}
        for used, total in best.items():
            for j, c in enumerate(row):
                if not used >> j & 1 and total + c < step.get(used | 1 << j, math.inf):
                    step[used | 1 << j] = total + c
        best = step
    return min(best.values())


def koopman_score(a: np.ndarray, b: np.ndarray) -> float:
    """exp(-d / 8) of the matching distance of the eigenvalues with a modulus above 0.05, the shorter list filled with zeros; 0 for short or flat windows."""
    one, two = koopman_operator(a), koopman_operator(b)
    if one is None or two is None:
        return 0.0
    p, q = (v[np.abs(v) > 0.05] for v in (np.linalg.eigvals(m[0]) for m in (one, two)))
    n = max(len(p), len(q))
    if not n:
        return 1.0
    p, q = (np.concatenate([v, np.zeros(n - len(v))]) for v in (p, q))
    return math.exp(-least_matching(np.abs(p[:, None] - q[None])) / MODES)


def evolved(values: np.ndarray, bars: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(moves, spread) of the next bars against the last value: the last delay row carried on by the operator, whose eigenvalues are drawn
    back to the unit circle; the spread is the one-step error times the root of the steps. None for short or flat windows."""
    made = koopman_operator(values)
    if made is None:
        return None
    a, u, rows = made
    w, v = np.linalg.eig(a)
    w = w * np.where(np.abs(w) > 1, 1 / np.maximum(np.abs(w), 1e-300), 1)
    try:
        start = np.linalg.solve(v, u.T @ rows[-1])
    except np.linalg.LinAlgError:
        return None
    steps = np.arange(1, bars + 1)
    ahead = (u[0] @ v @ (start[:, None] * w[:, None] ** steps)).real
    error = (rows[1:] - rows[:-1] @ u @ a.T @ u.T)[:, 0].std()
    last = float(values[-1])
    by = last if abs(last) > 1e-6 else 1.0
    return (ahead - last) / by, error * np.sqrt(steps) / abs(by)


def leaders(x: np.ndarray, most: int = 8) -> list[np.ndarray]:
    """Wavelet leaders, coarse levels first: the largest absolute detail of a place and its two neighbours."""
    low = np.array(DB4)
    high = low[::-1] * np.where(np.arange(8) % 2 == 0, -1, 1)
    out, a = [], np.asarray(x, float)
    for _ in range(max(1, min(most, int(math.log2(len(x) / 7))))):
        wide = np.pad(a, 7, mode="symmetric")
        d = np.abs(np.convolve(wide, high, "valid")[1::2])
        a = np.convolve(wide, low, "valid")[1::2]
        edge = np.pad(d, 1, mode="edge")
        out.append(np.maximum(np.maximum(edge[:-2], edge[1:-1]), edge[2:]) if len(d) >= 3 else d)
    return out[::-1]


def spectrum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, f) of the multifractal spectrum for moments -5 to 5 in halves, from the leaders' slopes over the logarithm of the level."""
    made, q = [np.maximum(v, 1e-15) for v in leaders(x)], np.arange(-5, 5.5, 0.5)
    if len(made) < 2:
        return np.array([0.5]), np.array([1.0])
    t = np.log2(np.arange(1, len(made) + 1))
    size = np.array([[np.log(v).mean() if k == 0 else np.log2((v**k).mean() + 1e-30) / abs(k) for v in made] for k in q])
    slope = np.where(size.std(axis=1) > 0, (size @ (t - t.mean())) / ((t - t.mean()) @ (t - t.mean())), 0.5)
    tau = q * slope - 1
    alpha = np.gradient(tau, q)
    f = q * alpha - tau
    ok = np.isfinite(alpha) & np.isfinite(f)
    return (alpha[ok], f[ok]) if ok.any() else (np.array([0.5]), np.array([1.0]))


def wavelet_score(a: np.ndarray, b: np.ndarray) -> float:
    """exp(-5 d) of the root mean square distance of two spectra on 50 points of the range they share, d = 1 if there is none; 0.5 for fewer than 16 values."""
    if min(len(a), len(b)) < 16:
        return 0.5
    (xa, fa), (xb, fb) = spectrum(a), spectrum(b)
    if min(len(xa), len(xb)) < 2:
        return math.exp(-2.5)
    lo, hi = max(xa.min(), xb.min()), min(xa.max(), xb.max())
    if lo >= hi:
        return math.exp(-5)
    grid = np.linspace(lo, hi, 50)
    return math.exp(-5 * math.sqrt(np.mean((np.interp(grid, xa, fa) - np.interp(grid, xb, fb)) ** 2)))


def flow(source: np.ndarray, target: np.ndarray, bins: int = 8) -> float:
    """``search.transfer_entropy`` of one pair of arrays, as far as both reach."""
    n = min(len(source), len(target))
    x, y = np.asarray(source[:n], float), np.asarray(target[:n], float)
    if n < 3 or np.ptp(x) < 1e-12 or np.ptp(y) < 1e-12:
        return 0.0
    place = lambda v: np.minimum(np.floor((v - v.min()) / np.ptp(v) * bins), bins - 1).astype(int)
    xp, yp, yf = place(x)[:-1], place(y)[:-1], place(y)[1:]

    def h(*parts: np.ndarray) -> float:
        code = np.zeros(n - 1, int)
        for p in parts:
            code = code * bins + p
        c = np.bincount(code)
        c = c[c > 0] / (n - 1)
        return float(-(c * np.log2(c)).sum())

    own = h(yf)
    return 0.0 if own < 1e-12 else min(1.0, max(0.0, h(yf, yp) + h(yp, xp) - h(yp) - h(yf, yp, xp)) / own)


def with_scores(pairs: DataFrame, scores: dict[str, tuple[str, str, Callable[[np.ndarray, np.ndarray], float]]]) -> DataFrame:
    """Adds a column per entry (column, column, function): for reranked rows, a few per query, spread over tasks as the rows are."""
    ship(pairs.sparkSession)

    def made(f: Callable) -> Callable:
        @F.pandas_udf("double")
        def score(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for x, y in columns:
                yield pd.Series([float(f(np.asarray(p, float), np.asarray(q, float))) for p, q in zip(x, y, strict=True)], dtype=float)

        return score

    for name, (a, b, f) in scores.items():
        pairs = pairs.withColumn(name, made(f)(a, b))
    return pairs


def with_evolution(rows: DataFrame, values: str, bars: int) -> DataFrame:
    """Adds moves and spread of the Koopman evolution of each window, arrays of ``bars`` numbers; null for short or flat windows."""
    ship(rows.sparkSession)

    @F.pandas_udf("moves array<double>, spread array<double>")
    def path(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in columns:
            got = [evolved(np.asarray(v, float), bars) for v in x]
            yield pd.DataFrame({"moves": [None if g is None else g[0].tolist() for g in got], "spread": [None if g is None else g[1].tolist() for g in got]})

    return rows.withColumn("_k", path(values)).select("*", "_k.moves", "_k.spread").drop("_k")
