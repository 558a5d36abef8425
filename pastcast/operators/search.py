"""Analogue search: query windows against all candidate windows of all series."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.functions.common import pair_sum, total
from pastcast.operators.windows import CHUNK, chunk_arrays, deviation, log_returns, mean, scaled
from pastcast.session import ship

#: Fixed weights of the scoring methods.
WEIGHTS = {"bempedelis_r2": 0.20, "bempedelis_smoothness": 0.10, "koopman": 0.20, "wavelet_spectrum": 0.15, "emd": 0.10, "tda": 0.08, "dtw": 0.07, "pearson_warped": 0.05, "transfer_entropy": 0.05}
#: Queries that are broadcast at most, and those of a block beyond that.
MAX_QUERIES, BLOCK = 10_000, 100


def breakpoints(alphabet: int) -> list[float]:
    """Cuts of the normal distribution into equal parts."""
    return [NormalDist().inv_cdf(k / alphabet) for k in range(1, alphabet)]


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """[start, end) of each segment mean; neighbours may share an element; every element alone if parts >= n."""
    if parts >= n:
        return [(k, k + 1) for k in range(n)]
    return [(k * n // parts, -(-(k + 1) * n // parts)) for k in range(parts)]


def sax(z: Column, n: int, parts: int = 16, alphabet: int = 8) -> Column:
    """Symbols 0 to alphabet - 1 of a z-scored window of n values."""
    cuts = breakpoints(alphabet)
    out = []
    for a, b in segments(n, parts):
        m = total(F.slice(z, a + 1, b - a)) / float(b - a)
        out.append(sum((F.when(m > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    return F.array(*out)


def mindist(a: Column, b: Column, n: int, alphabet: int = 8) -> Column:
    """Lower bound of the distance of two windows of n values from their symbols."""
    cuts = F.array(*[F.lit(c) for c in breakpoints(alphabet)])
    gap = F.zip_with(a, b, lambda x, y: F.when(F.abs(x - y) <= 1, 0.0).otherwise(F.get(cuts, F.greatest(x, y) - 1) - F.get(cuts, F.least(x, y))))
    return F.sqrt(F.lit(float(n)) / F.size(a)) * F.sqrt(total(F.transform(gap, lambda g: g * g)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays, null if either is flat."""
    da, db = deviation(a), deviation(b)
    return F.when((da != 0) & (db != 0), (pair_sum(a, b) / F.size(a) - mean(a) * mean(b)) / (da * db))


def _scores(windows: np.ndarray, queries: np.ndarray, parts: int, alphabet: int, methods: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(score, correlation) of every window with every query; queries are z-scored, flat ones zero."""
    n = windows.shape[1]
    m = windows.mean(axis=1, keepdims=True)
    d = windows.std(axis=1, keepdims=True)
    z = np.divide(windows - m, d, out=np.zeros_like(windows), where=d > 1e-10)
    corr = z @ queries.T / n
    live = (d > 1e-10) & (np.abs(queries).sum(axis=1) > 0)[None]
    score = np.zeros_like(corr)
    if methods.get("pearson"):
        score += methods["pearson"] * np.where(live, (corr + 1) / 2, 0)
    if methods.get("profile"):
        score += methods["profile"] * np.exp(-np.sqrt(np.maximum(0, 2 * (1 - corr))))
    if methods.get("sax"):
        cuts = np.array(breakpoints(alphabet))
        spans = segments(n, parts)
        word = lambda x: np.searchsorted(cuts, np.stack([x[:, a:b].mean(axis=1) for a, b in spans], axis=1))
        w, q = word(z), word(queries)
        lo, hi = np.minimum.outer(np.arange(alphabet), np.arange(alphabet)), np.maximum.outer(np.arange(alphabet), np.arange(alphabet))
        table = np.where(hi - lo <= 1, 0.0, cuts[np.maximum(hi - 1, 0)] - cuts[np.minimum(lo, alphabet - 2)]) ** 2
        total_ = np.zeros_like(corr)
        for k in range(len(spans)):
            total_ += table[w[:, k][:, None], q[:, k][None]]
        score += methods["sax"] * np.exp(-np.sqrt(n / len(spans)) * np.sqrt(total_) / n)
    return score, corr


def _packed(some: list, width: int) -> tuple:
    """Queries as arrays: z-scored values, ids, series, starts, cuts."""
    q = np.array([r["values"] for r in some], dtype=float).reshape(len(some), width)
    d = q.std(axis=1, keepdims=True)
    q = np.divide(q - q.mean(axis=1, keepdims=True), d, out=np.zeros_like(q), where=d > 1e-10)
    return q, [r["query_id"] for r in some], [r["series_id"] for r in some], np.array([r["q_start"] for r in some], dtype=np.int64), np.array([r["cut"] for r in some], dtype=np.int64)


def _drawing(width: int, length: int) -> np.ndarray:
    """The matrix that draws a row of ``width`` values linearly to ``length`` values."""
    x = np.linspace(0, width - 1, length)
    k = np.minimum(x.astype(int), width - 2)
    out = np.zeros((width, length))
    out[k, np.arange(length)] = 1 - (x - k)
    out[k + 1, np.arange(length)] += x - k
    return out


def candidates(rows: DataFrame, queries: DataFrame, width: int, keep: int, methods: dict[str, float], stride: int = 1, ahead: int = 0, parts: int = 16, alphabet: int = 8, size: int = CHUNK, own: bool = False, most: int = MAX_QUERIES, target: int | None = None) -> DataFrame:
    """(query_id, series_id, start, score, correlation): per query the ``keep`` best windows of each stretch.

    queries: (query_id, series_id, q_start, cut, values), any number. A window that overlaps the query's own span, or that with the
    ``ahead`` values after it reaches beyond ``cut`` on the query's series, is no candidate; ``ahead`` values must follow it. With own,
    only the query's series is searched. With target, the length of the queries' values, windows of another width are drawn to it linearly.
    Up to ``most`` queries are broadcast after a count, and one pass over stretches of positions serves all. More are dealt by hash into
    blocks, and each stretch meets each block. Windows are views and are never turned into rows.
    """
    spark = rows.sparkSession
    ship(spark)
    queries = queries.select("query_id", "series_id", "q_start", "cut", "values")
    some = queries.limit(most + 1).collect()
    blocked = len(some) > most
    length = target or width
    drawn = None if length == width else _drawing(width, length)
    shared = spark.sparkContext.broadcast(None if blocked else _packed(some, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                z, ids, series, begun, cut = _packed(row["_q"], length) if blocked else shared.value
                values = np.array(row["values"])
                n = min(row["size"], len(values) - width - ahead + 1)
                if n <= 0 or not len(ids):
                    continue
                at = np.arange(0, n, stride)
                start = row["first"] + at
                mine = np.array([s == row["series_id"] for s in series])
                out = []
                view = np.lib.stride_tricks.sliding_window_view(values, width)
                for k in range(0, len(at), 1024):
                    some_ = view[at[k : k + 1024]]
                    score, corr = _scores(some_ if drawn is None else some_ @ drawn, z, parts, alphabet, methods)
                    first = start[k : k + 1024][:, None]
                    bad = mine[None] & (((first < begun + length) & (first + width > begun)) | (first + width + ahead > cut))
                    if own:
                        bad = bad | ~mine[None]
                    score[bad] = -1
                    out.append((score, corr))
                score, corr = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
                order = np.lexsort((np.broadcast_to(start[:, None], score.shape), -np.round(score, 12)), axis=0)[:keep]
                best = np.take_along_axis(score, order, axis=0)
                r, c = np.nonzero(best >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in c], pa.string()), pa.array([row["series_id"]] * len(c), pa.string()), pa.array(start[order[r, c]]), pa.array(best[r, c]), pa.array(corr[order[r, c], c])],
                    ["query_id", "series_id", "start", "score", "correlation"],
                )

    stretches = chunk_arrays(rows, width + ahead, size, stride)
    if blocked:
        deal = F.pmod(F.xxhash64("query_id", "series_id", "q_start"), F.lit(-(-queries.count() // min(most, BLOCK))))
        packs = queries.groupBy(*["series_id"] * own, deal.alias("_b")).agg(F.collect_list(F.struct(*queries.columns)).alias("_q")).drop("_b")  # about BLOCK queries at most
        stretches = stretches.join(packs, "series_id") if own else stretches.crossJoin(packs)
    return stretches.mapInArrow(run, "query_id string, series_id string, start long, score double, correlation double")


def top(found: DataFrame, k: int, *keys: str, score: str = "score") -> DataFrame:
    """The k best rows per key with their rank; ties by series and start."""
    w = Window.partitionBy(*(keys or ("query_id",))).orderBy(F.round(score, 12).desc(), "series_id", "start")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def analogues(rows: DataFrame, queries: DataFrame, width: int, k: int = 5, methods: dict[str, float] | None = None, **how) -> DataFrame:
    """The k best matches of each query: the best of each stretch, then the best of those."""
    return top(candidates(rows, queries, width, k, methods or {"sax": 0.4, "profile": 0.4, "pearson": 0.2}, **how), k)


def last_windows(rows: DataFrame, width: int) -> DataFrame:
    """Each series' last ``width`` values as a query of that series."""
    end = rows.groupBy("series_id").agg(F.max("pos").alias("end")).filter(F.col("end") >= width - 1)
    some = rows.join(end, "series_id").filter(F.col("pos") > F.col("end") - width)
    q = some.groupBy("series_id", "end").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("s"))
    return q.select(F.col("series_id").alias("query_id"), "series_id", (F.col("end") - width + 1).alias("q_start"), (F.col("end") + 1).alias("cut"), F.col("s.value").alias("values"))


def confidence(scores: dict[str, Column], weights: dict[str, float] | None = None, rules: bool = True) -> Column:
    """0 to 100: weighted mean of the methods given, weights renormalised, then the bounded rules.

    A shape trap (dtw >= .94, pearson <= .62, transfer entropy <= .24) loses 12 %, 4 more with a tiny wavelet score; strong
    koopman (>= .86) and transfer entropy (>= .30) gain 6 %, 2 more with pearson >= .63.
    """
    weights = {k: w for k, w in (weights or WEIGHTS).items() if k in scores and w > 0}
    if not weights:
        return F.lit(0.0)
    whole = sum(weights.values())
    raw = sum((scores[k] * (w / whole) for k, w in weights.items()), F.lit(0.0))
    if rules:
        if {"dtw", "pearson_warped", "transfer_entropy"} <= set(weights):
            trap = (scores["dtw"] >= 0.94) & (scores["pearson_warped"] <= 0.62) & (scores["transfer_entropy"] <= 0.24)
            loss = F.when(scores["wavelet_spectrum"] <= 0.08, 0.16).otherwise(0.12) if "wavelet_spectrum" in weights else F.lit(0.12)
            raw = F.when(trap, raw * (1 - loss)).otherwise(raw)
        if {"koopman", "transfer_entropy"} <= set(weights):
            gain = F.when(scores["pearson_warped"] >= 0.63, 0.08).otherwise(0.06) if "pearson_warped" in weights else F.lit(0.06)
            raw = F.when((scores["koopman"] >= 0.86) & (scores["transfer_entropy"] >= 0.30), raw * (1 + gain)).otherwise(raw)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * 100 if rules else raw * 100))


def direction_keep(query_return: Column, match_return: Column, least: float = 0.02, penalty: float = 0.08) -> Column:
    """Factor for windows that both moved by ``least`` or more, in opposite directions."""
    both = (F.abs(query_return) >= least) & (F.abs(match_return) >= least)
    return F.when(both & (F.signum(query_return) != F.signum(match_return)), 1 - penalty).otherwise(1.0)


def with_light_score(df: DataFrame, q: str, c: str, out: str = "score") -> DataFrame:
    """Adds 0 to 100 from correlation and mean gap of z-scored log returns and the gap of whole log returns; q and c of one length."""
    df = df.withColumns({"_rq": log_returns(F.col(q)), "_rc": log_returns(F.col(c))})
    df = df.withColumns({f"_z{k}": scaled(F.col(f"_r{k}"), mean(F.col(f"_r{k}")), deviation(F.col(f"_r{k}"))) for k in "qc"})
    whole = lambda v: F.log(F.greatest(F.element_at(v, -1), F.lit(1e-12)) / F.greatest(F.element_at(v, 1), F.lit(1e-12)))
    gap = total(F.zip_with("_zq", "_zc", lambda a, b: F.abs(a - b))) / F.size("_zq")
    pearson = (pair_sum(F.col("_zq"), F.col("_zc")) / F.size("_zq") + 1) / 2  # of z-scores; flat ones are zeros
    score = 100 * (0.65 * F.greatest(F.lit(0.0), pearson) + 0.2 * F.exp(-gap) + 0.15 * F.exp(-2 * F.abs(whole(F.col(q)) - whole(F.col(c)))))
    return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).drop("_rq", "_rc", "_zq", "_zc")


def explained(scores: DataFrame, methods: dict[str, float]) -> DataFrame:
    """(query_id, rank, method, score, contribution, verdict) of each match's method scores, the largest contribution first."""
    whole = sum(methods.values())
    item = F.explode(F.array(*[F.struct(F.lit(k).alias("method"), F.col(k).alias("score"), (F.col(k) * (w / whole)).alias("contribution")) for k, w in methods.items()]))
    verdict = F.when(F.col("score") >= 0.7, "strong").when(F.col("score") >= 0.4, "moderate").when(F.col("score") >= 0.15, "weak").otherwise("negligible")
    return scores.select("query_id", "rank", item.alias("i")).select("query_id", "rank", "i.*").withColumn("verdict", verdict).orderBy("query_id", "rank", F.desc("contribution"))


def compared(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query_id, jaccard, recall, lift, spearman) of two result lists (query_id, series_id, start, rank); a missing rank is k + 1."""
    key = ["query_id", "series_id", "start"]
    both = a.select(*key, F.col("rank").alias("ra")).join(b.select(*key, F.col("rank").alias("rb")), key, "full_outer")
    shared = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    return both.groupBy("query_id").agg(
        (F.count_if(shared) / F.count("*")).alias("jaccard"),
        (F.count_if(shared) / F.count("ra")).alias("recall"),
        F.avg(F.coalesce("ra", F.lit(k + 1)) - F.coalesce("rb", F.lit(k + 1))).alias("lift"),
        F.when(F.count_if(shared) > 2, F.corr(F.when(shared, F.col("ra")), F.when(shared, F.col("rb")))).alias("spearman"),
    )


def transfer_entropy(pairs: DataFrame, keys: list[str], bins: int = 8) -> DataFrame:
    """(keys, te) from rows (keys, i, source, target): how much the source's last bin tells of the target's next, in 0 to 1.

    Bins are equal parts of each side's range inside a group; groups with a flat side have 0. Counts are partial aggregates;
    the four entropies come from one table of bin triples.
    """
    edge = pairs.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in ("source", "target") for n, f in (("lo", F.min), ("hi", F.max))])
    place = lambda c: F.when(F.col(f"hi_{c}") - F.col(f"lo_{c}") < 1e-12, 0).otherwise(F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * bins), F.lit(bins - 1)))
    binned = pairs.join(edge, keys).select(*keys, "i", place("source").alias("xp"), place("target").alias("yp"), ((F.col("hi_source") - F.col("lo_source") >= 1e-12) & (F.col("hi_target") - F.col("lo_target") >= 1e-12)).alias("live"))
    ahead = binned.select(*keys, (F.col("i") - 1).alias("i"), F.col("yp").alias("yf"))
    cell = binned.join(ahead, [*keys, "i"]).groupBy(*keys, "live", "yf", "yp", "xp").agg(F.count("*").alias("c"))
    n = F.sum("c").over(Window.partitionBy(*keys))
    cell = cell.withColumn("n", n)
    h = None
    for name, parts in (("yf", ["yf"]), ("yfyp", ["yf", "yp"]), ("yp", ["yp"]), ("ypxp", ["yp", "xp"]), ("all", ["yf", "yp", "xp"])):
        some = cell.groupBy(*keys, "live", "n", *parts).agg(F.sum("c").alias("c")).groupBy(*keys, "live").agg(F.sum(-F.col("c") / F.col("n") * F.log2(F.col("c") / F.col("n"))).alias("h_" + name))
        h = some if h is None else h.join(some, [*keys, "live"])
    te = F.greatest(F.lit(0.0), F.col("h_yfyp") + F.col("h_ypxp") - F.col("h_yp") - F.col("h_all"))
    return h.select(*keys, F.when(~F.col("live") | (F.col("h_yf") < 1e-12), 0.0).otherwise(F.least(F.lit(1.0), te / F.col("h_yf"))).alias("te"))


