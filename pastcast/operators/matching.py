"""The analogue search in full: windows of several scales, prefilter, warping, rerank by dynamics, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastcast.operators import dynamics, search
from pastcast.operators.trials import with_warping
from pastcast.operators.windows import CHUNK, chunk_arrays, log_returns, resampled, scaled_widths
from pastcast.session import stored

#: Fixed weights of the prefilter at the query's own width and at others.
OWN_SCALE, OTHER_SCALE = {"sax": 0.4, "profile": 0.4, "pearson": 0.2}, {"sax": 0.6, "pearson": 0.4}


def cut_out(rows: DataFrame, found: DataFrame, longest: int, extra: int = 0) -> DataFrame:
    """found (series_id, start, width, ...) with values, the window's, and following, the ``extra`` values after it.

    Windows meet the stretch that they begin in, so no other window becomes a row. longest: the largest width.
    """
    parts = chunk_arrays(rows, longest + extra).select("series_id", "first", F.col("values").alias("_v"))
    size = max(CHUNK, longest + extra)
    at = (F.col("start") - F.col("first") + 1).cast("int")
    met = found.withColumn("first", F.floor(F.col("start") / size) * size).join(parts, ["series_id", "first"])
    return met.withColumns({"values": F.slice("_v", at, F.col("width")), "following": F.slice("_v", at + F.col("width"), extra)}).drop("first", "_v")


def matches(rows: DataFrame, queries: DataFrame, width: int, k: int = 20, scales: tuple[float, ...] = (0.5, 0.75, 1.0, 1.5, 2.0), stride: int = 1, ahead: int = 0, keep: int = 1000, rerank: int = 20, own: bool = False) -> DataFrame:
    """(query_id, rank, series_id, start, end, scale, confidence, dtw, pearson_warped, koopman, wavelet_spectrum, transfer_entropy, start_ts, end_ts): the k best.

    Windows of every scale are drawn to the query's length and prefiltered; the ``keep`` best of each query are scored by warping and
    correlation, and the ``rerank`` best of those by Koopman spectra, wavelet spectra and the transfer entropy to what follows them. Others
    keep 0 there, so they sink. The order is by confidence with its rules, less the penalty for opposite directions; ties by series, start and width.
    queries: as ``search.candidates`` takes them, values of ``width``. With ts in rows the dates of the window's ends are added.
    """
    found, widths = None, list(dict.fromkeys(scaled_widths(width, scales)))
    for w in widths:
        some = search.candidates(rows, queries, w, keep, OWN_SCALE if w == width else OTHER_SCALE, stride=stride, ahead=ahead, own=own, target=width)
        some = some.withColumn("width", F.lit(w))
        found = some if found is None else found.union(some)
    order = [F.round("score", 12).desc(), "series_id", "start", "width"]
    cut = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("_r") <= keep).select("query_id", "series_id", "start", "width", "correlation")
    q = queries.select("query_id", F.col("values").alias("q"))
    scored = cut_out(rows, cut, max(widths), ahead).join(q, "query_id").withColumn("shape", resampled(F.col("values"), width))
    c = F.col("correlation")
    scored = with_warping(scored, "q", "shape").withColumn("pearson_warped", F.when(c.isNull() | F.isnan(c), 0.0).otherwise((c + 1) / 2))
    flat = F.array_max("shape") == F.array_min("shape")
    scored = stored(scored.withColumn("pearson_warped", F.when(flat, 0.0).otherwise(F.col("pearson_warped"))))
    cheap = search.confidence({m: F.col(m) for m in ("dtw", "pearson_warped")}, rules=False)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(cheap, 10).desc(), "series_id", "start", "width"))
    scored = scored.withColumn("_r", place)
    few = scored.filter(F.col("_r") <= rerank).withColumns({"_a": log_returns(F.col("q")), "_b": log_returns(F.col("values"))})
    few = dynamics.with_scores(few, {"koopman": ("_a", "_b", dynamics.koopman_score), "wavelet_spectrum": ("_a", "_b", dynamics.wavelet_score), "transfer_entropy": ("values", "following", dynamics.flow)})
    rest = scored.filter(F.col("_r") > rerank).withColumns({m: F.lit(0.0) for m in ("koopman", "wavelet_spectrum", "transfer_entropy")})
    names = ["dtw", "pearson_warped", "koopman", "wavelet_spectrum", "transfer_entropy"]
    cols = ["query_id", "series_id", "start", "width", "q", "values", *names]
    every = few.select(*cols).unionByName(rest.select(*cols))
    move = lambda v: F.when(F.element_at(v, 1) != 0, F.element_at(v, -1) / F.element_at(v, 1) - 1).otherwise(0.0)
    sure = search.confidence({m: F.col(m) for m in names}) * search.direction_keep(move(F.col("q")), move(F.col("values")))
    every = every.withColumn("confidence", sure)
    best = Window.partitionBy("query_id").orderBy(F.round("confidence", 8).desc(), "series_id", "start", "width")
    out = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = out.select("query_id", "rank", "series_id", "start", (F.col("start") + F.col("width")).alias("end"), (F.col("width") / float(width)).alias("scale"), "confidence", *names)
    if "ts" not in rows.columns:
        return out
    stamp = lambda name, at: rows.select("series_id", F.col("pos").alias(at), F.col("ts").alias(name))
    return out.withColumn("_l", F.col("end") - 1).join(stamp("start_ts", "start"), ["series_id", "start"]).join(stamp("end_ts", "_l"), ["series_id", "_l"]).drop("_l")
