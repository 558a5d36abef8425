"""Near-duplicate documents by DartMinHash signatures and banded joins (operator 3)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.llm.bloom import bounded
from pastcast.llm.graph import components
from pastcast.llm.tokens import hashes, mix, pieces, shingles, split
from pastcast.session import ship, stored, with_fields

_C = np.uint64(0x9E3779B97F4A7C15)


def weighted(doc: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight): distinct elements of each text and how often they occur; sorted."""
    order = np.lexsort((element, doc))
    doc, element = doc[order].astype(np.int64), element[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])
    at = np.flatnonzero(new)
    return doc[at], element[at], np.diff(np.append(at, len(doc))).astype(np.float64)


def cells(doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts each element's region [0, weight) into unit strips: (text, strip, its filled share)."""
    n = np.ceil(weight).astype(np.int64)
    level = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(doc, n), mix(np.repeat(element, n) + level.astype(np.uint64) * _C), np.minimum(np.repeat(weight, n) - level, 1.0)


def signatures(doc: np.ndarray, strip: np.ndarray, share: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k DartMinHash values; rows of texts without elements are 0.

    Every strip receives darts, a Poisson process over rank that its hash alone determines;
    a dart hits if it lands in the filled share. About k ln k + 2k darts of lowest rank are
    thrown for a text whatever its size; each falls to one coordinate, which keeps its earliest.
    A text with an empty coordinate throws again to twice the rank.
    """
    best = np.full(n * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    total = np.bincount(doc, weights=share, minlength=n)
    reach = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(n), where=total > 0)
    todo = np.ones(n, bool)
    while len(doc):
        d, s, f = doc, strip, share
        rank, turn = np.zeros(len(d)), 0
        while len(d):
            turn += 1
            dart = mix(s + np.uint64(turn * 0xD6E8FEB86659FD93 % 2**64))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53)
            on = rank < reach[d]
            d, s, f, rank, dart = d[on], s[on], f[on], rank[on], mix(dart[on] + _C)
            hit = (dart >> np.uint64(40)).astype(np.float64) / 2**24 < f
            order = rank.astype(np.float32).view(np.uint32).astype(np.uint64)
            np.minimum.at(best, (d * k + (dart % np.uint64(k)).astype(np.int64))[hit], ((order << np.uint64(32)) | (mix(dart) & np.uint64(0xFFFFFFFF)))[hit])
        empty = (best.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1) & (total > 0)
        reach = reach * 2
        todo = empty[doc]
        doc, strip, share = doc[todo], strip[todo], share[todo]
    out = best.reshape(n, k) & np.uint64(0xFFFFFFFF)
    out[total == 0] = 0
    return out


def _elements(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple]:
    """(batch, texts, owner and hash of every unit strip, its filled share)."""
    for batch, texts in pieces(batches, "t"):
        words = split(texts)
        yield batch, texts, *cells(*weighted(*shingles(hashes(texts, words), words, shingle)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.md5(text_col).alias("exact"), F.col(text_col).alias("t"))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = 20, rows: int = 6, shingle: int = 5) -> DataFrame:
    """(id, exact, n, band, sig): per row its id, a 128-bit text key, its number of elements, band keys and 4 bits of each signature value.

    Elements are shingles of ``shingle`` words weighted by how often the text holds them: the j-th
    occurrence of a shingle is an element of its own. A text without words has no band keys.
    """
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, doc, strip, share in _elements(batches, shingle):
            n = texts.n
            values = signatures(doc, strip, share, n, k)
            sig = values.reshape(n, bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
            for r in range(rows):
                key = mix(key * _C + sig[:, :, r])
            nibbles = np.zeros((n, -(-k // 16) * 16), np.uint64)
            nibbles[:, :k] = values & np.uint64(15)
            packed = np.bitwise_or.reduce(nibbles.reshape(n, -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)
            count = np.bincount(doc, minlength=n)
            offsets = np.concatenate(([0], np.cumsum(np.where(count > 0, bands, 0)))).astype(np.int32)
            sig_offsets = (np.arange(n + 1) * packed.shape[1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(count.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[count > 0].reshape(-1).view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(sig_offsets), pa.array(packed.reshape(-1).view(np.int64))),
                ],
                ["id", "exact", "n", "band", "sig"],
            )

    ship(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    return keyed.mapInArrow(run, with_fields(keyed.select("id", "exact"), "n int, band array<long>, sig array<long>"))


def elements(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(node, elements) of the texts wanted (node, id, exact), read from the row of that id: distinct 64-bit hashes of all elements.

    A Bloom filter of bounded size keeps most other rows out of the scan's Python step; a join decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, doc, strip, _ in _elements(batches, shingle):
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=texts.n)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(mix(strip + _C).view(np.int64)))], ["id", "exact", "elements"])

    ship(docs.sparkSession)
    key = F.struct("id", "exact")
    sieve = bounded(wanted.select(key.alias("key")), wanted.count())
    rows = _keyed(docs, id_col, text_col).filter(F.col("exact").isNotNull() & sieve.might_hold(key))
    made = rows.mapInArrow(run, with_fields(rows.select("id", "exact"), "elements array<long>"))
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.exact") == F.col("b.exact"))
    return made.alias("a").join(wanted.alias("b"), same).select("node", F.array_distinct("elements").alias("elements")).dropDuplicates(["node"])


def _similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, s): the exact weighted Jaccard similarity of each pair."""
    one = sets.select(F.col("node").alias("u"), F.col("elements").alias("eu"))
    two = sets.select(F.col("node").alias("v"), F.col("elements").alias("ev"))
    met = pairs.join(two, "v").join(one, "u").withColumn("both", F.size(F.array_intersect("eu", "ev")))
    return met.select("u", "v", (F.col("both") / (F.size("eu") + F.size("ev") - F.col("both"))).alias("s"))


def _agreeing(a: Column, b: Column, k: int) -> Column:
    """How many of the k 4-bit signature values agree."""
    ones, total = F.lit(0x1111111111111111), F.lit(0)
    for i in range(-(-k // 16)):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(ones))
    return k - total


def _shareable(sets: DataFrame) -> DataFrame:
    """(node, n, m): how many elements each set has, and how many of them some other set has too: no overlap is larger than m."""
    rows = sets.select("node", F.explode("elements").alias("e"))
    alone = rows.groupBy("e").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1").groupBy("node").agg(F.count("*").alias("own"))
    return sets.select("node", F.size("elements").alias("n")).join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("m"))


def met_in_blocks(rows: DataFrame, size: int = 256) -> DataFrame:
    """Adds lo, hi, own: (band, lo, hi) names pairs of blocks in which all rows (band, node, label) of a bucket with different labels meet.

    A label of more than ``size`` rows of a bucket is cut into blocks of its own, which don't meet each other; smaller labels
    share blocks. No task holds more than two blocks' rows of a bucket, and a bucket that is nearly one class costs its rows
    times what is outside that class. ``own`` is the row's block, lo or hi or both.
    """
    label = rows.groupBy("band", "label").agg(F.count("*").alias("c"))
    big = label.filter(F.col("c") > size).withColumn("pieces", F.ceil(F.col("c") / size).cast("int"))
    big = big.withColumn("to", F.sum("pieces").over(Window.partitionBy("band").orderBy("label")).cast("int"))  # a bucket's rows / size at most
    bucket = label.groupBy("band").agg(F.ceil(F.sum(F.when(F.col("c") <= size, F.col("c")).otherwise(0)) / size).cast("int").alias("small"))
    bucket = bucket.join(big.groupBy("band").agg(F.sum("pieces").cast("int").alias("large")), "band", "left").select("band", "small", (F.col("small") + F.coalesce("large", F.lit(0))).alias("blocks"))
    rows = rows.join(bucket, "band").join(big.select("band", "label", "pieces", "to"), ["band", "label"], "left")
    piece = lambda c, n: F.pmod(F.xxhash64(c, F.lit(5)), n).cast("int")
    first = F.col("small") + F.col("to") - F.col("pieces")
    rows = rows.withColumn("own", F.when(F.col("pieces").isNull(), piece("label", F.col("small"))).otherwise(first + piece("node", F.col("pieces"))))
    mine = F.col("pieces").isNotNull()
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: ~(F.coalesce(mine & (o >= first) & (o < first + F.col("pieces")), F.lit(False))))
    rows = rows.withColumn("_o", F.explode(other))
    return rows.withColumns({"lo": F.least("own", "_o"), "hi": F.greatest("own", "_o")}).drop("_o", "small", "blocks", "pieces", "to")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 20, rows: int = 6) -> DataFrame:
    """(id, exact, component_id, kept): the class of each row, named by its id and the digest of its text (``rows.digest``).

    Equal texts are one class member from the start. Distinct texts that agree on a band are candidates.
    In each bucket all members first meet the one that shares most buckets, and their similarity to it is computed exactly.
    Members of a bucket that are still in different classes then meet each other in pairs of blocks (``met_in_blocks``), unless
    the elements that others share with each, the triangle inequality for their distances to that pivot, or the signatures
    rule a link out; no candidate link between classes is capped, and members of one class are not paired again. Every link is
    verified on the full element sets. ``component_id`` is the smallest id of the class; ``kept`` marks its row, of several texts
    of that id the one with the smallest digest. Null ids come last: a class that has no other id has a null component_id.

    Rows with a null text are alone, and all are kept; texts without words, empty ones too, are linked to equal texts only; rows
    that repeat an id and its text give one row; ids may be of any type that has an order; an empty table gives no rows; other
    columns are ignored, whatever their names. With 20 bands of 6, a pair at 0.8 becomes a candidate with probability 0.998, and its
    signatures then agree enough with probability 0.9998.
    """
    k = bands * rows
    share = threshold + (1 - threshold) / 16
    least = math.floor(k * share - 3.6 * math.sqrt(k * share * (1 - share)))
    made = stored(sketch(docs, id_col, text_col, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    low = F.struct(F.col("id").isNull(), F.col("id").alias("id"))
    texts = made.filter("exact is not null").groupBy("exact").agg(F.min("row").alias("node"), F.min_by("id", "row").alias("id"), F.min(low).alias("low"), F.first("band").alias("band"), F.first("sig").alias("sig"))
    texts = stored(texts)
    band = texts.select("node", F.explode("band").alias("band"))
    full = band.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    inside = stored(band.join(full, "band"))
    weight = inside.groupBy("node").agg(F.sum("size").alias("weight"))
    member = stored(weight.join(texts.select("node", "id", "exact", "sig", F.col("band").alias("all")), "node"))
    pivot = inside.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("low"))).alias("top"))
    seen = stored(inside.join(pivot, "band").select("band", "node", (-F.col("top.low")).alias("pivot")))
    sets = stored(elements(docs, member.select("node", "id", "exact"), id_col, text_col))
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    tried = stored(_similarity(seen.filter(F.col("node") != F.col("pivot")).select(*pair("node", "pivot")).distinct(), sets))
    label = components(tried.filter(F.col("s") >= threshold))
    placed = seen.withColumns({"u": F.least("node", "pivot"), "v": F.greatest("node", "pivot")}).join(tried, ["u", "v"], "left").join(label, "node", "left")
    placed = stored(placed.select("band", "node", F.coalesce("s", F.lit(1.0)).alias("s"), F.coalesce("component", "node").alias("label")))
    apart = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo < hi and size > 2").select("band")
    open_ = stored(placed.join(apart, "band", "left_semi"))
    fair = _shareable(sets.join(open_.select("node").distinct(), "node", "left_semi"))
    open_ = met_in_blocks(open_).join(fair, "node").join(member.select("node", "sig", "all"), "node")
    a, b = (open_.filter(F.col("own") == F.col(x)).select("band", "lo", "hi", *[F.col(c).alias(c + x[0]) for c in ("node", "s", "label", "n", "m", "sig", "all")]) for x in ("lo", "hi"))
    likely = (
        ((F.col("a.lo") < F.col("a.hi")) | (F.col("nodel") < F.col("nodeh")))
        & (F.col("labell") != F.col("labelh"))
        & (F.least("ml", "mh") * (1 + threshold) >= threshold * (F.col("nl") + F.col("nh")) - 1e-6)
        & (F.abs(F.col("sl") - F.col("sh")) <= 1 - threshold + 1e-9)
        & (_agreeing(F.col("sigl"), F.col("sigh"), k) >= least)
        & (F.array_min(F.array_intersect("alll", "allh")) == F.col("a.band"))  # a pair comes from the first band it shares
    )
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))
    rest = a.alias("a").join(b.alias("b"), same & likely)
    rest = rest.select(*pair("nodel", "nodeh")).distinct().join(tried, ["u", "v"], "left_anti")
    more = _similarity(rest, sets).filter(F.col("s") >= threshold).select("u", "v")
    joined = components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).union(stored(more)))
    of = texts.select("node", "exact", "low").join(joined, "node", "left").select("exact", "low", F.coalesce("component", "node").alias("component"))
    best = of.groupBy("component").agg(F.min(F.struct("low", "exact")).alias("best"))
    of = stored(of.join(best, "component").select("exact", F.col("best.low.id").alias("component_id"), F.col("best.exact").alias("keeper")))
    whole = made.filter("exact is not null").select("id", "exact").distinct().join(of, "exact")
    whole = whole.select("id", "exact", "component_id", (F.col("id").eqNullSafe(F.col("component_id")) & (F.col("exact") == F.col("keeper"))).alias("kept"))
    alone = made.filter("exact is null").select("id").distinct().select("id", F.lit("-").alias("exact"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return whole.union(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 20, rows: int = 6) -> DataFrame:
    """(id, component_id, kept): ``classes`` by id, for documents whose id is not null; an id with several texts has a row for each class."""
    made = classes(docs, id_col, text_col, threshold, bands, rows).filter("id is not null")
    return made.groupBy("id", "component_id").agg(F.bool_or("kept").alias("kept"))
