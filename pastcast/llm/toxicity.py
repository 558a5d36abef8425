"""Toxic spans and document scores by a linear-chain conditional random field (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastcast.llm.quality import picked
from pastcast.llm.tokens import FOLD, Texts, Words, hashes, mix, pieces, split
from pastcast.session import ship, stored, with_fields

_GRAM = np.uint64(0x9E3779B97F4A7C15)
_NEWLINE = 10


def features(texts: Texts, words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, first feature of each word): hashed byte runs of 3, 4 and 5 with the word's bounds, and the word itself."""
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    size = words.end - words.start + 2  # a mark before and after
    total = np.cumsum(size)
    place = np.arange(total[-1]) - np.repeat(total - size, size)
    data = np.zeros(total[-1] + 4, np.uint64)
    inner = (place > 0) & (place < np.repeat(size - 1, size))
    data[:-4][inner] = FOLD[texts.data[(place - 1 + np.repeat(words.start, size))[inner]]]
    h, left, grams = np.zeros(total[-1], np.uint64), np.repeat(size, size) - place, []
    for n in range(5):
        h = h * np.uint64(0x100000001B3) + data[n : n + len(h)] + np.uint64(1)
        if n >= 2:
            grams.append((left > n, h + np.uint64(n * 0xD6E8FEB86659FD93 % 2**64)))
    count = sum(np.maximum(size - n, 0) for n in (2, 3, 4)) + 2
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(first[-1], np.int64)
    at = first[:-1].copy()
    for n, (ok, g) in zip((2, 3, 4), grams, strict=True):
        made = np.maximum(size - n, 0)
        out[np.repeat(at - (np.cumsum(made) - made), made) + np.arange(made.sum())] = (mix(g[ok]) % np.uint64(buckets)).astype(np.int64)
        at += made
    out[at] = (mix(hashes(texts, words) ^ _GRAM) % np.uint64(buckets)).astype(np.int64)
    return out, first  # the last feature of a word is bucket 0: what holds for any word


def chains(texts: Texts, words: Words) -> np.ndarray:
    """First word of each chain, and the number of words: a chain is a line of a text."""
    if not len(words.start):
        return np.zeros(1, np.int64)
    line = np.concatenate(([0], np.cumsum(texts.data == _NEWLINE)))[words.start]
    new = (np.diff(line) > 0) | (np.diff(words.doc) > 0)
    return np.concatenate(([0], np.flatnonzero(new) + 1, [len(words.start)]))


def _walk(out: np.ndarray, add: np.ndarray, at: np.ndarray, alive: np.ndarray, step: int, one: tuple[float, float], zero: tuple[float, float]) -> None:
    """out[next] = add + log(e^a e^one0 + e^one1) - log(e^a e^zero0 + e^zero1) along all chains at once.

    ``at`` has the first position of each chain, the longest chain first. The last few long chains go on as plain floats.
    """
    for k in range(1, len(alive)):
        n = alive[k]
        if n < 4:
            for j in range(n):
                length = int(np.searchsorted(-alive, -j, "left"))  # positions of chain j
                where = at[j] + step * np.arange(k - 1, length)
                plus, a = add[where].tolist(), float(out[where[0]])
                got = [a]
                for x in plus[1:]:
                    e = math.exp(min(a, 500.0))
                    a = x + math.log(e * one[0] + one[1]) - math.log(e * zero[0] + zero[1])
                    got.append(a)
                out[where] = got
            return
        now = at[:n] + step * k
        e = np.exp(np.minimum(out[now - step], 500.0))
        out[now] = add[now] + np.log((e * one[0] + one[1]) / (e * zero[0] + zero[1]))


def forward_backward(emission: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of label 1 at every position; their sum is the log odds of its marginal.

    emission: log odds of label 1 at a position; trans: 2 x 2 transition scores; first: the chains' first positions and the end.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    t = np.exp(trans)
    forward = np.array(emission, dtype=np.float64)
    _walk(forward, emission, start, alive, 1, (t[1, 1], t[0, 1]), (t[1, 0], t[0, 0]))
    after = np.array(emission, dtype=np.float64)  # backward log odds with the position's own emission
    _walk(after, emission, start + size - 1, alive, -1, (t[1, 1], t[1, 0]), (t[0, 1], t[0, 0]))
    return forward, after - emission


@dataclass
class Crf:
    """Feature weights, transition scores and the logistic map from marginals to a document score."""

    weights: np.ndarray
    trans: np.ndarray
    map: np.ndarray  # of (1, log odds of any toxic word, log expected number, log expected share)

    @property
    def buckets(self) -> int:
        return len(self.weights)

    def marginals(self, texts: Texts) -> tuple[Words, np.ndarray]:
        words = split(texts)
        emission = np.zeros(len(words.start))
        for at in range(0, len(emission), 1 << 15):
            some = Words(words.start[at : at + (1 << 15)], words.end[at : at + (1 << 15)], words.doc, words.first)
            bucket, first = features(texts, some, self.buckets)
            emission[at : at + (1 << 15)] = np.add.reduceat(self.weights[bucket], first[:-1])
        f, b = forward_backward(emission, chains(texts, words), self.trans)
        return words, 1 / (1 + np.exp(-np.clip(f + b, -50, 50)))

    @staticmethod
    def summary(words: Words, p: np.ndarray, n: int) -> np.ndarray:
        """Per text: 1, log odds that any word is toxic, log of the expected number, log of the expected share."""
        none = np.bincount(words.doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)
        number = np.bincount(words.doc, weights=p, minlength=n)
        size = np.maximum(np.bincount(words.doc, minlength=n), 1)
        odds = np.log(np.maximum(-np.expm1(none), 1e-9)) - none
        return np.stack([np.ones(n), np.clip(odds, -10, 10), np.log(number + 1e-3), np.log(number / size + 1e-5)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.map, -30, 30)))


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((2, buckets), np.int64)
        for batch, texts in pieces(batches, "text", 1 << 19):
            words = split(texts)
            bucket, first = features(texts, words, buckets)
            doc = np.repeat(words.doc, np.diff(first))
            pair = np.unique(doc * buckets + bucket)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for v in (0, 1):
                got[v] += np.bincount(pair[y[pair // buckets] == v] % buckets, minlength=buckets)
        at = np.flatnonzero(got.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[0, at]), pa.array(got[1, at])], ["bucket", "clean", "toxic"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, chains, toxic) of each whole text: the hash of each word, the number of words of each line."""
    for batch, texts in pieces(batches, "text", 1 << 19):
        words = split(texts)
        line = chains(texts, words)
        size = np.diff(line)
        head = words.doc[line[:-1]] if len(size) else np.zeros(0, np.int64)
        ends = np.searchsorted(head, np.arange(texts.n + 1)).astype(np.int32)
        lists = [(words.first, hashes(texts, words).view(np.int64)), (ends, size.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(pa.array(np.asarray(o, np.int32)), pa.array(v)) for o, v in lists), batch.column(1)], ["words", "chains", "toxic"])


def _kinds(buckets: int):
    """(word, feats): the features of each distinct word of a batch, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "text", 1 << 19):
            words = split(texts)
            word, at = np.unique(hashes(texts, words).view(np.int64), return_index=True)
            bucket, first = features(texts, Words(words.start[at], words.end[at], words.doc, words.first), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(bucket.astype(np.int32)))], ["word", "feats"])

    return run


def _fit_chain(token: np.ndarray, size: np.ndarray, y: np.ndarray, bucket: np.ndarray, first: np.ndarray, buckets: int, steps: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam on labelled chains.

    token: the kind of each word, chain after chain; size: words of each chain; y: labels; kind k has the features bucket[first[k]:first[k + 1]].
    """
    begin = np.concatenate(([0], np.cumsum(size)))
    # blocks of whole chains bound what a step holds
    cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, begin[-1], 1 << 16)), len(size)))
    blocks, seen = [], np.zeros((2, 2))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        inner = np.ones(begin[hi] - begin[lo], bool)
        inner[begin[lo:hi] - begin[lo]] = False
        blocks.append((slice(begin[lo], begin[hi]), begin[lo : hi + 1] - begin[lo], np.flatnonzero(inner).astype(np.int32)))
        here = y[blocks[-1][0]]
        np.add.at(seen, (here[blocks[-1][2] - 1], here[blocks[-1][2]]), 1)
    many = np.diff(first)
    x = np.zeros(buckets + 4)
    x[buckets:] = np.log((seen + 1) / (seen + 1).sum(axis=1, keepdims=True)).reshape(-1)
    x[0] = -5.0  # a word is clean unless its own features say otherwise, unseen words too
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        of_kind, trans = np.add.reduceat(x[:buckets].astype(np.float32)[bucket], first[:-1]).astype(np.float64), x[buckets:].reshape(2, 2)
        pull, joint = np.zeros(len(many)), np.zeros((2, 2))
        for where, start, pairs in blocks:
            e = of_kind[token[where]]
            f, b = forward_backward(e, start, trans)
            p = 1 / (1 + np.exp(-np.clip(f + b, -50, 50)))
            ahead = (b + e)[pairs]
            whole = np.stack([np.full(len(pairs), trans[0, 0]), trans[0, 1] + ahead, trans[1, 0] + f[pairs - 1], trans[1, 1] + f[pairs - 1] + ahead])
            share = np.exp(whole - whole.max(axis=0))
            joint += (share / share.sum(axis=0)).sum(axis=1).reshape(2, 2)
            pull += np.bincount(token[where], weights=p - y[where], minlength=len(many))
        g = np.zeros_like(x)
        g[:buckets] = np.bincount(bucket, weights=np.repeat(pull.astype(np.float32), many), minlength=buckets)
        g[buckets:] = (joint - seen).reshape(-1)
        g = g / len(y) * 50
        g[1:] += ridge * x[1:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return x[:buckets], x[buckets:].reshape(2, 2)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for weighted ridge logistic regression; the first column isn't penalised."""
    w, pen = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    pen[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + pen, x.T @ (weight * (p - y)) + pen @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text_col: str = "text", most: int = 2000, buckets: int = 1 << 18, steps: int = 40, chance: float = 1e-4, ratio: float = 10) -> Crf:
    """Fits on about ``most`` documents of each label, picked by a hash of the key; labels has (key, label in 0, 1).

    The picked keys, bounded by ``most``, are broadcast to the documents; of rows that repeat a key one counts.
    Words of toxic texts are labelled first: a byte run marks its words if it is ``ratio`` times as frequent in toxic as in clean texts
    (half an occurrence added), and if as many toxic ones among the texts that hold it have at most the probability ``chance`` where
    labels are dealt at random (by the Chernoff bound). A chain is then fitted to the whole
    texts, line by line, and a logistic map to the marginals of the same texts. The driver receives a hash of each word, and
    the features of each distinct one: what it holds is bounded by ``most`` texts. The map weighs texts by how common their label
    is among all labels. Without labels of both kinds every score is the smoothed share of label 1, below a half.
    """
    spark = docs.sparkSession
    ship(spark)
    some, sizes = picked(labels, label, most, key)
    rows = docs.select(key, F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(some), key)
    picked_docs = stored(rows.select("text", F.col(label).cast("int").alias("toxic"), key).groupBy(key, "toxic").agg(F.min("text").alias("text")))  # a key names one text
    size = {r.toxic: r.n for r in picked_docs.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = np.array([np.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 1.5)), 0.0, 0.0, 0.0])
    if len(size) < 2:
        return Crf(np.zeros(1, np.float32), np.zeros((2, 2)), np.minimum(none, -1e-6))
    n0, n1 = size[0], size[1]
    counted = picked_docs.select("text", "toxic").mapInArrow(_counts(buckets), "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    k, c, share = F.col("toxic"), F.col("clean"), n1 / (n0 + n1)
    surprise = k * F.log(k / (k + c) / share) + F.when(c > 0, c * F.log(c / (k + c) / (1 - share))).otherwise(0.0)
    marked = counted.filter((k > 0) & (k / n1 > ratio * (c + 0.5) / n0) & (surprise >= -math.log(chance)))
    odd = np.zeros(buckets, bool)
    odd[[r.bucket for r in marked.collect()]] = True  # at most one row per bucket
    rows = picked_docs.select("text", "toxic").mapInArrow(_tokens, "words array<long>, chains array<int>, toxic int").toArrow()
    kinds = picked_docs.select("text").mapInArrow(_kinds(buckets), "word long, feats array<int>").dropDuplicates(["word"]).toArrow()
    flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy()
    size = flat(rows, 1)
    if not odd.any() or not len(size):
        return Crf(np.zeros(1, np.float32), np.zeros((2, 2)), np.minimum(none, -1e-6))
    word, bucket = kinds.column(0).to_numpy(), flat(kinds, 1)
    first = np.concatenate(([0], np.cumsum(kinds.column(1).combine_chunks().value_lengths().to_numpy())))
    order = np.argsort(word)
    token = order[np.searchsorted(word[order], flat(rows, 0))].astype(np.int32)
    toxic = np.repeat(rows.column(2).to_numpy(), rows.column(0).combine_chunks().value_lengths().to_numpy()) == 1
    y = (np.maximum.reduceat(odd[bucket], first[:-1])[token] & toxic).astype(np.int8)
    del rows, kinds
    weights, trans = _fit_chain(token, size, y, bucket, first, buckets, steps, 1e-4)
    model = Crf(weights.astype(np.float32), trans, np.array([0.0, 1.0, 0.0, 0.0]))
    seen = score(picked_docs.select(F.col(key), "text", "toxic"), model, keep=("toxic",), raw=True).select("raw", "toxic").toArrow()
    x = np.stack(seen.column(0).to_numpy())
    y = seen.column(1).to_numpy().astype(float)
    model.map = logistic(x, y, np.where(y == 1, sizes[1] / n1, sizes[0] / n0))
    return model


def score(docs: DataFrame, model: Crf, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), span_at: float = 0.5, raw: bool = False) -> DataFrame:
    """Columns ``keep``, then score and spans: byte ranges [start, end) of words whose marginal is at least span_at.

    Neighbouring marked words of a line make one span with their largest marginal. A null or empty text has no words, no
    spans and the score of a text without toxic words; repeated rows each have a row; an empty table gives none. Columns of docs
    other than ``keep`` and the text are ignored; a kept column named score, spans or raw is refused. With raw, a column of the values that the logistic map reads.
    """
    if {"score", "spans", "raw"} & set(keep):
        raise ValueError("a kept column has the name of a result; keep it inside a struct")
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.trans, model.map))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*shared.value)
        for batch, texts in pieces(batches, "_t", 2 << 20):
            words, p = crf.marginals(texts)
            x = crf.summary(words, p, texts.n)
            on = np.flatnonzero(p >= span_at)
            line = np.repeat(np.arange(len(chains(texts, words)) - 1), np.diff(chains(texts, words))) if len(p) else p
            new = np.concatenate(([True], (np.diff(on) > 1) | (np.diff(line[on]) > 0))) if len(on) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(on)) - 1 if len(head) else head
            doc = words.doc[on[head]] if len(head) else np.zeros(0, np.int64)
            base = texts.begin[doc]
            top = np.maximum.reduceat(p[on], head) if len(head) else np.zeros(0)
            items = pa.StructArray.from_arrays([pa.array((words.start[on[head]] - base).astype(np.int32)), pa.array((words.end[on[tail]] - base).astype(np.int32)), pa.array(top.astype(np.float64))], ["start", "end", "p"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(texts.n + 1)).astype(np.int32)), items)
            columns = [batch.column(k) for k in range(len(keep))] + [pa.array(crf.score(x)), spans]
            names = [*keep, "score", "spans"]
            if raw:
                columns.append(pa.array(list(x), pa.list_(pa.float64())))
                names.append("raw")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = with_fields(docs.select(*keep), "score double, spans array<struct<start:int,end:int,p:double>>" + ", raw array<double>" * raw)
    return docs.select(*keep, F.col(text_col).alias("_t")).mapInArrow(run, schema)
