"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastcast.llm.tokens import DIGIT, HIGH, LOWER, UPPER, VISIBLE, Texts, hashes, mix, pieces, split
from pastcast.session import ship, with_fields

_SHAPES, _PAIRS, _WORDS = 512, 254, 256
#: Terms: hashed token shapes, hashed pairs of shapes, hashed words, a token repeated at once, a token repeated after one.
TERMS = _SHAPES + _PAIRS + _WORDS + 2
_KINDS = np.stack([UPPER, LOWER | HIGH, DIGIT, ~(UPPER | LOWER | HIGH | DIGIT)]).astype(np.int32)
_SOFT = np.zeros(256, bool)
_SOFT[list(b".,;:")] = True
_LOUD = np.zeros(256, bool)
_LOUD[list(b"!?")] = True


def terms(texts: Texts) -> np.ndarray:
    """texts x TERMS: log of one plus how often each term occurs; rows of texts without tokens are 0."""
    out = np.zeros(texts.n * TERMS)
    tok = split(texts, VISIBLE)
    if len(tok.start):
        edges = np.stack([tok.start, tok.end], axis=1).reshape(-1)
        edges = edges[:-1] if edges[-1] == len(texts.data) else edges
        upper, lower, digit, other = (np.add.reduceat(kind[texts.data], edges)[::2] for kind in _KINDS)
        size = tok.end - tok.start
        first_upper = UPPER[texts.data[tok.start]]
        letters = upper + lower
        case = np.where(letters == 0, 0, np.where(upper == 0, 1, np.where(lower == 0, 2, np.where(first_upper & (upper == 1), 3, 4))))
        last = texts.data[tok.end - 1]
        tail = np.where(_SOFT[last], 1, np.where(_LOUD[last], 2, np.where(_KINDS[3][last] == 1, 3, 0)))
        coarse = (case * 4 + tail) * 4 + np.minimum(other, 3)
        shape = (coarse * 2 + (digit > 0)) * 6 + np.searchsorted([1, 3, 6, 10, 15], size)
        h = hashes(texts, tok)
        same = tok.doc[1:] == tok.doc[:-1]
        pair = coarse[:-1] * 80 + coarse[1:]
        again = same & (h[1:] == h[:-1])
        later = (tok.doc[2:] == tok.doc[:-2]) & (h[2:] == h[:-2])
        hashed = lambda x, n: (mix(x.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
        for doc, term in (
            (tok.doc, hashed(shape, _SHAPES)),
            (tok.doc[1:][same], _SHAPES + hashed(pair[same], _PAIRS)),
            (tok.doc, _SHAPES + _PAIRS + hashed(h, _WORDS)),
            (tok.doc[1:][again], np.full(again.sum(), TERMS - 2)),
            (tok.doc[2:][later], np.full(later.sum(), TERMS - 1)),
        ):
            out += np.bincount(doc * TERMS + term, minlength=len(out))
    return np.log1p(out).reshape(texts.n, TERMS).astype(np.float32)


@dataclass
class Neighbours:
    """Projection to the latent space, unit vectors of the labelled texts there, their labels and vote weights."""

    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def vote(self, x: np.ndarray, k: int = 25, block: int = 512) -> np.ndarray:
        """Share of label 1 among the k nearest by exact cosine, weighted by its fourth power; all that tie with the k-th count; the prior for empty texts."""
        out = np.full(len(x), self.prior)
        k = min(k, len(self.labels))
        if not k:
            return out
        for at in range(0, len(x), block):
            some = x[at : at + block]
            cosine = self.project(some) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 4 * self.weights[near]
            total, good = w.sum(axis=1), (w * self.labels[near]).sum(axis=1)
            last = np.take_along_axis(cosine, near, axis=1).min(axis=1)
            tied = cosine >= last[:, None]
            for i in np.flatnonzero(tied.sum(axis=1) > k):
                every = np.maximum(cosine[i, tied[i]], 0) ** 4 * self.weights[tied[i]]
                total[i], good[i] = every.sum(), (every * self.labels[tied[i]]).sum()
            ok = (total > 0) & some.any(axis=1)
            out[at : at + block][ok] = (good + 0.5 * self.prior * self.weights.min())[ok] / (total + 0.5 * self.weights.min())[ok]
        return out


def picked(labels: DataFrame, label: str, most: int, key: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """About ``most`` rows (key, label) of each label 0 and 1, by a hash of the key, and how many of each there are."""
    rows = labels.select(key, label).filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).distinct()
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    part: Column = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    limit = F.lit(0.0)
    for value, n in sizes.items():
        limit = F.when(F.col(label) == value, min(1.0, most / n)).otherwise(limit)
    return rows.filter(part < limit), sizes


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text_col: str = "text", most: int = 3000, dims: int = 48) -> Neighbours:
    """Fits on about ``most`` documents of each label, picked by a hash of the key; labels has (key, label in 0, 1).

    The picked keys, bounded by ``most``, are broadcast to the documents; of rows that repeat a key one counts. Their term rows (TERMS numbers each) come to the driver, which finds
    the latent space from their singular vectors. Votes weigh a label by how common it is among all labels. Without labels
    of both kinds every score is the share of label 1, smoothed by one label of each kind.
    """
    spark = docs.sparkSession
    ship(spark)
    some, sizes = picked(labels, label, most, key)
    rows = docs.select(key, F.col(text_col).alias("_t")).join(F.broadcast(some), key).groupBy(key, F.col(label).cast("int").alias("y")).agg(F.min("_t").alias("_t")).select("_t", "y")  # a key names one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_t"):
            x = terms(texts)
            offsets = pa.array((np.arange(texts.n + 1) * TERMS).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1))), batch.column(1)], ["x", "y"])

    got = rows.mapInArrow(run, "x array<float>, y int").toArrow()
    y = got.column(1).to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:
        none = np.zeros(0, np.float32)
        return Neighbours(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), none, none, (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2))
    x = got.column(0).combine_chunks().flatten().to_numpy().reshape(len(y), TERMS)
    share = np.array([sizes[v] / max((y == v).sum(), 1) for v in (0, 1)])
    seen = (x > 0).T @ share[y]
    idf = np.log((1 + share[y].sum()) / (1 + seen)) + 0.1
    unit = x * idf
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    _, vectors = np.linalg.eigh((unit.T @ unit).astype(np.float64))
    basis = (idf[:, None] * vectors[:, ::-1][:, :dims]).astype(np.float32)
    model = Neighbours(basis, np.zeros((0, dims), np.float32), y.astype(np.float32), (share[y] / share.min()).astype(np.float32), float(sizes[1] / (sizes[0] + sizes[1])))
    model.vectors = model.project(x).astype(np.float32)
    return model


def score(docs: DataFrame, model: Neighbours, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, score) of every text: exact cosines to all labelled vectors, in blocks.

    Null and empty texts get the share of label 1; repeated rows each have a row; an empty table gives none; columns of docs other
    than the key and the text are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_t"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.vote(terms(texts)).astype(np.float64))], [key, "score"])

    return docs.select(key, F.col(text_col).alias("_t")).mapInArrow(run, with_fields(docs.select(key), "score double"))
