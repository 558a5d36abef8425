"""Hard negatives of anchor vectors by a vertical scan with bounds (operator 12).

Vectors are kept in blocks of columns, one per dimension. An anchor reads a block's columns in the descending order of
its own magnitudes. What the columns not read yet can add lies between sums of their smallest and largest products, so
rows leave the candidates as soon as they can't reach what is still asked for: the best rows of the anchor's label,
then the rows of other labels whose score lies in a positive's window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.session import ship, stored

#: Rows of a block of columns.
BLOCK_ROWS = 4096
#: Bytes of the anchors' vectors that are broadcast at once; the rest follow in further scans.
ANCHOR_BYTES = 16 << 20
#: Columns read between two looks at the bounds.
STEP = 8


@dataclass
class Block:
    """Rows in the order of their labels: ids, labels, components by dimension (whole numbers)."""

    ids: np.ndarray
    labels: np.ndarray
    columns: np.ndarray  # dimensions x rows

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray) -> Block:
        order = np.lexsort((ids, labels))
        return cls(ids[order], labels[order], np.ascontiguousarray(columns[:, order]))

    @classmethod
    def read(cls, ids: bytes, labels: bytes, columns: bytes) -> Block:
        ids = np.frombuffer(ids, np.int64)
        return cls(ids, np.frombuffer(labels, np.int64), np.frombuffer(columns, np.float64).reshape(-1, len(ids)))

    def deepened(self, dims: int) -> np.ndarray:
        return np.pad(self.columns, ((0, max(0, dims - len(self.columns))), (0, 0)))

    def label_runs(self) -> dict[int, slice]:
        values, first = np.unique(self.labels, return_index=True)
        return {int(v): slice(a, b) for v, a, b in zip(values, first, [*first[1:], len(self.labels)], strict=True)}


class Scan:
    """Columns of some rows and the range of each, for anchors to read."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray):
        self.ids, self.columns = ids, columns
        self.low, self.high = columns.min(axis=1), columns.max(axis=1)

    def exact_for(self, anchors: np.ndarray) -> bool:
        """Whether doubles hold every sum of products without rounding."""
        top = max(float(np.abs(self.low).max(initial=0)), float(np.abs(self.high).max(initial=0)))
        return top * float(np.abs(anchors).max(initial=0)) * len(self.columns) < 2.0**53

    def whole(self) -> Scan:
        """The same with integers of any size."""
        to_int = np.frompyfunc(int, 1, 1)
        return Scan(self.ids, to_int(self.columns))

    def survivors(self, q: np.ndarray, may_stay) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the rows that ``may_stay`` never ruled out.

        ``may_stay(lower, upper)`` gets bounds of the scores of the rows that are left and says which stay.
        """
        order = np.argsort(-np.abs(q), kind="stable")
        q = q[order]
        ends = np.stack([q * self.low[order], q * self.high[order]])
        least, most = (np.concatenate((np.cumsum(x[::-1])[::-1], [0])) for x in (ends.min(axis=0), ends.max(axis=0)))
        alive, score = None, np.zeros(self.columns.shape[1], q.dtype)  # alive None: all rows
        for at in range(0, len(q), STEP):
            stay = may_stay(score + least[at], score + most[at])
            if not stay.all():
                alive = np.flatnonzero(stay) if alive is None else alive[stay]
                score = score[stay]
                if not len(alive):
                    return alive, score
            dims = order[at : at + STEP]
            read = self.columns[dims] if alive is None else self.columns[dims[:, None], alive]
            score = score + q[at : at + STEP] @ read
        alive = np.arange(len(score)) if alive is None else alive
        stay = may_stay(score, score)
        return alive[stay], score[stay]


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties by smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def best_of_label(scan: Scan, q: np.ndarray, own_id: int, k: int, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The k first rows of the scan and of those held already, without the anchor itself."""
    others = scan.ids != own_id
    floor = held[1][-1] if len(held[1]) >= k else None

    def may_stay(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        least = floor
        if len(lower) > k + 1:  # one of the k + 1 may be the anchor
            kth = np.partition(lower, len(lower) - k - 1)[len(lower) - k - 1]
            least = kth if least is None else max(least, kth)
        return np.ones(len(lower), bool) if least is None else upper >= least

    rows, scores = scan.survivors(q, may_stay)
    scores, rows = scores[others[rows]], rows[others[rows]]
    return first(np.concatenate((held[0], scan.ids[rows])), np.concatenate((held[1], scores)), k)


def best_in_windows(scan: Scan, q: np.ndarray, windows: list[tuple[int, int]], k: int, held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores (both ends inside) the k first rows of the scan and of those held already."""
    floors = [max(low, h[1][-1]) if len(h[1]) >= k else low for (low, _), h in zip(windows, held, strict=True)]
    least, most = min(floors), max(high for _, high in windows)
    rows, scores = scan.survivors(q, lambda lower, upper: (upper >= least) & (lower <= most))
    out = []
    for (_, high), floor, h in zip(windows, floors, held, strict=True):
        inside = (scores >= floor) & (scores <= high)
        out.append(first(np.concatenate((h[0], scan.ids[rows[inside]])), np.concatenate((h[1], scores[inside])), k) if inside.any() else h)
    return out


def _usable(vectors: DataFrame, scale: float, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v): one row of each id, components times ``scale``, not yet rounded down."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") * scale)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _blocks(rows: DataFrame) -> DataFrame:
    """(ids, labels, columns) as bytes, one row per block."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            some = whole.slice(at, BLOCK_ROWS).combine_chunks().to_batches()[0]
            v = some.column(2)
            flat, size = v.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)
            columns = np.zeros((int(size.max(initial=0)), len(size)))
            row = np.repeat(np.arange(len(size)), size)
            columns[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), row] = np.floor(flat)
            b = Block.of(some.column(0).to_numpy(), some.column(1).to_numpy(), columns)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (b.ids, b.labels, b.columns)], ["ids", "labels", "columns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)

    return rows.mapInArrow(run, "ids binary, labels binary, columns binary")


def _as_long(x) -> int:
    x = int(x)
    if not -(1 << 63) <= x < 1 << 63:
        raise OverflowError("an inner product is beyond 64 bits")
    return x


@dataclass
class Anchors:
    """Anchors of one scan: ids, labels, vectors (rows) and, for the second scan, the scores of each one's positives."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    positive_scores: list[list[int]] | None = None

    def scans(self, block: Block, same_label: bool) -> Iterator[tuple[Scan, list[int]]]:
        """Scans of a block's rows with the anchors that read them; vectors of different lengths are padded with 0."""
        columns = block.deepened(self.vectors.shape[1])
        runs = block.label_runs()
        for label in np.unique(self.labels):
            mine = np.flatnonzero(self.labels == label)
            own = runs.get(int(label), slice(0, 0))
            inside = np.zeros(len(block.ids), bool)
            inside[own] = True
            rows = own if same_label else np.flatnonzero(~inside)
            if len(block.ids[rows]) and len(columns):
                yield Scan(block.ids[rows], columns[:, rows]), list(mine)

    def deepened(self, dims: int) -> np.ndarray:
        return np.pad(self.vectors, ((0, 0), (0, max(0, dims - self.vectors.shape[1]))))

    def read(self, block: Block, held: dict, positives: int, negatives: int, low: int, high: int) -> None:
        """Adds a block's rows to what each anchor holds: (ids, scores) of its label, or of each positive's window."""
        none = (np.zeros(0, np.int64), np.zeros(0))
        first_scan = self.positive_scores is None
        for scan, mine in self.scans(block, first_scan):
            vectors = self.deepened(len(scan.columns))
            exact = scan.exact_for(vectors)
            scan = scan if exact else scan.whole()
            for a in mine:
                q = vectors[a] if exact else np.frompyfunc(int, 1, 1)(vectors[a])
                if first_scan:
                    held[a] = best_of_label(scan, q, self.ids[a], positives, held.get(a, none))
                elif windows := [(-(-low * s // 100), high * s // 100) for s in self.positive_scores[a]]:
                    held[a] = best_in_windows(scan, q, windows, negatives, held.get(a, [none] * len(windows)))


def _scan(blocks: DataFrame, anchors: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """(anchor_id, at, id, score): what each task's blocks have of each anchor; ``at`` is the place of the positive score, -1 for positives."""
    shared = blocks.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = shared.value, {}
        for batch in batches:
            for row in zip(*[batch.column(k) for k in range(3)], strict=True):
                own.read(Block.read(*[x.as_buffer() for x in row]), held, positives, negatives, low, high)
        out = []
        for a, got in held.items():
            for at, (ids, scores) in enumerate([got] if own.positive_scores is None else got):
                out += [(int(own.ids[a]), -1 if own.positive_scores is None else at, int(i), _as_long(s)) for i, s in zip(ids, scores, strict=True)]
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return blocks.mapInArrow(run, "anchor_id long, at int, id long, score long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor_id", "at", "id", "score"])


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, id_col: str = "id", label_col: str = "label", vector_col: str = "vector") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(``scale`` x). A row's score is its inner product with the anchor, higher first, ties by smaller id. An
    anchor's positives are its first ``positives`` other rows of its label; each gets the first ``negatives`` rows of other labels whose
    score is from ``low`` to ``high`` hundredths of its own. ``anchors`` is a condition on the column ``id``.

    Rows without an id, a label or a vector take no part, nor do vectors with null or non-finite components; of rows that repeat an id
    the one with the smallest (label, vector) counts; vectors of different lengths meet as if padded with 0; a positive whose
    score is negative has no negatives; an empty table gives no rows; other columns are ignored. Scores are exact, however large the
    components; one beyond 64 bits raises an error.

    Anchors are broadcast, ``ANCHOR_BYTES`` at most at once by the counted size of all; each such part reads all blocks twice.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(_usable(vectors, scale, id_col, label_col, vector_col))
    asked = rows.filter(anchors)
    n, dims = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks, parts = stored(_blocks(rows)), max(1, -(-n * 8 * (dims or 1) // ANCHOR_BYTES))
    out = []
    for part in range(parts):
        some = sorted(asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect())
        wide = max((len(r.v) for r in some), default=0)
        a = Anchors(np.array([r.id for r in some], np.int64), np.array([r.label for r in some], np.int64), np.floor(np.array([[*r.v, *[0.0] * (wide - len(r.v))] for r in some]).reshape(len(some), wide)))
        args = (positives, negatives, low, high)
        found = _ranked(_scan(blocks, a, *args), ["anchor_id"], positives).collect()  # a few per anchor of this part
        place = {int(i): k for k, i in enumerate(a.ids)}
        a.positive_scores = [[] for _ in some]
        scores: dict[tuple[int, int], int] = {}
        named = []
        for r in sorted(found, key=lambda r: (r.anchor_id, r["rank"])):
            own = a.positive_scores[place[r.anchor_id]]
            if r.score >= 0:
                if (r.anchor_id, r.score) not in scores:
                    scores[r.anchor_id, r.score] = len(own)
                    own.append(r.score)
                named.append((r.anchor_id, scores[r.anchor_id, r.score], r.id, r.score))
        pairs = spark.createDataFrame(named, "anchor_id long, at int, positive_id long, positive_score long")
        best = _ranked(_scan(blocks, a, *args), ["anchor_id", "at"], negatives)
        got = best.join(F.broadcast(pairs), ["anchor_id", "at"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(got if parts == 1 else stored(got))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole
