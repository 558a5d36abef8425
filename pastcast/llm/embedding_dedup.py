"""Near-duplicate vectors by product quantisation with exact rerank (operator 10)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastcast.llm.graph import components
from pastcast.session import ship, stored

_SLACK = 1e-6


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centre.T - 0.5 * (centre**2).sum(axis=1)).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        size = np.bincount(near, minlength=len(centre))
        centre[size > 0] = total[size > 0] / size[size > 0, None]
    return centre


@dataclass
class Quantiser:
    """Coarse centres, and for each subspace the codewords of what the nearest centre leaves."""

    centres: np.ndarray
    books: np.ndarray  # subspaces x codewords x width

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int, codewords: int, seed: int = 5) -> Quantiser:
        rng = np.random.default_rng(seed)
        width = -(-x.shape[1] // subspaces)
        x = np.pad(x, ((0, 0), (0, width * subspaces - x.shape[1])))
        centres = _kmeans(x, lists, 12, rng)
        rest = x - centres[cls._coarse(x, centres)]
        books = [_kmeans(rest[:, s * width : (s + 1) * width], codewords, 8, rng) for s in range(subspaces)]
        return cls(centres, np.stack(books))

    @staticmethod
    def _coarse(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)

    def order(self) -> np.ndarray:
        """Place of each list along the direction in which the centres vary most, so that neighbours in it are near each other."""
        c = self.centres - self.centres.mean(axis=0)
        way = np.linalg.eigh(c.T @ c)[1][:, -1]
        out = np.empty(len(c), np.int64)
        out[np.argsort(c @ way, kind="stable")] = np.arange(len(c))
        return out

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.centres.shape[1] - x.shape[1])))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error): nearest centre, nearest codeword per subspace, distance of x to what they stand for."""
        x = self.padded(x)
        coarse = self._coarse(x, self.centres)
        rest = x - self.centres[coarse]
        width = self.books.shape[2]
        codes, error = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for s, book in enumerate(self.books):
            part = rest[:, s * width : (s + 1) * width]
            codes[:, s] = (part @ book.T - 0.5 * (book**2).sum(axis=1)).argmax(axis=1)
            error += ((part - book[codes[:, s]]) ** 2).sum(axis=1)
        return coarse, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, reach: float) -> np.ndarray:
        """vectors x lists: whether a list can hold a vector within ``reach``.

        A vector of another list lies beyond the plane halfway between the two centres; if that plane is
        farther than reach, nothing of that list is near enough.
        """
        x = self.padded(x)
        norm = (self.centres**2).sum(axis=1)
        gap = (norm - 2 * x @ self.centres.T) + (x**2).sum(axis=1)[:, None]
        own = gap.argmin(axis=1)
        between = np.sqrt(np.maximum(norm[:, None] + norm[None] - 2 * self.centres @ self.centres.T, 1e-12))  # too small a distance asks too much, never too little
        return (gap - gap[np.arange(len(x)), own][:, None]) / (2 * between[own]) <= reach + _SLACK

    def lookup(self, x: np.ndarray, coarse: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of exact vectors x to the coded vectors of one list, by table lookups."""
        rest = self.padded(x) - self.centres[coarse]
        width, out = self.books.shape[2], np.zeros((len(x), len(codes)), np.float32)
        for s, book in enumerate(self.books):
            part = rest[:, s * width : (s + 1) * width]
            table = ((part**2).sum(axis=1)[:, None] + (book**2).sum(axis=1)[None] - 2 * part @ book.T).astype(np.float32)
            out += table[:, codes[:, s]]
        return np.sqrt(np.maximum(out, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest absolute component, then by their norm: no component under- or overflows on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(x: np.ndarray, y: np.ndarray, near: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs in ``near`` (rows of x by rows of y, unit rows) have a cosine in doubles of at least the threshold.

    A product of matrices decides what is not within 1e-9 of the threshold. There the sum of the two rows' products decides,
    which is the same number for both orders of a pair.
    """
    out = np.zeros(near.shape, bool)
    i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(i):
        return out
    cosine = x[i] @ y[j].T
    some = near[np.ix_(i, j)]
    hit = some & (cosine >= threshold)
    a, b = np.nonzero(some & (np.abs(cosine - threshold) < 1e-9))
    hit[a, b] = (x[i[a]] * y[j[b]]).sum(axis=1) >= threshold
    out[np.ix_(i, j)] = hit
    return out


def _classes(rows: np.ndarray, cols: np.ndarray, hit: np.ndarray, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label reachable over the links of a block, for each of its rows and columns."""
    a, b, big = rows.astype(np.int32), cols.astype(np.int32), np.iinfo(np.int32).max
    while True:
        before = a.copy(), b.copy()
        for at in range(0, len(a), step):
            some = hit[at : at + step]
            b = np.minimum(b, np.where(some, a[at : at + step, None], big).min(axis=0, initial=big))
        for at in range(0, len(a), step):
            a[at : at + step] = np.minimum(a[at : at + step], np.where(hit[at : at + step], b[None], big).min(axis=1, initial=big))
        if (a == before[0]).all() and (b == before[1]).all():
            return a, b


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, x): one row per id that can link: label not null, components finite, not all zero. x keeps floats as floats.

    Of several rows of one id the smallest (label, vector) counts; only those rows are shuffled with their vectors.
    """
    x = F.col(vec_col)
    if vectors.schema[vec_col].dataType.simpleString() != "array<float>":
        x = x.cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), x.alias("x"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = rows.filter("id is not null and label is not null and x is not null and size(x) > 0").filter(~F.exists("x", bad) & F.exists("x", lambda v: v != 0))
    twice = stored(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    if twice.isEmpty():
        return rows
    one = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.*")
    return rows.join(twice, "id", "left_anti").union(one)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object if pa.types.is_string(column.type) else None)


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    sample_rows: int = 8192,
    lists: int | None = None,
    subspaces: int = 8,
    codewords: int = 64,
    block: int = 2048,
) -> DataFrame:
    """(id, n_links, component_id, kept): links of cosine >= threshold between vectors of one label and width.

    Centres and codewords are fitted on about ``sample_rows`` vectors, picked by a hash of the id; there are as many lists as the
    root of the number of vectors, 16 to 1024, unless ``lists`` says otherwise. Every vector is indexed under its label and nearest
    centre by its codes and its distance to what they stand for. Every vector asks all lists that can hold a vector near enough
    (a bound, not a number of probes). A coded vector is ruled out when its asymmetric distance less its coding error exceeds the
    distance that the threshold stands for, so no link is lost; what is left is compared by exact cosines of doubles (``links``).
    Neighbouring lists of a label are taken together to cells of about ``block`` vectors, and a vector travels once to each
    cell of which it asks a list. A larger cell is cut by hash; a block pair returns a count and a class per row, never its pairs.

    Equal vectors of one label are one member that counts as many (``copies``), so a vector that a third of all rows repeat is
    compared once. Vectors are scaled by their largest component first, so tiny and huge ones link like others. Vectors that
    can't link (null, zero, non-finite components, null label) and null ids stand alone with 0 links; rows that repeat an id give
    one row; an empty table gives none; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    if not 1 <= codewords <= 256:
        raise ValueError("a code is one byte: 1 to 256 codewords")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    key = [F.xxhash64("label", "x", F.lit(k)).alias(f"h{k}") for k in (1, 2)]
    rows = valid(vectors, id_col, vec_col, label_col).select("id", "label", F.size("x").alias("width"), "x", *key)
    reps = rows.groupBy("h1", "h2", "label", "width").agg(F.min(F.struct("id", "x")).alias("r"), F.count("*").alias("copies"))
    reps = stored(reps.select("h1", "h2", "label", "width", "r.*", "copies"))
    found = None
    for r in sorted(reps.groupBy("width").agg(F.count("*").alias("total")).toLocalIterator()):  # widths of vectors are few
        mine = reps.filter(F.col("width") == r.width)
        part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
        some = _matrix(mine.filter(part < min(1.0, sample_rows / r.total)).select("x").toArrow().column(0).combine_chunks()) if r.total > 1 else np.zeros((0, r.width))
        if len(some) < 2:
            some = np.eye(2, r.width) if r.width > 1 else np.array([[1.0], [-1.0]])
        quantiser = Quantiser.fit(unit(some), lists or int(min(1024, max(16, math.sqrt(r.total)))), min(subspaces, r.width), codewords)
        one = _search(mine, quantiser, reach, threshold, block, r.total)
        found = one if found is None else found.union(one)
    ids = vectors.select(F.col(id_col).alias("id")).distinct()
    if found is None:
        return ids.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found)
    counted = found.filter("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    label = components(found.filter("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v")).distinct())
    known = reps.join(counted, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    known = stored(known.select("h1", "h2", "id", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    again = known.filter("copies > 1").select("h1", "h2", "n_links", "component_id")
    of = rows.select("id", "h1", "h2").join(again, ["h1", "h2"]).select("id", "n_links", "component_id")
    of = of.union(known.filter("copies = 1").select("id", "n_links", "component_id"))
    joined = ids.join(of, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return joined.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


#: Labels of more than a block of vectors that are broadcast at most with their number of cells.
BROADCAST_LABELS = 100_000


def _search(rows: DataFrame, quantiser: Quantiser, reach: float, threshold: float, block: int, total: int) -> DataFrame:
    """(id, n, component) per vector and block pair that it is part of."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(quantiser)
    large = stored(rows.groupBy("label").agg(F.count("*").alias("m")).filter(F.col("m") > block).select("label", F.ceil(F.col("m") / block).cast("int").alias("cells")))  # total / block rows at most
    side = F.broadcast(large) if total / block <= BROADCAST_LABELS or large.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else large
    kind = rows.schema["id"].dataType.simpleString()
    number = rows.schema["x"].dataType.elementType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        place = q.order()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                x = unit(_matrix(some.column(2)))
                cells = np.minimum(some.column(3).to_numpy(), len(q.centres))[:, None]
                coarse, codes, error = q.encode(x)
                i, j = np.nonzero(q.probes(x, reach))
                asked = np.unique(np.stack([i, place[j] * cells[i, 0] // len(q.centres)]), axis=1)
                ends = np.searchsorted(asked[0], np.arange(len(x) + 1)).astype(np.int32)
                cell = place[coarse] * cells[:, 0] // len(q.centres)
                columns = [*(some.column(k) for k in (0, 1, 2, 4)), pa.array(coarse.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float32)), pa.array(cell.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(asked[1].astype(np.int32)))], ["id", "label", "x", "copies", "coarse", "codes", "error", "cell", "asks"])

    kept = rows.join(side, "label", "left").select("id", "label", "x", F.coalesce("cells", F.lit(1)).alias("cells"), "copies")
    kept = stored(kept.mapInArrow(index, f"id {kind}, label string, x array<{number}>, copies long, coarse int, codes binary, error float, cell int, asks array<int>"))
    where = ["label", "cell"]
    # blocks of a cell and of those who ask it; a cell that nobody else asks is asked by its own
    sizes = kept.groupBy(*where).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / (2 * block)).cast("int")).drop("n")
    crowd = kept.select("label", F.explode("asks").alias("cell")).groupBy(*where).agg(F.count("*").alias("n")).withColumn("turns", F.ceil(F.col("n") / (2 * block)).cast("int")).drop("n")
    sizes = stored(sizes.join(crowd, where))
    cut = sizes.filter("blocks > 1 or turns > 1")  # every other cell is one block
    salt = lambda n: F.pmod(F.xxhash64("id", F.lit(9)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    n = lambda c: F.coalesce(F.col(c), F.lit(1))
    members = kept.select(*where, "id", "copies", "coarse", "codes", "error", "x").join(cut, where, "left").select(*where, salt(n("blocks")).alias("mb"), every(n("turns")).alias("qb"), "id", "copies", "coarse", "codes", "error", "x")
    asked = kept.select("label", F.explode("asks").alias("cell"), "id", "x").join(cut, where, "left").select(*where, every(n("blocks")).alias("mb"), salt(n("turns")).alias("qb"), "id", "x")

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        id_type = left.column("id_a").type if "id_a" in left.column_names else pa.int64()
        schema = pa.schema([("id", id_type), ("n", pa.int64()), ("component", id_type)])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q = shared.value
        left, right = (t.rename_columns([c[:-2] for c in t.column_names]) for t in (left, right.sort_by("coarse_m")))
        names, place = np.unique(np.concatenate([_ids(left.column("id")), _ids(right.column("id"))]), return_inverse=True)
        ask, ids = place[: left.num_rows], place[left.num_rows :]
        x, y = (unit(_matrix(t.column("x").combine_chunks())) for t in (left, right))
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        error, coarse = right.column("error").to_numpy(), right.column("coarse").to_numpy()
        heads = np.flatnonzero(np.append(True, np.diff(coarse) != 0))
        hit = np.zeros((len(ask), len(ids)), bool)
        for at in range(0, len(ask), 512):
            some = x[at : at + 512]
            near, wants = np.zeros((len(some), len(ids)), bool), q.probes(some, reach)
            for lo, hi in zip(heads, np.append(heads[1:], len(ids)), strict=True):
                who = np.flatnonzero(wants[:, coarse[lo]])
                near[who, lo:hi] = q.lookup(some[who], coarse[lo], codes[lo:hi]) - error[lo:hi] <= reach + 1e-3
            near &= ask[at : at + 512, None] != ids[None]
            hit[at : at + 512] = links(some, y, near, threshold)
        linked, other = hit.any(axis=1), hit.any(axis=0)
        a, b = _classes(ask, ids, hit) if linked.any() else (ask, ids)
        copies = right.column("copies").to_numpy()
        n = np.array([copies[row].sum() for row in hit[linked]], np.int64)
        made = np.concatenate([ask[linked], ids[other]]), np.concatenate([a[linked], b[other]])
        return pa.table([pa.array(names[made[0]], id_type), np.concatenate([n, np.zeros(other.sum(), np.int64)]), pa.array(names[made[1]], id_type)], schema=schema)

    keys = [*where, "mb", "qb"]
    asked, members = (x.toDF(*[c + s for c in x.columns]) for x, s in ((asked, "_a"), (members, "_m")))  # else Spark takes both for one
    by = lambda s: [k + s for k in keys]
    return asked.groupBy(*by("_a")).cogroup(members.groupBy(*by("_m"))).applyInArrow(match, f"id {kind}, n long, component {kind}")
