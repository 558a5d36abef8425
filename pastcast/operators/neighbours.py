"""Exact nearest vectors and vectors within a radius: rows only meet the blocks that can hold what they look for.

Every vector keeps its distances to a few pivots. A block of the searched side is a ring around its nearest pivot and
keeps, for every pivot, the range of its members' distances. By the triangle inequality a row is no nearer to a
member than to that range, for each pivot. A first meeting with the most alike block gives each row a bound;
after that rows beside each other, packed, only meet the bundled blocks that may hold something within the bound of one of them. Packs
and bundles meet where Spark reads both tables, so neither rows nor blocks are shuffled once more for each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastcast.session import ship, stored, with_fields

#: Vectors, picked by a hash of the id, among which pivots are chosen; blocks of the searched side at most (their rows grow with the table beyond).
SAMPLE, MAX_BLOCKS = 4096, 4096
#: Bytes of a searched side, counted, up to which it is broadcast whole instead.
DIRECT_BYTES = 16 << 20
#: A broadcast side of more rows than ``BOXED`` and at most ``FLAT`` numbers a row is cut into boxes; rows that ask beside each other go to few of them. Rows asked at a time.
BOXED, FLAT, ASKED = 1024, 8, 1 << 16
#: Distances that a task holds at a time; of a product in single precision, which stay in a core's cache; pairs computed from the vectors at a time.
CELLS, TILE, PAIRS = 1 << 21, 1 << 19, 1 << 16
#: Bytes of a pack of asking rows or a bundle of blocks, about (each pack is sent to a task with each bundle); packs or bundles of a table, at least, if its rows or blocks are so many.
PACKED, PACKS = 16 << 20, 16
_SLACK, _GRID = 1e-7, 256


def pivots_of(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each the farthest from those before it; fewer if no more differ."""
    out = x[:1]
    near = np.full(len(x), np.inf)
    while 0 < len(out) < n:
        near = np.minimum(near, ((x - out[-1]) ** 2).sum(axis=1))
        if not near.max() > 0:
            break
        out = np.vstack((out, x[near.argmax()]))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.reshape(-1)))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(x) else np.zeros((0, len(pivots)))


def units(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows of length 1 for the cosine, zero rows as they are; the rows themselves for other metrics."""
    if metric != "cosine":
        return x
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def reach(u: np.ndarray, metric: str) -> np.ndarray:
    """A distance of the metric as one of the triangle inequality."""
    return (np.sqrt(np.maximum(2 * u, 0)) if metric == "cosine" else u) + _SLACK


class Neighbours:
    """The searched side (id, vec[, group]) in blocks, ready to be asked by any number of rows of the other side.

    metric: euclidean, or cosine (1 less the cosine; 1 for a zero vector). Vectors of one side and the other have one length; null vectors take no
    part; a row is no neighbour of the row with its own id. With ``group``, the name of a column of both sides, a row asks each
    group but its own by itself; groups are few. ``met`` counts (meetings of a row and a block, all there could be). A searched side of at most
    ``direct`` bytes is broadcast and has no blocks; the results are the same.
    """

    def __init__(self, right: DataFrame, metric: str = "euclidean", group: str | None = None, block: int = 4096, pivots: int = 32, direct: int = DIRECT_BYTES) -> None:
        self.spark, self.metric, self.group, self.met = right.sparkSession, metric, group, (0, 0)
        ship(self.spark)
        rows = self._plain(right)
        n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
        self.small, self.bundled, self.n, self.most = None, None, n, max(64, PACKED // (8 * max(width, 1)))
        if n * width * 8 <= direct:
            whole = rows.toArrow().combine_chunks()
            part = lambda name: whole.column(name).combine_chunks() if n else whole.column(name)
            y = units(_matrix(part("vec")), metric) if n else np.zeros((0, 1))
            g = whole.column("g").to_pandas().to_numpy()
            self.groups = sorted(set(g))
            members = [np.flatnonzero(g == x) for x in self.groups]
            boxes = [boxes_of(y[m]) if metric == "euclidean" and len(m) > BOXED and y.shape[1] <= FLAT else None for m in members]
            self.small = (y, whole.column("id").to_pandas().to_numpy(), members, boxes)
            return
        share = F.lit(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)).cast("long")
        some = sorted(rows.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < share).select("id", "vec").limit(8 * SAMPLE).collect())
        sample = np.array([r.vec for r in some], float) if some else np.zeros((1, 1))
        self.pivots = pivots_of(units(sample, metric), pivots)
        cell = lambda d: d.argmin(axis=1)
        rows = stored(self._with_lists(rows, cell))
        grid = F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)])
        size = max(block, -(-n // MAX_BLOCKS))
        cuts = {(r.g, r.cell): [r.s[i * _GRID // m] for i in range(1, m)] for r in rows.groupBy("g", "cell").agg(F.count("*").alias("n"), F.percentile_approx(F.get("d", F.col("cell")), grid, F.lit(10 * _GRID)).alias("s")).collect() if (m := min(_GRID, -(-r.n // size)))}
        rows = self._with_rings(rows, cuts)
        low, high = (F.array(*[f(F.get("d", F.lit(j))) for j in range(len(self.pivots))]) for f in (F.min, F.max))
        rings = sorted(rows.groupBy("g", "cell", "ring").agg(F.count("*").alias("n"), low.alias("low"), high.alias("high")).collect(), key=lambda r: (r.g, r.cell, r.ring))
        parts = [max(1, -(-r.n // size)) for r in rings]  # many equal distances make a large ring, which is dealt by hash
        first = np.cumsum([0, *parts])
        known = [(r.g, r.cell, r.ring, int(first[i]), parts[i]) for i, r in enumerate(rings)]
        places = self.spark.createDataFrame(known, "g string, cell int, ring int, first int, parts int")
        self.rows = stored(rows.join(F.broadcast(places), ["g", "cell", "ring"]).select("id", "vec", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(6)), F.col("parts"))).cast("int").alias("block")))
        wide = len(self.pivots)
        self.low, self.high = (np.repeat(np.array([r[c] for r in rings]).reshape(len(rings), wide), parts, axis=0) for c in ("low", "high"))
        self.groups = sorted({r.g for r in rings})
        self.of_block = np.repeat(np.array([self.groups.index(r.g) for r in rings], np.int64), parts)

    def _plain(self, df: DataFrame) -> DataFrame:
        g = F.col(f"`{self.group}`").cast("string") if self.group else F.lit("")
        return df.select("id", F.coalesce(g, F.lit("")).alias("g"), F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null")

    def _with_lists(self, rows: DataFrame, cell=None) -> DataFrame:
        """Unit vectors where the cosine counts, distances to the pivots, and the nearest one if asked for."""
        pivots, metric = self.pivots, self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = units(_matrix(batch.column(2)), metric)
                d = _to_pivots(x, pivots)
                more = [pa.array(cell(d).astype(np.int32))] if cell else []
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(x), _lists(d), *more], ["id", "g", "vec", "d", *(["cell"] if cell else [])])

        return rows.mapInArrow(run, with_fields(rows.select("id", "g"), "vec array<double>, d array<double>" + ", cell int" * bool(cell)))

    def _with_rings(self, rows: DataFrame, cuts: dict[tuple[str, int], list[float]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g, cell, d = batch.column(1).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(), _matrix(batch.column(3))
                ring = np.zeros(len(g), np.int32)
                for key in set(zip(g, cell, strict=True)):
                    at = np.flatnonzero((g == key[0]) & (cell == key[1]))
                    ring[at] = np.searchsorted(cuts[key], d[at, key[1]]) if cuts.get(key) else 0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ring)], [*batch.schema.names, "ring"])

        return rows.mapInArrow(run, with_fields(rows, "ring int"))

    def _asking(self, left: DataFrame) -> DataFrame:
        return self._with_lists(self._plain(left))

    def _first_meeting(self, asking: DataFrame) -> DataFrame:
        """(id, to, vec, d, u, block): for each row and each group it asks, the block whose distances to the pivots are most like its own."""
        middle, of_block, groups, grouped = (self.low + self.high) / 2, self.of_block, self.groups, bool(self.group)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d, own = _matrix(batch.column(3)), batch.column(1).to_numpy(zero_copy_only=False)
                gap = (d**2).sum(axis=1)[:, None] - 2 * d @ middle.T + (middle**2).sum(axis=1)[None]
                for g, name in enumerate(groups):
                    mine = np.flatnonzero(of_block == g)
                    at = np.flatnonzero(own != name) if grouped else np.arange(len(d))
                    if len(at) and len(mine):
                        best = mine[gap[np.ix_(at, mine)].argmin(axis=1)]
                        take = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([take.column(0), pa.array(np.full(len(at), g, np.int32)), take.column(2), take.column(3), pa.array(np.full(len(at), np.inf)), pa.array(best.astype(np.int32))], ["id", "to", "vec", "d", "u", "block"])

        return asking.mapInArrow(run, with_fields(asking.select("id"), "to int, vec array<double>, d array<double>, u double, block int"))

    def _further_meetings(self, asking: DataFrame) -> DataFrame:
        """(id, to, vec, u, block): rows (id, to, vec, d, u, seen) with every block of their group, but ``seen``, that may hold a member within u."""
        low, high, of_block, metric = self.low, self.high, self.of_block, self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d, to, u, seen = _matrix(batch.column(3)), batch.column(1).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy()
                for at in range(0, len(d), 256):
                    some = slice(at, at + 256)
                    least = np.zeros((len(d[some]), len(low)))
                    for j in range(d.shape[1]):
                        x = d[some, j, None]
                        np.maximum(least, np.maximum(low[:, j] - x, x - high[:, j]), out=least)
                    may = (least <= reach(u[some], metric)[:, None]) & (of_block[None] == to[some, None])
                    row, block = np.nonzero(may & (np.arange(len(low))[None] != seen[some, None]))
                    for k in range(0, len(row), 4096):
                        take = batch.take(pa.array(row[k : k + 4096] + at))
                        yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), take.column(2), take.column(4), pa.array(block[k : k + 4096].astype(np.int32))], ["id", "to", "vec", "u", "block"])

        return asking.mapInArrow(run, with_fields(asking.select("id", "to"), "vec array<double>, u double, block int"))

    def _meet(self, dealt: DataFrame, k: int | None, digits: int, keep: bool, rows_per_task: int = 8192) -> DataFrame:
        """(id, to[, vec, d, seen, u], found): what each dealt row finds in its block, the k best or all within u; with ``keep`` a row for the next meetings."""
        counts = dealt.groupBy("block").agg(F.count("*").alias("c")).select("block", F.greatest(F.ceil(F.col("c") / rows_per_task), F.lit(1)).cast("int").alias("parts"))
        counts = stored(counts)  # at most a row per block
        left = dealt.join(F.broadcast(counts), "block").withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts"))).drop("parts")
        right = self.rows.join(F.broadcast(counts), "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
        left, names = left.select("block", "part", "id", "to", "vec", "u", *(["d"] if keep else [])), ["id", "to", *(["vec", "d", "seen", "u"] if keep else []), "found"]
        other = self.rows.schema["id"].dataType.simpleString()
        schema = with_fields(dealt.select("id", "to"), ("vec array<double>, d array<double>, seen int, u double, " if keep else "") + f"found array<struct<other:{other},distance:double,place:double>>")
        cosine = self.metric == "cosine"

        def match(one: pa.Table, two: pa.Table) -> pa.Table:
            one, two = one.combine_chunks(), two.combine_chunks()
            kind = two.column("r_id").type if two.num_columns else pa.int64()
            found_type = pa.list_(pa.struct([("other", kind), ("distance", pa.float64()), ("place", pa.float64())]))
            found, bound = [], np.full(one.num_rows, np.inf)
            if one.num_rows and two.num_rows:
                x, y = (_matrix(t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)) for t, c in ((one, "vec"), (two, "r_vec")))
                limit = one.column("u").to_numpy()
                for some, pairs in best_pairs(x, y, one.column("id").to_pandas().to_numpy(), two.column("r_id").to_pandas().to_numpy(), limit, k, digits, cosine):
                    i, j, d = pairs
                    ends = np.searchsorted(i, np.arange(some.start, some.stop + 1)).astype(np.int32)
                    items = pa.StructArray.from_arrays([two.column("r_id").combine_chunks().take(pa.array(j)) if isinstance(two.column("r_id"), pa.ChunkedArray) else two.column("r_id").take(pa.array(j)), pa.array(d), pa.array(np.round(d, digits))], ["other", "distance", "place"])
                    found.append(pa.ListArray.from_arrays(pa.array(ends), items).cast(found_type))
                    if k:
                        full = np.flatnonzero(np.diff(ends) == k)
                        bound[full + some.start] = np.maximum.reduceat(d, ends[:-1][full]) if len(full) else np.inf
            column = pa.chunked_array(found, found_type) if found else pa.chunked_array([pa.array([[]] * one.num_rows, found_type)])
            columns = [one.column("id"), one.column("to"), *([one.column("vec"), one.column("d"), one.column("block"), pa.array(bound)] if keep else []), column]
            return pa.table(dict(zip(names, columns, strict=True)))

        right = right.toDF(*[f"r_{c}" for c in right.columns])
        return left.groupBy("block", "part").cogroup(right.groupBy("r_block", "r_part")).applyInArrow(match, schema)

    def _packs(self, rows: DataFrame, n: int, k: int) -> DataFrame:
        """(pack, to, ids, vecs, us, seen, may): n rows (id, to, vec, seen, u), beside each other in the table, packed; may: the blocks that may hold something for one of them."""
        low, high, of_block, pivots, metric, size = self.low, self.high, self.of_block, self.pivots, self.metric, max(64, min(self.most, -(-n // PACKS), PACKED // (16 * k)))  # so are the k best of its rows

        def packed(held: list[pa.RecordBatch], to: int) -> pa.RecordBatch:
            one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x, u, seen = _matrix(one.column(2)), one.column(4).to_numpy(), one.column(3).to_numpy()
            d, may = _to_pivots(x, pivots), np.zeros(len(low), bool)
            cuts = [0, *(np.flatnonzero(seen[1:] != seen[:-1]) + 1), len(seen)]
            for a, b in zip(cuts, cuts[1:], strict=False):  # rows of one first block
                least = np.maximum(low - d[a:b].max(axis=0), d[a:b].min(axis=0) - high).max(axis=1)
                may |= (least <= reach(u[a:b].max(), metric)) & (of_block == to) & (np.arange(len(low)) != seen[a])
            ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), one.column(0))
            columns = [pa.array([to], pa.int32()), ids, *(pa.array([c.tobytes()]) for c in (x, u, seen)), pa.array([np.flatnonzero(may).tolist()], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, ["to", "ids", "vecs", "us", "seen", "may"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, key = [], 0, None
            for batch in batches:
                to = batch.column(1).to_numpy()
                cuts = sorted({0, *(np.flatnonzero(to[1:] != to[:-1]) + 1), *range(0, len(to), size), len(to)})
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if held and (key != to[a] or n + b - a > size):
                        yield packed(held, int(key))
                        held, n = [], 0
                    held, n, key = [*held, batch.slice(a, b - a)], n + b - a, to[a]
            if held:
                yield packed(held, int(key))

        kind = rows.schema["id"].dataType.simpleString()
        return stored(rows.select("id", "to", "vec", "seen", "u").mapInArrow(run, f"to int, ids array<{kind}>, vecs binary, us binary, seen binary, may array<int>").withColumn("pack", F.monotonically_increasing_id()))

    def _blocks(self) -> DataFrame:
        """(r_block, r_ids, r_vecs): the searched side, a row per block."""
        kind = self.rows.schema["id"].dataType.simpleString()

        def pack(one: pa.Table) -> pa.Table:
            ids = one.column("id").combine_chunks()
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            x = np.concatenate([_matrix(c) for c in one.column("vec").chunks])
            return pa.table({"r_block": one.column("block").slice(0, 1), "r_ids": pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids), "r_vecs": pa.array([x.tobytes()])})

        return self.rows.groupBy("block").applyInArrow(pack, f"r_block int, r_ids array<{kind}>, r_vecs binary")

    def _bundles(self) -> DataFrame:
        """(r_blocks, r_rows): blocks beside each other, together; made once."""
        if self.bundled is None:
            together = max(1, min(self.most * len(self.low) // max(self.n, 1), len(self.low) // PACKS))
            rows = self._blocks().groupBy(F.floor(F.col("r_block") / together)).agg(F.collect_list(F.struct("r_block", "r_ids", "r_vecs")).alias("r_rows"))
            self.bundled = stored(rows.select(F.col("r_rows.r_block").alias("r_blocks"), "r_rows"))
        return self.bundled

    def _packs_meet(self, packs: DataFrame, k: int, digits: int) -> DataFrame:
        """(to, met, found): per pack and part of the bundles, the k best of each of its rows within its bound, and how often a row met a block."""
        low, high, pivots, metric = self.low, self.high, self.pivots, self.metric
        both = packs.join(self._bundles().hint("shuffle_replicate_nl"), F.arrays_overlap("may", "r_blocks")).select("pack", "to", "ids", "vecs", "us", "seen", "may", "r_rows")
        kind, other = packs.schema["ids"].dataType.elementType.simpleString(), self.rows.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = None  # the pack at hand; its bundles follow each other

            def told() -> pa.RecordBatch:
                held = np.arange(k) < now["held"][:, None]
                i, j, d = np.nonzero(held)[0], now["who"][held], now["near"][held]
                items = pa.StructArray.from_arrays([now["ids"].take(pa.array(i)), pa.array(j, now["kind"]), pa.array(d), pa.array(np.round(d, digits))], ["id", "other", "distance", "place"])
                return pa.RecordBatch.from_arrays([pa.array([now["to"]], pa.int32()), pa.array([now["met"]]), pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)], ["to", "met", "found"])

            def ask(b: int, y: np.ndarray, others: np.ndarray) -> None:
                least = np.maximum(low[b] - now["d"], now["d"] - high[b]).max(axis=1)
                some = np.flatnonzero((least <= reach(now["cap"], metric)) & (now["seen"] != b))
                now["met"] += len(some)
                if not len(some):
                    return
                for i, j, d in pairs_within(now["x"][some], y, now["cap"][some] + 2 * 10.0**-digits, metric == "cosine"):
                    i = some[i]
                    new = (now["plain"][i] != others[j]) & (d <= now["cap"][i] + 2 * 10.0**-digits)
                    if new.any():
                        take_in(now["near"], now["who"], now["held"], (i[new], others[j[new]], d[new]), digits)
                full = now["held"] == k
                now["cap"][full] = np.minimum(now["cap"][full], now["near"][full, k - 1] + 10.0**-digits)

            for batch in batches:
                for r in range(batch.num_rows):
                    at = lambda c: batch.column(c)[r]  # noqa: E731, B023
                    blocks, many, vecs = (at(7).values.field(c) for c in ("r_block", "r_ids", "r_vecs"))
                    if now is None or now["pack"] != at(0).as_py():
                        if now:
                            yield told()
                        ids = at(2).values
                        x = np.frombuffer(at(3).as_buffer()).reshape(len(ids), -1)
                        now = {"pack": at(0).as_py(), "to": at(1).as_py(), "ids": ids, "plain": ids.to_pandas().to_numpy(), "x": x, "d": _to_pivots(x, pivots), "cap": np.frombuffer(at(4).as_buffer()).copy(), "seen": np.frombuffer(at(5).as_buffer(), np.int32), "met": 0, "kind": many.type.value_type}
                        now |= {"may": set(at(6).as_py()), "near": np.zeros((len(x), k)), "who": np.empty((len(x), k), many.flatten().to_pandas().to_numpy().dtype), "held": np.zeros(len(x), np.int64)}
                    for t, b in enumerate(blocks.to_pylist()):
                        if b in now["may"]:
                            ask(b, np.frombuffer(vecs[t].as_buffer()).reshape(len(many[t].values), -1), many[t].values.to_pandas().to_numpy())
            if now:
                yield told()

        return stored(both.mapInArrow(run, f"to int, met long, found array<struct<id:{kind},other:{other},distance:double,place:double>>"))

    def _flat(self, found: DataFrame) -> DataFrame:
        return found.select("id", "to", F.explode("found").alias("f")).select("id", "to", "f.other", "f.distance", "f.place")

    def _named(self, out: DataFrame) -> DataFrame:
        return out.withColumn("to", F.element_at(F.array(*[F.lit(g) for g in self.groups] or [F.lit("")]), F.col("to") + 1)) if self.group else out.drop("to")

    def _at_once(self, left: DataFrame, k: int | None, radius: float, digits: int) -> DataFrame:
        """(id, to, other, distance, rank) against the whole searched side in every task."""
        tasks = 2 * self.spark.sparkContext.defaultParallelism  # a small table comes in one part, but its rows ask for much work
        rows, shared, metric, groups, grouped = self._plain(left).repartition(tasks, "id"), self.spark.sparkContext.broadcast(self.small), self.metric, self.groups, bool(self.group)
        kind = left.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y, others, members, boxes = shared.value
            for batch in larger(batches, ASKED) if any(boxes) else batches:
                own, ids = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_pandas().to_numpy()
                x = units(_matrix(batch.column(2)), metric)
                for g, mine in enumerate(members):
                    at = np.flatnonzero(own != groups[g]) if grouped else np.arange(len(ids))
                    if not len(at):
                        continue
                    asked, limit = (x[at], y[mine], ids[at], others[mine]), np.full(len(at), radius)
                    found = boxed_pairs(*asked, limit, k, digits, boxes[g]) if k and boxes[g] else (p for _, p in best_pairs(*asked, limit, k, digits, metric == "cosine"))
                    for i, j, d in found:
                        new = np.r_[True, i[1:] != i[:-1]][: len(i)]
                        rank = np.arange(len(i)) - np.flatnonzero(new)[np.cumsum(new) - 1] + 1
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[i])), pa.array(np.full(len(i), g, np.int32)), pa.array(others[mine[j]], batch.column(0).type), pa.array(d), pa.array(rank.astype(np.int32))], ["id", "to", "other", "distance", "rank"])

        return rows.mapInArrow(run, with_fields(rows.select("id"), f"to int, other {kind}, distance double, rank int"))

    def nearest(self, left: DataFrame, k: int, digits: int = 9) -> DataFrame:
        """(id, [to,] other, distance, rank): the k nearest of each row of left (id, vec[, group]); ties of so many ``digits`` by id.

        Any number of rows may ask. A row whose first block holds fewer than k others has no bound and meets all blocks of its group.
        """
        if self.small:
            return self._named(self._at_once(left, k, np.inf, digits))
        asking = self._asking(left)
        first = stored(self._first_meeting(asking))
        seen = stored(self._meet(first, k, digits, True))
        asked = {r.to: r["count"] for r in first.groupBy("to").count().collect()}
        further = self._packs_meet(self._packs(seen, sum(asked.values()), k), k, digits)
        sizes = np.bincount(self.of_block, minlength=len(self.groups))
        self.met = (sum(asked.values()) + (further.agg(F.sum("met")).first()[0] or 0), sum(n * int(sizes[to]) for to, n in asked.items()))
        out = self._flat(seen).unionByName(further.select("to", F.explode("found").alias("f")).select("f.id", "to", "f.other", "f.distance", "f.place"))
        place = F.row_number().over(Window.partitionBy("id", "to").orderBy("place", "other"))
        return self._named(out.withColumn("rank", place).drop("place").filter(F.col("rank") <= k))

    def within(self, left: DataFrame, radius: float, digits: int = 9) -> DataFrame:
        """(id, [to,] other, distance): all pairs at a distance, rounded to so many digits, of at most the radius."""
        if self.small:
            return self._named(self._at_once(left, None, float(radius) + 10.0**-digits, digits).drop("rank").filter(F.round("distance", digits) <= radius))
        asking = self._asking(left)
        to = F.explode(F.sequence(F.lit(0), F.lit(max(len(self.groups), 1) - 1)))
        asked = asking.withColumns({"to": to, "u": F.lit(float(radius) + 10.0**-digits), "seen": F.lit(-1)})
        if self.group:
            asked = asked.filter(F.col("g") != F.element_at(F.array(*[F.lit(g) for g in self.groups] or [F.lit("")]), F.col("to") + 1))
        dealt = stored(self._further_meetings(asked.select("id", "to", "vec", "d", "u", "seen")))
        self.met = (dealt.count(), asked.count() * len(self.low) // max(len(self.groups), 1))
        return self._named(self._flat(self._meet(dealt, None, digits, False)).filter(F.col("place") <= radius).drop("place"))


def best_pairs(x: np.ndarray, y: np.ndarray, ids: np.ndarray, others: np.ndarray, limit: np.ndarray, k: int | None, digits: int, cosine: bool) -> Iterator[tuple[slice, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Some rows of x at a time: (i, j, distance), by row: the k nearest rows of y with another id (ties of so many digits by id) or all, within the row's limit.

    A matrix product finds who may be near; the distances given are computed from the vectors.
    """
    codes, _ = pd.factorize(np.concatenate((ids, others)))
    own, theirs = codes[: len(ids)], codes[len(ids) :]
    rank = np.empty(len(others), np.int64)
    rank[np.argsort(others, kind="stable")] = np.arange(len(others))
    square = (y**2).sum(axis=1)
    few = max(1, min(512, CELLS // max(len(y), 1)))
    for at in range(0, len(x), few):
        some = slice(at, min(at + few, len(x)))
        u = x[some]
        d = 1 - u @ y.T if cosine else np.sqrt(np.maximum((u**2).sum(axis=1)[:, None] + square[None] - 2 * u @ y.T, 0))
        slack = 1e-6 if cosine else 1e-6 * (1 + np.sqrt(square.max(initial=0)))
        d[own[some, None] == theirs[None]] = np.inf
        cap = limit[some] + slack
        if k and k < len(y):
            cap = np.minimum(cap, np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * slack)
        i, j = np.nonzero((d <= cap[:, None]) & np.isfinite(d))
        step = 1 << 16
        exact = np.concatenate([1 - (u[i[a : a + step]] * y[j[a : a + step]]).sum(axis=1) if cosine else np.sqrt(((u[i[a : a + step]] - y[j[a : a + step]]) ** 2).sum(axis=1)) for a in range(0, len(i), step)] or [np.zeros(0)])
        if k:
            order = np.lexsort((rank[j], np.round(exact, digits), i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.searchsorted(i, np.arange(len(u)))
            keep = np.arange(len(i)) - first[i] < k
            i, j, exact = i[keep], j[keep], exact[keep]
        yield some, (i + at, j, exact)


def pairs_within(x: np.ndarray, y: np.ndarray, cap: np.ndarray, cosine: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows of x at a time: (i, j, distance) of at least all pairs within each row's cap, and none far beyond.

    A product in single precision, with room for its error, finds who may be near; the distances given are computed from the vectors.
    """
    middle = np.zeros(x.shape[1]) if cosine else y.mean(axis=0)
    u, v = x - middle, y - middle
    su, sv = (u**2).sum(axis=1), (v**2).sum(axis=1)
    most = max(su.max(initial=0), sv.max(initial=0))
    kind = np.float32 if most < 1e30 else np.float64
    slack = (x.shape[1] + 8) * 4 * float(np.finfo(kind).eps) * most
    least = 1 - cap if cosine else (su - np.where(np.isfinite(cap), cap, 1e300).clip(max=1e150) ** 2) / 2
    if not cosine:  # u v >= (|u|^2 + |v|^2 - cap^2) / 2
        u, v = np.c_[u, np.ones(len(u))], np.c_[v, -sv / 2]
    u, v, least = u.astype(kind), np.ascontiguousarray(v.astype(kind).T), np.maximum(least - slack, -1e37 if kind is np.float32 else -1e307).astype(kind)
    few = max(1, TILE // max(len(y), 1))
    cells, n = [], 0
    for at in range(0, len(x), few):
        cells.append(places(u[at : at + few] @ v >= least[at : at + few, None]) + at * len(y))
        n += len(cells[-1])
        if n < PAIRS and at + few < len(x):
            continue
        cell, cells, n = np.concatenate(cells), [], 0
        for a in range(0, len(cell), PAIRS):
            i, j = np.divmod(cell[a : a + PAIRS], len(y))
            yield i, j, 1 - (x[i] * y[j]).sum(axis=1) if cosine else np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))


def places(true: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a table of bools of which few are true: eight are looked at as one number."""
    flat = true.reshape(-1)
    whole = len(flat) // 8 * 8
    eight = np.flatnonzero(flat[:whole].view(np.uint64))
    at, one = np.nonzero(flat[:whole].reshape(-1, 8)[eight])
    return np.concatenate((eight[at] * 8 + one, whole + np.flatnonzero(flat[whole:])))


def merged(found: tuple, more: tuple, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row of both (row, other, distance), by row and place; ties of so many digits by other."""
    i, j, d = (np.concatenate(p) for p in zip(found, more, strict=True))
    order = np.lexsort((pd.factorize(j, sort=True)[0] if j.dtype == object else j, np.round(d, digits), i))
    i, j, d = i[order], j[order], d[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
    keep = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
    return i[keep], j[keep], d[keep]


def take_in(near: np.ndarray, who: np.ndarray, held: np.ndarray, more: tuple, digits: int) -> None:
    """Puts more (row, other, distance) among the best of their rows (as wide as ``near`` and ``who``, of which ``held`` are filled); other rows aren't looked at."""
    rows, at = np.unique(more[0], return_inverse=True)
    old = np.arange(near.shape[1]) < held[rows, None]
    i, j, d = merged((np.nonzero(old)[0], who[rows][old], near[rows][old]), (at, *more[1:]), near.shape[1], digits)
    n = np.bincount(i, minlength=len(rows))
    place = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    near[rows[i], place], who[rows[i], place], held[rows] = d, j, n


def larger(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many, but the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def leaves_of(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of x in leaves of at most so many rows: halves of halves, each cut across its longest side."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) > size:
            half = len(at) // 2
            at = at[np.argpartition(x[at, np.ptp(x[at], axis=0).argmax()], half)]
            todo += [at[:half], at[half:]]
        elif len(at):
            out.append(at)
    return out


def boxes_of(y: np.ndarray, size: int = 128) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(leaves, low, high): the finite rows of y in boxes."""
    finite = np.flatnonzero(np.isfinite(y).all(axis=1))
    leaves = [finite[at] for at in leaves_of(y[finite], size)]
    low, high = (np.array([f(y[at], axis=0) for at in leaves]).reshape(len(leaves), y.shape[1]) for f in (np.min, np.max))
    return leaves, low, high


def boxed_pairs(x: np.ndarray, y: np.ndarray, ids: np.ndarray, others: np.ndarray, limit: np.ndarray, k: int, digits: int, boxes: tuple[list[np.ndarray], np.ndarray, np.ndarray], together: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``best_pairs`` finds by the euclidean distance, for rows of x beside each other at a time, from the boxes of y that may hold it.

    The rows of the first boxes around a group of rows bound how far its k nearest can be; boxes beyond that are left out.
    """
    leaves, low, high = boxes
    if not leaves:
        return
    sizes, middle = np.array([len(at) for at in leaves]), (low + high) / 2
    slack = 4e-6 * (1 + np.abs(np.r_[low, high]).max() * np.sqrt(y.shape[1]))
    finite = np.flatnonzero(np.isfinite(x).all(axis=1))
    for group in leaves_of(x[finite], together):
        at = finite[group]
        u, least, most = x[at], x[at].min(axis=0), x[at].max(axis=0)
        gap = np.sqrt((np.maximum(0, np.maximum(low - most, least - high)) ** 2).sum(axis=1))
        order = np.argsort(((middle - (least + most) / 2) ** 2).sum(axis=1), kind="stable")
        near = np.concatenate([leaves[b] for b in order[: np.searchsorted(np.cumsum(sizes[order]), k + 1) + 1]])  # one more, since a row isn't its own neighbour
        d = np.sqrt(((u[:, None] - y[near][None]) ** 2).sum(axis=2))
        d[ids[at][:, None] == others[near][None]] = np.inf
        bound = np.partition(d, k - 1, axis=1)[:, k - 1].max() if k <= len(near) else np.inf
        may = np.flatnonzero(gap <= min(bound, limit[at].max()) + slack)
        if len(may):
            near = np.concatenate([leaves[b] for b in may])
            for _, (i, j, exact) in best_pairs(u, y[near], ids[at], others[near], limit[at], k, digits, False):
                yield at[i], near[j], exact
