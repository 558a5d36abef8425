"""Exact token counts of every prefix of a text (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastcast.llm.spm import Model, Remembered, model
from pastcast.llm.tokens import pieces
from pastcast.session import ship, with_fields


_SHORT = 60


class PrefixCounter:
    """Tables of token counts by prefix length in characters."""

    def __init__(self, m: Model) -> None:
        self.model = m
        self.bytes = Remembered(lambda s: bytes(m.count_list(s)))  # of at most _SHORT characters: below 256

    def table(self, text: str) -> np.ndarray:
        """Entry k: ids in the encoding of the first k characters. Entry 0 is 0."""
        m = self.model
        if not text:
            return np.zeros(1, np.int32)
        if not m.plain:  # a prefix may normalise differently from the whole
            return np.array([0, *(len(self.of_normal(m.normalised(text[:k])[0])) and int(self.of_normal(m.normalised(text[:k])[0])[-1]) for k in range(1, len(text) + 1))], np.int32)
        out = self.of_normal("▁" + text.replace(" ", "▁"))
        out[0] = 0
        return out

    def of_normal(self, text: str) -> np.ndarray:
        parts = self.model.stretches(text)
        if not parts:
            return np.zeros(0, np.int32)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        if size.max() <= _SHORT:
            flat = np.frombuffer(b"".join(map(self.bytes.__getitem__, parts)), dtype=np.uint8).astype(np.int32)
        else:
            flat = np.concatenate([self.model.counts(x) if len(x) > _SHORT else np.frombuffer(self.bytes[x], np.uint8).astype(np.int32) for x in parts])
        total = flat[np.cumsum(size) - 1]
        return flat + np.repeat((np.cumsum(total) - total).astype(np.int32), size)


@lru_cache(maxsize=2)
def counter(blob: bytes) -> PrefixCounter:
    return PrefixCounter(model(blob))


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def prefix_table(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """Adds the table of every text: element k is the token count of its first k characters. Null texts have the table of the empty text.

    ``tokens_of_prefix``, ``prefix_of_budget`` and ``tokens_between`` answer from the stored table without encoding again.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(_read(model_path))
    names = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(shared.value)
        for batch, _ in pieces(batches, "_t", 1 << 20):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            made = pa.array([tables.table(t or "") for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(names))] + [made], [*names, out])

    rows = docs.select(*names, F.col(text_col).alias("_t"))
    schema = with_fields(docs.select(*names), f"`{out}` array<int>")
    return rows.mapInArrow(run, schema)


def tokens_of_prefix(table: str | Column, characters: Column | int) -> Column:
    """Tokens of the first so many characters; of the whole text if it is shorter."""
    table = F.col(table) if isinstance(table, str) else table
    return F.get(table, F.least(F.lit(characters) if isinstance(characters, int) else characters, F.size(table) - 1))


def prefix_of_budget(table: str | Column, budget: int) -> Column:
    """The most characters whose prefix has at most ``budget`` tokens."""
    table = F.col(table) if isinstance(table, str) else table
    return F.aggregate(F.transform(table, lambda n, k: F.when(n <= budget, k).otherwise(0)), F.lit(0), lambda a, k: F.greatest(a, k))


def budgets(docs: DataFrame, model_path: str, limits: tuple[int, ...] = (4096,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, cuts): the whole text's count, and for each limit the most characters and bytes whose prefix keeps it.

    Made from the prefix table of each whole text, which exists inside the task only. Null and empty texts have 0 tokens;
    repeated rows each have a row.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(_read(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(shared.value)
        for batch, _ in pieces(batches, "_t", 1 << 20):
            total, cuts = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                table = tables.table(text)
                total.append(int(table[-1]))
                row = []
                for limit in limits:
                    at = len(text) if table[-1] <= limit else int(np.flatnonzero(table <= limit)[-1])
                    row.append({"limit": limit, "chars": at, "bytes": len(text[:at].encode("utf-8", "replace"))})
                cuts.append(row)
            kind = pa.list_(pa.struct([("limit", pa.int32()), ("chars", pa.int32()), ("bytes", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(cuts, kind)], [id_col, "n_tokens", "cuts"])

    rows = docs.select(id_col, F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, with_fields(docs.select(id_col), "n_tokens long, cuts array<struct<limit:int,chars:int,bytes:int>>"))
