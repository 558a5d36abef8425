"""SentencePiece encoding with byte offsets, and decoding (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastcast.llm.spm import SPACE, Model, Remembered, model
from pastcast.llm.tokens import pieces
from pastcast.session import ship, with_fields


class Codec:
    """Encodes texts to ids with the source bytes of each, and decodes ids."""

    def __init__(self, m: Model) -> None:
        self.model = m
        self.packed = [self._pack(ids, t) if t else b"" for ids, t in zip(m.ids, m.tokens, strict=True)]
        self.pairs = Remembered(self._pairs)

    def _pairs(self, text: str) -> bytes:
        """(id, source bytes) of a stretch in which each character but an escaped space stands for itself."""
        m, at, out = self.model, len(text), []
        last, length = m.prefixes(text), m.length
        while at:
            t = last[at]
            if t:
                out.append(self.packed[t])
                at -= length[t]
            else:
                at -= 1
                out.append(self._pack(m.ids_of(text[at]), text[at]))
        return b"".join(reversed(out))

    @staticmethod
    def _pack(ids: list[int], token: str) -> bytes:
        size = len(token.replace(SPACE, " ").encode("utf-8", "replace"))
        pairs = [(i, 1) for i in ids] if len(ids) == size else [*((i, 0) for i in ids[:-1]), (ids[-1], size)]
        return np.array(pairs, dtype="<i4").tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte, end byte); the bytes are those of the source text."""
        m = self.model
        if not text:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        if m.plain and SPACE not in text:
            got = np.frombuffer(b"".join(map(self.pairs.__getitem__, m.stretches(SPACE + text.replace(" ", SPACE)))), dtype="<i4").reshape(-1, 2)
            end = np.maximum(np.cumsum(got[:, 1]) - 1, 0)  # the dummy prefix has no source
            return got[:, 0], np.concatenate(([0], end[:-1])), end
        normal, src = m.normalised(text)
        ids, start, end, at = [], [], [], 0
        for part in m.stretches(normal):
            for some, n in m.encoded(part):
                a, b = src[at], src[at + n]
                whole = len(some) == b - a
                for k, i in enumerate(some):
                    ids.append(i)
                    start.append(a + k if whole else a)
                    end.append(a + k + 1 if whole else b if k == len(some) - 1 else a)
                at += n
        return np.array(ids, np.int32), np.array(start, np.int32), np.array(end, np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.model.decoded(ids)


@lru_cache(maxsize=2)
def codec(blob: bytes) -> Codec:
    return Codec(model(blob))


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True, decode: bool = True) -> DataFrame:
    """(id, ids, starts, ends, decoded): the ids of every whole text, the source bytes [start, end) of each, and the ids' text.

    The end id has the empty range at the end. Null texts are encoded as empty ones; repeated rows each have a row.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        last = np.array([c.model.end], np.int32) if add_end else np.zeros(0, np.int32)
        for batch, texts in pieces(batches, "_t", 1 << 20):
            made: list[list[np.ndarray]] = [[], [], []]
            back = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids, start, end = c.encode(text or "")
                tail = np.full(len(last), texts.begin[k + 1] - texts.begin[k], np.int32)
                for to, some in zip(made, (np.append(ids, last), np.append(start, tail), np.append(end, tail)), strict=True):
                    to.append(some)
                back.append(c.decode(made[0][-1].tolist()) if decode else None)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in made[0]]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(back, pa.string())], [id_col, "ids", "starts", "ends", "decoded"])

    rows = docs.select(id_col, F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, with_fields(docs.select(id_col), "ids array<int>, starts array<int>, ends array<int>, decoded string"))
