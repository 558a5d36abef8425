"""Words of whole Arrow text batches as numpy arrays: boundaries, owners and 64-bit hashes.

All work is on the UTF-8 bytes of a batch at once, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTE = np.arange(256)
UPPER = (_BYTE >= 65) & (_BYTE <= 90)
LOWER = (_BYTE >= 97) & (_BYTE <= 122)
DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
HIGH = _BYTE >= 128
#: A word is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes.
WORD = UPPER | LOWER | DIGIT | HIGH
#: A token is a maximal run of bytes above the space.
VISIBLE = _BYTE > 32
#: ASCII lower case of each byte.
FOLD = np.where(UPPER, _BYTE + 32, _BYTE).astype(np.uint8)
_POWERS = np.multiply.accumulate(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))
BATCH_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """Bytes of several texts and where each begins; null texts are empty."""

    data: np.ndarray
    begin: np.ndarray  # one more than texts

    @property
    def n(self) -> int:
        return len(self.begin) - 1


@dataclass
class Words:
    """Byte ranges [start, end) in ``texts.data`` and the text that owns each word."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # index of each text's first word; one more than texts


def texts_of(column: pa.Array) -> Texts:
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches that hold about ``limit`` bytes of text each, one text at least: bounds a task's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, min(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, batch.num_rows))
            yield batch.slice(at, to - at), texts_of(column.slice(at, to - at))
            at = to


def split(texts: Texts, inside: np.ndarray = WORD) -> Words:
    """Maximal runs of bytes for which ``inside`` holds; a run ends where its text ends."""
    flag = np.zeros(len(texts.data) + 2, dtype=np.int8)
    flag[1:-1] = inside[texts.data]
    step = np.diff(flag)
    cut = texts.begin[1:-1]
    cut = cut[(cut > 0) & (cut < len(texts.data))]
    joined = np.unique(cut[(flag[cut] == 1) & (flag[cut + 1] == 1)])  # runs that go on into the next text
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(joined):
        start, end = np.sort(np.append(start, joined)), np.sort(np.append(end, joined))
    first = np.searchsorted(start, texts.begin)
    return Words(start, end, np.repeat(np.arange(texts.n), np.diff(first)), first)


def hashes(texts: Texts, words: Words, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with ASCII letters in lower case if fold."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    size = words.end - words.start
    owner_start = np.repeat(words.start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    flat = np.arange(len(owner_start)) + owner_start
    data = (FOLD if fold else _BYTE.astype(np.uint8))[texts.data[flat]].astype(np.uint64)
    place = flat - np.repeat(words.start, size)
    weight = _POWERS[place & 63] + (place >> 6).astype(np.uint64)
    return mix(np.add.reduceat((data + np.uint64(1)) * weight, np.cumsum(size) - size) + size.astype(np.uint64))


def shingles(h: np.ndarray, words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of n words; a text with 1 to n - 1 words has one shingle of all of them."""
    count = np.diff(words.first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), made)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made)
    at, left = words.first[:-1][doc] + place, np.minimum(count[doc], n)
    out = np.zeros(len(doc), np.uint64)
    for k in range(n):
        use = left > k
        out[use] = mix(out[use] * np.uint64(0x9E3779B97F4A7C15) + h[at[use] + k])
    return doc, out
