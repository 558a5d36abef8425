"""Phrases whose words occur together more often than apart (operator 13).

Every word opens one window: itself and the words that follow it in its piece, padded where the piece ends. Only
windows of the longest order are counted. A shorter phrase is a prefix of as many windows as it has occurrences, so
its count is a sum over the windows that begin with it: sums of long prefixes, then Spark's ROLLUP from pairs to words and totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.llm.tokens import FOLD, split, texts_of
from pastcast.session import ship, stored

_BYTE = np.arange(256)
_ENDS = np.isin(_BYTE, [*b".,;:!?", 10, 11, 12, 13])
#: A word is a maximal run of bytes that neither end a piece nor are a space or a tab.
_INSIDE = ~_ENDS & (_BYTE != 32) & (_BYTE != 9)
#: Bytes of text that a task counts at once: bounds its memory.
BUFFER_BYTES = 8 << 20


def _windows(column: pa.Array, longest: int) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """(words of each place, null where padded, and how often) of the distinct windows, some at a time, in order of their words' codes.

    A word's code takes 63 / ``longest`` bits, so as many words are coded at once as have different codes; the windows of
    the last ones look ahead at the words that follow them. A single text may be of any length.
    """
    texts = texts_of(column)
    words = split(texts, _INSIDE)
    n = len(words.start)
    if not n:
        return
    folded = FOLD[texts.data]
    ends = np.concatenate(([0], np.cumsum(_ENDS[texts.data], dtype=np.int32)))
    goes_on = np.zeros(n + longest, bool)  # the next word follows in the same piece
    goes_on[: n - 1] = (words.doc[1:] == words.doc[:-1]) & (ends[words.start[1:]] == ends[words.end[:-1]])
    bits = 63 // longest
    most = (1 << bits) - longest  # a chunk and what it looks ahead have at most 2^bits - 1 codes
    for at in range(0, n, most):
        to, ahead = min(at + most, n), min(at + most + longest - 1, n)
        size = words.end[at:ahead] - words.start[at:ahead]
        offsets = np.concatenate(([0], np.cumsum(size)))
        data = folded[np.arange(offsets[-1], dtype=np.int32) + np.repeat((words.start[at:ahead] - offsets[:-1]).astype(np.int32), size)]
        coded = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())).dictionary_encode()
        code = np.zeros(to - at + longest, np.int64)  # 0 pads
        code[: ahead - at] = coded.indices.to_numpy() + 1
        key, open_ = code[: to - at].copy(), np.ones(to - at, bool)
        for k in range(1, longest):
            open_ &= goes_on[at + k - 1 : to + k - 1]
            key = (key << bits) | np.where(open_, code[k : to - at + k], 0)
        key, count = np.unique(key, return_counts=True)
        places = []
        for k in range(longest):
            c = (key >> (bits * (longest - 1 - k))) & ((1 << bits) - 1)
            places.append(coded.dictionary.take(pa.array(c - 1, mask=c == 0)))
        yield places, count


def counted_windows(docs: DataFrame, longest: int = 3, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(head, w2 .. , c): windows of each task's stretches of text with their counts there, not yet summed over tasks.

    The lang and the first two words are one text, with a line feed after the lang, which no word holds: rows
    of fewer columns take less room in the shuffle.
    """
    if not 2 <= longest <= 15:
        raise ValueError("phrases have 2 to 15 words")
    ship(docs.sparkSession)
    names = ["head", *[f"w{k}" for k in range(2, longest)], "c"]

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        langs = whole.column("lang")
        for lang in langs.unique().to_pylist():
            some = whole.filter(pa.compute.equal(langs, lang)).column("text")
            for places, count in _windows(some.combine_chunks() if isinstance(some, pa.ChunkedArray) else some, longest):
                for at in range(0, len(count), 1 << 15):
                    first = pa.compute.binary_join_element_wise(*[p.slice(at, 1 << 15) for p in places[:2]], " ", null_handling="skip")
                    head = pa.compute.binary_join_element_wise(pa.scalar(lang), first, "\n")
                    yield pa.RecordBatch.from_arrays([head, *[p.slice(at, 1 << 15) for p in places[2:]], pa.array(count[at : at + (1 << 15)])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BUFFER_BYTES:
                yield from counted(held)
                held, size = [], 0
        if size:
            yield from counted(held)

    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "head string, " + "".join(f"w{k} string, " for k in range(2, longest)) + "c long")


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, size, f): phrases of 1 to ``longest`` words that occur at least ``least`` times; size 0 counts all words of a lang.

    Windows are dealt by their first two words, so the sums of all prefixes of two words and more need no further shuffle.
    """
    windows, parts = counted_windows(docs, longest, text_col, lang_col).repartition("head"), []
    first = F.substring_index("head", "\n", -1)
    lang = F.col("head").substr(F.lit(1), F.length("head") - F.length(first) - 1).alias("lang")
    for size in range(longest, 1, -1):
        words = [f"w{k}" for k in range(2, longest)]
        reached = [F.contains(first, F.lit(" ")), *[F.col(w).isNotNull() for w in words]][size - 2 :]  # by windows that are not padded before this length
        # reading all later words and filtering no key, all lengths share one shuffle
        level = windows.groupBy("head", *words[: size - 2]).agg(F.sum("c").alias("c"), F.max(reduce(or_, reached)).alias("whole"))
        often = level.filter((F.col("c") >= least) & F.col("whole"))
        parts.append(often.select(lang, F.concat_ws(" ", first, *words[: size - 2]).alias("phrase"), F.lit(size).alias("size"), F.col("c").alias("f")))
    pairs = level.filter("whole is not null").select(lang, F.substring_index(first, " ", 1).alias("w0"), "c")  # all: the filter only has them read what the others read
    sums = pairs.rollup("lang", "w0").agg(F.sum("c").alias("f"), F.grouping_id().alias("g"))
    size = F.when(F.col("g") == 1, 0).when((F.col("g") == 0) & (F.col("f") >= least), 1)
    parts.append(sums.select("lang", F.coalesce("w0", F.lit("")).alias("phrase"), size.alias("size"), "f").filter("size is not null"))
    return reduce(DataFrame.unionByName, parts)


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)) in decimals of 38 digits: exact for counts below 10^16."""
    big = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first ``most`` phrases of 2 to ``longest`` words.

    A phrase with a >= ``least`` occurrences counts as its weakest cut: the lowest score over all places to cut it in two, with l
    and r occurrences of the halves (the earliest cut of equal ones). It is dropped if a longer phrase of at least ``least``
    occurrences holds it and occurs at least ``percent`` times in 100 of its own. Order: score, a (descending), phrase
    (by UTF-8 bytes). n counts all words of the lang.

    Null texts are empty ones; a null lang is ``und``; rows that repeat count each time; an empty table gives no rows; other
    columns are ignored. Letters A-Z are lower-cased; texts may be of any length.
    """
    counts = stored(phrase_counts(docs, longest, least, text_col, lang_col))
    some = counts.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size")
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = some.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    f = counts.filter("size > 0").select("lang", "phrase", "f")
    cuts = cuts.join(f.toDF("lang", "left", "l"), ["lang", "left"]).join(f.toDF("lang", "right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", exact_score(F.col("a"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: part(i, s))))
    held = some.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(held, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = kept.withColumn("rank", rank).filter(F.col("rank") <= most)
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
