"""Benchmark items inside documents by size-partitioned MinHash containment (operator 6, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastcast.session import stored

BROADCAST_ROWS = 500_000


def words(text: str | Column) -> Column:
    """Lower-case runs of letters and digits; empty for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(F.lower(text), F.lit("")), r"[^\p{L}\p{N}]+"), "")


def _gram(w: str, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(F.col(w), at + k) for k in range(size)])


def _grams(w: str, size: int) -> Column:
    """Distinct hashes of every run of ``size`` words."""
    return F.when(F.size(w) >= size, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: _gram(w, i, size)))).otherwise(F.array().cast("array<bigint>"))


def index(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """(item_id, size, grams, n, class, sketch) of every item that has words.

    Items fall into classes by shingle count, the powers of two. An item of n shingles may lack n - ceil(threshold * n) of
    them; its sketch holds one MinHash minimum more than the largest item of its class may lack, the lowest under one hash
    order for all. A document that holds enough of an item then holds a sketch value: no item is missed.
    Items of fewer than ``shingle`` words have one shingle of all their words.
    """
    rows = items.select(F.col(id_col).alias("item_id"), words(text_col).alias("w")).distinct().filter(F.size("w") > 0)
    rows = rows.withColumn("size", F.least(F.lit(shingle), F.size("w")))
    grams = F.coalesce(*[F.when(F.col("size") == k, _grams("w", k)) for k in range(1, shingle + 1)])
    rows = rows.withColumn("grams", grams).withColumn("n", F.size("grams")).withColumn("class", F.floor(F.log2("n")).cast("int"))
    largest = F.pow(F.lit(2), F.col("class") + 1) - 1
    keep = (largest - F.ceil(threshold * largest) + 1).cast("int")
    ordered = F.array_sort(F.transform("grams", lambda g: F.struct(F.xxhash64(g, F.lit(7)).alias("rank"), g.alias("g"))))
    return rows.withColumn("sketch", F.transform(F.slice(ordered, F.lit(1), keep), lambda x: x.g)).drop("w")


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, item_col: str = "item_id", exact: bool = False) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): items of which a document holds at least the threshold of shingles.

    Every run of words of every text is looked up among the sketch values. A text and an item that share one are a candidate once,
    however many values they share, and are verified on the full shingle sets. The sketches are broadcast when they are at
    most BROADCAST_ROWS, and the words of a candidate's text are then at hand; else hits are joined by shuffle and find their
    texts again by id and digest, null ids too. Both ways give the same rows.

    Null or empty texts and items hold nothing; repeated rows count once, and so do rows of one id whose texts hold the same share;
    documents with a null id have rows with a null doc_id; items with a null id likewise; empty tables give no rows; other columns are
    ignored, whatever their names. With ``exact`` a further column has the digest of the text that holds the item.
    """
    found = stored(index(items, item_col, threshold=threshold, shingle=shingle))
    sketch = found.select("item_id", "size", F.explode("sketch").alias("gram"))
    small = sketch.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(text_col).alias("t"), words(text_col).alias("w"))
    out = None
    for size in sorted(r.size for r in found.select(F.col("size")).distinct().toLocalIterator()):  # 1 to shingle
        runs = rows.filter(F.size("w") >= size).select("doc_id", "t", "w", F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("at"))
        runs = runs.select("doc_id", "t", "w", _gram("w", F.col("at"), size).alias("gram"))
        mine = sketch.filter(F.col("size") == size).select("item_id", "gram")
        if small:
            hits = runs.join(hint(mine), "gram").select("doc_id", "t", "item_id", "w").dropDuplicates(["doc_id", "t", "item_id"])
        else:
            met = runs.select("doc_id", "t", "gram").join(mine, "gram").select("doc_id", "t", "item_id").distinct()
            same = (F.col("a.t") == F.col("b.t")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
            hits = met.alias("a").join(rows.alias("b"), same).select("a.doc_id", "a.t", "item_id", "w").dropDuplicates(["doc_id", "t", "item_id"])
        grams = found.filter(F.col("size") == size).select(F.col("item_id").alias("_item"), "grams", "n")
        hits = hits.join(hint(grams), F.col("item_id").eqNullSafe(F.col("_item")))
        hits = hits.select("doc_id", *["t"] * exact, "item_id", "n", F.size(F.array_intersect("grams", _grams("w", size))).alias("n_found"))
        out = hits if out is None else out.union(hits)
    if out is None:
        out = rows.filter("false").select("doc_id", *["t"] * exact, F.lit(None).cast(items.schema[item_col].dataType).alias("item_id"), F.lit(0).alias("n"), F.lit(0).alias("n_found"))
    out = out.filter(F.col("n_found") >= threshold * F.col("n")).distinct()
    return out.select("doc_id", *[F.col("t").alias("exact")] * exact, "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("n_found").cast("long"), (F.col("n_found") / F.col("n")).alias("containment"))
