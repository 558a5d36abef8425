"""Removing documents without shuffling the texts of those that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastcast.llm.bloom import bounded
from pastcast.session import stored


def digest(text: str | Column) -> Column:
    """128 bits of a text; a value of its own for null."""
    return F.coalesce(F.md5(text), F.lit("-"))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs whose (id, digest of the text) is not in ``gone`` (columns ``id`` and ``exact``); a null id equals a null id.

    Exactly the rows judged go: of one id with several texts the others stay, and rows that repeat stay repeated. A Bloom
    filter of bounded size over the digests passes most rows on; only those that it holds are shuffled to be joined.
    Columns of docs may have any names.
    """
    asked = stored(gone.select(F.col("id").alias("_gone"), F.col("exact").alias("_exact")).distinct())
    n = asked.count()
    if not n:
        return docs
    key = digest(F.col(f"`{text_col}`"))
    held = bounded(asked.select(F.col("_exact").alias("key")), n).might_hold(key)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_gone")) & (key == F.col("_exact"))
    return docs.filter(~held).union(docs.filter(held).join(asked, same, "left_anti"))


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each (id, text); which of the equal ones stays is arbitrary where other columns differ.

    Only rows whose (id, digest) occurs more than once are shuffled with their texts.
    """
    key = F.struct(F.col(f"`{id_col}`").alias("id"), digest(F.col(f"`{text_col}`")).alias("exact"))
    twice = docs.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("k.id").alias("id"), F.col("k.exact").alias("exact"))
    twice = stored(twice)
    n = twice.count()
    if not n:
        return docs
    held = bounded(twice.select(F.col("exact").alias("key")), n).might_hold(digest(F.col(f"`{text_col}`")))
    some = docs.filter(held)
    return docs.filter(~held).union(some.withColumns({"_i": F.col(f"`{id_col}`"), "_d": digest(F.col(f"`{text_col}`"))}).dropDuplicates(["_i", "_d"]).drop("_i", "_d"))
