"""A cleaning pipeline over ``documents``: quality, toxicity, near duplicates, benchmark items, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents, whatever else their names are. Rows with a null doc_id
are judged like others. An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastcast.llm import decontaminate, minhash, quality, rows, sentencepiece_codec, toxicity
from pastcast.llm.queries import learned, tokenizer
from pastcast.session import stored, table


def _packed(docs: DataFrame) -> DataFrame:
    """All columns as one, beside the text: they pass through a scoring step whatever their names are."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more.

    Null and empty texts get the share of good labels, and stay where that is 0.3 or more; repeated rows are each judged by their text.
    """
    model = quality.fit(docs, learned(spark, sf_dir, "quality"))
    return quality.score(_packed(docs), model, key="row").filter("score >= 0.3").select("row.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5. Null and empty texts have no toxic words and stay; repeated rows are each judged by their text."""
    model = toxicity.fit(docs, learned(spark, sf_dir, "toxic"))
    return toxicity.score(_packed(docs), model, keep=("row",)).filter("score < 0.5").select("row.*")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id (null ids last).

    Rows with a null text all stay, as they are no copies of a text; equal texts, empty ones too, are a class; of rows that repeat an id and a
    text one stays; of an id with several texts those stay that lead their class.
    """
    judged = stored(minhash.classes(docs))
    return rows.without(rows.later_copies(docs), judged.filter("not kept").select("id", "exact"))


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the shingles of every benchmark item. Null and empty texts hold nothing and stay; rows that repeat share
    their fate; of an id with several texts only those go that hold an item."""
    found = stored(decontaminate.contained(docs, table(spark, sf_dir, "benchmark"), exact=True))
    return rows.without(docs, found.select(F.col("doc_id").alias("id"), "exact"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text with an end id, the bytes of the text that each stands for, and the text that the ids decode to.

    Null texts are encoded as empty ones, by the end id alone; repeated rows each have a row.
    """
    out = sentencepiece_codec.encode_documents(docs, tokenizer())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", distinct_texts),
    ("decontamination", free_of_benchmark),
    ("tokens", tokens),
]

#: SQL can't state the trained and encoding stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
