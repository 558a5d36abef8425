"""The pipeline: each stage's decisions, and odd rows."""

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F

from pastcast.llm import decontaminate, minhash, queries, sentencepiece_codec


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (None, "a b", None, None, None)], docs.schema)
    docs = docs.union(odd).withColumn("score", F.lit(1))
    seen = {r.doc_id for r in docs.collect()}
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.collect()}
        assert now <= seen
        seen = now
    kept = docs.filter("doc_id is not null")
    assert minhash.near_duplicates(kept).filter("not kept").count() == 0
    assert decontaminate.contained(kept, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    out = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert out.count() == docs.count() and all(r.n_tokens == len(r.ids) == len(r.ends) for r in out.collect())


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    left = {r.doc_id for r in cp.good_quality(spark, docs, sf_dir).collect()}
    assert np.mean([k in left for k in good]) > 0.97
    assert queries.QUERIES


def test_tokens_are_decoded(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "caf\u00e9  \u2581 \ufb01n", "en", "s", 0)], docs.schema)
    m = sentencepiece_codec.codec(open(queries.tokenizer(), "rb").read())
    rows = cp.tokens(spark, docs.union(odd), sf_dir).collect()
    assert len(rows) == 43 and all(r.decoded == m.decode(list(r.ids)) for r in rows)
    assert {r.doc_id: r.decoded for r in rows}[9002] == ""
    assert sum(len(r.decoded) > 20 for r in rows) > 30


def test_rows_of_one_id_are_judged_by_their_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 40").first().text
    words = " ".join(f"word{k}" for k in range(40))
    odd = [(1, words), (1, words + " more"), (1, "quite another text of some words here"), (1, item), (2, words), (None, words), (None, item), (None, "a text without an id for once"), (7, None), (7, None), (8, ""), (9, "")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd], docs.schema)
    left = sorted(((r.doc_id, r.text) for r in cp.distinct_texts(spark, d, sf_dir).collect()), key=str)
    lead = [t for i, t in left if i == 1 and t.startswith(words)]
    assert len(lead) == 1
    assert left == sorted([(1, lead[0]), (1, odd[2][1]), (1, item), (None, odd[7][1]), (7, None), (8, "")], key=str)
    clean = sorted(((r.doc_id, r.text) for r in cp.free_of_benchmark(spark, d, sf_dir).collect()), key=str)
    assert clean == sorted([x for x in odd if x[1] != item], key=str)
