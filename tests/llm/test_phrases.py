"""Operator 13: phrases by their weakest cut."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pastcast.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, percent=50, most=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + size])) for size in range(1, longest + 1) for i in range(len(w) - size + 1))
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in some.items():
        inside = lambda x: any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))
        if any(g == lang and len(x) > len(w) and 100 * b >= percent * a and inside(x) for (g, x), b in some.items()):
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, all_ in out.items() for k, (s, a, p, left, right) in enumerate(sorted(all_)[:most]))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_sql(spark, sf_dir, same_as_sql):
    same_as_sql(queries.QUERIES["op13_top_order_phrases"](spark, sf_dir), queries.ORACLES["op13_top_order_phrases"], sf_dir)


TEXTS = [
    ("New York City. new york\tcity, New York", "en"),
    ("big apple big apple big apple big apple", "en"),
    ("é à É à é\x0bà é\x0cà é\rà", None),
    ("a.b a b", "und"),
    (None, "en"),
    ("", None),
    (" \t\n", "x"),
    ("two lines two lines two lines", "a\nb"),
    ("w " * 9000, "x"),
    ("Ünï ünï ünï 日本 日本 日本", "x"),
] * 4


@pytest.mark.parametrize("longest, least, percent, most", [(3, 10, 50, 2000), (2, 2, 50, 3), (4, 3, 100, 5), (5, 1, 10, 2000)])
def test_equals_brute_force(spark, longest, least, percent, most):
    docs = spark.createDataFrame(TEXTS, "text string, lang string").withColumns({"phrase": F.lit("clash"), "c": F.lit(1), "w2": F.lit("x"), "head": F.lit(3), "score": F.lit(2)})
    got = rows_of(phrases.collocations(docs, longest, least, percent, most))
    want = brute(TEXTS, longest, least, percent, most)
    assert got == want


def test_partitions_and_buffers_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "text string, lang string")
    want = brute(TEXTS, 3, 2)
    for n in (1, 7):
        assert rows_of(phrases.collocations(docs.repartition(n), 3, 2)) == want
    import pyarrow as pa

    text = pa.array(["a b c d. e a b c " * 50, "b c"])
    f = Counter()
    for longest in (3, 9, 15):  # fifteen words leave four bits: codes of 12 words at once
        got = Counter()
        for places, count in phrases._windows(text, longest):
            for row, c in zip(zip(*[p.to_pylist() for p in places], strict=True), count, strict=True):
                got[row] += int(c)
        f = Counter()
        for t in text.to_pylist():
            for piece in t.split("."):
                w = piece.split()
                f.update(tuple((w[i + k] if i + k < len(w) else None) for k in range(longest)) for i in range(len(w)))
        assert got == f


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 9_007_199_254_740_993, 9_007_199_254_740_995, 9_123_456_789_012_345
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases.exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)
