"""Registered queries of the operators in this package, and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastcast.llm import chat, decontaminate, embedding_dedup, hard_negatives, minhash, phrases, quality, secret_scan, sentencepiece_codec, sharding, token_counts, toxicity, url_filter
from pastcast.session import table

#: Fixed values of the rule list.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def tokenizer() -> str:
    """Path of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that no model of the registered queries learns from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def learned(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """(doc_id, label) of the rows that models may learn from."""
    return table(spark, sf_dir, "labels").select("doc_id", label).filter(~held_out())


def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, learned(spark, sf_dir, "toxic"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))).alias("spans"))


def op2_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by the rule list."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.UrlFilter.fit(pages, RULES).judge(pages).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def op4_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of all documents, equal texts together as far as row quotas allow."""
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which a document holds at least 0.8 of the 5-word shingles."""
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT least(5, len(w)) AS size FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, least(5, len(w)) AS size, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dg AS (SELECT DISTINCT doc_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, s WHERE len(w) >= size)),
n AS (SELECT item_id, count(*) AS n FROM bg GROUP BY item_id)
SELECT doc_id, item_id, any_value(n) AS n_shingles, count(*) AS n_found, count(*)::DOUBLE / any_value(n) AS containment
FROM dg JOIN bg USING (size, g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)
"""


def op8_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered in parts of 256 turns."""
    return chat.render(table(spark, sf_dir, "conversations"))


def op5_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document and whether it is above 4096, from its prefix table."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce("text", F.lit("")).alias("text"))
    out = token_counts.budgets(rows.select(F.struct("doc_id", "n_bytes").alias("row"), "text"), tokenizer(), (4096,), "row")
    return out.select("row.doc_id", "row.n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), F.col("cuts")[0]["bytes"].cast("long").alias("bytes_within"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document with an end id, and their decoding, as digests."""
    out = sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), tokenizer())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP8_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
h AS (SELECT *, string_agg(coalesce('+' || role, '-') || chr(1) || coalesce('+' || text, '-'), chr(2)) OVER (PARTITION BY conv_id ORDER BY pos) AS key FROM p),
f AS (SELECT key, min(conv_id) AS conv_id FROM h WHERE pos = n GROUP BY key),
k AS (SELECT conv_id FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.pos < h.n AND h.key = f.key))
SELECT conv_id, ((pos - 1) // 256)::INT AS part, any_value(n) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM p WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY ALL
"""


def op3_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under links of 5-word shingle similarity >= 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.fit(docs, learned(spark, sf_dir, "quality")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all vectors of equal labels at cosine 0.98."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op11_assignment_lexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans (whole matches), and all spans, the lexer's too."""
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda x: x.kind == secret_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    plain = F.transform("found", lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end")))
    spans = secret_scan.joined(F.array_sort(F.concat("base", plain)))
    return out.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"))


def op12_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50, with labels of every seventh id moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id))::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3
"""


def op13_top_order_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of 2 to 3 words by their weakest cut."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS s(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, k, ((1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) AS c JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, array_to_string(w[i:i + 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE size = 3)) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
FROM s JOIN t ON t.lang = s.lang LEFT JOIN d ON d.lang = s.lang AND d.phrase = s.phrase WHERE coalesce(100 * longer < 50 * a, true) QUALIFY rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_crf_toxicity": op1_crf_toxicity,
    "op2_bloom_cascade": op2_bloom_cascade,
    "op3_dartminhash": op3_dartminhash,
    "op4_label_propagation": op4_label_propagation,
    "op5_prefix_counts": op5_prefix_counts,
    "op6_containment": op6_containment,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_snapshot_collapse": op8_snapshot_collapse,
    "op9_neighbour_votes": op9_neighbour_votes,
    "op10_product_quantisation": op10_product_quantisation,
    "op11_assignment_lexing": op11_assignment_lexing,
    "op12_bond_negatives": op12_bond_negatives,
    "op13_top_order_phrases": op13_top_order_phrases,
}

ORACLES: dict[str, str] = {
    "op2_bloom_cascade": OP2_SQL,
    "op6_containment": OP6_SQL,
    "op8_snapshot_collapse": OP8_SQL,
    "op12_bond_negatives": OP12_SQL,
    "op13_top_order_phrases": OP13_SQL,
}
