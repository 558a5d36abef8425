"""Operator 11: secrets by fixed patterns and by assigned names."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pastcast.llm import queries, secret_scan
from pastcast.llm.tokens import texts_of

#: The contract's patterns, tried plainly.
PLAIN = [
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(PLAIN) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in sorted(spans)]


def texts(n=300):
    r = random.Random(7)
    parts = ["password", "PassWd", "secret", "ToKen", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAABCDEFGHIJ1234", "0123456789abcdef", "deadbeef", "abc", "Zz9+/", "é", "日本", "\n", "ſ", "K", "x" * 12, "token=token=", "a" * 40]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


ODD = [None, "", " ", "=", ":", '="', "a=" * 3000, 'x="' * 3000, "'" * 999, "f" * 100_000, "password=" + "A" * 50_000, "token: " * 500, "password: token: abcdefghijklmnop", 'k = "a\\"b', "é" * 15 + "f" * 16 + "é", "f" * 15]


@pytest.fixture(scope="module")
def scanned(spark):
    """Texts and their rows, each twice."""
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts() + ODD)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, spans int")
    return rows, secret_scan.scan(df).select("doc_id", secret_scan.joined(F.col("base")).alias("base"), secret_scan.joined(F.transform("found", lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end")))).alias("found")).collect()


def test_base_equals_brute_force(scanned):
    rows, got = scanned
    assert sorted((r.doc_id, r.base) for r in got) == sorted((k, ",".join(brute(t))) for k, t, _, _ in rows)
    assert any(",".join(brute(t)).count(",") > 3 for _, t, _, _ in rows)


def test_query_equals_brute_force(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest tables hold no assignment
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op11_assignment_lexing"](spark, sf_dir).collect()
    assert len(got) == len(docs) and sum(r.n_assign for r in got) > 0
    for r in got:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), [k for k, *_ in PLAIN + [("literal",)]].index(x.split(":")[0])))


def test_hex_filter_misses_none():
    for t in texts():
        assert secret_scan._with_hex(texts_of(pa.array([t, "", t])))[0] or not re.search("[0-9a-f]{16}", t)
    for at in range(40):
        assert secret_scan._with_hex(texts_of(pa.array(["z" * at + "f" * 16])))[0]


CASES = [
    ('db_pwd = "Xk39!qpz#Lm2"', ["Xk39!qpz#Lm2"]),
    ("credentials: {user: bob, passphrase: 'Tr0ub4dor&3zq'}", ["Tr0ub4dor&3zq"]),
    ('k = "Zq8#mmPw0!rTy"\nother = 1\nclient_secret = k', ["Zq8#mmPw0!rTy"]),  # a constant
    ('k = "Zq8#mmPw0!rTy"\nk2 = k\nlogin(pwd=k2)', ["Zq8#mmPw0!rTy"]),
    ('k = "Zq8#mmPw0!rTy"\nk = "harmless words 1"\npwd = k', []),  # given anew
    ('BASE=Qw7xYz81LmNo\nAUTH_TOKENS="x"\nAUTH="${BASE}"', ["Qw7xYz81LmNo"]),
    ('signingKey := `aa88-BBzz-77qq-RRtt`', ["aa88-BBzz-77qq-RRtt"]),
    ('pwd = "abcd1234" +\n  "EFGH5678"', ["abcd1234", "EFGH5678"]),
    ("config['master_key'] = 'mK-20x!88-zzTop'", ["mK-20x!88-zzTop"]),
    ("pwd: str = 'mK-20x!88-zzTop'", ["mK-20x!88-zzTop"]),
    ('<passcode>9fj3-KKz8-12mn</passcode>', ["9fj3-KKz8-12mn"]),
    ('<add key="bearer" value="9fj3-KKz8-12mn"/>', ["9fj3-KKz8-12mn"]),
    ("api key: z9Y8x7W6v5U4", ["z9Y8x7W6v5U4"]),
    ('pwd = """line one 9\nline TWO 8"""', []),  # a sentence
    ('pwd_file = "/etc/Keys/2024/prod.txt"', []),
    ('max_tokens = "12345678abcdEFGH"', []),
    ("the pwd: something", []),
    ('pwd = "changeme-12345"', []),
    ('pwd = "aaaaaaaaaaaa"', []),
    ('pwd = os.getenv("Zq8#mmPw0!rTy")', []),
    ('if pwd == "Zq8#mmPw0!rTy":', []),
    ("colour = 'Zq8#mmPw0!rTy'", []),
    ("see https://example.org/pwd and a: b", []),
]


def test_literals_by_name(spark):
    df = spark.createDataFrame([(k, "é日\n" + t) for k, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: [("é日\n" + CASES[r.doc_id][0])[x.start : x.end] for x in r.found] for r in secret_scan.scan(df).collect()}
    assert {CASES[k][0]: v for k, v in got.items()} == dict(CASES)


def test_covered_literals_are_not_told_twice(spark):
    df = spark.createDataFrame([(1, 'token = "24be64439e3e49cf46b2d7c90f3602a3"')], "doc_id long, text string")
    row = secret_scan.scan(df).first()
    assert len(row.base) == 2 and row.found == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.scan(df).count() == 0
