"""Secrets in source and configuration text, by fixed patterns and by the names that literals are assigned to (operator 11).

A task reads a text once: the fixed patterns give the base spans, the lexer gives literals with all names that they reach,
through constants too. What a name and a literal are worth is decided by column expressions on those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastcast.llm.tokens import Texts, pieces
from pastcast.session import ship, with_fields

#: Kinds in their order (the last is the lexer's), their patterns and least lengths.
KINDS = ["assign", "access", "hex", "literal"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}

_HEX_BYTE = np.isin(np.arange(256), [*b"0123456789abcdef"])

#: Names whose last words say that the value is a secret, names that say so elsewhere, and endings that say it is about one.
SENSITIVE = r"(password|passwd|passphrase|passcode|pwd|secret|token|credentials?|apikey|bearer|(api|access|secret|private|signing|encryption|auth|account|master|shared|client|license)_key|auth)"
ABOUT = r"_(ids?|names?|counts?|length|len|size|types?|files?|paths?|urls?|uris?|endpoint|field|label|expiry|expires|ttl|limit|policy|hint|prompt|regex|pattern|index|version|header|prefix|enabled|required)$|^(max|min|num|n|is|has|use)_"
PLACEHOLDER = r"(?i)^(.)\1*$|example|change_?me|placeholder|dummy|your[-_ ]|xxxx|\*\*\*|^<.*>$|^\$|todo|redacted|lorem|^(none|null|true|false|undefined)$"


def base_spans(text: str, may_have_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap within a kind; those that are too short are dropped."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if may_have_hex:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _with_hex(texts: Texts) -> np.ndarray:
    """Which texts may hold 16 hexadecimal digits in a row: such a run covers every 16th byte, and eight bytes to one side of it."""
    is_hex = np.concatenate((np.zeros(8, bool), _HEX_BYTE[texts.data], np.zeros(8, bool)))
    at = np.arange(15, len(texts.data), 16)
    at = at[is_hex[at + 8]]
    left, right = np.ones(len(at), bool), np.ones(len(at), bool)
    for k in range(1, 8):
        left &= is_hex[at + 8 - k]
        right &= is_hex[at + 8 + k]
    out = np.zeros(texts.n, bool)
    out[np.searchsorted(texts.begin, at[left | right], "right") - 1] = True
    return out


@dataclass
class Literal:
    """Pieces (start, end) of one value, as they are concatenated, and the names that it reaches."""

    pieces: list[tuple[int, int]]
    quoted: bool
    names: list[str] = field(default_factory=list)


_OPERATOR = re.compile(r":=|=>|==|[!<>]=|::|:(?!//)|=")
#: Read backwards from an operator: the name before it, in quotes or brackets too, and a word before that (``api key:``).
_BEFORE = re.compile(r"""[ \t]*[\])]?["'`]?([\w$-][\w.$-]*(?:\x20[A-Za-z]+(?![\w.]))?)""")
#: Likewise of ``name: type =``.
_TYPED = re.compile(r"""[ \t]*[\w.\[\]]+[ \t]*:[ \t]*["'`]?([\w$-][\w.$-]*)""")
_OPENING = re.compile(r"""[ \t]*(?:[rbfuRBFU]{0,2}(?=["'`]))?("{3}|'{3}|["'`])?""")
_JOINED = re.compile(r"""(?:[ \t]*\+\s*|[ \t]+)[rbfu]{0,2}(["'`])""")
_BARE = {"=": re.compile(r"""[^\s"'`,;(){}\[\]<>#=&?]+={0,2}"""), ":": re.compile(r"""[^\s"'`,;(){}\[\]<>#=&?:]+={0,2}""")}
_BRACED = re.compile(r"[ \t]*\$?\{[^{}\s]{1,128}\}")
_REFERENCE = re.compile(r"""\$?\{{0,2}[ ]?([A-Za-z_][\w.]*)[ ]?\}{0,2}$""")
_ELEMENT = re.compile(r"""<([A-Za-z][\w.-]*)>([^<>\s]+)</\1>|\b(?:key|name)\s*=\s*["']([\w.-]+)["']\s+value\s*=\s*["']([^"'\n]+)["']""")


class Lexer:
    """Name-literal pairs of one text, in its order."""

    def __init__(self, text: str):
        self.text, self.found, self.known, self.unclosed = text, {}, {}, {}

    def literals(self) -> list[Literal]:
        """All literals that a name is given, directly or through constants given before."""
        text, at = self.text, 0
        while m := _OPERATOR.search(text, at):
            at = m.end()
            if m[0] in (":=", "=>", "=", ":") and (names := self.names_before(m.start(), m[0])):
                self.give(names, *self.value_after(m.end(), m[0][0]))
        if "</" in text or "value" in text:
            for m in _ELEMENT.finditer(text):
                g = 2 if m[1] else 4
                self.give([m[g - 1]], Literal([m.span(g)], True), "")
        return list(self.found.values())

    def names_before(self, end: int, operator: str) -> list[str]:
        back = self.text[max(0, end - 200) : end][::-1]
        typed = _TYPED.match(back) if operator == "=" else None
        return [m[1][::-1] for m in (_BEFORE.match(back), typed) if m]

    def closing(self, quote: str, start: int) -> int:
        """Where a string that begins at start ends, -1 if its line ends before (three quotes may span lines)."""
        if start < self.unclosed.get(quote, -1):
            return -1
        text, at = self.text, start
        line = text.find("\n", start) if len(quote) == 1 else -1
        line = len(text) if line < 0 else line
        while (k := text.find(quote, at, line)) >= 0:
            slashes = 0
            while k - slashes > start and text[k - slashes - 1] == "\\":
                slashes += 1
            if slashes % 2 == 0:
                return k
            at = k + 1
        self.unclosed[quote] = line
        return -1

    def value_after(self, start: int, operator: str) -> tuple[Literal | None, str]:
        """(literal, name that the value refers to)."""
        text = self.text
        m = _OPENING.match(text, start)
        quote, at, parts = m[1], m.end(), []
        while quote:
            end = self.closing(quote, at)
            if end < 0:
                break
            parts.append((at, end))
            more = _JOINED.match(text, end + len(quote))
            if not more:
                break
            quote, at = more[1], more.end()
        if parts:
            inner = text[parts[0][0] : min(parts[0][1], parts[0][0] + 130)] if len(parts) == 1 else ""
            refers = _REFERENCE.match(inner) if inner[:1] in ("$", "{") else None
            return Literal(parts, True), refers[1] if refers else ""
        m = _BARE[operator].match(text, at if not quote else start)
        if not m:
            braced = _BRACED.match(text, start)
            refers = _REFERENCE.match(braced[0].strip()) if braced else None
            return None, refers[1] if refers else ""
        if text[m.end() : m.end() + 1] == "(":
            return None, ""  # a call
        refers = _REFERENCE.match(m[0]) if len(m[0]) <= 128 else None
        return Literal([m.span()], False), refers[1] if refers else ""

    def give(self, names: list[str], literal: Literal | None, refers: str) -> None:
        """Adds the names to the literal, or to those that the constant referred to holds; the names then hold them."""
        held = self.known.get(refers)
        if held is None and literal is not None:
            held = [self.found.setdefault(literal.pieces[0][0], literal)]
        for name in names if held is not None else []:
            for x in held:
                if name not in x.names:
                    x.names.append(name)
            self.known[name] = self.known[name.rpartition(".")[2]] = held


def name_score(name: Column) -> Column:
    """1 for a name that ends as a secret's name does, 0.6 for one that has such words elsewhere, 0 for one about a secret and all others."""
    snake = F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_"))
    return F.when(snake.rlike(ABOUT), 0.0).when(snake.rlike(f"(^|_){SENSITIVE}$"), 1.0).when(snake.rlike(f"(^|_){SENSITIVE}_"), 0.6).otherwise(0.0)


def literal_score(value: Column, quoted: Column) -> Column:
    """0 to 1: distinct characters over ten; halved for one class of characters, cut for sentences; 0 for placeholders, for fewer than
    eight characters, and for bare words that don't mix digits and letters."""
    classes = sum(value.rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    variety = F.least(F.lit(1.0), F.size(F.array_distinct(F.split(value, ""))) / 10.0)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    fine = (F.length(value) >= 8) & ~value.rlike(PLACEHOLDER) & (quoted | mixed)
    return F.when(~fine, 0.0).otherwise(variety * F.when(classes >= 2, 1.0).otherwise(0.5) * F.when(value.rlike(r"\s"), 0.4).otherwise(1.0))


def scan(docs: DataFrame, threshold: float = 0.5, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, base, found): base spans and the literals found by name, as arrays of structs in the order of their starts.

    ``base`` has (start, kind, end) of whole matches, kinds as numbers in the order of ``KINDS``; ``found`` has (start, kind, end, names, score) of literals with
    name_score x literal_score of at least ``threshold`` that no base span covers. Positions count code points, ends are
    exclusive. A literal that is concatenated from pieces has a span for each.

    Null and empty texts have no spans; rows that repeat each have a row; an empty table gives none; texts may be of any length; columns of docs
    other than the key and the text are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    span = "struct<start:int,kind:int,end:int>"
    literal = "struct<names:array<string>,value:string,quoted:boolean,pieces:array<struct<start:int,end:int>>>"
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    at_type = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    literal_type = pa.list_(pa.struct([("names", pa.list_(pa.string())), ("value", pa.string()), ("quoted", pa.bool_()), ("pieces", pa.list_(at_type))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_t"):
            base, lexed = [], []
            for text, may in zip(batch.column(1).to_pylist(), _with_hex(texts), strict=True):
                text = text or ""
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in base_spans(text, may)])
                all_ = Lexer(text).literals() if "=" in text or ":" in text or "</" in text else []
                values = [(x, "".join(text[a:b] for a, b in x.pieces)) for x in all_]
                lexed.append([{"names": x.names, "value": v, "quoted": x.quoted, "pieces": [{"start": a, "end": b} for a, b in x.pieces]} for x, v in values if len(v) >= 8])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_type), pa.array(lexed, literal_type)], [key, "_base", "_lexed"])

    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text_col}`").alias("_t"))
    got = rows.mapInArrow(run, with_fields(rows.select(key), f"_base array<{span}>, _lexed array<{literal}>"))
    scored = F.transform("_lexed", lambda x: F.struct(x.names.alias("names"), x.pieces.alias("pieces"), (F.array_max(F.transform(x.names, name_score)) * literal_score(x.value, x.quoted)).alias("score")))
    hits = F.filter(scored, lambda x: x.score >= threshold)
    flat = F.flatten(F.transform(hits, lambda x: F.transform(x.pieces, lambda p: F.struct(p.start.alias("start"), F.lit(KINDS.index("literal")).alias("kind"), p.end.alias("end"), x.names.alias("names"), x.score.alias("score")))))
    new = F.filter(flat, lambda x: ~F.exists("_base", lambda b: (b.start <= x.start) & (b.end >= x.end)))
    return got.select(key, F.col("_base").alias("base"), F.array_sort(new).alias("found"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x.kind + 1), x.start.cast("string"), x.end.cast("string"))), ",")
