"""Exact URL rule lists as Bloom filter cascades (operator 2, DataFrame functions only)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastcast.llm.bloom import Level, bits_for, exact_size
from pastcast.session import stored

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits that the levels of one pass over the urls may take in a plan (2 MB); a longer list is asked in more passes.
PLAN_BITS = 1 << 24
#: A later level of at most so many keys mistakes nearly none, which ends the cascade; larger ones mistake half, the smallest in sum.
LAST_KEYS, LAST_RATE = 1 << 12, 2**-16


def _rate(n: int, total: int) -> float:
    """False answers of level 1: about the listed share of the universe, so that no later level is larger than the list."""
    return min(0.5, max(2**-30, math.sqrt(0.5) * n / max(total, 1)))


def _later_rate(n: int) -> float:
    return 0.5 if n > LAST_KEYS else LAST_RATE


def build(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels for distinct listed keys against all other keys of the universe (both have one column ``key``).

    Level 1 encodes the listed keys, level 2 the other keys that level 1 takes for listed, level 3 the
    listed keys that level 2 takes for others, and so on until none is mistaken; every key of the
    universe is then answered exactly. The build makes one pass over the universe.
    Null keys are ignored; an empty list gives no levels.
    """
    inside = stored(listed.filter("key is not null").select("key").distinct())
    n, total = inside.count(), universe.count()
    outside, levels = universe.select("key").filter("key is not null").join(inside, "key", "left_anti"), []
    while n:
        levels.append(exact_size(inside, n, _later_rate(n) if levels else _rate(n, total), len(levels) + 1))
        wrong = stored(outside.filter(levels[-1].holds(F.col("key"))))
        inside, outside, n = wrong, inside, wrong.count()
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed; null keys are not."""
    out = F.lit(False)
    for level in reversed(levels):
        out = level.holds(key) & ~out
    return F.coalesce(out, F.lit(False))


def _share(key: Column, shares: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(shares))


def _of_share(keys: Column, share: int, shares: int) -> Column:
    return keys if shares == 1 else F.filter(keys, lambda k: _share(k, shares) == share)


def _best(keys: Column, cascades: dict[str, list[Level]]) -> Column:
    """(n, rule, verdict) of the longest listed key; null if none is listed."""

    def judged(k: Column) -> Column:
        kind = F.when(member(k, cascades["block"]), "block").when(member(k, cascades["allow"]), "allow")
        return F.struct(F.length(k).alias("n"), k.alias("rule"), kind.alias("verdict"))

    return F.array_max(F.filter(F.transform(keys, judged), lambda x: x.verdict.isNotNull()))


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (ASCII letters in lower case) and path; both are empty for null urls or without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url_col), "://([^/?#]*)([^?#]*)", k), F.lit(""))
    return pages.withColumns({"host": F.translate(part(1), _UPPER, _UPPER.lower()), "path": part(2)})


@dataclass
class UrlFilter:
    """Cascades per verdict for each share of the keys (one share where the list is short), and the host label counts and path
    lengths that occur in the rules."""

    shares: list[dict[str, list[Level]]]
    labels: list[int]
    lengths: list[int]

    @staticmethod
    def keys(labels: list[int], lengths: list[int]) -> Column:
        """Every (host suffix, path prefix) of a url that could be a rule, as one array; the expression is of one size for any rules."""
        numbers = lambda v: F.split(F.lit(",".join(map(str, v))), ",").cast("array<int>") if v else F.array().cast("array<int>")
        suffixes = F.transform(numbers(labels), lambda a: F.call_function("substring_index", F.col("host"), F.lit("."), -a))
        fitting = F.filter(numbers(lengths), lambda b: (F.col("host") != "") & (F.length("path") >= b))
        prefixes = F.transform(fitting, lambda b: F.substring(F.col("path"), F.lit(1), b))
        return F.flatten(F.transform(prefixes, lambda p: F.transform(suffixes, lambda s: F.concat(s, p))))

    @classmethod
    def fit(cls, pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], url_col: str = "url") -> UrlFilter:
        """rules: (verdict, host, path), a DataFrame of any size or a list; universe: all keys of all urls.

        The driver receives the distinct label counts and path lengths of the rules, and the levels' bits. Rules with a
        null part are ignored. A list whose levels could pass PLAN_BITS is split by the hash of its keys into shares that do
        not, each with cascades of its own against its share of the universe.
        """
        spark = pages.sparkSession
        if not isinstance(rules, DataFrame):
            rules = spark.createDataFrame(rules, "verdict string, host string, path string")
        rules = rules.select("verdict", "host", "path").dropna()
        listed = stored(rules.select("verdict", F.concat("host", "path").alias("key")).distinct())
        shape = rules.select((F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("a"), F.length("path").alias("b"))
        labels, lengths = (sorted(r[0] for r in shape.select(c).distinct().toLocalIterator()) for c in "ab")
        universe = with_parts(pages.select(url_col), url_col).select("host", "path").distinct().select(F.explode(cls.keys(labels, lengths)).alias("key"))
        universe = stored(universe.union(listed.select("key")).distinct())
        n, total = listed.count(), universe.count()
        most = 4 * bits_for(n, _rate(n, total)) if n else 0  # levels that mistake half sum to less than three times the first
        count = max(1, math.ceil(most / (PLAN_BITS - 2 * bits_for(LAST_KEYS, LAST_RATE))))
        part = lambda df, s: df if count == 1 else df.filter(_share(F.col("key"), count) == s)
        return cls([{v: build(part(listed.filter(F.col("verdict") == v), s), part(universe, s)) for v in ("block", "allow")} for s in range(count)], labels, lengths)

    def judge(self, pages: DataFrame, url_col: str = "url") -> DataFrame:
        """Adds host, path, rule and verdict.

        A rule fits its host and all subdomains if the path starts with the rule's; the longest rule (host
        and path together) wins, block before allow for one key in both lists. A url that fits no rule has a null
        rule and is allowed: no key of it is listed. No join and no shuffle; each row asks for (label counts x fitting path lengths)
        keys, in one pass over the rows per share of the list, between which the rows are stored with their best rule so far.
        Repeated rows each keep their row; null or malformed urls are allowed; an empty table gives no rows; columns of pages
        named host, path, rule or verdict are replaced.
        """
        clash = [c for c in pages.columns if c in ("host", "path", "rule", "verdict")]
        rows = with_parts(pages.drop(*clash), url_col)
        mark = "_best" + "_" * max(map(len, rows.columns))  # longer than any column
        for s, cascades in enumerate(self.shares):
            best = _best(_of_share(self.keys(self.labels, self.lengths), s, len(self.shares)), cascades)
            rows = rows.withColumn(mark, best if s == 0 else F.greatest(F.col(mark), best))
            if s + 1 < len(self.shares):
                rows = stored(rows)
        return rows.withColumns({"rule": F.col(mark)["rule"], "verdict": F.coalesce(F.col(mark)["verdict"], F.lit("allow"))}).drop(mark)
