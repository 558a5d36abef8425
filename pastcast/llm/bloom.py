"""Bloom filters as column expressions over a literal of bounded size."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bits of one array of a filter at most; a larger filter has several, and a key's hash picks one.
ARRAY_BITS = 1 << 20


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as 64-bit words, hash count and seed."""

    words: tuple[int, ...]
    bits: int
    probes: int
    seed: int

    def might_hold(self, key: Column) -> Column:
        """Whether all bits of the key are set, as one test per probe; the plan has the words once per probe."""
        out = F.lit(True)
        for at in positions(key, self.bits, self.probes, self.seed):
            out = out & self._set(at)
        return out

    def holds(self, key: Column) -> Column:
        """The same answer from one loop over the probes; the plan has the words once, so they may be many."""
        one, two = _hashes(key, self.bits, self.seed)
        return F.forall(F.sequence(F.lit(0), F.lit(self.probes - 1)), lambda j: self._set((one + j * two) % self.bits))

    def _set(self, at: Column) -> Column:
        size = ARRAY_BITS // 64
        parts = [self.words[k : k + size] for k in range(0, len(self.words), size)]
        texts = [F.split(F.lit(",".join(map(str, part))), ",").cast("array<bigint>") for part in parts]  # fold to literals
        words = F.array(*texts) if len(texts) > 1 else texts[0]
        place = F.shiftright(at, 6).cast("int")
        word = F.get(F.get(words, F.floor(place / size).cast("int")), place % size) if len(texts) > 1 else F.get(words, place)
        return F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def _hashes(key: Column, bits: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(2 * seed + k)), F.lit(bits)) for k in (0, 1)]


def positions(key: Column, bits: int, probes: int, seed: int) -> list[Column]:
    """Double hashing: the bits of a key."""
    one, two = _hashes(key, bits, seed)
    return [(one + j * two) % bits for j in range(probes)]


def fill(keys: DataFrame, bits: int, probes: int, seed: int) -> Level:
    """The filter of column ``key``; bits are gathered by an aggregate, and at most bits / 64 words reach the driver."""
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, probes, seed))).alias("at"))
    word = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("b"))
    got = {r.w: r.b for r in word.collect()}
    return Level(tuple(got.get(w, 0) for w in range(bits // 64)), bits, probes, seed)


def bits_for(count: int, rate: float) -> int:
    """Bits of a filter of so many keys with a share ``rate`` of false answers."""
    return 64 * max(1, math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64))


def exact_size(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A filter of the rate asked for."""
    return fill(keys, bits_for(count, rate), max(1, math.ceil(-math.log2(rate))), seed)


def bounded(keys: DataFrame, count: int, max_bits: int = 1 << 22, seed: int = 1) -> Level:
    """A prefilter that never exceeds max_bits: with more keys it lets more others through, and still all keys."""
    bits = 64 * max(1, min(max_bits, 10 * count) // 64)
    return fill(keys, bits, max(1, min(7, round(bits / max(count, 1) * math.log(2)))), seed)
