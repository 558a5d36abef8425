"""Exact quantiles by narrowing: no task and no buffer holds the values of a large key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.session import stored

#: Values of a key that one aggregation buffer or one sort may hold.
FEW = 100_000
#: A sketch of a key gives this many steps of its distribution; narrowing keeps about six of them.
STEPS = 1000
#: Keys with open ranks up to which these are broadcast to the values.
BROADCAST_ROWS = 100_000


def quantiles(rows: DataFrame, keys: list[str], column: str, ps: list[float], few: int = FEW, steps: int = STEPS) -> DataFrame:
    """(keys, p, value): the ps-quantiles of a column per key, interpolated linearly between the two ranks around each; exact.

    Keys of at most ``few`` values are sorted in one buffer each. For larger ones a sketch brackets each rank; values below,
    on and inside the bracket are counted, and only those strictly inside go on, until few are left. A value that holds much
    of a key is an end of a bracket and is counted, never gathered. Null and NaN values don't count; a key without others has
    no rows; without ``keys`` there is one key. Keys are null-safe.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    item = stored(rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(column).cast("double").alias("_x")).filter("_x is not null and not isnan(_x)"))
    size = item.groupBy(*names).agg(F.count("*").alias("_n")).filter("_n > 0")
    large = stored(size.filter(F.col("_n") > few))
    n_large = large.count()
    ends = lambda out: out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "p", "value")
    direct = _direct(item, names, ps)
    if not n_large:
        return ends(direct)
    both = _meet(item, large.withColumn("_large", F.lit(True)), names, n_large, "left")
    direct = _direct(both.filter("_large is null"), names, ps)
    big = stored(both.filter("_large").drop("_large", "_n"))
    at = F.col("p") * (F.col("_n") - 1)
    asked = large.withColumn("p", F.explode(F.array(*map(F.lit, ps)))).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))).cast("array<long>")))
    found = selected(big, names, asked.select(*names, "rank").distinct(), few, steps)
    value = lambda f, name: found.select(*names, F.col("rank").alias(f), F.col("value").alias(name))
    pairs = asked.drop("rank").distinct().withColumns({"_lo": F.floor(at), "_hi": F.ceil(at), "_w": at - F.floor(at)})
    out = _meet(_meet(pairs, value("_lo", "_a"), [*names, "_lo"], None), value("_hi", "_b"), [*names, "_hi"], None)
    return ends(direct.unionByName(out.select(*names, "p", (F.col("_a") + F.when(F.col("_w") > 0, F.col("_w") * (F.col("_b") - F.col("_a"))).otherwise(0.0)).alias("value"))))


def _direct(item: DataFrame, names: list[str], ps: list[float]) -> DataFrame:
    made = item.groupBy(*names).agg(F.percentile("_x", F.array(*map(F.lit, ps))).alias("_v")).filter("_v is not null")
    return made.select(*names, F.explode(F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), F.col("_v").alias("v"))).alias("_i")).select(*names, F.col("_i")["p"].alias("p"), F.col("_i")["v"].alias("value"))


def _meet(left: DataFrame, right: DataFrame, names: list[str], n: int | None, how: str = "inner") -> DataFrame:
    """Join on null-safe keys; a right side of a counted, bounded size is broadcast."""
    if not names:
        return left.crossJoin(F.broadcast(right)) if how == "inner" else left.join(F.broadcast(right), F.lit(True), how)  # one key, one row
    other = right.toDF(*[f"_r{c}" if c in names else c for c in right.columns])
    on = None
    for c in names:
        same = F.col(c).eqNullSafe(F.col(f"_r{c}"))
        on = same if on is None else on & same
    return left.join(F.broadcast(other) if n is not None and n <= BROADCAST_ROWS else other, on, how).drop(*[f"_r{c}" for c in names])


def selected(item: DataFrame, names: list[str], asked: DataFrame, few: int = FEW, steps: int = STEPS) -> DataFrame:
    """(names, rank, value): the values at the asked ranks (from 0) of each key of item (names, _x)."""
    ids = [*names, "rank"]
    left = stored(asked.withColumn("_skip", F.lit(0).cast("long")))  # _skip: values of the key below those still in item
    rows, own, out = item, names, None
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    while n := left.count():
        sketch = rows.groupBy(*own).agg(F.count("*").alias("_m"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.percentile_approx("_x", grid, F.lit(10 * steps)).alias("_s"))
        at = F.floor((F.col("rank") - F.col("_skip")) / F.col("_m") * steps)
        open_ = _meet(left, sketch, own, None)
        open_ = open_.withColumns({
            "_lo": F.when(at < 3, F.col("_min")).otherwise(F.get("_s", F.greatest(at - 2, F.lit(0)).cast("int"))),
            "_hi": F.when(at > steps - 4, F.col("_max")).otherwise(F.get("_s", F.least(at + 3, F.lit(steps)).cast("int"))),
        }).drop("_s")
        open_ = stored(open_)
        met = _meet(rows, open_.select(*(ids if own == ids else [*names, "rank"]), "_lo", "_hi"), own, n)
        is_ = lambda c: F.count_if(c)
        x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
        counted = met.groupBy(*ids).agg(is_(x < lo).alias("_below"), is_(x == lo).alias("_on_lo"), is_((x > lo) & (x < hi)).alias("_inside"), is_((x == hi) & (hi > lo)).alias("_on_hi"))
        now = stored(_meet(open_, counted, ids, None))
        place = F.col("rank") - F.col("_skip") - F.col("_below")
        on_lo, inside = F.col("_on_lo"), F.col("_on_lo") + F.col("_inside")
        hit = F.when((place >= 0) & (place < on_lo), lo).when((place >= inside) & (place < inside + F.col("_on_hi")), hi)
        done = now.withColumn("value", hit).filter("value is not null").select(*ids, "value")
        deeper = (place >= on_lo) & (place < inside)
        # a sketch that missed its rank (it may not) would leave the side that holds it
        outside = now.filter((place < 0) | (place >= inside + F.col("_on_hi")))
        if not outside.isEmpty():
            raise RuntimeError("a sketch missed its rank")
        next_left = stored(now.filter(deeper).select(*ids, (F.col("_skip") + F.col("_below") + F.col("_on_lo")).alias("_skip"), F.col("_inside"), "_lo", "_hi"))
        m = next_left.count()
        out = done if out is None else out.unionByName(done)
        if not m:
            break
        kept = _meet(rows, next_left.select(*ids, "_lo", "_hi", "_inside"), own, m).filter((x > lo) & (x < hi)).select(*ids, "_x", "_inside")
        kept = stored(kept)
        last = kept.filter(F.col("_inside") <= few)
        w = Window.partitionBy(*ids).orderBy("_x")
        small = next_left.filter(F.col("_inside") <= few).select(*ids, (F.col("rank") - F.col("_skip") + 1).alias("_at"))
        ranked = _meet(last.withColumn("_k", F.row_number().over(w)), small, ids, None).filter(F.col("_k") == F.col("_at"))
        out = out.unionByName(ranked.select(*ids, F.col("_x").alias("value")))
        left = stored(next_left.filter(F.col("_inside") > few).select(*ids, "_skip"))
        rows, own = kept.filter(F.col("_inside") > few).drop("_inside"), ids
    if out is None:
        return asked.withColumn("value", F.lit(None).cast("double")).filter("false")
    return stored(out)


def one_row(rows: DataFrame, column: str, named: dict[str, float], few: int = FEW) -> DataFrame:
    """One row with the quantiles of a column under the given names; null where there are no values."""
    q = quantiles(rows, [], column, sorted(set(named.values())), few)
    return q.agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for name, p in named.items()])


def per_key(rows: DataFrame, keys: list[str], column: str, named: dict[str, float], few: int = FEW) -> DataFrame:
    """(keys, names): one row per key with its quantiles under the given names."""
    q = quantiles(rows, keys, column, sorted(set(named.values())), few)
    pick: list[Column] = [F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for name, p in named.items()]
    return q.groupBy(*keys).agg(*pick)
