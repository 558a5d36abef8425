"""Across series, events and vectors: divergence, information flow, event features, neighbours, graphs, fidelity, history."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.functions.common import micros, pair_sum, total
from pastcast.operators import order_stats
from pastcast.operators.neighbours import Neighbours
from pastcast.operators.search import transfer_entropy
from pastcast.session import checkpointed, ship, stored, with_fields
from pastcast.sources.series import framed, in_chunk

#: Fixed event types of the feature vector.
EVENT_TYPES = ["rate_decision", "economic_data", "geopolitical", "earnings", "policy", "natural_disaster", "market_crash", "other"]


def tail_returns(rows: DataFrame, most: int) -> DataFrame:
    """(series_id, back, ret): log returns of the last ``most`` steps, counted back from the end from 0."""
    end = rows.groupBy("series_id").agg(F.max("pos").alias("end"))
    r = framed(rows, {"ret": F.log("value") - F.lag(F.log("value")).over(in_chunk())}, before=1)
    return r.join(end, "series_id").filter((F.col("pos") > F.col("end") - most) & F.col("ret").isNotNull()).select("series_id", (F.col("end") - F.col("pos")).alias("back"), "ret")


def divergence(rows: DataFrame, long: int = 252, recent: int = 20) -> DataFrame:
    """(a, b, long, recent, score, direction) of every pair of series: correlations of returns matched from the tail."""
    t = tail_returns(rows, long)
    a, b = t.toDF("a", "back", "ra"), t.toDF("b", "back", "rb")
    both = a.join(b, "back").filter("a < b")
    new = F.col("back") < recent
    out = both.groupBy("a", "b").agg(F.corr("ra", "rb").alias("long"), F.corr(F.when(new, F.col("ra")), F.when(new, F.col("rb"))).alias("recent"))
    gap = F.col("recent") - F.col("long")
    return out.withColumns({"score": F.abs(gap), "direction": F.when(gap > 0, "converging").otherwise("diverging")})


def information_flow(rows: DataFrame, most: int = 252, least: float = 0.05) -> DataFrame:
    """(a, b, forward, backward, net, direction) of every pair: transfer entropy of returns both ways."""
    t = tail_returns(rows, most)
    a, b = t.toDF("a", "back", "ra"), t.toDF("b", "back", "rb")
    both = a.join(b, "back").filter("a < b").withColumn("i", -F.col("back"))
    one = transfer_entropy(both.select("a", "b", "i", F.col("ra").alias("source"), F.col("rb").alias("target")), ["a", "b"]).withColumnRenamed("te", "forward")
    two = transfer_entropy(both.select("a", "b", "i", F.col("rb").alias("source"), F.col("ra").alias("target")), ["a", "b"]).withColumnRenamed("te", "backward")
    net = F.col("forward") - F.col("backward")
    return one.join(two, ["a", "b"]).withColumns({"net": net, "direction": F.when(net > least, "a_leads").when(net < -least, "b_leads").otherwise("mutual")})


def event_vector(kind: Column, ts: Column, magnitude: Column, direction: Column, types: list[str] = EVENT_TYPES) -> Column:
    """As many numbers as types and six: the type (unknown ones are the last), month and weekday (Monday 0) on circles, magnitude in 0 to 1, direction."""
    known = F.when(kind.isin(types), kind).otherwise(types[-1])
    angle = lambda x, n: x * (2 * math.pi / n)
    month, weekday = angle(F.month(ts) - 1, 12), angle(F.weekday(ts), 7)
    return F.array(*[F.when(known == t, 1.0).otherwise(0.0) for t in types], F.sin(month), F.cos(month), F.sin(weekday), F.cos(weekday), F.greatest(F.lit(0.0), F.least(F.lit(1.0), magnitude)), direction.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    d = F.sqrt(pair_sum(a, a) * pair_sum(b, b))
    return F.when(d == 0, 0.0).otherwise(pair_sum(a, b) / d)


def met(rows: DataFrame, queries: DataFrame, key: list[str], block: int = 1000) -> tuple[DataFrame, list[str]]:
    """Every row beside every query (query_id, ...), and the keys within which one task can rank the rows of a query.

    Any number of queries: up to ``block`` are broadcast. More are dealt by hash into blocks of about that many, and the rows
    into parts by ``key``; each part meets each block in one task.
    """
    n = queries.count()
    if n <= block:
        return rows.crossJoin(F.broadcast(queries)), ["query_id"]
    blocks = -(-n // block)
    parts = max(-(-rows.count() // (20 * block)), 1)
    place = lambda m, *c: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    q = queries.withColumn("_b", place(blocks, "query_id")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    r = rows.withColumn("_p", place(parts, *key)).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return r.join(q, ["_p", "_b"]), ["query_id", "_p"]


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = 4096, digits: int = 12) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar rows (id, vec) of each query (query_id, vec), itself left out; ties of so many ``digits`` by id.

    Any number of queries; each only meets the blocks of rows that can hold one of its nearest.
    """
    near = Neighbours(rows, "cosine", block=block).nearest(queries.select(F.col("query_id").alias("id"), "vec"), k, digits)
    return near.select(F.col("id").alias("query_id"), F.col("other").alias("id"), (1 - F.col("distance")).alias("similarity"), "rank")


def within(rows: DataFrame, queries: DataFrame, distance: float, block: int = 4096, digits: int = 9) -> DataFrame:
    """(query_id, id, distance): all rows (id, vec) at a cosine distance, rounded to so many digits, of at most ``distance`` of each query (query_id, vec), itself left out."""
    near = Neighbours(rows, "cosine", block=block).within(queries.select(F.col("query_id").alias("id"), "vec"), distance, digits)
    return near.select(F.col("id").alias("query_id"), F.col("other").alias("id"), "distance")


def around(events: DataFrame, anchors: DataFrame, days: int) -> DataFrame:
    """(anchor, id): events at most so many days before or after each anchor, both ends inclusive; joined on day buckets, then filtered."""
    day = lambda c: F.floor(micros(c) / 86_400_000_000)
    a = anchors.select("anchor", F.col("ts").alias("_t"), F.explode(F.sequence(day("ts") - days - 1, day("ts") + days + 1)).alias("_d"))
    met = events.select("id", "ts", day("ts").alias("_d")).join(a, "_d")
    return met.filter(F.abs(micros("ts") - micros("_t")) <= days * 86_400_000_000).select("anchor", "id")


def around_counts(events: DataFrame, anchors: DataFrame, days: int, parts: int = 64) -> DataFrame:
    """(anchor, n, first_id, last_id): how many events (id, ts) are at most so many days, one at least, before or after each anchor (anchor, ts), both ends inclusive, and their smallest and largest id; anchors without any are left out.

    No event meets an anchor. Time is cut into stretches, ``parts`` to a period: running counts inside the stretches of a period's two ends are
    taken from that end on, and what lies between is a frame over one row per stretch. The work grows with the events and the anchors.
    """
    wide = days * 86_400_000_000
    size = 2 * wide // parts
    none = lambda kind: F.lit(None).cast(kind)
    kind, name = events.schema["id"].dataType, anchors.schema["anchor"].dataType
    rows = events.select(micros("ts").alias("t"), "id", none(name).alias("anchor"), none("int").alias("side"))
    ends = anchors.select("anchor", micros("ts").alias("t"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    rows = rows.unionByName(ends.select((F.col("t") + F.col("side") * F.lit(wide)).alias("t"), none(kind).alias("id"), "anchor", "side"))
    rows = rows.filter("t is not null").withColumn("b", F.expr(f"(t - pmod(t, {size}L)) div {size}L"))
    found = {"n": F.count("id"), "first_id": F.min("id"), "last_id": F.max("id")}
    up, down = Window.partitionBy("b").orderBy("t"), Window.partitionBy("b").orderBy(F.desc("t"))  # equal times count as one place
    near = rows.withColumns({c: F.when(F.col("side") == 1, x.over(up)).otherwise(x.over(down)) for c, x in found.items()}).filter("side is not null")
    whole = rows.groupBy("b").agg(*[x.alias(c) for c, x in found.items()])
    between = Window.orderBy("b").rangeBetween(1, parts - 1)  # a row per stretch of time
    mid = whole.select("b", F.sum("n").over(between).alias("n"), F.min("first_id").over(between).alias("first_id"), F.max("last_id").over(between).alias("last_id"))
    near = near.select("anchor", "side", "b", *found)
    part = near.select("anchor", *found).unionByName(near.filter("side = -1").select("anchor", "b").join(mid, "b").select("anchor", *found))
    return part.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")).filter("n > 0")


def best_periods(events: DataFrame, query: list[float], k: int, days: int = 30) -> DataFrame:
    """(start, n, similarity): of the periods of so many days that start daily from the first event on, those whose mean vector is nearest the query; ties by start.

    Vectors are summed per day; a period is a frame over the days' sums, so that what is shuffled doesn't depend on its length.
    """
    dims = len(query)
    ends = events.agg(F.min(micros("ts")).alias("lo"), F.max(micros("ts")).alias("hi")).first()
    starts = (ends.hi - ends.lo) // 86_400_000_000 + 1 - days if ends.lo is not None else -1
    sums = [f"s{d}" for d in range(dims)]
    offset = F.floor((micros("ts") - F.lit(ends.lo)) / 86_400_000_000).alias("start")
    day = events.select(offset, "vec").groupBy("start").agg(F.count("*").alias("n"), *[F.sum(F.get("vec", F.lit(d))).alias(c) for d, c in enumerate(sums)])
    every = events.sparkSession.range(0, max(starts + days, 0)).withColumnRenamed("id", "start").join(day, "start", "left")
    frame = Window.orderBy("start").rowsBetween(0, days - 1)  # one row per day
    whole = every.select("start", *[F.coalesce(F.sum(c).over(frame), F.lit(0)).alias(c) for c in ("n", *sums)]).filter((F.col("n") > 0) & (F.col("start") <= starts))
    q = F.array(*[F.lit(float(x)) for x in query])
    return whole.select("start", "n", F.round(cosine(F.array(*[F.col(c) / F.col("n") for c in sums]), q), 9).alias("similarity")).orderBy(F.desc("similarity"), "start").limit(k)


def scorecard(predictions: DataFrame, outcomes: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate, brier, log_score): per bin of probability, empty bins with 0 rows, and over all as bin -1."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    rows = predictions.join(outcomes, "id").withColumns({"y": F.col("outcome").cast("double"), "bin": F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")})
    rows = rows.withColumns({"b": (F.col("p") - F.col("y")) ** 2, "l": -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))})
    made = rows.groupingSets([["bin"], []], "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"), F.avg("b").alias("brier"), F.avg("l").alias("log_score"))
    made = made.withColumn("bin", F.coalesce("bin", F.lit(-1)))
    return rows.sparkSession.range(-1, bins).select(F.col("id").cast("int").alias("bin")).join(made, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def transitions(items: DataFrame, key: str, order: str, parts: int | None = None) -> DataFrame:
    """(key, from, to, distance) of consecutive items (id, vec) of each key.

    Items are dealt by ranges of (key, order); a range's last item of a key meets the first of the next range that has the key.
    """
    rows = items.select(key, "id", "vec", F.col(order).alias("_o"))
    rows = stored((rows.repartitionByRange(parts, key, "_o") if parts else rows.repartitionByRange(key, "_o")).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy(key, "_p").orderBy("_o")
    item = F.struct("id", "vec")
    heads = rows.groupBy(key, "_p").agg(F.min_by(item, "_o").alias("_h"))
    heads = heads.select(F.col(key).alias("_k"), F.col("_p").alias("_q"), F.lead("_h").over(Window.partitionBy(key).orderBy("_p")).alias("_n"))  # a row per range and key
    rows = rows.withColumn("_l", F.lead(item).over(w)).join(heads, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_p") == F.col("_q")))
    rows = rows.withColumn("_t", F.coalesce("_l", "_n")).filter("_t is not null")
    return rows.select(key, F.col("id").alias("from"), F.col("_t.id").alias("to"), F.sqrt(total(F.zip_with("vec", "_t.vec", lambda x, y: (x - y) * (x - y)))).alias("distance"))


def _relaxed(edges: DataFrame, source: int, most: int | None = None) -> tuple[DataFrame, list[int]]:
    """(node, cost, hops, prev) of every node that the source reaches in at most so many rounds, and how many nodes had their edges relaxed in each round.

    An edge counts as one hop, or as many as its column ``hops`` says.
    """
    hops = F.col("hops") if "hops" in edges.columns else F.lit(1)
    both = stored(edges.select("u", "v", "w", hops.alias("_s")).union(edges.select("v", "u", "w", hops.alias("_s"))))
    cost = edges.sparkSession.createDataFrame([(source, 0.0, 0, None)], "node long, cost double, hops int, prev long")
    front, counts = cost, []
    while (most is None or len(counts) < most) and (n := front.count()):
        counts.append(n)
        step = front.join(both, front.node == both.u).select(F.col("v").alias("node"), F.struct((F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + F.col("_s")).alias("hops"), F.col("u").alias("prev")).alias("s"))
        step = step.groupBy("node").agg(F.min("s").alias("s")).select("node", "s.*")
        old = cost.select(F.col("node").alias("_n"), F.col("cost").alias("_c"), F.col("hops").alias("_h"))
        front = checkpointed(step.join(old, step.node == old._n, "left").filter("_c is null or cost < _c or (cost = _c and hops < _h)").select("node", "cost", "hops", "prev"))
        cost = checkpointed(cost.join(front.select("node"), "node", "left_anti").union(front))
    return cost, counts


def _without_chains(edges: DataFrame, source: int) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (u, v, w, hops) without nodes of one or two neighbours but the source, and the nodes taken out, round by round: (node, a, z), each neighbour a struct (v, w, hops).

    In a round no two neighbours go, the first of them in an order hashed anew does; a third of a chain goes, so rounds grow with the logarithm of its length.
    """
    best = lambda df: df.groupBy("u", "v").agg(F.min(F.struct("w", "hops")).alias("s")).select("u", "v", "s.*")
    line = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("w").cast("double").alias("w"), F.lit(1).alias("hops"))
    line, out = stored(best(line.filter("u < v and w is not null"))), []
    while True:
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(out))), F.col(c))
        both = line.unionByName(line.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "hops"))
        item = F.struct("v", "w", "hops")
        light = both.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"), F.min(item).alias("a"), F.max(item).alias("z"))
        light = stored(light.filter((F.col("n") <= 2) & (F.col("node") != source)))
        beside = light.select("node", F.explode(F.array("a.v", "z.v")).alias("v")).join(light.select(F.col("node").alias("v")), "v")
        held = beside.filter(order("v") < order("node")).select("node").distinct()
        gone = stored(light.join(held, "node", "left_anti").select("node", "a", F.when(F.col("n") == 2, F.col("z")).alias("z")))
        if gone.isEmpty():
            return line, out
        out.append(gone)
        name = gone.select("node")
        rest = line.join(name.toDF("u"), "u", "left_anti").join(name.toDF("v"), "v", "left_anti").select("u", "v", "w", "hops")
        over = gone.filter("z is not null").select(F.least("a.v", "z.v").alias("u"), F.greatest("a.v", "z.v").alias("v"), (F.col("a.w") + F.col("z.w")).alias("w"), (F.col("a.hops") + F.col("z.hops")).alias("hops"))
        line = stored(best(rest.unionByName(over)))


def _costs(edges: DataFrame, source: int) -> DataFrame:
    """(node, cost, hops) of every node that the source reaches: the cheapest way, and of those the shortest.

    Chains are drawn together first, so rounds don't grow with a path's length; the nodes of a chain then get their costs from its ends.
    """
    core, gone = _without_chains(edges, source)
    cost = _relaxed(core, source)[0].select("node", "cost", "hops")
    for some in reversed(gone):
        for end in ("a", "z"):
            far = cost.toDF("_n", "_c", "_h")
            some = some.join(far, F.col(f"{end}.v") == F.col("_n"), "left").withColumn(f"_{end}", F.when(F.col("_c").isNotNull(), F.struct((F.col("_c") + F.col(f"{end}.w")).alias("cost"), (F.col("_h") + F.col(f"{end}.hops")).alias("hops")))).drop("_n", "_c", "_h")
        cost = stored(cost.unionByName(some.select("node", F.least("_a", "_z").alias("s")).filter("s is not null").select("node", "s.*")))
    return cost


def shortest_paths(edges: DataFrame, source: int, most: int | None = None) -> DataFrame:
    """(node, cost) of every node that the source reaches over undirected edges (u, v, w) of non-negative weight, or over at most so many of them.

    With a limit, only the nodes whose cost fell in the last round relax their edges in the next.
    """
    return (_costs(edges, source) if most is None else _relaxed(edges, source, most)[0]).select("node", "cost")


def shortest_path(edges: DataFrame, source: int, target: int | None = None) -> DataFrame:
    """(step, node, cost): a cheapest path from source to target, or to the node of the largest cost; no rows when there is none.

    The nodes before the target are found by predecessors' predecessors, each round twice as far.
    """
    cost = _costs(edges, source)
    if target is None:
        target = cost.orderBy(F.desc("cost"), "node").first().node
    both = edges.select("u", "v", "w").union(edges.select("v", "u", "w"))
    both = both.join(cost.toDF("u", "_c", "_h"), "u").join(cost.toDF("v", "_d", "_g"), "v").filter("_c < _d or (_c = _d and _h < _g)")
    jump = checkpointed(both.groupBy(F.col("v").alias("node")).agg(F.min(F.struct(F.col("_c") + F.col("w"), F.col("_h"), F.col("u").alias("prev")))["prev"].alias("prev")))
    path = checkpointed(cost.filter(F.col("node") == target).select("node"))
    n = path.count()
    while n:
        path = checkpointed(path.union(path.join(jump, "node").select(F.col("prev").alias("node"))).distinct())
        now = path.count()
        if now == n:
            break
        n = now
        far = jump.select(F.col("node").alias("_n"), F.col("prev").alias("_p"))
        jump = checkpointed(jump.join(far, jump.prev == far._n, "left").select("node", F.coalesce("_p", "prev").alias("prev")))
    hops = path.join(cost, "node")
    return hops.select(F.col("hops").alias("step"), "node", "cost")


def marginal_fidelity(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column, ks, wasserstein, mean, std, skew, kurtosis): distances of each column's distributions; absolute differences of moments.

    Counts are summed per distinct value; running counts inside a stretch of the value order start from the stretch totals, so no
    task holds a column. Stretches are cut by approximate quantiles of the distinct values: a skewed column fills them evenly.
    """
    item = lambda df, s: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("i"), F.lit(s).alias("s")).select("i.column", "i.x", "s").filter("x is not null")
    rows = item(real, 0).union(item(synthetic, 1))
    stats = rows.groupBy("column", "s").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"))
    a, b = (stats.filter(F.col("s") == k).select("column", *[F.col(c).alias(f"{c}{k}") for c in ("n", "mean", "std", "skew", "kurt")]) for k in (0, 1))
    both = a.join(b, "column")
    value = stored(rows.groupBy("column", "x").agg(F.count_if(F.col("s") == 0).alias("c0"), F.count_if(F.col("s") == 1).alias("c1")))
    edge = value.groupBy("column").agg(F.percentile_approx("x", [i / 64 for i in range(1, 64)], 1000).alias("e"))
    value = value.join(F.broadcast(edge.join(both.select("column", "n0", "n1"), "column")), "column")  # a row per column
    value = value.withColumn("k", F.size(F.filter("e", lambda c: c < F.col("x")))).drop("e")
    inside = Window.partitionBy("column", "k").orderBy("x")
    run = value.withColumns({"r0": F.sum("c0").over(inside), "r1": F.sum("c1").over(inside), "next": F.lead("x").over(inside)})
    part = value.groupBy("column", "k").agg(F.sum("c0").alias("p0"), F.sum("c1").alias("p1"), F.min("x").alias("first"))
    over = Window.partitionBy("column").orderBy("k")  # 64 rows at most
    part = part.select("column", "k", (F.sum("p0").over(over) - F.col("p0")).alias("q0"), (F.sum("p1").over(over) - F.col("p1")).alias("q1"), F.lead("first").over(over).alias("after"))
    run = run.join(part, ["column", "k"]).withColumn("gap", F.abs((F.col("r0") + F.col("q0")) / F.col("n0") - (F.col("r1") + F.col("q1")) / F.col("n1")))
    dist = run.groupBy("column").agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * (F.coalesce("next", "after", "x") - F.col("x"))).alias("wasserstein"))
    diff = [F.abs(F.col(f"{c}0") - F.col(f"{c}1")).alias(out) for c, out in (("mean", "mean"), ("std", "std"), ("skew", "skew"), ("kurt", "kurtosis"))]
    return dist.join(both, "column").select("column", "ks", "wasserstein", *diff)


def correlation_gap(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(frobenius, largest) of the difference of the correlation matrices, each from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = lambda df, s: df.agg(*[F.corr(a, b).alias(f"{s}{k}") for k, (a, b) in enumerate(pairs)])
    both = one(real, "a").crossJoin(one(synthetic, "b"))  # one row each
    gap = [F.abs(F.col(f"a{k}") - F.col(f"b{k}")) for k in range(len(pairs))]
    return both.select(F.sqrt(2 * sum((g * g for g in gap), F.lit(0.0))).alias("frobenius"), F.greatest(*gap, F.lit(0.0)).alias("largest"))


def tails(real: DataFrame, synthetic: DataFrame, columns: list[str], few: int = order_stats.FEW) -> DataFrame:
    """(column, p01, p99, low_cvar, high_cvar): ratios of extreme quantiles and differences of mean tails beyond 5 % and 95 %, per column.

    A ratio whose real quantile is 0 is null. Quantiles are exact, found by narrowing; null and NaN values don't count.
    """
    marks = {"01": 0.01, "05": 0.05, "95": 0.95, "99": 0.99}

    def one(df: DataFrame, s: str) -> DataFrame:
        item = stored(df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])).alias("i")).select("i.*").filter("x is not null and not isnan(x)"))
        q = stored(order_stats.per_key(item, ["column"], "x", {f"{s}{n}": p for n, p in marks.items()}, few))
        t = item.join(F.broadcast(q), "column").groupBy("column").agg(F.avg(F.when(F.col("x") <= F.col(f"{s}05"), F.col("x"))).alias(f"{s}low"), F.avg(F.when(F.col("x") >= F.col(f"{s}95"), F.col("x"))).alias(f"{s}high"))  # q has a row per column
        return q.join(t, "column")

    both = one(real, "a").join(one(synthetic, "b"), "column")
    ratio = lambda n: F.try_divide(f"b{n}", f"a{n}").alias(f"p{n}")
    return both.select("column", ratio("01"), ratio("99"), F.abs(F.col("alow") - F.col("blow")).alias("low_cvar"), F.abs(F.col("ahigh") - F.col("bhigh")).alias("high_cvar"))


def tail_fidelity(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """(p01, p99, low_cvar, high_cvar) of one column, as one row."""
    return tails(real, synthetic, [column]).drop("column")


def feedback(rows: DataFrame) -> DataFrame:
    """(user_id, setup_id, kind, up, down, net): per user and per user and setup (setup_id null: the user over all), by kind."""
    out = rows.groupingSets([["user_id", "kind"], ["user_id", "setup_id", "kind"]], "user_id", "setup_id", "kind").agg(F.count_if(F.col("thumb") == "up").alias("up"), F.count_if(F.col("thumb") == "down").alias("down"))
    return out.withColumn("net", (F.col("up") - F.col("down")) / (F.col("up") + F.col("down")))


def differing(runs: DataFrame, left: int, right: int) -> DataFrame:
    """(key, left, right): the summary entries in which two runs differ, one side null if it lacks the key."""
    side = lambda k, name: runs.filter(F.col("run_id") == k).select(F.explode("summary").alias("key", name))
    return side(left, "left").join(side(right, "right"), "key", "full_outer").filter(~F.col("left").eqNullSafe(F.col("right")))


def latest(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last entry of each key."""
    return entries.groupBy(key).agg(F.max_by(F.struct(*[c for c in entries.columns if c != key]), F.struct(*order)).alias("e")).select(key, "e.*")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of undirected edges (u, v): each round every node moves onto the first of itself and its neighbours, in an order hashed anew.

    What were neighbours stay neighbours or become one, and about half of the nodes go, whatever their numbers: rounds grow with the logarithm
    of the table. A hub's neighbours are aggregated before the shuffle and never gathered. Moves are then followed from the last round back.
    """
    known = edges.select("u", "v").filter("u is not null and v is not null")
    line = stored(known.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct())
    moves: list[DataFrame] = []
    while not line.isEmpty():
        if len(moves) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), F.col(c).alias("to"))
        both = line.unionByName(line.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy(F.col("u").alias("node")).agg(F.min(order("v")).alias("m"))
        moves.append(stored(first.select("node", F.least("m", order("node"))["to"].alias("to"))))
        ends = line.join(moves[-1].toDF("u", "a"), "u").join(moves[-1].toDF("v", "b"), "v")
        line = stored(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct())
    alone = known.filter("u = v").select(F.col("u").alias("node")).distinct()
    if not moves:
        return alone.withColumn("component", F.col("node"))
    root = moves.pop()
    while moves:
        root = stored(moves.pop().join(root.toDF("to", "_r"), "to", "left").select("node", F.coalesce("_r", "to").alias("to")))
    out = root.join(root.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component")
    return out.unionByName(alone.join(root, "node", "left_anti").withColumn("component", F.col("node")))


def autocorrelation(rows: DataFrame, lags: list[int]) -> DataFrame:
    """(series_id, lag, acf) about the series mean, by frames that reach the longest lag."""
    stats = rows.groupBy("series_id").agg(F.avg("value").alias("m"), (F.var_pop("value") * F.count("*")).alias("v"))
    w = in_chunk()
    back = framed(rows, {f"l{k}": F.lag("value", k).over(w) for k in lags}, before=max(lags)).join(stats, "series_id")
    item = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), ((F.col("value") - F.col("m")) * (F.col(f"l{k}") - F.col("m"))).alias("p")) for k in lags]))
    return back.select("series_id", "v", item.alias("i")).groupBy("series_id", "i.lag").agg(F.try_divide(F.sum("i.p"), F.first("v")).alias("acf"))


def column_autocorrelations(rows: DataFrame, columns: list[str], lags: list[int]) -> DataFrame:
    """(series_id, lag, acf) of each column of rows (pos, columns), placed once for all columns, about the column's mean; series_id: the column's name."""
    w = in_chunk()
    one = rows.select(F.lit("").alias("series_id"), "pos", *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    of = range(len(columns))
    stats = one.agg(*[F.avg(f"_v{i}").alias(f"_m{i}") for i in of], *[(F.var_pop(f"_v{i}") * F.count("*")).alias(f"_s{i}") for i in of])
    back = framed(one, {f"_b{i}_{k}": F.lag(f"_v{i}", k).over(w) for i in of for k in lags}, before=max(lags)).crossJoin(F.broadcast(stats))  # one row
    gap = lambda c, i: F.col(c) - F.col(f"_m{i}")
    sums = back.agg(*[F.sum(gap(f"_v{i}", i) * gap(f"_b{i}_{k}", i)).alias(f"_p{i}_{k}") for i in of for k in lags], *[F.first(f"_s{i}").alias(f"_s{i}") for i in of])
    item = [F.struct(F.lit(c).alias("series_id"), F.lit(k).alias("lag"), F.try_divide(f"_p{i}_{k}", f"_s{i}").alias("acf")) for i, c in enumerate(columns) for k in lags]
    return sums.select(F.explode(F.array(*item)).alias("i")).select("i.*")


def temporal_gap(real: DataFrame, synthetic: DataFrame, lags: list[int]) -> DataFrame:
    """One row (acf): the mean distance of the autocorrelations of two sets of series (series_id, pos, value) at the lags."""
    a, b = autocorrelation(real, lags), autocorrelation(synthetic, lags).withColumnRenamed("acf", "other")
    return a.join(b, ["series_id", "lag"]).agg(F.avg(F.abs(F.col("acf") - F.col("other"))).alias("acf"))


def _partial(r: list[float]) -> list[float]:
    """Partial autocorrelations of lags 1, 2, ... by the Durbin-Levinson recursion; r begins with lag 1. NaN from where it breaks down."""
    out, phi, left = [], [], 1.0
    for k, x in enumerate(r):
        last = (x - sum(f * r[k - 1 - i] for i, f in enumerate(phi))) / left if left > 1e-12 else math.nan
        phi = [f - last * phi[k - 1 - i] for i, f in enumerate(phi)] + [last]
        left *= 1 - last * last
        out.append(last)
    return out


def partial_autocorrelation(rows: DataFrame, lags: list[int]) -> DataFrame:
    """(series_id, lag, acf, pacf); a series too short for a lag, or flat, has null there. One row per series is folded, its correlations."""
    every = list(range(1, max(lags) + 1))
    got = autocorrelation(rows, every).groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("lag", "acf"))).alias("m"))  # max(lags) each
    got = got.select("series_id", F.array(*[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(float("nan"))) for k in every]).alias("r"))
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(p=[_partial(list(r)) for r in pdf["r"]])

    made = got.mapInPandas(run, with_fields(got.select("series_id"), "r array<double>, p array<double>")).withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags])))
    return made.select("series_id", "lag", *[F.nanvl(F.get(c, F.col("lag") - 1), F.lit(None).cast("double")).alias(n) for c, n in (("r", "acf"), ("p", "pacf"))])


def temporal_fidelity(real: DataFrame, copy: DataFrame, lags: list[int]) -> DataFrame:
    """(series_id, lag, acf, pacf): how far a copy's (partial) autocorrelations are from the real ones, and their means as lag 0; null where one lacks."""
    a, b = partial_autocorrelation(real, lags), partial_autocorrelation(copy, lags)
    far = a.join(b.toDF("series_id", "lag", "_a", "_p"), ["series_id", "lag"], "left").select("series_id", "lag", F.abs(F.col("acf") - F.col("_a")).alias("acf"), F.abs(F.col("pacf") - F.col("_p")).alias("pacf"))
    whole = far.groupBy("series_id").agg(F.avg("acf").alias("acf"), F.avg("pacf").alias("pacf")).withColumn("lag", F.lit(0))
    return far.unionByName(whole)


def rejected(directions: DataFrame, log: DataFrame) -> DataFrame:
    """The directions (direction_id, ...) with the last of their entries in the log (direction_id, line, ...), the highest line; others are left out."""
    return directions.join(latest(log, "direction_id", ["line"]), "direction_id")
