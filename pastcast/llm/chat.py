"""Collapse of cumulative conversation snapshots, and chat rendering (operator 8, DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.session import stored

#: Rows of a side that is broadcast at most; a larger side is joined by shuffle.
BROADCAST_ROWS = 1_000_000
_MARK = "-"


def _key(conv_id: str | Column) -> Column:
    """A conversation's id as text that is never null."""
    c = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return F.when(c.isNull(), _MARK).otherwise(F.concat(F.lit("+"), c.cast("string")))


def _id(key: str, kind: str) -> Column:
    return F.when(F.col(key) != _MARK, F.substring(key, 2, 1 << 30)).cast(kind)


def _content(salt: int) -> Column:
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    return F.xxhash64(F.lit(salt), F.col("role").isNull(), filled[0], F.col("text").isNull(), filled[1])


def _side(df: DataFrame, most: int) -> DataFrame:
    """Broadcast after a count, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@dataclass
class Rolled:
    """Places of turns and hashes of prefixes, without any text.

    turns: (c, turn, blk, start, copies): one row per conversation and turn number, its first place less one and how many distinct
    rows share the number. ties: (c, turn, role, text, k): rows of shared numbers with their order among themselves.
    prefixes: (c, pos, h1, h2, n).
    """

    turns: DataFrame
    ties: DataFrame | None
    prefixes: DataFrame


def _in_blocks(rows: DataFrame, blk: str, order: str, add: dict[str, str], how: str) -> DataFrame:
    """Adds running aggregates (``how``) of columns before each row: inside (c, blk), then over one row per block."""
    inside = Window.partitionBy("c", blk).orderBy(order)
    before = Window.partitionBy("c").orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    undo = (lambda a, b: a - b) if how == "sum" else (lambda a, b: a.bitwiseXOR(b))
    both = (lambda a, b: a + b) if how == "sum" else (lambda a, b: a.bitwiseXOR(b))
    run = lambda c, w: F.expr(f"{how}({c})").over(w)
    whole = rows.groupBy("c", blk).agg(*[F.expr(f"{how}({c})").alias(c) for c in add])
    whole = whole.select("c", blk, *[F.coalesce(run(c, before), F.lit(0)).alias(f"_{o}") for c, o in add.items()])
    rows = rows.withColumns({o: undo(run(c, inside), F.col(c)) for c, o in add.items()})
    return rows.join(whole, ["c", blk]).withColumns({o: both(F.col(o), F.col(f"_{o}")) for o in add.values()}).drop(*[f"_{o}" for o in add.values()])


def _ordered_ties(rows: DataFrame) -> DataFrame:
    """(c, turn, role, text, k): distinct rows in the order of (role, text), nulls first, from 0 in each (c, turn).

    Rows are cut by ranges, ranked inside each range and then over one row per range: a turn number that a third of all
    rows share is spread over tasks.
    """
    order = [F.col(x).asc_nulls_first() for x in ("role", "text")]
    parts = stored(rows.distinct().repartitionByRange("c", F.col("turn").asc_nulls_first(), *order).withColumn("_part", F.spark_partition_id()))
    key = ["c", "turn"]
    size = parts.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    size = size.withColumn("_skip", F.sum("_n").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_n"))
    ranked = parts.withColumn("_k", F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*order)) - 1)
    same = F.col("a.turn").eqNullSafe(F.col("b.turn")) & (F.col("a.c") == F.col("b.c")) & (F.col("a._part") == F.col("b._part"))
    return ranked.alias("a").join(size.alias("b"), same).select("a.c", "a.turn", "role", "text", (F.col("_k") + F.col("_skip")).alias("k"))


def rolling(turns: DataFrame, block: int = 1024) -> Rolled:
    """Each turn's place from 1, a 128-bit hash of the turns up to it, and the conversation's length.

    Turns are ordered by (turn, role, text), nulls first; identical rows are one turn. What is shuffled is a hash
    of each turn; texts travel only where several distinct rows share a turn number. Places and hashes come in two
    levels, inside blocks of ``block`` turn numbers and then over blocks, so a long conversation is spread over tasks.
    """
    named = turns.select(_key("conv_id").alias("c"), F.col("turn").cast("long").alias("turn"), "role", "text")
    both = F.struct(_content(1).alias("a"), _content(2).alias("b"))
    at = named.select("c", "turn", both.alias("h")).groupBy("c", "turn").agg(F.min("h").alias("h"), F.max("h").alias("top"))
    at = stored(at.select("c", "turn", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))).alias("blk"), "h.a", "h.b", (F.col("h") != F.col("top")).alias("shared")))
    shared = at.filter("shared").select("c", "turn")
    count, ties = F.lit(1).cast("long"), None
    if not shared.isEmpty():
        same = F.col("x.turn").eqNullSafe(F.col("y.turn")) & (F.col("x.c") == F.col("y.c"))
        ties = stored(_ordered_ties(named.alias("x").join(_side(shared, BROADCAST_ROWS).alias("y"), same, "left_semi")))
        size = ties.groupBy("c", "turn").agg(F.count("*").alias("copies"))
        at = at.alias("x").join(size.alias("y"), same, "left").select("x.*", "copies")
        count = F.coalesce(F.col("copies"), F.lit(1).cast("long"))
    at = _in_blocks(at.withColumn("copies", count), "blk", "turn", {"copies": "start"}, "sum")
    size = at.groupBy("c", "blk").agg(F.sum("copies").alias("n")).groupBy("c").agg(F.sum("n").alias("n"))
    mixed = lambda k, h, pos: F.xxhash64(F.lit(k), pos, h)
    one = F.col("copies") == 1
    at = at.withColumns({"x1": F.when(one, mixed(1, F.col("a"), F.col("start") + 1)), "x2": F.when(one, mixed(2, F.col("b"), F.col("start") + 1))}).drop("a", "b")
    if ties is not None:
        same = F.col("x.turn").eqNullSafe(F.col("y.turn")) & (F.col("x.c") == F.col("y.c"))
        inner = ties.alias("x").join(at.select("c", "turn", "start").alias("y"), same).select("x.c", "x.turn", F.floor(F.col("k") / block).alias("part"), "start", "k", *[mixed(h, _content(h), F.col("start") + F.col("k") + 1).alias(f"x{h}") for h in (1, 2)])
        inner = stored(inner.withColumn("c", F.concat_ws("|", F.coalesce(F.col("turn").cast("string"), F.lit("")), "c")))  # a shared number is run through like a conversation
        inside = stored(_in_blocks(inner, "part", "k", {"x1": "p1", "x2": "p2"}, "bit_xor"))
        inside = inside.withColumn("c", F.expr("substring(c, instr(c, '|') + 1)"))
        whole = inside.groupBy("c", "turn").agg(F.expr("bit_xor(x1)").alias("t1"), F.expr("bit_xor(x2)").alias("t2"))
        at = at.alias("x").join(whole.alias("y"), same, "left").select("x.c", "x.turn", "blk", "shared", "copies", "start", F.coalesce("x1", "t1").alias("x1"), F.coalesce("x2", "t2").alias("x2"))
    at = stored(_in_blocks(at, "blk", "turn", {"x1": "y1", "x2": "y2"}, "bit_xor").join(size, "c"))
    upto = lambda k: F.col(f"y{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"h{k}")
    out = at.filter(one).select("c", (F.col("start") + 1).alias("pos"), upto(1), upto(2), "n")
    if ties is not None:
        rows = inside.drop("start").alias("x").join(at.select("c", "turn", "start", "y1", "y2", "n").alias("y"), same)
        full = lambda k: F.col(f"y{k}").bitwiseXOR(F.col(f"p{k}")).bitwiseXOR(F.col(f"x{k}")).alias(f"h{k}")
        out = out.union(rows.select("x.c", (F.col("start") + F.col("k") + 1).alias("pos"), full(1), full(2), "n"))
    return Rolled(at.select("c", "turn", "start", "copies", "n"), ties, out)


def maximal(prefixes: DataFrame, kind: str = "long") -> DataFrame:
    """(c, n) of conversations that are neither a proper prefix of another nor equal to one with a smaller conv_id."""
    whole = prefixes.filter("pos = n").groupBy("h1", "h2").agg(F.min(F.struct(F.col("c") == _MARK, _id("c", kind).alias("id"), "c")).alias("m"), F.first("n").alias("n"))
    shorter = prefixes.filter("pos < n").select("h1", "h2").distinct()
    return whole.join(shorter, ["h1", "h2"], "left_anti").select("m.c", "n")


def render(turns: DataFrame, part_turns: int = 256, start: str = "<|im_start|>", end: str = "<|im_end|>", block: int = 1024) -> DataFrame:
    """(conv_id, part, n_turns, text): maximal conversations in chat markup.

    A conversation comes in parts of ``part_turns`` turns, numbered from 0; joined in order they are the whole rendering,
    so that no row holds an unbounded conversation. Texts of the conversations that stay are shuffled once, to their part, where the
    table of places is small enough to be broadcast, else twice. Null roles or texts render as empty; a null conv_id is a
    conversation like any other; repeated rows are one turn; equal turn numbers are ordered by role and text; an empty table
    gives no rows; columns other than conv_id, turn, role and text are ignored, whatever their names.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rolled = rolling(turns, block)
    keep = stored(maximal(rolled.prefixes, kind))
    kept = stored(rolled.turns.join(keep.select("c"), "c", "left_semi"))
    # a conversation whose turns are numbered without gaps or ties needs no row per turn
    first = kept.groupBy("c").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.max("copies").alias("most"), F.count("*").alias("rows"), F.max("n").alias("n"), F.count("turn").alias("numbered"))
    even = (F.col("most") == 1) & (F.col("numbered") == F.col("rows")) & (F.col("last") - F.col("first") + 1 == F.col("rows"))
    first = stored(first.withColumn("even", F.coalesce(even, F.lit(False))))
    named = turns.select(_key("conv_id").alias("c"), F.col("turn").cast("long").alias("turn"), "role", "text")
    text = F.concat(F.lit(start), F.coalesce(F.col("role").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(end + "\n")).alias("line")
    lines = named.join(_side(first.filter("even").select("c", "first", "n"), BROADCAST_ROWS), "c").select("c", (F.col("turn") - F.col("first")).alias("at"), "n", text)
    odd = kept.join(first.filter("not even").select("c"), "c", "left_semi")
    same = F.col("x.turn").eqNullSafe(F.col("y.turn")) & (F.col("x.c") == F.col("y.c"))
    lines = lines.union(named.alias("x").join(_side(odd.filter("copies = 1"), BROADCAST_ROWS).alias("y"), same).select("x.c", F.col("start").alias("at"), "n", text))
    if rolled.ties is not None:
        lines = lines.union(rolled.ties.alias("x").join(_side(odd.filter("copies > 1"), BROADCAST_ROWS).alias("y"), same).select("x.c", (F.col("start") + F.col("k")).alias("at"), "n", text))
    part = F.floor(F.col("at") / part_turns).cast("int").alias("part")
    # a set, since rows may be repeated without bound
    grouped = lines.groupBy("c", part).agg(F.first("n").alias("n_turns"), F.sort_array(F.collect_set(F.struct("at", "line"))).alias("lines"))
    return grouped.select(_id("c", kind).alias("conv_id"), "part", "n_turns", F.array_join("lines.line", "").alias("text"))
