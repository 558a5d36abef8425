"""Shards by balanced label propagation over linked documents (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.session import checkpointed, stored

#: Rows of a window at most, about; and large groups that are broadcast at most: those with more than 1 / _HOT of all rows.
_RANK_ROWS, _HOT = 4_000, 5_000


def ranked(rows: DataFrame, key: list[str], bucket: Column, by: list[str], name: str) -> DataFrame:
    """Adds a gapless rank from 0 inside each key, ordered by bucket, then ``by``.

    A window sees one bucket of a key; bucket offsets are a window over one row per key and bucket.
    """
    rows = rows.withColumn("_k", bucket)
    size = rows.groupBy(*key, "_k").agg(F.count("*").alias("_n"))
    size = size.withColumn("_skip", F.sum("_n").over(Window.partitionBy(*key).orderBy("_k")) - F.col("_n")).drop("_n")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "_k").orderBy(*by)) - 1)
    return rows.join(size, [*key, "_k"]).withColumn(name, F.col("_r") + F.col("_skip")).drop("_k", "_r", "_skip")


def _hashed(by: str, buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(by, F.lit(2)), buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("long")


def _step(cells: DataFrame, room: DataFrame, shards: int, turn: int) -> DataFrame:
    """One round: every (group, shard) cell wants to go to the shard where most of its group is.

    Wishes are summed to a shards x shards table. Opposite wishes are swapped in full; beyond that a shard takes
    in what its quota leaves, shared evenly among those who want to come. Cells then move their share, fractions settled
    by hash.
    """
    # a hashed preference decides ties, differently for each group
    prefer = F.struct("rows", F.xxhash64("g", "shard", F.lit(turn)), "shard")
    mode = cells.groupBy("g").agg(F.max(prefer).alias("m")).select("g", F.col("m.shard").alias("to"))
    wish = checkpointed(cells.join(mode, "g"))
    move = wish.filter("shard <> to")
    ask = move.groupBy("shard", "to").agg(F.sum("rows").alias("ask"))
    back = ask.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("ask").alias("back"))
    ask = ask.join(back, ["shard", "to"], "left").withColumn("swap", F.least("ask", F.coalesce("back", F.lit(0))))
    more = ask.groupBy("to").agg(F.sum(F.col("ask") - F.col("swap")).alias("more"))
    held = cells.groupBy(F.col("shard").alias("to")).agg(F.sum("rows").alias("held"))
    free = room.join(held, "to", "left").select("to", F.greatest(F.lit(0), F.col("quota") - F.coalesce("held", F.lit(0))).alias("free"))
    take = ask.join(more, "to").join(free, "to")
    take = take.select("shard", "to", ((F.col("swap") + (F.col("ask") - F.col("swap")) * F.least(F.lit(1.0), F.col("free") / F.greatest(F.col("more"), F.lit(1)))) / F.col("ask")).alias("share"))
    share = F.coalesce("share", F.lit(0.0)) * F.col("rows")
    chance = F.pmod(F.xxhash64("g", "shard", F.lit(-turn)), F.lit(1 << 20)) / float(1 << 20)
    gone = F.when(F.col("shard") == F.col("to"), 0).otherwise(F.least(F.col("rows"), F.floor(share + chance))).cast("long")
    wish = wish.join(F.broadcast(take), ["shard", "to"], "left").withColumn("gone", gone)  # take: shards x shards rows
    parts = wish.select("g", F.explode(F.array(F.struct("shard", (F.col("rows") - F.col("gone")).alias("rows")), F.struct(F.col("to").alias("shard"), F.col("gone").alias("rows")))).alias("p"))
    return checkpointed(parts.groupBy("g", "p.shard").agg(F.sum("p.rows").alias("rows")).filter("rows > 0"))


def _by_ends(rank: Column, ends: Column) -> Column:
    """Place of the first end above the rank."""
    return F.size(F.filter(ends, lambda e: e <= rank))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, rounds: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): all rows in shards whose counts differ by one at most.

    Documents with equal texts are linked. Linked documents begin in the shard of their id's hash; in each round they move
    to where most of their group is, as far as quotas allow (balanced label propagation). The state is one row per
    group and shard, never one per document, so a group with a third of all rows is ``shards`` rows. While they move, a shard may
    hold an eighth more than its quota. What ends up above the quota then fills the shards that have room, group after group, and unlinked
    documents fill the rest exactly: a shard's ends may cut a group each, and a group larger than a quota is cut.
    ``slot`` counts from 0 in each shard. Null texts have size 8, a null checksum and no links; empty texts are linked
    with each other; repeated rows each get a slot; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)).cast("long"), F.lit(0)) + 8
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.encode(F.col(text_col), "UTF-8")).alias("text_crc32"), F.md5(text_col).alias("g"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    large = max(1, total // _HOT)  # about _HOT groups at most have more rows
    step, buckets = min(large, _RANK_ROWS), max(1, total // _RANK_ROWS)
    groups = stored(rows.filter("g is not null").groupBy("g").agg(F.count("*").alias("copies")).filter("copies > 1"))
    hot = groups.filter(F.col("copies") > large)
    # a large group's rows meet its row by broadcast, all others by shuffle
    rows = rows.join(F.broadcast(hot.select("g", F.col("copies").alias("many"))), "g", "left")
    calm = rows.filter("many is null").join(groups.filter(F.col("copies") <= large), "g", "left")
    linked = stored(calm.filter("copies is not null").unionByName(rows.filter("many is not null").withColumn("copies", F.col("many"))))
    single = calm.filter("copies is null")
    quotas = [total // shards + (k < total % shards) for k in range(shards)]
    spark = docs.sparkSession
    room = spark.createDataFrame([(k, q + q // 8 + 1) for k, q in enumerate(quotas)], "to int, quota long")  # some play, which the last step takes back
    cells = checkpointed(linked.groupBy("g", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("rows")))
    for turn in range(1, rounds + 1):
        cells = _step(cells, room, shards, turn)
    # a group's documents take its cells in turn
    cells = cells.withColumn("end", F.sum("rows").over(Window.partitionBy("g").orderBy("shard")))
    ends = stored(cells.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends")))  # at most one entry per shard
    placed = ranked(linked, ["g"], _hashed("row", F.ceil(F.col("copies") / step)), ["row"], "rank")
    placed = placed.filter("many is null").join(ends, "g").unionByName(placed.filter("many is not null").join(F.broadcast(ends.join(F.broadcast(hot.select("g")), "g", "left_semi")), "g"))
    placed = placed.withColumn("shard", F.get(F.col("ends.shard"), _by_ends(F.col("rank"), F.col("ends.end"))))
    quota = F.get(F.array(*[F.lit(q) for q in quotas]), F.col("shard"))
    # whole groups keep their place first: those above the quota are the last by a hash of the group
    whole = F.struct(F.lit(0).alias("kind"), _hashed("g", buckets).alias("hash"), F.when(F.col("many").isNull(), F.lit("")).otherwise(F.col("g")).alias("g"), F.floor(F.col("rank") / step).alias("stretch"))
    placed = stored(ranked(placed.withColumn("bucket", whole), ["shard"], F.col("bucket"), ["g", "row"], "at"))
    stay = placed.filter(F.col("at") < quota).select("doc_id", "size", "text_crc32", "row", "shard", F.col("at").alias("slot"))
    loose = placed.filter(F.col("at") >= quota).select("doc_id", "size", "text_crc32", "g", "row", "bucket")
    one = F.struct(F.lit(1).alias("kind"), _hashed("row", buckets).alias("hash"), F.lit("").alias("g"), F.lit(0).cast("long").alias("stretch"))
    loose = loose.union(single.select("doc_id", "size", "text_crc32", "g", "row", one.alias("bucket")))  # groups first, each in one stretch
    held = {r.shard: r.n for r in stay.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row per shard
    upto, sums = 0, []
    for k in range(shards):
        upto += quotas[k] - held.get(k, 0)
        sums.append(upto)
    fill = F.array(*[F.lit(x).cast("long") for x in sums])
    loose = ranked(loose.withColumn("_one", F.lit(0)), ["_one"], F.col("bucket"), ["g", "row"], "rank").withColumn("shard", _by_ends(F.col("rank"), fill))
    skip = F.get(F.array(*[F.lit(held.get(k, 0) - (sums[k - 1] if k else 0)).cast("long") for k in range(shards)]), F.col("shard"))
    loose = loose.select("doc_id", "size", "text_crc32", "row", "shard", (F.col("rank") + skip).alias("slot"))
    out = stay.unionByName(loose)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def cut(placed: DataFrame, group: str = "text_crc32") -> DataFrame:
    """One row (groups, split, links, cut): groups of linked documents, those in more than one shard, all links, and links across shards.

    Counts come from one row per (group, shard); rows of a null group have no links.
    """
    cell = placed.filter(F.col(group).isNotNull()).groupBy(group, "size", "shard").agg(F.count("*").alias("c"))
    g = cell.groupBy(group, "size").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("shards")).filter("n > 1")
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("shards") > 1).alias("split"), (F.sum(F.col("n") * (F.col("n") - 1)) / 2).cast("long").alias("links"), (F.sum(F.col("n") * F.col("n") - F.col("q")) / 2).cast("long").alias("cut"))
