"""Coverage, quality, freshness and alignment of bar datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastcast.functions.common import micros, timeframe_seconds
from pastcast.sources.bars import DATASET
from pastcast.sources.series import framed, in_chunk

#: Seconds between bars; other codes count as a day.
EXPECTED = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400}


def coverage(catalog: DataFrame) -> DataFrame:
    """Datasets, rows, sorted symbols, oldest and newest stamp: overall, and by asset class, timeframe and source in one pass."""
    sets = [[], ["asset_class"], ["timeframe"], ["source"]]
    cols = [F.col(c) for c in ("asset_class", "timeframe", "source")]
    out = catalog.groupingSets([[F.col(c) for c in s] for s in sets], *cols)
    return out.agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("datasets"),
        F.sum("row_count").alias("total_rows"),
        F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"),
        F.min("start_timestamp").alias("oldest"),
        F.max("end_timestamp").alias("newest"),
    )


def expected_seconds(timeframe: Column) -> Column:
    out = F.lit(86400)
    for code, n in EXPECTED.items():
        out = F.when(timeframe == code, n).otherwise(out)
    return out


def quality(bars: DataFrame, catalog: DataFrame, now: Column, stale_hours: float = 48, gap_factor: float = 3.0, spike: float = 0.5, size: int = 1 << 16) -> DataFrame:
    """(dataset, issue, severity, n): one row per failed check.

    bars has (dataset, pos, timestamp, close), catalog (dataset, timeframe, row_count, updated). All datasets are checked in
    one pass over chunks of positions, so a dataset with most of the rows is spread over tasks.
    """
    w = in_chunk("dataset")
    rows = bars.join(catalog.select("dataset", "timeframe"), "dataset")
    rows = framed(rows, {"prev": F.lag("close").over(w), "gap": (micros("timestamp") - micros(F.lag("timestamp").over(w))) / 1e6}, before=1, size=size)
    found = rows.groupBy("dataset").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("gap") > gap_factor * expected_seconds(F.col("timeframe"))).alias("gap"),
        F.count_if((F.col("prev") > 0) & (F.abs(F.col("close") - F.col("prev")) / F.col("prev") > spike)).alias("spike"),
        (F.count("*") - F.countDistinct("timestamp")).alias("duplicate"),
    )
    stale = (micros(now) - micros("updated")) / 3.6e9 > stale_hours
    all_ = catalog.join(found, "dataset", "left")
    checks = [
        ("empty", "error", F.when(F.coalesce("row_count", F.lit(0)) == 0, 1)),
        ("missing_data", "error", F.when((F.col("row_count") > 0) & F.col("n").isNull(), 1)),
        ("stale", "warning", F.when(stale, 1)),
        *[(k, "warning", F.when(F.col(k) > 0, F.col(k))) for k in ("gap", "spike", "duplicate")],
    ]
    issue = F.explode(F.array_compact(F.array(*[F.when(n.isNotNull(), F.struct(F.lit(k).alias("issue"), F.lit(s).alias("severity"), n.cast("long").alias("n"))) for k, s, n in checks])))
    return all_.select("dataset", issue.alias("i")).select("dataset", "i.*")


def freshness(catalog: DataFrame, now: Column, stale_hours: float = 48) -> DataFrame:
    """Hours since the update, rounded to 1, and whether that is stale."""
    hours = (micros(now) - micros("updated")) / 3.6e9
    return catalog.withColumns({"hours": F.round(hours, 1), "stale": hours > stale_hours}).orderBy(F.desc("hours"))


def search(catalog: DataFrame, asset_class: str | None = None, source: str | None = None, min_rows: int = 0) -> DataFrame:
    """Datasets of a class and source with enough rows."""
    out = catalog.filter(F.col("row_count") >= min_rows)
    for name, value in (("asset_class", asset_class), ("source", source)):
        out = out.filter(F.col(name) == value) if value else out
    return out


def aligned(bars: DataFrame, symbols: list[str], value: str = "close", ts: str = "timestamp") -> DataFrame:
    """One column per symbol, one row per timestamp that any of them has."""
    return bars.filter(F.col("symbol").isin(symbols)).groupBy(ts).pivot("symbol", symbols).agg(F.first(value))


def align_pair(left: DataFrame, right: DataFrame, how: str = "intersection", bucket: int = 86400) -> DataFrame:
    """(ts, left, right) of two series (ts, value): intersection, union, left_anchor or right_anchor.

    An anchor keeps each bar of its leg with the nearest prior bar of the other. That as-of join is one union: the
    last value inside a stretch of ``bucket`` seconds, else the last value of earlier stretches, of which there is one row each.
    """
    a, b = left.select("ts", F.col("value").alias("left")), right.select("ts", F.col("value").alias("right"))
    if how in ("intersection", "union"):
        return a.join(b, "ts", "inner" if how == "intersection" else "full_outer")
    if how == "right_anchor":
        return align_pair(right, left, "left_anchor", bucket).select("ts", F.col("right").alias("left"), F.col("left").alias("right"))
    if how != "left_anchor":
        raise ValueError(f"not an alignment: {how!r}")
    both = a.select("ts", "left", F.lit(None).cast("double").alias("right"), F.lit(1).alias("side")).union(b.select("ts", F.lit(None).cast("double").alias("left"), "right", F.lit(0).alias("side")))
    both = both.withColumn("k", F.floor(micros("ts") / (bucket * 1_000_000)))
    inside = Window.partitionBy("k").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last("right", ignorenulls=True).over(inside))
    carry = both.groupBy("k").agg(F.max_by("right", F.when(F.col("right").isNotNull(), F.col("ts"))).alias("last"))
    earlier = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch
    carry = carry.withColumn("carry", F.last("last", ignorenulls=True).over(earlier)).select("k", "carry")
    return near.filter("side = 1").join(carry, "k").select("ts", "left", F.coalesce("near", "carry").alias("right"))


def slice_bars(bars: DataFrame, slices: DataFrame, max_slices: int = 10_000) -> DataFrame:
    """(slice id, bar) for every bar inside a slice of its dataset, both ends inclusive; a catalogue above max_slices is joined by shuffle."""
    small = slices.limit(max_slices + 1).count() <= max_slices
    side = (F.broadcast(slices) if small else slices).withColumnRenamed("dataset", "_dataset")
    return bars.join(side, (F.col("dataset") == F.col("_dataset")) & F.col("ts").between(F.col("start"), F.col("end"))).drop("_dataset")


def slice_problems(slices: DataFrame, pairs: DataFrame, classes: list[str], today: Column) -> DataFrame:
    """(id, problem) rows: repeated ids, order and future of dates, unknown class, deprecated without successor, pairs that dangle or don't overlap."""
    problem = lambda df, text: df.select(F.col("id").cast("string").alias("id"), F.lit(text).alias("problem"))
    out = problem(slices.groupBy("id").count().filter("count > 1"), "duplicate id")
    for test, text in (
        (F.col("start") >= F.col("end"), "start not before end"),
        (F.col("end") > today, "end in the future"),
        (~F.col("regime_class").isin(classes), "unknown regime class"),
        ((F.col("status") == "deprecated") & F.col("successor_id").isNull(), "deprecated without successor"),
    ):
        out = out.unionByName(problem(slices.filter(test), text))
    legs = pairs.select(F.col("pair_id").alias("id"), F.explode(F.array("left_id", "right_id")).alias("leg"))
    known = slices.select(F.col("id").alias("leg"), "start", "end")
    out = out.unionByName(problem(legs.join(known, "leg", "left_anti").select("id").distinct(), "dangling pair"))
    span = legs.join(known, "leg").groupBy("id").agg(F.count("*").alias("n"), F.max("start").alias("lo"), F.min("end").alias("hi"))
    return out.unionByName(problem(span.filter("n = 2 and lo > hi"), "pair does not overlap"))


def merged_catalog(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries that have a data file, with defaults for what is missing and a label for the frequency."""
    label = F.create_map(*[F.lit(x) for kv in {"1m": "minute", "5m": "5 minutes", "1h": "hourly", "1d": "daily", "1w": "weekly"}.items() for x in kv])
    kept = entries.join(files, "path", "left_semi")
    return kept.withColumns({"name": F.coalesce("name", "path"), "frequency": F.coalesce(label[F.col("timeframe")], F.col("timeframe"), F.lit("unknown"))})


__all__ = ["DATASET", "align_pair", "aligned", "coverage", "freshness", "merged_catalog", "quality", "search", "slice_bars", "slice_problems", "timeframe_seconds"]
