"""Loading, slicing and placing series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastcast.functions.common import micros

#: Fixed names of date columns, in order of preference.
DATE_NAMES = ["date", "Date", "datetime", "Datetime", "timestamp", "time", "Time"]


def resolve(columns: list[str], name: str) -> str:
    """The column of that name, exact before case-insensitive; KeyError lists what there is."""
    if name in columns:
        return name
    same = [c for c in columns if c.lower() == name.lower()]
    if not same:
        raise KeyError(f"no column {name!r}; available: {', '.join(columns)}")
    return same[0]


def load(spark: SparkSession, source: str | DataFrame, column: str = "close", date_column: str | None = None, series: str | None = None) -> DataFrame:
    """(series_id, ts, value) of a CSV file, a Parquet file or a DataFrame; ts is null without a date column."""
    df = source
    if isinstance(source, str):
        df = spark.read.csv(source, header=True, inferSchema=True) if source.lower().endswith(".csv") else spark.read.parquet(source)
    value = F.col(resolve(df.columns, column)).cast("double")
    date = resolve(df.columns, date_column) if date_column else next((c for c in DATE_NAMES if c in df.columns), None)
    ts = F.col(date).cast("timestamp_ntz") if date else F.lit(None).cast("timestamp_ntz")
    return df.select((F.col(series).cast("string") if series else F.lit(column)).alias("series_id"), ts.alias("ts"), value.alias("value"))


def positions(rows: DataFrame, *order: str, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Adds pos, from 0 in each series by (ts, order).

    Ranks inside a day and offsets of days: no task orders a whole series, only its row per day.
    """
    rows = rows.withColumn("_day", F.floor(micros(ts) / 86_400_000_000))
    inside = Window.partitionBy(series, "_day").orderBy(ts, *order)
    size = rows.groupBy(series, "_day").agg(F.count("*").alias("_n"))
    size = size.withColumn("_skip", F.sum("_n").over(Window.partitionBy(series).orderBy("_day")) - F.col("_n")).drop("_n")
    return rows.withColumn("_k", F.row_number().over(inside)).join(size, [series, "_day"]).withColumn("pos", F.col("_skip") + F.col("_k") - 1).drop("_day", "_k", "_skip")


def between(rows: DataFrame, first: str, last: str, ts: str = "ts") -> DataFrame:
    """Rows of a date range, both ends inclusive."""
    return rows.filter(F.col(ts).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))


def newest(rows: DataFrame, most: int = 10_000, series: str = "series_id") -> DataFrame:
    """The last ``most`` rows of each series by pos."""
    end = rows.groupBy(series).agg(F.max("pos").alias("_end"))
    return rows.join(end, series).filter(F.col("pos") > F.col("_end") - most).drop("_end")


def chunked(rows: DataFrame, before: int = 0, after: int = 0, size: int = 1 << 16) -> DataFrame:
    """Adds chunk: each row in its stretch of ``size`` positions, and where it is needed as context of the next or last one.

    A frame of at most ``before`` rows back and ``after`` rows ahead is then whole inside a chunk for the chunk's own rows
    (``core``), so that one long series is worked on by many tasks.
    """
    size = max(size, before, after, 1)
    own, place = F.floor(F.col("pos") / size), F.col("pos") % size
    targets = [own]
    if before:
        targets.append(F.when(place >= size - before, own + 1))
    if after:
        targets.append(F.when((place < after) & (own > 0), own - 1))
    return rows.withColumn("chunk", F.explode(F.array_compact(F.array(*targets)))).withColumn("core", F.col("chunk") == own)


def known_around(rows: DataFrame, key: str, idx: str, column: str, size: int = 1 << 16) -> DataFrame:
    """Adds before and after: (value, at) of the nearest known values of a column at or before, and at or after, each row; null where there is none.

    Rows are looked through inside stretches of ``size`` positions; what a stretch doesn't hold comes from the first or last known value of
    the stretches beside it, one row each.
    """
    rows = rows.withColumn("_s", F.floor(F.col(idx) / size))
    item = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("value"), F.col(idx).alias("at")))
    w = Window.partitionBy(key, "_s").orderBy(idx)
    rows = rows.withColumn("_i", item).withColumns({"_b": F.last("_i", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_a": F.first("_i", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    ends = rows.groupBy(key, "_s").agg(F.max_by("_i", F.when(F.col("_i").isNotNull(), F.col(idx))).alias("_l"), F.min_by("_i", F.when(F.col("_i").isNotNull(), F.col(idx))).alias("_f"))
    over = Window.partitionBy(key).orderBy("_s")
    ends = ends.select(key, "_s", F.last("_l", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_p"), F.first("_f", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_n"))
    return rows.join(ends, [key, "_s"]).withColumns({"before": F.coalesce("_b", "_p"), "after": F.coalesce("_a", "_n")}).drop("_s", "_i", "_b", "_a", "_p", "_n")


def in_chunk(series: str = "series_id") -> Window:
    return Window.partitionBy(series, "chunk").orderBy("pos")


def framed(rows: DataFrame, columns: dict[str, Column], before: int = 0, after: int = 0, size: int = 1 << 16) -> DataFrame:
    """Adds columns made of bounded window expressions over ``in_chunk()``."""
    return chunked(rows, before, after, size).withColumns(columns).filter("core").drop("chunk", "core")
