"""Events, questions, storm tracks and competition series from JSON and text files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "event_id string, timestamp string, event_type string, title string, description string, source string, tags array<string>, metadata map<string,string>, impact map<string,string>"
QUESTION = "questions array<struct<question_id:string,question:string,category:string,source:string,resolution_date:string,resolved:boolean,resolution:boolean,prices:array<struct<timestamp:string,probability:double,volume:double>>>>"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a file with one event per line, blank lines skipped, or (``.json``) of one series document; missing fields are null."""
    if path.endswith(".json"):
        doc = spark.read.json(path, schema=f"name string, version string, events array<struct<{_fields(EVENT)}>>", multiLine=True)
        return doc.select(F.explode("events").alias("e")).select("e.*")
    return spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", EVENT).alias("e")).select("e.*")


def _fields(ddl: str) -> str:
    return ddl.replace(" array<string>", ":array<string>").replace(" map<string,string>", ":map<string,string>").replace(" string", ":string")


def write_events(events: DataFrame, path: str) -> None:
    """One event per line."""
    events.write.json(path)


def resumed(work: DataFrame, path: str, keys: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs the work (keys, ...) that has no result yet in the JSON lines under path, appends the results there, and returns all of them."""
    spark = work.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    schema = run(work).schema
    left = work.join(spark.read.schema(schema).json(path).select(*keys).distinct(), keys, "left_anti") if known else work
    run(left).write.mode("append").json(path)
    return spark.read.schema(schema).json(path)


LEDGER = "run_id string, timestamp string, benchmark_id string, lane_id string, status string, decision string, metrics_after map<string,double>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a ledger with one JSON object per line, with the line's place; blank and malformed lines are skipped, missing fields are null."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    read = F.from_json("value", f"{LEDGER}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(read.alias("e"), "line").filter("e is not null and e._bad is null").select("e.*", "line").drop("_bad")


def latest_runs(entries: DataFrame) -> DataFrame:
    """(lane_id, entries, run_id, timestamp, status): how many entries each lane has and its latest one by timestamp, the later line of equal ones."""
    last = F.max_by(F.struct("run_id", "timestamp", "status"), F.struct(F.coalesce("timestamp", F.lit("")), "line"))
    return entries.groupBy("lane_id").agg(F.count("*").alias("entries"), last.alias("e")).select("lane_id", "entries", "e.*")


def compared_runs(entries: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, a, b, delta): the metrics of two runs, each as its last line says, with the difference where both have one. LookupError for a run without a line."""

    def side(run: str, name: str) -> DataFrame:
        row = entries.filter(F.col("run_id") == run).agg(F.count("*").alias("n"), F.max_by("metrics_after", "line").alias("m"))
        if not row.first().n:
            raise LookupError(f"run_id not found: {run}")
        return row.select(F.explode("m").alias("metric", name))

    return side(a, "a").join(side(b, "b"), "metric", "full_outer").withColumn("delta", F.col("b") - F.col("a"))


def event_problems(events: DataFrame, order: str, now: Column) -> DataFrame:
    """(event_id, place, problem) rows: empty required fields, stamps that are no time or more than a day ahead, repeated ids with their first place.

    ``order`` is the column with an event's place.
    """
    rows = events.withColumn("_t", F.expr("try_to_timestamp(timestamp)"))
    first = rows.groupBy("event_id").agg(F.min(order).alias("_first"))
    rows = rows.join(first, rows.event_id.eqNullSafe(first.event_id), "left").drop(first.event_id)
    blank = lambda c: F.when(F.col(c).isNull() | (F.trim(c) == ""), F.lit(f"empty {c}"))
    stamped = F.col("timestamp").isNotNull() & (F.trim("timestamp") != "")
    checks = [blank(c) for c in ("event_id", "timestamp", "event_type", "title")] + [
        F.when(stamped & F.col("_t").isNull(), "bad timestamp"), F.when(F.col("_t") > now + F.expr("interval 1 day"), "in the future"),
        F.when(F.col("_first") < F.col(order), F.concat(F.lit("same id as "), F.col("_first").cast("string"))),
    ]
    return rows.select("event_id", F.col(order).alias("place"), F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions, and their prices placed in time order."""
    q = spark.read.json(path, schema=QUESTION, multiLine=True).select(F.explode("questions").alias("q")).select("q.*")
    prices = q.select("question_id", F.explode("prices").alias("p")).select("question_id", "p.*")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("timestamp")) - 1
    return q.drop("prices"), prices.withColumn("place", place)


def question_summary(questions: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: counts, the Brier score of resolved questions by their last price, sorted categories and sources."""
    last = prices.groupBy("question_id").agg(F.max_by("probability", "timestamp").alias("p"))
    rows = questions.join(last, "question_id", "left")
    brier = F.when(F.col("resolved") & F.col("resolution").isNotNull(), (F.col("p") - F.col("resolution").cast("double")) ** 2)
    return rows.agg(F.count("*").alias("questions"), F.count_if("resolved").alias("resolved"), F.avg(brier).alias("brier"), F.sort_array(F.collect_set("category")).alias("categories"), F.sort_array(F.collect_set("source")).alias("sources"))


def read_tracks(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(storm_id, name, year, fix_idx, datetime_utc, lat, lon, max_wind_kt, min_pressure_mb, status) of best-track files.

    A header line (id, name, rows) is followed by its fix lines. Hemisphere letters give the sign, negative numbers are missing;
    storms with fewer than ``least`` winds are left out. One row per file is split, so a file is one task's work.
    """
    lines = spark.read.text(path, wholetext=True).select(F.xxhash64("value").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).filter(F.trim("line") != "")
    part = F.transform(F.split("line", ","), lambda x: F.trim(x))
    lines = lines.withColumn("f", part).withColumn("head", F.regexp_like(F.get("f", F.lit(0)), F.lit("^[A-Z]{2}[0-9]{6}$")))
    w = Window.partitionBy("file").orderBy("at")
    up = lambda k: F.last(F.when(F.col("head"), F.get("f", F.lit(k))), ignorenulls=True).over(w)
    lines = lines.withColumns({"storm_id": up(0), "name": up(1), "start": F.last(F.when(F.col("head"), F.col("at")), ignorenulls=True).over(w)}).filter("not head and storm_id is not null")
    get = lambda k: F.get("f", F.lit(k))
    degree = lambda k: F.expr(f"try_cast(substring(f[{k}], 1, length(f[{k}]) - 1) as double)") * F.when(F.substring(get(k), -1, 1).isin("S", "W"), -1).otherwise(1)
    number = lambda k: F.expr(f"try_cast(f[{k}] as double)")
    out = lines.select(
        "storm_id", "name", F.substring("storm_id", 5, 4).cast("int").alias("year"), (F.col("at") - F.col("start") - 1).alias("fix_idx"), F.try_to_timestamp(F.concat(get(0), get(1)), F.lit("yyyyMMddHHmm")).alias("datetime_utc"),
        degree(4).alias("lat"), degree(5).alias("lon"), F.when(number(6) >= 0, number(6)).alias("max_wind_kt"), F.when(number(7) >= 0, number(7)).alias("min_pressure_mb"), get(3).alias("status"),
    )
    enough = out.groupBy("storm_id").agg(F.count("max_wind_kt").alias("n")).filter(F.col("n") >= least)
    return out.join(enough, "storm_id", "left_semi")


def read_wide(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """(series_id, pos, value) of lines id, v1, v2, ... (commas) or id:...:v1,v2 (tsf); series that are short, constant or hold what is no number are left out."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith("@"))
    tsf = F.contains("value", F.lit(":"))
    parts = F.split("value", ":")
    values = F.when(tsf, F.split(F.element_at(parts, -1), ",")).otherwise(F.slice(F.split("value", ","), 2, 1 << 30))
    rows = lines.select(F.trim(F.regexp_replace(F.when(tsf, F.get(parts, F.lit(0))).otherwise(F.substring_index("value", ",", 1)), '"', "")).alias("series_id"), F.filter(F.transform(values, lambda x: F.trim(F.regexp_replace(x, '"', ""))), lambda x: x != "").alias("v"))
    rows = rows.withColumn("x", F.transform("v", lambda x: x.try_cast("double")))
    good = (F.size("x") >= least) & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.array_min("x") < F.array_max("x"))
    return rows.filter(good).select("series_id", F.posexplode("x").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def held_back(rows: DataFrame, last: int = 56) -> DataFrame:
    """Adds test: whether a point is among the last of its series."""
    end = rows.groupBy("series_id").agg(F.max("pos").alias("_e"))
    return rows.join(end, "series_id").withColumn("test", F.col("pos") > F.col("_e") - last).drop("_e")
