"""Dataset files ``{asset_class}/{symbol}/{timeframe}.parquet`` below a root: one view over all, and writing them.

A dataset is a Parquet file, or a folder of Parquet files as Spark writes it. Its columns of the path come from the files' metadata,
so a filter on them already leaves files out of the listing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pastcast.sources.bars import DATASET

#: Schema of a root without datasets.
BARS = "timestamp timestamp_ntz, open double, high double, low double, close double, volume double"
_DATASET_PATH = r"^[^/]+(?<!\.parquet)/[^/]+(?<!\.parquet)/[^/]+\.parquet(/part-[^/]+)?$"


def _path(spark: SparkSession, root: str):
    """(Hadoop path, its file system)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(path), fs


def _below(root: str) -> Column:
    """The path of a row's file relative to the root, both given as URIs."""
    bare = lambda c: F.regexp_replace(c, "^[A-Za-z0-9+.-]+:/*", "")
    start = len(root.split(":", 1)[-1].lstrip("/").rstrip("/")) + 1 if ":" in root else len(root.lstrip("/").rstrip("/")) + 1
    return F.substr(bare(F.col("_metadata.file_path")), F.lit(start + 1))


def _name(part: Column) -> Column:
    """A name from a part of a URI, then from Spark's escapes of partition values."""
    plain = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    once = F.coalesce(plain(part), part)
    return F.coalesce(plain(once), once)


def datasets(spark: SparkSession, root: str, schema: str | StructType | None = None) -> DataFrame:
    """Rows of all dataset files below root with asset_class, symbol and timeframe; files at other depths are skipped.

    The schemas of all files are merged, columns that a file lacks are null; a given schema saves reading every footer. A column of a file
    that has the name of a path column gives way to it. A root without datasets gives an empty table of bars.
    """
    path, fs = _path(spark, root)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    at = path.toUri().toString()
    empty = spark.createDataFrame([], f"{BARS}, asset_class string, symbol string, timeframe string")
    if not fs.exists(path) or not _any_dataset(spark, fs, path):
        return empty
    rows = reader.schema(schema).parquet(root) if schema else reader.option("mergeSchema", "true").parquet(root)
    below = _below(at)
    parts = F.split(F.regexp_replace(below, r"\.parquet(/part-[^/]+)?$", ""), "/")
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in DATASET]
    return rows.filter(below.rlike(_DATASET_PATH)).select(*keep, *[_name(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(DATASET)])


def _any_dataset(spark: SparkSession, fs, root) -> bool:
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "*/*/*.parquet"))
    return found is not None and len(found) > 0


def register(spark: SparkSession, root: str, view: str = "ohlcv", schema: str | StructType | None = None) -> DataFrame:
    """The datasets below root as a temporary view; also returned."""
    out = datasets(spark, root, schema)
    out.createOrReplaceTempView(view)
    return out


def write(bars: DataFrame, root: str) -> None:
    """Writes every dataset of bars (asset_class, symbol, timeframe, ...) to its place below root; one that is there is replaced, others stay.

    One job writes all below a hidden folder of the root; then each dataset's folder is moved to its place.
    """
    spark = bars.sparkSession
    path, fs = _path(spark, root)
    make = spark._jvm.org.apache.hadoop.fs.Path
    staged = make(path, f"_staged-{uuid.uuid4().hex}")
    bars.write.partitionBy(*DATASET).parquet(staged.toString())
    for status in fs.globStatus(make(staged, "asset_class=*/symbol=*/timeframe=*")) or []:
        done = status.getPath()
        a, s, t = (p.getName().split("=", 1)[1] for p in (done.getParent().getParent(), done.getParent(), done))
        target = make(path, f"{a}/{s}/{t}.parquet")
        fs.mkdirs(target.getParent())
        fs.delete(target, True)
        fs.rename(done, target)
    fs.delete(staged, True)
