"""Session helpers: shipping the package to executors, shared scratch tables, lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_shipped: set[str] = set()
_local: dict[str, str] = {}


#: Rows of an Arrow batch at most: texts of several kB each must fit in a task's share of memory, on both sides of the pipe.
ARROW_ROWS = 1500


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of every executor, once per application, and bound Arrow batches of texts.

    The bound is a setting of the session: Spark reads it when a plan runs, after this function has returned. A smaller one stays.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="pastcast-"), f"pastcast-{uuid.uuid4().hex[:8]}")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))


def scratch(spark: SparkSession) -> str:
    """A new folder below this application's own in ``spark.checkpoint.dir``.

    Where that is unset, the warehouse of the cluster is the shared folder, unless it is a folder of one machine, which is an error; a local
    master, with one machine, uses a temporary one.
    """
    base, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base and sc.master.startswith("local"):
        base = _local.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    elif not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is a local one")
    return f"{base.rstrip('/')}/pastcast/{sc.applicationId}/{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Deletes what this application has stored; for the end of a job, since DataFrames made before may read it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(scratch(spark)))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, *keys: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    (df.repartition(*keys) if keys else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``stored``, for small tables of iterative jobs: read back, a table has its real size.

    ``checkpoint()`` keeps the estimate, which a join makes the product of its sides: in a loop its digits double each round until no driver holds them.
    """
    return stored(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of df and further fields given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
