"""OHLCV bars: canonical form, upserts, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastcast.session import stored

DATASET = ["asset_class", "symbol", "timeframe"]
_PRICES = ["open", "high", "low", "close"]


def canonical(raw: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """Lower-case names, the last arrival of each timestamp, then doubles; rows with a bad price go, a bad or missing volume is 0.

    Deduplication precedes the coercion: a bad last duplicate removes its timestamp. Raises KeyError for missing columns.
    """
    df = raw.toDF(*[c.lower() for c in raw.columns])
    missing = [c for c in ["timestamp", *_PRICES] if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    if "volume" not in df.columns:
        df = df.withColumn("volume", F.lit(0.0))
    stamp = F.expr("try_cast(timestamp as timestamp_ntz)")
    df = df.withColumn("timestamp", stamp).filter("timestamp is not null")
    last = Window.partitionBy(*keys, "timestamp").orderBy(*[F.col(c).desc() for c in arrival])
    df = df.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
    number = lambda c: F.expr(f"try_cast({c} as double)")
    df = df.withColumns({c: number(c) for c in _PRICES} | {"volume": F.coalesce(number("volume"), F.lit(0.0))})
    return df.dropna(subset=_PRICES)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing bars, then new ones; a new bar replaces one with its keys and timestamp."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return canonical(both, keys, ["_src"]).drop("_src")


#: Datasets of a batch up to which their folders are named in the plan.
MOST_FOLDERS = 1000


class BarStore:
    """Bars under a path, upserted batch by batch: only the datasets that a batch touches are written anew, the files of others stay.

    ``data/version=n`` holds what commit n wrote; ``commits/version=n`` names the version of every dataset and each writer's last batch, and
    counts once its job has ended (its success mark is the last thing written). A run that fails before leaves the table as it was; a new
    process finds the same table, and a batch that is delivered again is left out. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], writer: str = "default") -> None:
        self.spark, self.path, self.keys, self.writer = spark, path.rstrip("/"), keys, writer

    def version(self) -> int:
        """The last commit, -1 without one."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/version=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=-1)

    def _commit(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/commits/version={version}")

    def last_batch(self) -> int:
        """The last batch of this writer, -1 without one."""
        version = self.version()
        row = self._commit(version).filter((F.col("kind") == "writer") & (F.col("writer") == self.writer)).first() if version >= 0 else None
        return row["at"] if row else -1

    def _rows(self, placed: DataFrame, only: list | None = None) -> DataFrame | None:
        """Bars of the datasets in placed (keys, at); only: rows of keys to which they may be restricted, to open no other folder."""
        versions = sorted(r["at"] for r in placed.select("at").distinct().collect())  # at most one per commit whose data are still in use
        if not versions:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", "true").parquet(*[f"{self.path}/data/version={v}" for v in versions])
        for k in self.keys if only is not None else []:
            rows = rows.filter(F.col(f"in_{k}").cast("string").isin(sorted({r[k] for r in only})))
        mine = placed.select(*self.keys, F.col("at").alias("version"))
        return rows.drop(*[f"in_{k}" for k in self.keys]).join(mine, [*self.keys, "version"], "left_semi").drop("version")

    def read(self) -> DataFrame | None:
        """The bars of the last commit; None before the first."""
        version = self.version()
        return self._rows(self._commit(version).filter("kind = 'dataset'")) if version >= 0 else None

    def upsert(self, batch: DataFrame, batch_id: int | None = None) -> bool:
        """Adds a batch; the last arrival of a timestamp wins, rows with a null key are left out. False, and nothing done, for a batch id that this writer has committed."""
        version = self.version()
        before = self.last_batch()
        if batch_id is not None and batch_id <= before:
            return False
        batch = stored(batch.toDF(*[c.lower() for c in batch.columns]).withColumns({k: F.col(k).cast("string") for k in self.keys}).dropna(subset=self.keys))
        touched = batch.select(*self.keys).distinct()
        some = touched.limit(MOST_FOLDERS + 1).collect()
        old = self._commit(version) if version >= 0 else None
        placed = old.filter("kind = 'dataset'").drop("kind", "writer") if old is not None else None
        held = self._rows(placed.join(touched, self.keys, "left_semi"), some if len(some) <= MOST_FOLDERS else None) if placed is not None else None
        rows = upsert(held, batch, self.keys) if held is not None else canonical(batch.withColumn("_src", F.lit(1)), self.keys, ["_src"]).drop("_src")
        new = version + 1
        rows.withColumns({f"in_{k}": F.col(k) for k in self.keys}).write.mode("overwrite").partitionBy(*[f"in_{k}" for k in self.keys]).parquet(f"{self.path}/data/version={new}")
        entries = touched.withColumn("at", F.lit(new).cast("long"))
        if placed is not None:
            entries = entries.unionByName(placed.join(touched, self.keys, "left_anti"))
        entries = entries.withColumns({"kind": F.lit("dataset"), "writer": F.lit(None).cast("string")})
        mine = self.spark.createDataFrame([("writer", self.writer, int(batch_id if batch_id is not None else before))], "kind string, writer string, at long")
        if old is not None:
            mine = mine.unionByName(old.filter((F.col("kind") == "writer") & (F.col("writer") != self.writer)).select("kind", "writer", "at"))
        entries.unionByName(mine, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.path}/commits/version={new}")
        return True


def manifest(bars: DataFrame, updated_at: str, source: str = "upload") -> DataFrame:
    """One row per dataset: first and last timestamp, row count, last update."""
    return bars.groupBy(*DATASET).agg(F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp"), F.count("*").alias("row_count")).withColumns({"source": F.lit(source), "last_updated_at": F.lit(updated_at).cast("timestamp_ntz")})


def replace_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows without a new row of the same key, and the new rows."""
    key = [*DATASET, "source"]
    return old.join(new, key, "left_anti").unionByName(new)
