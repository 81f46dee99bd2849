"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one for a local session and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: executors have no folder in common")
        path = "file://" + tempfile.mkdtemp(prefix="tramline-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    keep(spark, path)
    return path


def keep(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends."""
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))


def scratch_count() -> int:
    return len(_made)


def drop_since(count: int) -> None:
    """Delete the folders that were made since scratch_count() was `count`."""
    own = _made[count:]
    for spark, path in own:
        delete(spark, path)
    del _made[count : count + len(own)]


def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            delete(spark, path)


def _found(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whatever store it is."""
    where, store = _found(spark, path)
    store.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its store."""
    where, store = _found(spark, path)
    return store.exists(where)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: it cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size: for a scan, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Parts:
    """A table that grows by parts: each is written once, and the whole is one scan however many there are."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, scratch(spark, name), 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write a part and read it again."""
        self.schema = df.schema
        own = f"{self.path}/part={self.count}"
        df.write.parquet(own)
        self.count += 1
        return self.spark.read.schema(df.schema).parquet(own)

    def all(self) -> DataFrame:
        columns = [f.name for f in self.schema]
        return self.spark.read.schema(self.schema).parquet(self.path).select(*columns)
