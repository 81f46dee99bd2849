"""The quarter-hour binning as Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.store import shared_dir


def windowed(stream: DataFrame, ts: str, dim: str, width: str = "15 minutes", late: str = "1 day") -> DataFrame:
    """dim, start, n: counts in tumbling windows. In append and update mode the watermark bounds the state; complete mode keeps all."""
    at = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    counts = at.groupBy(F.window("_at", width).alias("w"), dim).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(dim, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def _opened(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a folder of Parquet files, or over one file: its folder with a filter, as a stream reads folders."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def counted(spark: SparkSession, path: str, ts: str, dim: str) -> DataFrame:
    """All of a Parquet path through the stream once, into a Parquet table in the shared folder.

    The stream ends with the data (availableNow). Rows may come in any order over all time, so nothing may count as
    late: the query runs in complete mode, whose state is one row for each window and value.
    """
    out = f"{shared_dir(spark)}/quarters-{uuid.uuid4().hex}"
    source = _opened(spark, path)

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table")

    query = windowed(source, ts, dim).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/table")
