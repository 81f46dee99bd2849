"""Running sums over a whole table, and tables written between the steps of a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.store import plan_bytes, stage

#: Estimated bytes up to which a running sum may take place in one task.
SMALL = 64 << 20


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: the plan of a loop must not grow with its rounds."""
    return stage(df, "kept")


def running_sum(df: DataFrame, order: list[Column], weight: Column, out: str, small: int = SMALL) -> DataFrame:
    """df with `out`: the sum of weight over all rows up to this one in the given order, which should have no ties.

    A table that is small by estimate is summed in one task. Beyond that, rows are dealt by range, each range's sum
    gives the next one's offset, and rows are summed within their range; no task holds more than a range.
    """
    if plan_bytes(df) <= small:
        return df.withColumn(out, F.sum(weight).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.withColumn("_w", weight).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum("_w").alias("_total"))  # a row for each range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.withColumn("_sum", F.sum("_w").over(within)).join(offsets, "_range")
    return joined.withColumn(out, F.col("_sum") + F.col("_offset")).drop("_w", "_range", "_sum", "_offset")
