"""Samples that repeat: rows are ordered by a hash, never by chance. A limit here is the feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int) -> Column:
    """A fixed order that other engines can compute too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def stratified(df: DataFrame, stratum: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """Of each stratum min(n, max(1, round(n · size / total))) rows, rounded half to even."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))  # one row
    wanted = sizes.join(F.broadcast(total)).select(
        stratum, F.least("_n", F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(size) / F.col("_total"), 0).cast("long"))).alias("_k")
    )
    most = int(size) + 1
    # No stratum is given more than `size` + 1 rows, so a top-k by hash is enough before the exact cut.
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key))).where(F.col("_r") <= most)
    return ranked.join(wanted, stratum).where(F.col("_r") <= F.col("_k")).drop("_r", "_k")


def sources(nodes: DataFrame, key: str, k: int, seed: int = 7) -> DataFrame:
    """k nodes without replacement."""
    return nodes.orderBy(hash_order(F.col(key), seed), key).limit(k)


def stochastic_counts(df: DataFrame, share: Column, total: int, key: Column, seed: int = 0) -> DataFrame:
    """df with particles: floor(share · total + u), u fixed in [0, 1) by the key, so the expected sum is total."""
    u = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("particles", F.floor(share * total + u))
