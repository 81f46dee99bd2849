"""Corridors: street segments of one name, compared across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.bins import log2_ratio


def weighted(segments: DataFrame, group: str, value: str, length: str, prefix: str) -> DataFrame:
    """group, prefix_n, prefix_len, prefix_mean (length-weighted), prefix_vkm (value times length in thousands)."""
    product = F.sum(F.col(value) * F.col(length))
    return segments.groupBy(group).agg(
        F.count(F.lit(1)).alias(f"{prefix}_n"), F.sum(length).alias(f"{prefix}_len"),
        F.try_divide(product, F.nullif(F.sum(length), F.lit(0.0))).alias(f"{prefix}_mean"), (product / 1000).alias(f"{prefix}_vkm"),
    )


def with_shares(table: DataFrame, values: list[str]) -> DataFrame:
    """table with v_share: each value in thousandths of its total; totals are one row, computed before, not a global window."""
    totals = table.agg(*[F.sum(v).alias(f"_{v}") for v in values])  # one row
    shares = {f"{v}_share": F.try_divide(F.col(v) * 1000, F.nullif(F.col(f"_{v}"), F.lit(0.0))) for v in values}
    return table.join(F.broadcast(totals)).withColumns(shares).drop(*[f"_{v}" for v in values])


def compare(model: DataFrame, observed: DataFrame, counts: DataFrame, group: str, shortest: Column) -> DataFrame:
    """Corridors in both model and observed, counts where there are any, filtered by `shortest`, then shares and their ratio.

    The filter comes before the shares, which are of what is left.
    """
    table = model.join(observed, group).join(counts, group, "left").where(shortest)
    table = with_shares(table, ["model_vkm", "observed_vkm"])
    return table.withColumn("log2_ratio", log2_ratio(F.col("model_vkm_share"), F.col("observed_vkm_share")))


def well_observed(table: DataFrame, crossings: str, least: float) -> DataFrame:
    return table.withColumn("well_observed", F.col(crossings) >= least)


def top(table: DataFrame, by: Column, n: int, *ties: str) -> DataFrame:
    """The first n rows by a descending column; ties by the given columns."""
    return table.orderBy(by.desc(), *ties).limit(n)


def verdict(ratio: Column, band: float = 1.0) -> Column:
    return F.when(ratio.isNull(), "unknown").when(ratio > band, "model higher").when(ratio < -band, "observed higher").otherwise("agree")


def split_connected(members: DataFrame, parts: DataFrame, group: str) -> DataFrame:
    """Corridor members with the component that a junction graph gives them, as corridors of their own."""
    return members.join(parts, "node", "left").withColumn(group, F.concat_ws("#", F.col(group), F.col("component")))


def modal(samples: DataFrame, key: str, name: str) -> DataFrame:
    """key, name, n: the most frequent name, the larger of two."""
    votes = samples.groupBy(key, name).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col(name).desc())
    return votes.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")
