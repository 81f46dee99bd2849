"""Queries behind an interactive map: each takes the state as parameters and returns a lazy frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.bins import per_lane, with_poisson
from tramline.operators.stats import lower_quantile


def chosen(filters: Mapping[str, Sequence[str]], plausible_only: bool = False) -> Column:
    """All dimensions within their sets; an empty set lets nothing through."""
    ok = F.col("plausible") if plausible_only else F.lit(True)
    for column, values in filters.items():
        ok = ok & (F.col(column).isin(list(values)) if values else F.lit(False))
    return ok


def grouped(trips: DataFrame, dimension: str, on: Sequence[str], filters: Mapping[str, Sequence[str]], plausible_only: bool = False) -> DataFrame:
    """dimension, active (trips that pass the filters), shown (those if the category is on)."""
    rows = trips.where(chosen(filters, plausible_only))
    is_on = F.col(dimension).isin(list(on)) if on else F.lit(False)
    return rows.groupBy(dimension).agg(F.count(F.lit(1)).alias("active"), F.count_if(is_on).alias("shown"))


def volumes(cube: DataFrame, segment: str, on: Sequence[str], bin: int | None = None) -> DataFrame:
    """segment, n: the day's volume, or that of one bin, of the modes that are on."""
    rows = cube.where(F.col("mode").isin(list(on)) if on else F.lit(False))
    if bin is not None:
        rows = rows.where(F.col("bin") == bin)
    return rows.groupBy(segment).agg(F.sum("trips").alias("n")).where("n > 0")


def share_lens(rows: DataFrame, segment: str, picks: Mapping[str, Sequence[str]], least: int = 50, scale: float = 1.3) -> DataFrame | None:
    """segment, total, share, lens = log2(share / city share) / scale, on segments of at least `least`.

    Only if exactly one dimension is narrowed, to exactly one value; otherwise there is no lens (None).
    """
    narrowed = {d: v for d, v in picks.items() if v}
    if len(narrowed) != 1 or len(next(iter(narrowed.values()))) != 1:
        return None
    (dimension, (value,)) = next(iter(narrowed.items()))
    hit = F.count_if(F.col(dimension) == value)
    own = rows.groupBy(segment).agg(F.count(F.lit(1)).alias("total"), hit.alias("hits"))
    city = own.agg(F.sum("total").alias("_t"), F.sum("hits").alias("_h"))  # one row
    joined = own.join(F.broadcast(city)).where(F.col("total") >= least)
    share = F.col("hits") / F.col("total")
    lens = F.log2(F.greatest(share, F.lit(1e-6)) / F.greatest(F.try_divide(F.col("_h"), F.nullif(F.col("_t"), F.lit(0))), F.lit(1e-6))) / scale
    return joined.select(segment, "total", share.alias("share"), lens.alias("lens"))


def lane_reference(roads: DataFrame, count: str, lanes: str, q: float = 0.95) -> DataFrame:
    """One row: the lower-index quantile of counts per lane."""
    return lower_quantile(roads.withColumn("_l", per_lane(F.col(count), F.col(lanes))), "_l", q)


def heat(cells: DataFrame, weight: str, reach: int = 1) -> DataFrame:
    """ix, iy, heat: each cell's weight spread over its neighbours, halved for each step away."""
    steps = [(i, j, 0.5 ** max(abs(i), abs(j))) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    kernel = F.array(*[F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy"), (F.col(weight) * w).alias("w")) for i, j, w in steps])
    return cells.select(F.inline(kernel)).groupBy("ix", "iy").agg(F.sum("w").alias("heat"))


def tooltip(street: DataFrame, cube: DataFrame, segment: str, key) -> DataFrame:
    """One street's row and its day volume by mode, as a map."""
    one = cube.where(F.col(segment) == key).groupBy("mode").agg(F.sum("trips").alias("n"))
    modes = one.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "n")))).alias("by_mode"))
    return street.where(F.col(segment) == key).join(F.broadcast(modes))  # one row


def road_tooltip(roads: DataFrame, key: str, value, count: str, names: DataFrame, thin: int = 5) -> DataFrame:
    """One road's count with its 95 % interval, whether it is too small to tell, counts at both ends of the sweep, crossings
    per lane, slow index, and the road database's fields.

    roads: key, the count, c0, c8, lanes, slow_index. names: key and the fields.
    """
    one = with_poisson(roads.where(F.col(key) == value).withColumn("k", F.col(count).cast("long")), "k")
    lane = F.when(F.col("lanes") >= 1, F.col("k") / F.col("lanes"))
    shown = one.select(key, "k", "lo95", "hi95", (F.col("k") < thin).alias("thin"), "c0", "c8", "lanes", lane.alias("per_lane"), "slow_index")
    return shown.join(names.where(F.col(key) == value), key, "left")


def legend(df: DataFrame, layers: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows each layer shows."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in layers.items()])
