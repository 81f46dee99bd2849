"""Snapping points and lines to a network.

All pairs within a radius come from an equi-join on grid cells as wide as the radius: network points stay in their
cell, probes look into theirs and the eight around it. Nothing is broadcast and nothing compared beyond
neighbouring cells; a crowded cell is an ordinary skewed key, which AQE splits.

The nearest point, and the busiest, need no pairs. Probes of a place are asked once, network points of a place count once.
Both are dealt by tiles of four tolerances, points near a border to each tile that it may concern, and tiles by buckets;
a bucket is searched on numpy arrays. The nearest is sought in grids of doubling cells, from about two points a cell on:
whoever finds one no farther than a cell is done. The busiest is sought in blocks of falling values, of doubling size:
whoever finds one is done. So work and what is shuffled are about linear in the rows, however crowded a place is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.functions.geo import hypot
from tramline.operators.prefix import kept
from tramline.store import Parts


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


def within(probes: DataFrame, network: DataFrame, radius: float, strict: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """All pairs of probes and network points (x, y of the network as nx, ny) no farther apart than radius, with distance."""
    net = network.withColumnsRenamed({x: "nx", y: "ny"}).withColumns({"_cx": _cell(F.col("nx"), radius), "_cy": _cell(F.col("ny"), radius)})
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = probes.withColumn("_o", around).withColumns({"_cx": _cell(F.col(x), radius) + F.col("_o.i"), "_cy": _cell(F.col(y), radius) + F.col("_o.j")}).drop("_o")
    joined = near.join(net, ["_cx", "_cy"]).withColumn("distance", hypot(F.col(x) - F.col("nx"), F.col(y) - F.col("ny"))).drop("_cx", "_cy")
    return joined.where(F.col("distance") < radius if strict else F.col("distance") <= radius)


def spread(probes: DataFrame, keys: list[str]) -> DataFrame:
    """probes dealt by their keys over all tasks.

    Few bytes of probes can make many pairs, which the size of the input does not tell the planner; and what is
    grouped by the probe after a broadcast join is then where it belongs already.
    """
    return probes.repartition(int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Width of a tile in tolerances, buckets for each shuffle partition, pairs that are compared at a time, points of the first block.
TILE, BUCKETS, PAIRS, BLOCK = 4, 4, 1 << 21, 64
#: By what share of a cell rounding may misplace a point; cells are at least FINEST of the coordinates wide, so it never does by more.
SLACK, FINEST = 1e-6, 1e-9


def _ranks(columns: list[pa.Array]) -> np.ndarray:
    """Numbers that stand in Spark's order of the rows of some columns: nulls first, NaN last."""
    keys = []
    for c in columns:
        if pa.types.is_floating(c.type):
            rank = np.unique(pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False), return_inverse=True)[1] + 1
            keys.append(np.where(pc.is_null(c).to_numpy(zero_copy_only=False), 0, rank))
        else:
            keys.append(pc.rank(c, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64))
    order = np.lexsort(keys[::-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


class _Grid:
    """Points by square cells, sorted so that the cells above one another are a range."""

    def __init__(self, x: np.ndarray, y: np.ndarray, size: float):
        cx, cy = np.floor(x / size), np.floor(y / size)
        self.size, self.columns = size, np.unique(cx)
        self.low, self.span = cy.min(), cy.max() - cy.min() + 1
        key = np.searchsorted(self.columns, cx) * self.span + (cy - self.low)
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def crowd(self) -> int:
        """Points of the fullest cell."""
        return int(np.unique(self.key, return_counts=True)[1].max())

    def near(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of probes, where the pairs of each begin, and the points of their cell and the eight around it; some PAIRS at a time."""
        cx, cy = np.floor(x / self.size), np.floor(y / self.size)
        bottom, top = np.clip(cy - 1 - self.low, 0, self.span), np.clip(cy + 1 - self.low, -1, self.span - 1)
        for side in (-1, 0, 1):
            at = np.searchsorted(self.columns, cx + side)
            there = np.flatnonzero(self.columns[np.minimum(at, len(self.columns) - 1)] == cx + side)
            first = np.searchsorted(self.key, at[there] * self.span + bottom[there], "left")
            n = np.searchsorted(self.key, at[there] * self.span + top[there], "right") - first
            there, first, n = there[n > 0], first[n > 0], n[n > 0]
            ends = np.cumsum(n)
            begin = 0
            while begin < len(n):
                before = ends[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
                some = n[begin:stop]
                starts = ends[begin:stop] - some - before
                points = np.arange(some.sum()) + np.repeat(first[begin:stop] - starts, some)
                yield there[begin:stop], starts, self.order[points]
                begin = stop


def _nearest(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, rank: np.ndarray, reach: float, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """The least distance of each probe, and its point, of equally near ones that of the least rank; -1 where none is within reach."""
    distance, best = np.full(len(x), np.inf), np.full(len(x), -1, np.int64)
    point = np.argsort(rank)
    # A little wider than the reach, so that rounding keeps no point out of the cells around.
    size = reach * (1 + SLACK)
    level = int(np.ceil(np.log2(max(1, _Grid(nx, ny, size).crowd() / 2)) / 2))
    widest = max(np.abs(nx).max(), np.abs(ny).max(), size)
    left = np.arange(len(x))
    for k in range(max(0, min(level, int(np.log2(size / (widest * FINEST))))), -1, -1):
        grid = _Grid(nx, ny, size / 2**k)
        found, least = np.full(len(left), np.inf), np.full(len(left), len(rank), np.int64)
        for who, starts, points in grid.near(x[left], y[left]):
            n = np.diff(np.append(starts, len(points)))
            dx, dy = np.repeat(x[left[who]], n) - nx[points], np.repeat(y[left[who]], n) - ny[points]
            d = np.sqrt(dx * dx + dy * dy)
            d0 = np.minimum.reduceat(d, starts)
            r0 = np.minimum.reduceat(np.where(d == np.repeat(d0, n), rank[points], len(rank)), starts)
            least[who] = np.where(d0 < found[who], r0, np.where(d0 == found[who], np.minimum(r0, least[who]), least[who]))
            found[who] = np.minimum(found[who], d0)
        done = found <= grid.size * (1 - SLACK) if k else (found < reach if strict else found <= reach)
        distance[left[done]], best[left[done]] = found[done], point[least[done]]
        left = left[~done]
    return distance, best


def _busiest(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, rank: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The distance and the point of the greatest rank within reach of each probe; -1 where there is none."""
    distance, best = np.full(len(x), np.inf), np.full(len(x), -1, np.int64)
    falling = np.argsort(-rank)
    left, begin, n = np.arange(len(x)), 0, BLOCK
    while begin < len(falling) and len(left):
        block = falling[begin : begin + n]
        bx, by, br = nx[block], ny[block], rank[block]
        most = np.full(len(left), -1, np.int64)
        for who, starts, points in _Grid(bx, by, reach * (1 + SLACK)).near(x[left], y[left]):
            n_of = np.diff(np.append(starts, len(points)))
            dx, dy = np.repeat(x[left[who]], n_of) - bx[points], np.repeat(y[left[who]], n_of) - by[points]
            inside = np.sqrt(dx * dx + dy * dy) <= reach
            most[who] = np.maximum(most[who], np.maximum.reduceat(np.where(inside, br[points], -1), starts))
        done = most >= 0
        best[left[done]] = falling[len(falling) - 1 - most[done]]
        left = left[~done]
        begin, n = begin + n, n * 2
    return distance, best


def _searched(probes: DataFrame, points: DataFrame, values: list[str], reach: float, search: Callable) -> DataFrame:
    """The distinct places x, y of probes that have a result, with its distance and the values of its point (x, y, values)."""
    buckets = BUCKETS * int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = lambda c: F.floor(c / (TILE * reach))
    bucket = lambda i, j: F.pmod(F.xxhash64(i, j), F.lit(buckets))
    # Beyond the reach by a little, whatever rounding does.
    spans = [F.sequence(tile(F.col(c) - reach * (1 + SLACK)), tile(F.col(c) + reach * (1 + SLACK))) for c in ("x", "y")]
    around = F.array_distinct(F.flatten(F.transform(spans[0], lambda i: F.transform(spans[1], lambda j: bucket(i, j)))))
    dealt = points.select(F.explode(around).alias("_bucket"), "x", "y", *values)
    asked = _finite(probes).distinct().select(bucket(tile(F.col("x")), tile(F.col("y"))).alias("_bucket"), "x", "y")
    schema = T.StructType([*(T.StructField(n, T.DoubleType()) for n in ("x", "y", "distance")), *(points.schema[v] for v in values)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        columns = [right.column(v).combine_chunks() for v in values]
        x, y, nx, ny = (t.column(c).to_numpy() for t in (left, right) for c in ("x", "y"))
        if len(x) and len(nx):
            distance, best = search(x, y, nx, ny, _ranks(columns))
        else:
            distance, best = np.empty(len(x)), np.full(len(x), -1, np.int64)
        hit = np.flatnonzero(best >= 0)
        taken = pa.array(best[hit])
        return pa.table([pa.array(x[hit]), pa.array(y[hit]), pa.array(distance[hit]), *(c.take(taken) for c in columns)], names=schema.names)

    return asked.groupBy("_bucket").cogroup(dealt.groupBy("_bucket")).applyInArrow(run, schema)


def _finite(df: DataFrame) -> DataFrame:
    """x and y as doubles, without the rows that no distance can be told of."""
    xy = df.select(*[c for c in df.columns if c not in ("x", "y")], *[F.col(c).cast("double").alias(c) for c in ("x", "y")])
    return xy.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))


def _back(probes: DataFrame, found: DataFrame) -> DataFrame:
    """probes with what was found for their place."""
    named = found.withColumnsRenamed({"x": "_x", "y": "_y"})
    joined = probes.join(named, (probes["x"].cast("double") == F.col("_x")) & (probes["y"].cast("double") == F.col("_y")), "left")
    return joined.drop("_x", "_y")


def nearest(probes: DataFrame, network: DataFrame, tolerance: float, keys: list[str], target: str, strict: bool = True) -> DataFrame:
    """For each probe the nearest target of the network below the tolerance, the smaller of two; null if there is none.

    Results are found for places and joined to the probes by x and y, which must come out equal whenever they are computed.
    """
    net = _finite(network.select(target, "x", "y")).groupBy("x", "y").agg(F.min(F.struct(target)).alias("_t")).select("x", "y", f"_t.{target}")
    return _back(probes, _searched(probes.select("x", "y"), net, [target], tolerance, lambda *a: _nearest(*a, tolerance, strict)))


def nearest_of_few(probes: DataFrame, network: DataFrame, keys: list[str], target: str) -> DataFrame:
    """The nearest target however far, for a network of few points.

    The network's points are gathered into one array row; its size is checked and must stay below FEW.
    """
    few = network.select(target, "x", "y").agg(F.collect_list(F.struct("x", "y", target)).alias("_net"))
    if network.count() > FEW:
        raise ValueError(f"more than {FEW} points; use nearest_in_rings()")
    away = F.transform("_net", lambda n: F.struct(hypot(n["x"] - F.col("x"), n["y"] - F.col("y")).alias("distance"), n[target].alias("t")))
    best = F.array_min(away)
    return probes.join(F.broadcast(few)).withColumn("_b", best).select(*probes.columns, F.col("_b.distance").alias("distance"), F.col("_b.t").alias(target))


#: Network points that nearest_of_few() takes.
FEW = 10_000


def nearest_in_rings(probes: DataFrame, network: DataFrame, start: float, keys: list[str], target: str) -> DataFrame:
    """The nearest target however far: the radius doubles for the probes that have found none, until it covers everything.

    Null only where the network is empty. A round costs the pairs within its radius, so `start` should be of the order
    of the distances that most probes have.
    """
    extent = probes.select("x", "y").unionByName(network.select("x", "y")).agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    reach = 0.0 if extent[0] is None else ((extent[1] - extent[0]) ** 2 + (extent[3] - extent[2]) ** 2) ** 0.5
    parts, left, radius = Parts(probes.sparkSession, "rings"), probes, start
    while True:
        tried = kept(nearest(left, network, radius, keys, target, strict=False))
        last = radius >= reach
        parts.add(tried if last else tried.where(F.col(target).isNotNull()))
        left = tried.where(F.col(target).isNull()).select(*probes.columns)
        if last or left.isEmpty():
            return parts.all()
        # The last radius is a little more than the extent, whatever rounding does to distances.
        radius = min(radius * 2, max(reach * 1.001, radius * 1.001))


def busiest_around(probes: DataFrame, network: DataFrame, radius: float, keys: list[str], value: str, name: str | None = None) -> DataFrame:
    """For each probe the largest value within the radius, and with name that of its point; the larger name of two."""
    columns = [value] + ([name] if name else [])
    net = _finite(network.select(*columns, "x", "y")).groupBy("x", "y").agg(F.max(F.struct(*columns)).alias("_t")).select("x", "y", *[f"_t.{c}" for c in columns])
    return _back(probes, _searched(probes.select("x", "y"), net, columns, radius, lambda *a: _busiest(*a, radius)).drop("distance"))


def pairs_within(points: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """a < b, distance: all pairs of points no farther apart than radius."""
    hits = within(points.select(F.col(key).alias("a"), "x", "y"), points.select(F.col(key).alias("b"), "x", "y"), radius)
    return hits.where("a < b").select("a", "b", "distance")


def majority(samples: DataFrame, key: str, name: str, share: float = 0.5) -> DataFrame:
    """key, name, votes, samples: what most samples of each key hit, if that are at least `share` of all its samples.

    Of names with equally many votes the larger is taken; samples without a name count in the total alone.
    """
    votes = samples.groupBy(key, name).agg(F.count(F.lit(1)).alias("votes"))
    # One more level of the same aggregation gives totals and winner together: no second pass over the samples.
    best = votes.groupBy(key).agg(F.sum("votes").alias("samples"), F.max(F.when(F.col(name).isNotNull(), F.struct("votes", F.col(name).alias("name")))).alias("_b"))
    won = best.select(key, F.col("_b.name").alias(name), F.col("_b.votes").alias("votes"), "samples")
    return won.where((F.col("votes") / F.col("samples")) >= share)


def median_if_hit(samples: DataFrame, key: str, value: str, share: float = 0.5) -> DataFrame:
    """key, value: the median over the samples that hit (value not null), null if fewer than `share` did."""
    hit = F.avg(F.col(value).isNotNull().cast("double"))
    return samples.groupBy(key).agg(F.when(hit >= share, F.median(value)).alias(value))


#: Doublings of the radius by which route_candidates() reaches the tolerance.
STEPS = 6


def route_candidates(trips: DataFrame, vertices: DataFrame, tolerance: float, key: str = "id", route: str = "route") -> DataFrame:
    """key, route, d1, d2: of the routes that pass both ends of a trip within the tolerance, that of the least sum.

    trips: key, x1, y1, x2, y2. vertices: route, x, y. Radii double up to the tolerance. What passes one of the ends beyond a
    radius has a sum beyond it, so a trip whose least sum is no more than the radius is done, and the others go on: the
    routes that are compared are about those between which the best is found, not all within the tolerance. Trips of the
    same ends are asked once, and of routes of the same vertices the smallest takes part.
    """
    ends = ["x1", "y1", "x2", "y2"]
    asked = kept(trips.where(F.col(key).isNotNull()).select(key, *ends).distinct())
    same = vertices.groupBy(route).agg(F.sort_array(F.collect_set(F.struct("x", "y"))).alias("_p")).groupBy("_p").agg(F.min(route).alias(route))
    net = kept(same.select(route, F.inline("_p")))
    places = left = kept(asked.select(*ends).distinct().withColumn("_trip", F.monotonically_increasing_id()))
    parts = Parts(trips.sparkSession, "candidates")
    for step in range(STEPS, -1, -1):
        radius = tolerance / 2**step
        points = left.select("_trip", F.inline(F.array(*[F.struct(F.lit(e).alias("_e"), F.col(f"x{e}").alias("x"), F.col(f"y{e}").alias("y")) for e in (1, 2)])))
        near = within(spread(points, ["_trip"]), net, radius).groupBy("_trip", route).agg(*[F.min(F.when(F.col("_e") == e, F.col("distance"))).alias(f"d{e}") for e in (1, 2)])
        both = near.where(F.col("d1").isNotNull() & F.col("d2").isNotNull())
        best = both.groupBy("_trip").agg(F.min(F.struct((F.col("d1") + F.col("d2")).alias("sum"), route, "d1", "d2")).alias("_b"))
        found = parts.add(best.where(F.lit(step == 0) | (F.col("_b.sum") <= radius)).select("_trip", "_b.*"))
        if step == 0:
            break
        left = kept(left.join(found, "_trip", "left_anti"))
        if left.isEmpty():
            break
    return asked.join(places.join(parts.all(), "_trip"), ends).select(key, route, "d1", "d2")


def coverage(samples: DataFrame, hit: Column, weight: Column) -> DataFrame:
    """Share of weight that hit."""
    return samples.agg(F.try_divide(F.sum(F.when(hit, weight).otherwise(0.0)), F.sum(weight)).alias("coverage"))


def first_source(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first by order."""
    by = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
