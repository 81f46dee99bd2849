"""Grid cells, time bins, classes and quantisation as Column expressions."""

from __future__ import annotations

from functools import cache, reduce
from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A raster of 100 m cells, and quarter hours from 03:00 to 24:00.
GRID_X0, GRID_Y0, GRID_SIZE, GRID_NX, GRID_NY = 299000.0, 6383900.0, 100.0, 361, 335
BIN_SECONDS, FIRST_BIN, BINS = 900, 12, 84
# Speed classes, and the minimum average speeds by which roads are filtered.
SPEED_CLASSES = [30, 40, 50, 60, 70, 80, 90, 100, 110, 120]
SPEED_FILTERS = [0, 2.5, 5, 7.5, 10, 12.5, 15, 17.5, 20]
DEFAULT_CLASS = 50
# The longest plausible distance by mode in km.
DISTANCE_CAPS = {"Walking": 5.0, "Bicycle/E-bike": 25.0, "Moped": 45.0, "Transportation service": 60.0}
DEFAULT_CAP = 80.0


def cell_index(x: Column, y: Column, x0: float = GRID_X0, y0: float = GRID_Y0, size: float = GRID_SIZE) -> tuple[Column, Column]:
    """Column and row of the cell of a point."""
    return F.floor((x - x0) / size), F.floor((y - y0) / size)


def in_raster(ix: Column, iy: Column, nx: int = GRID_NX, ny: int = GRID_NY) -> Column:
    return ix.between(0, nx - 1) & iy.between(0, ny - 1)


def cell_centre(ix: Column, iy: Column, x0: float = GRID_X0, y0: float = GRID_Y0, size: float = GRID_SIZE) -> tuple[Column, Column]:
    return (ix + 0.5) * size + x0, (iy + 0.5) * size + y0


def time_bin(seconds: Column, width: int = BIN_SECONDS, first: int = FIRST_BIN, bins: int = BINS) -> Column:
    """The bin of a time of day; early and late times go to the first and last bin."""
    return F.greatest(F.least(F.floor(seconds / width) - first, F.lit(bins - 1)), F.lit(0)).cast("int")


def time_at(distance: Column, total: Column, t0: Column, t1: Column) -> Column:
    """When a trip has gone a distance, at even speed; the start if it goes nowhere."""
    return t0 + F.coalesce(F.try_divide(distance, F.nullif(total, F.lit(0.0))), F.lit(0.0)) * (t1 - t0)


def vertex_fraction(position: Column, vertices: Column) -> Column:
    """How far along a line its vertex is, by number."""
    return position / F.greatest(vertices - 1, F.lit(1))


def speed_class(limit: Column) -> Column:
    """The nearest speed class, the lower of two; the default where the limit isn't known."""
    known = F.nanvl(limit.cast("double"), F.lit(None).cast("double"))
    near = F.array_min(F.array(*[F.struct(F.abs(known - c).alias("d"), F.lit(c).alias("c")) for c in SPEED_CLASSES]))
    return F.when(known.isNull(), DEFAULT_CLASS).otherwise(near["c"])


def plausible(distance_km: Column, mode: Column) -> Column:
    """Whether a trip's distance is within its mode's cap."""
    caps = F.create_map(*[F.lit(x) for pair in DISTANCE_CAPS.items() for x in pair])
    return distance_km <= F.coalesce(F.try_element_at(caps, F.coalesce(mode, F.lit(""))), F.lit(DEFAULT_CAP))


def slow_index(c0: Column, total0: Column, c8: Column, total8: Column, least: int = 5) -> Column:
    """Share of slow traffic against share of fast traffic; null where c8 is 0 or both counts are small."""
    ratio = F.try_divide(c0 / total0, F.nullif(c8 / total8, F.lit(0.0)))
    return F.when((c8 > 0) & ((c0 >= least) | (c8 >= least)), ratio)


def log2_ratio(a: Column, b: Column, floor: float = 1e-6) -> Column:
    return F.log2(F.greatest(a, F.lit(floor)) / F.greatest(b, F.lit(floor)))


def per_lane(count: Column, lanes: Column, least: int = 5) -> Column:
    return F.when((lanes >= 1) & (count >= least), count / lanes)


def sqrt_byte(value: Column, peak: Column) -> Column:
    """A value from 0 to peak on a square-root scale of 0 to 255."""
    return F.bround(F.sqrt(value / peak) * 255, 0).cast("int")


def from_sqrt_byte(byte: Column, peak: Column) -> Column:
    return F.pow(byte / 255.0, 2) * peak


def share_byte(n: Column, total: Column) -> Column:
    """255 times a share, rounded half to even, within 0 to 255."""
    return F.least(F.greatest(F.coalesce(F.bround(F.try_divide(n * 255.0, F.nullif(total, F.lit(0))), 0), F.lit(0.0)), F.lit(0.0)), F.lit(255.0)).cast("int")


def packed_key(parts: list[tuple[Column, int]]) -> Column:
    """One long for several non-negative numbers, each below its size: the first counts most."""
    key = F.lit(0).cast("long")
    for part, size in parts:
        key = key * F.lit(size) + part.cast("long")
    return key


def unpacked_key(key: Column, sizes: list[int]) -> list[Column]:
    """The numbers of packed_key()."""
    parts = []
    for size in reversed(sizes):
        parts.append(F.pmod(key, F.lit(size)))
        key = F.call_function("div", key, F.lit(size))
    return parts[::-1]


def saturating(value: Column, low: int, high: int) -> Column:
    """A number cut to a range, then an integer; casting alone would raise."""
    return F.least(F.greatest(value, F.lit(low)), F.lit(high)).cast("int")


def banded(value: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the band, open below and closed above; null outside."""
    pairs = zip(edges[:-1], edges[1:], labels, strict=True)
    return F.coalesce(*[F.when((value > low) & (value <= high), label) for low, high, label in pairs])


def interval_class(value: Column, peak: Column, classes: int = 6) -> Column:
    """Class 0 to classes - 1 of a positive count, in steps of ceil(peak / classes)."""
    return F.least(F.lit(classes - 1), F.floor((value - 1) / F.ceil(peak / classes))).cast("int")


def unit_hash(value: Column, seed: int = 0) -> Column:
    """A fixed number in [0, 1) for each value."""
    return F.pmod(F.xxhash64(F.lit(seed), value), F.lit(1 << 32)) / float(1 << 32)


def _poisson_below(k: int, mean: float) -> float:
    """The chance of k events or fewer."""
    if mean <= 0:
        return 1.0
    return min(1.0, sum(exp(i * log(mean) - mean - lgamma(i + 1)) for i in range(k + 1)))


def _solve(low: float, high: float, above) -> float:
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) else (low, middle)
    return (low + high) / 2


@cache
def poisson_interval(k: int, level: float = 0.95) -> tuple[float, float]:
    """The exact interval of a Poisson mean, given a count (Garwood)."""
    tail = (1 - level) / 2
    top = k + 12 * (k + 1) ** 0.5 + 20
    low = 0.0 if k == 0 else _solve(0.0, float(k), lambda m: 1 - _poisson_below(k - 1, m) < tail)
    return low, _solve(float(k), top, lambda m: _poisson_below(k, m) > tail)


def poisson_table(spark: SparkSession, most: int = 200) -> DataFrame:
    """k, low, high for counts up to `most`, which is the table's size."""
    return spark.createDataFrame([(k, *poisson_interval(k)) for k in range(most + 1)], "k long, low double, high double")


def with_poisson(df: DataFrame, count: str, most: int = 200) -> DataFrame:
    """df with lo95, hi95 and rse of a count: exact to `most`, beyond it by the normal approximation."""
    k = F.col(count)
    table = F.broadcast(poisson_table(df.sparkSession, most).withColumnRenamed("k", "_k"))  # most + 1 rows
    joined = df.join(table, k == F.col("_k"), "left").drop("_k")
    near = F.sqrt(k.cast("double")) * 1.96
    return joined.withColumns({
        "lo95": F.coalesce("low", F.when(k.isNotNull(), F.greatest(k - near, F.lit(0.0)))), "hi95": F.coalesce("high", k + near), "rse": F.when(k > 0, 1 / F.sqrt(k.cast("double"))),
    }).drop("low", "high")


def ramp(value: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """array<int> of red, green and blue: linear between the stops, constant beyond them."""

    def channel(c: int) -> Column:
        parts = []
        for (a, low), (b, high) in zip(stops, stops[1:], strict=False):
            parts.append(F.when(value <= b, F.round(F.lit(low[c]) + (F.greatest(value, F.lit(a)) - a) / (b - a) * (high[c] - low[c]), 0)))
        return F.coalesce(*parts, F.lit(float(stops[-1][1][c]))).cast("int")

    return F.when(value.isNotNull(), F.array(channel(0), channel(1), channel(2)))


def diverging(value: Column, limit: float, low: tuple[int, int, int], middle: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """A ramp with two sides around zero."""
    return ramp(value, [(-limit, low), (0.0, middle), (limit, high)])


def total_of(columns: list[Column]) -> Column:
    """The sum of what isn't null; null only if all are."""
    some = reduce(lambda a, b: a | b, [c.isNotNull() for c in columns])
    return F.when(some, reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns]))
