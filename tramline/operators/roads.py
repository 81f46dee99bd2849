"""Roads with counts by minimum speed: pairing of directions, sweep, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.bins import interval_class, slow_index


def undirected(directed: DataFrame, counts: list[str], first: list[str] = (), most: list[str] = (), order: list[str] = ()) -> DataFrame:
    """lo, hi, key: records (u, v, key) of both directions as one road.

    Counts are summed; of `first` the first value that isn't null, by order; of `most` the largest.
    """
    road = [F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "key"]
    sums = [F.sum(c).alias(c) for c in counts]
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in first]
    return directed.groupBy(*road).agg(*sums, *firsts, *[F.max(c).alias(c) for c in most])


def both_directions(directed: DataFrame, count: str) -> DataFrame:
    """u < v, key, there, back: roads that have a record each way."""
    there = directed.groupBy("u", "v", "key").agg(F.sum(count).alias("n"))
    back = there.select(F.col("v").alias("u"), F.col("u").alias("v"), "key", F.col("n").alias("back"))
    return there.join(back, ["u", "v", "key"]).where("u < v").select("u", "v", "key", F.col("n").alias("there"), "back")


def direction_split(pairs: DataFrame, least: float = 10) -> DataFrame:
    """One row: percent with equal counts, percent with one direction only, median share of the busier one."""
    total = F.col("there") + F.col("back")
    share = F.when(total >= least, F.greatest("there", "back") / total)
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), (F.avg((F.col("there") == F.col("back")).cast("double")) * 100).alias("equal_pct"),
        (F.avg((((F.col("there") == 0) | (F.col("back") == 0)) & (total > 0)).cast("double")) * 100).alias("one_way_pct"), F.median(share).alias("busier_share"),
    )


def sweep(roads: DataFrame, counts: list[str]) -> DataFrame:
    """filter, roads, crossings: how many roads have a count, and the counts' sum, for each column."""
    aggs = [f for i, c in enumerate(counts) for f in (F.count_if(F.col(c) > 0).alias(f"n{i}"), F.sum(c).alias(f"s{i}"))]
    one = roads.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("filter"), F.col(f"n{i}").alias("roads"), F.col(f"s{i}").alias("crossings")) for i, c in enumerate(counts)])
    return one.select(F.inline(rows))


def with_slow_index(roads: DataFrame, slow: str, fast: str) -> DataFrame:
    totals = roads.agg(F.greatest(F.lit(1), F.sum(slow)).alias("_t0"), F.greatest(F.lit(1), F.sum(fast)).alias("_t8"))  # one row
    return roads.join(F.broadcast(totals)).withColumn("slow_index", slow_index(F.col(slow), F.col("_t0"), F.col(fast), F.col("_t8"))).drop("_t0", "_t8")


def volume_classes(roads: DataFrame, count: str, classes: int = 6) -> DataFrame:
    """class, roads, low, high: roads with a count in even steps of it."""
    peak = roads.agg(F.max(count).alias("_peak"))  # one row
    with_class = roads.where(F.col(count) > 0).join(F.broadcast(peak)).withColumn("class", interval_class(F.col(count), F.col("_peak"), classes))
    return with_class.groupBy("class").agg(F.count(F.lit(1)).alias("roads"), F.min(count).alias("low"), F.max(count).alias("high"))


def painted(roads: DataFrame, count: str, thin: int = 5, slow: Column | None = None) -> DataFrame:
    """roads with thin (a count too small to tell) and paint: "none", "thin", "slow", "fast" or "even"."""
    few = F.col(count) < thin
    index = slow if slow is not None else F.col("slow_index")
    paint = F.when(F.col(count) <= 0, "none").when(few, "thin").when(index > 1.25, "slow").when(index < 0.8, "fast").otherwise("even")
    return roads.withColumns({"thin": few, "paint": paint})


def positional_join(a: DataFrame, b: DataFrame, row: str = "source_row", file: str = "source_file") -> DataFrame:
    """Rows of two aligned sources side by side, by the row number, and the file's if there is one, that both were given when read.

    Sources whose files have different lengths are not aligned: that raises, before anything is joined.
    """
    keys = [c for c in (file, row) if c in a.columns and c in b.columns]
    by = [c for c in keys if c != row]
    n, m = (sorted(tuple(r) for r in df.groupBy(*by).agg(F.count(F.lit(1))).collect()) for df in (a, b))  # a row for each file
    if n != m:
        raise ValueError(f"sources are not aligned: {n[:3]} and {m[:3]} rows")
    return a.join(b, keys)


def looked_up(rows: DataFrame, ordinal: str, vocabulary: DataFrame, out: str) -> DataFrame:
    """rows with the name that a column of ordinals stands for, null where there is none; vocabulary: ordinal, name."""
    names = vocabulary.select(F.col("ordinal").alias("_o"), F.col("name").alias(out))
    return rows.join(names, F.col(ordinal) == F.col("_o"), "left").drop("_o")


def with_sources(roads: DataFrame, records: DataFrame, key: str, counts: list[str], order: list[str], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """roads with what their source records say: n_directions, rows ("1 + 2"), source_c for each count, whether all match, and
    x, y of the first record, within the box if one is given.

    records: key, order, x, y and the counts.
    """
    first = F.min_by(F.struct("x", "y"), F.struct(*order))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(order[0])), lambda r: r.cast("string")), " + ")
    sums = records.groupBy(key).agg(F.count(F.lit(1)).alias("n_directions"), rows.alias("rows"), first.alias("_at"), *[F.sum(c).alias(f"source_{c}") for c in counts])
    same = F.lit(True)
    for c in counts:
        same = same & F.coalesce(F.col(c) == F.col(f"source_{c}"), F.lit(False))
    joined = roads.join(sums, key, "left").withColumns({"matches": same, "x": F.col("_at.x"), "y": F.col("_at.y")}).drop("_at")
    if box is None:
        return joined
    return joined.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def with_zero(roads: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """roads with a value for each key, 0 where there is none."""
    return roads.join(values.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def checked_join(flows: DataFrame, streets: DataFrame, key: str) -> DataFrame:
    """flows with their streets; a flow on a street that isn't there raises, by an error in the row itself, not by a second job."""
    found = flows.join(streets.withColumn("_there", F.lit(True)), key, "left")
    message = F.concat(F.lit("no street "), F.col(key).cast("string"))
    return found.withColumn("_there", F.coalesce(F.col("_there"), F.raise_error(message).cast("boolean"))).where("_there").drop("_there")
