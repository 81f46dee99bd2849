"""Flows: trips by cell, street and time of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.bins import BINS, time_at, time_bin
from tramline.operators.graph import bounded_paths, path_to, shortest_paths
from tramline.operators.polyline import subsegment_samples
from tramline.operators.prefix import kept, running_sum
from tramline.operators.snap import nearest
from tramline.operators.stats import quantiles


def trips_from_events(events: DataFrame, person: str, time_us: Column, mode: str, order: list[str]) -> DataFrame:
    """A trip from each event of a person to the next: trip_id (the event's), person, mode, purposes, t_start, t_end.

    Times are seconds of the first event's day, so t_end passes 86,400 for trips over midnight.
    """
    by = Window.partitionBy(person).orderBy("_us", *order)
    rows = events.withColumn("_us", time_us)
    rows = rows.withColumns({"_next": F.lead("_us").over(by), "purpose_to": F.lead(mode).over(by)}).where(F.col("_next").isNotNull())
    day = F.pmod(F.col("_us"), F.lit(86_400_000_000))
    start = day / 1e6
    return rows.select(
        *order, F.col(person).alias("person"), F.col(mode).alias("mode"), F.col(mode).alias("purpose_from"), "purpose_to",
        start.alias("t_start"), (start + (F.col("_next") - F.col("_us")) / 1e6).alias("t_end"),
    )


def under_way(trips: DataFrame, dims: list[str], bins: int = BINS) -> DataFrame:
    """dims, bin, n: trips under way in each bin, on a dense spine.

    +1 at the bin of the start and -1 after that of the end, summed before the shuffle, then a running sum over at
    most bins + 1 rows for each group.
    """
    start, end = time_bin(F.col("t_start")), time_bin(F.col("t_end"))
    events = F.array(F.struct(start.alias("bin"), F.lit(1).alias("d")), F.struct((end + 1).alias("bin"), F.lit(-1).alias("d")))
    steps = trips.select(*dims, F.inline(events)).groupBy(*dims, "bin").agg(F.sum("d").alias("d"))
    spine = steps.select(*dims).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    dense = spine.join(steps, [*dims, "bin"], "left")
    by = Window.partitionBy(*dims).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return dense.select(*dims, "bin", F.sum(F.coalesce("d", F.lit(0))).over(by).alias("n"))


def interval_series(trips: DataFrame, dims: list[str], t0: float, t1: float, bins: int = 96) -> DataFrame:
    """dims, bin, n: trips that touch each of `bins` even parts of t0 to t1; bins that none touches are left out."""
    place = lambda t: F.floor((F.col(t) - t0) / (t1 - t0) * bins)
    inside = trips.where((F.col("t_end") >= t0) & (F.col("t_start") < t1))
    low, high = F.greatest(place("t_start"), F.lit(0)), F.least(place("t_end"), F.lit(bins - 1))
    return inside.withColumn("bin", F.explode(F.sequence(low.cast("int"), high.cast("int")))).groupBy(*dims, "bin").agg(F.count(F.lit(1)).alias("n"))


def moving_at(trips: DataFrame, now: float, dims: list[str]) -> DataFrame:
    """dims, n: trips with t_start <= now <= t_end."""
    return trips.where((F.col("t_start") <= now) & (F.col("t_end") >= now)).groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))


def distinct_load(points: DataFrame, trip: str, keys: list[str]) -> DataFrame:
    """keys, n: trips that have a point with these keys; a trip counts once for each."""
    return points.select(trip, *keys).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def hourly(cube: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """The quarter-hour cube by hour; what is in two quarters counts twice, as in the source."""
    return cube.withColumn("hour", F.floor(F.col("bin") / 4).cast("int")).groupBy(*keys, "hour").agg(F.sum(value).alias(value))


def flow_day(triples: DataFrame, dims: dict[str, list[str]], edge: str = "edge_id", trip: str = "trip_id") -> DataFrame:
    """edge, trips_all, trips (plausible), and a column "dim:value" of plausible trips for each value of each dimension.

    One aggregation with conditional counts: no pivot, and no shuffle for each dimension.
    """
    once = triples.select(trip, edge, "plausible", *dims).distinct()
    counts = [F.count_if(F.col("plausible") & (F.col(d) == v)).alias(f"{d}:{v}") for d, values in dims.items() for v in values]
    return once.groupBy(edge).agg(F.count(F.lit(1)).alias("trips_all"), F.count_if("plausible").alias("trips"), *counts)


def flow_time(triples: DataFrame, edge: str = "edge_id", trip: str = "trip_id") -> DataFrame:
    """edge, mode, bin, trips: plausible trips by edge, mode and bin, each counted once for each."""
    once = triples.where("plausible").select(trip, edge, "mode", "bin").distinct()
    return once.groupBy(edge, "mode", "bin").agg(F.count(F.lit(1)).alias("trips"))


def assigned(pieces: DataFrame, points: DataFrame, nodes: DataFrame, edges: DataFrame, short: float, step: float, tolerance: float, junction: float, factor: float = 1.6, slack: float = 60.0, tile: float = 2000.0) -> DataFrame:
    """trip_id, edge_id, bin: each trip's edges, once for each bin.

    Pieces up to `short` are sampled and snapped to points of the network; longer ones take the path between the junctions
    near their ends, in the bin of their middle, and are sampled where there is none. pieces: trip_id, piece, t0, t1 and
    the columns of segments(). points: edge_id, x, y. nodes and edges: as junctions() gives them.
    """
    by = ["trip_id", "piece", "k"]

    def snapped(some: DataFrame) -> DataFrame:
        samples = subsegment_samples(some, step)
        probes = samples.select(*by, time_bin(time_at(F.col("at"), F.col("total"), F.col("t0"), F.col("t1"))).alias("bin"), "x", "y")
        return nearest(probes, points, tolerance, by, "edge_id").select("trip_id", "piece", "edge_id", "bin")

    far = kept(pieces.where(F.col("length") > short))
    middle = time_bin(time_at(F.col("along") + F.col("length") / 2, F.col("total"), F.col("t0"), F.col("t1")))
    ends = far.select("trip_id", "piece", "length", middle.alias("bin"), F.inline(F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in "ab"])))
    near = nearest(ends, nodes, junction, ["trip_id", "piece", "end"], "id", strict=False).where(F.col("id").isNotNull())
    both = near.groupBy("trip_id", "piece", "bin", "length").agg(*[F.max(F.when(F.col("end") == e, F.col("id"))).alias(n) for e, n in (("a", "src"), ("b", "dst"))])
    both = kept(both.where("src <> dst"))
    # Used twice, and each search is dear.
    paths = kept(bounded_paths(both.select("src", "dst", F.col("length").alias("chord")), nodes, edges, factor, slack, tile))
    # The bound of a pair of junctions is that of its longest chord; a shorter one keeps to its own.
    lengths = paths.join(edges.select("edge_id", F.col("length").alias("_l")), "edge_id").groupBy("src", "dst").agg(F.sum("_l").alias("_path"))
    fits = both.hint("merge").join(lengths, ["src", "dst"]).where(F.col("_path") <= F.col("length") * factor + slack)
    chords = fits.hint("merge").join(paths, ["src", "dst"]).select("trip_id", "piece", "edge_id", "bin")
    return assign(snapped(pieces.where(F.col("length") <= short)), kept(chords), snapped(far))


def assign(short: DataFrame, long: DataFrame, fallback: DataFrame) -> DataFrame:
    """trip_id, edge_id, bin: short pieces by snapping, long chords by their path, and by snapping where no path was found.

    Each frame has trip_id, piece, edge_id, bin; fallback is used for the pieces that long does not have. Written frames
    are small by their files and large as rows, so that a broadcast of pieces would fill the driver: they are merged.
    """
    rest = fallback.join(long.select("trip_id", "piece").distinct().hint("merge"), ["trip_id", "piece"], "left_anti")
    columns = ["trip_id", "edge_id", "bin"]
    return short.select(columns).unionByName(long.select(columns)).unionByName(rest.select(columns)).where(F.col("edge_id").isNotNull()).distinct()


def budgeted(cube: DataFrame, segment: str, traffic: Column, budget: int) -> DataFrame:
    """The cube's rows of the busiest segments while their rows together stay within the budget.

    The running sum is over segments, not over the cube's rows.
    """
    sizes = cube.groupBy(segment).agg(F.count(F.lit(1)).alias("rows"), F.sum(traffic).alias("traffic"))
    summed = running_sum(sizes, [F.col("traffic").desc(), F.col(segment)], F.col("rows"), "sum")
    return cube.join(summed.where(F.col("sum") <= budget).select(segment), segment, "left_semi")


def row_starts(cube: DataFrame, segment: str) -> DataFrame:
    """segment, ordinal, row_start, rows: offsets of each segment in the cube sorted by segment."""
    sizes = cube.groupBy(segment).agg(F.count(F.lit(1)).alias("rows"))
    numbered = running_sum(running_sum(sizes, [F.col(segment)], F.lit(1), "number"), [F.col(segment)], F.col("rows"), "upto")
    return numbered.select(segment, (F.col("number") - 1).cast("int").alias("ordinal"), (F.col("upto") - F.col("rows")).alias("row_start"), "rows")


def fitted_profile(shape: DataFrame, periods: DataFrame, group: str) -> DataFrame:
    """group, hour, share: an hourly shape scaled so that each period has its given share; sums to 1, six decimals.

    shape: hour, period, s. periods: group, period, g.
    """
    joined = periods.join(shape, "period")
    within = Window.partitionBy(group, "period")
    raw = joined.withColumn("raw", F.coalesce(F.try_divide(F.col("s") * F.col("g"), F.sum("s").over(within)), F.lit(0.0)))
    total = F.sum("raw").over(Window.partitionBy(group))
    return raw.select(group, "hour", F.round(F.try_divide(F.col("raw"), total), 6).alias("share"))


def with_fallback(links: DataFrame, group: str, value: str, least: int = 10) -> DataFrame:
    """group, value, n, used: a group's median if it has enough links, or else the median of all."""
    overall = quantiles(links, value, [], (0.5,)).select(F.col("p50").alias("overall"))  # one row
    medians = quantiles(links, value, [group], (0.5,)).select(F.col(group).alias("_g"), F.col("p50").alias(value))
    sizes = links.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.join(medians, sizes[group].eqNullSafe(F.col("_g")), "left")
    return groups.join(F.broadcast(overall)).select(group, value, "n", F.when(F.col("n") >= least, F.col(value)).otherwise(F.col("overall")).alias("used"))


def network_routes(trips: DataFrame, nodes: DataFrame, edges: DataFrame, reach: float, key: str = "trip_id") -> DataFrame:
    """key, points: for trips (key, match, points) that are "straight", the way over a network between the nodes nearest to
    their ends, within reach, with the trip's own ends around it. Trips whose ends share a node, or are not joined, have none.
    """
    asked = trips.where(F.col("match") == "straight").select(key, F.element_at("points", 1).alias("a"), F.element_at("points", -1).alias("b"))
    ends = asked.select(key, F.inline(F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"{e}.x").alias("x"), F.col(f"{e}.y").alias("y")) for e in "ab"])))
    near = nearest(ends, nodes, reach, [key, "end"], "id").where(F.col("id").isNotNull())
    pairs = near.groupBy(key).agg(*[F.max(F.when(F.col("end") == e, F.col("id"))).alias(n) for e, n in (("a", "source"), ("b", "target"))])
    pairs = kept(pairs.where("source <> target"))
    paths = kept(shortest_paths(edges, pairs.select(F.col("source").alias("node")).distinct()))
    found = path_to(paths, pairs.select("source", "target").distinct())
    # Only those that lead back to their source are ways; steps count from the target.
    placed = found.join(nodes.select(F.col("id").alias("node"), "x", "y"), "node")
    ways = placed.groupBy("source", "target").agg(F.reverse(F.array_sort(F.collect_list(F.struct("step", "x", "y")))).alias("way"), F.bool_or(F.col("node") == F.col("source")).alias("whole")).where("whole")
    joined = asked.join(pairs, key).join(ways, ["source", "target"])
    way = F.transform("way", lambda w: F.struct(w["x"].alias("x"), w["y"].alias("y")))
    own = [F.array(F.struct(F.col(f"{e}.x").alias("x"), F.col(f"{e}.y").alias("y"))) for e in "ab"]
    return joined.select(key, F.concat(own[0], way, own[1]).alias("points"))


def rerouted(trips: DataFrame, routes: DataFrame, key: str = "trip_id") -> DataFrame:
    """trips with the points and match of a network route where the first matching had left them "straight".

    routes: key, points. Trips that have been matched, or have no route, stay as they are.
    """
    new = routes.select(key, F.col("points").alias("_new"))
    joined = trips.join(new, key, "left")
    take = (F.col("match") == "straight") & F.col("_new").isNotNull()
    return joined.withColumns({"points": F.when(take, F.col("_new")).otherwise(F.col("points")), "match": F.when(take, "osm_network").otherwise(F.col("match"))}).drop("_new")
