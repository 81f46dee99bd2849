"""Polylines: lengths, distances along the line, resampling, splitting, coding.

A line is an array of structs (x, y). vertices() and segments() turn lines into rows; the rest works on those or
on the arrays. Per-line work is either an expression over the array, which needs no shuffle, or a window
partitioned by the line's id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.functions.geo import equirectangular, hypot, point_segment_distance, position_on_segment


def _heads(line: Column) -> Column:
    return F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0)))


def _tails(line: Column) -> Column:
    return F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body and the lambdas in it use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line(x: Column, y: Column) -> Column:
    """The array of (x, y) of two parallel arrays; a third ordinate, if any, is simply not passed on."""
    return F.zip_with(x, y, lambda a, b: F.struct(a.alias("x"), b.alias("y")))


def array_length(points: Column) -> Column:
    """Planar length of a line, as an expression over the array."""
    steps = lambda p: F.zip_with(_heads(p), _tails(p), lambda a, b: hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(_let(points, steps), F.lit(0.0), lambda total, s: total + s)


def vertices(lines: DataFrame, key: str = "id", points: str = "points") -> DataFrame:
    """The lines' columns without the points, and pos, x, y and n (vertices of the line)."""
    others = [c for c in lines.columns if c != points]
    exploded = lines.select(*others, F.size(points).alias("n"), F.posexplode(points).alias("pos", "p"))
    return exploded.select(*others, "n", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def _flat(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and y of all vertices of a batch of lines, and where each line begins and the last one ends."""
    sizes = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)
    flat = lines.flatten()
    return flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _step_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    dx, dy = np.diff(x), np.diff(y)
    return np.sqrt(dx * dx + dy * dy)


def segments(lines: DataFrame, key: str = "id", points: str = "points") -> DataFrame:
    """The lines' columns without the points, and pos, ax, ay, bx, by, length, along (distance before the segment) and total.

    Distances are added up once for each line, on Arrow batches, linear in the vertices; nothing is shuffled, and no row
    carries a whole line.
    """
    others = [c for c in lines.columns if c != points]
    names = ["ax", "ay", "bx", "by", "length", "along", "total"]
    schema = T.StructType([*(lines.schema[c] for c in others), T.StructField("pos", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, ends = _flat(batch.column(len(others)))
            first, step, along, total, counts = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)], [np.empty(0)], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                counts.append(max(b - a - 1, 0))
                if b - a > 1:
                    length = _step_lengths(x[a:b], y[a:b])
                    upto = np.cumsum(length)
                    first.append(np.arange(a, b - 1))
                    step.append(length)
                    along.append(np.concatenate(([0.0], upto[:-1])))
                    total.append(np.full(b - a - 1, upto[-1]))
            at = np.concatenate(first)
            values = [x[at], y[at], x[at + 1], y[at + 1], *map(np.concatenate, (step, along, total))]
            yield _repeated(batch, others, np.array(counts, np.int64), [pa.array(v, pa.float64()) for v in values], schema.names)

    return lines.select(*others, points).mapInArrow(run, schema)


def _repeated(batch: pa.RecordBatch, others: list[str], counts: np.ndarray, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """The other columns as often as each row has results, their numbers within the row, and the results."""
    row = pa.array(np.repeat(np.arange(len(counts)), counts))
    number = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(len(others))), pa.array(number, pa.int32()), *columns], names)


def cumulative(verts: DataFrame, key: str = "id") -> DataFrame:
    """Vertices with step (distance from the one before) and along (distance from the first)."""
    order = Window.partitionBy(key).orderBy("pos")
    step = F.coalesce(hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)), F.lit(0.0))
    stepped = verts.withColumn("step", step)
    return stepped.withColumn("along", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def subsegment_samples(segs: DataFrame, step: float) -> DataFrame:
    """max(1, ceil(L / step)) points of each segment at the middles of even parts: k, x, y, at (distance along the line)."""
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / step)).cast("int")
    rows = segs.withColumn("parts", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return _placed(rows, (F.col("k") + 0.5) / F.col("parts")).drop("parts")


def densify(segs: DataFrame, step: float) -> DataFrame:
    """max(1, ceil(L / step)) + 1 points of each segment, both ends included: k, x, y, at."""
    n = (F.greatest(F.lit(1), F.ceil(F.col("length") / step)) + 1).cast("int")
    rows = segs.withColumn("parts", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return _placed(rows, F.col("k") / (F.col("parts") - 1)).drop("parts")


def _placed(rows: DataFrame, fraction: Column) -> DataFrame:
    f = fraction
    return rows.withColumns({
        "x": F.col("ax") + f * (F.col("bx") - F.col("ax")), "y": F.col("ay") + f * (F.col("by") - F.col("ay")), "at": F.col("along") + f * F.col("length"),
    })


def _interpolated(lines: DataFrame, key: str, points: str, wanted: Column) -> DataFrame:
    """The lines' columns without the points, and j, at, total, x and y at the distances that `wanted` gives as an array from the
    column total.

    The last segment with a length that begins at or before a distance holds the point. Each line's distances are added
    up once and searched, on Arrow batches; only the samples become rows.
    """
    others = [c for c in lines.columns if c != points]
    schema = T.StructType([*(lines.schema[c] for c in others), T.StructField("j", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in ("at", "total", "x", "y"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(others)
            x, y, ends = _flat(batch.column(n))
            distances, totals = batch.column(n + 1), batch.column(n + 2).to_numpy(zero_copy_only=False)
            at = distances.flatten().to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(distances), 0).to_numpy(zero_copy_only=False))))
            out, counts = [np.empty((4, 0))], []
            for a, b, p, q, total in zip(ends[:-1].tolist(), ends[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), totals.tolist(), strict=True):
                counts.append(q - p if b - a > 1 else 0)
                if not counts[-1]:
                    continue
                length, want = _step_lengths(x[a:b], y[a:b]), at[p:q]
                real = np.flatnonzero(length > 0)
                if not len(real):
                    out.append(np.stack([want, np.full(q - p, total), np.full(q - p, x[a]), np.full(q - p, y[a])]))
                    continue
                starts = np.concatenate(([0.0], np.cumsum(length)[:-1]))[real]
                k = np.maximum(np.searchsorted(starts, want, side="right") - 1, 0)
                f, seg = np.minimum(1.0, (want - starts[k]) / length[real[k]]), a + real[k]
                out.append(np.stack([want, np.full(q - p, total), x[seg] + f * (x[seg + 1] - x[seg]), y[seg] + f * (y[seg + 1] - y[seg])]))
            yield _repeated(batch, others, np.array(counts, np.int64), [pa.array(c, pa.float64()) for c in np.concatenate(out, axis=1)], schema.names)

    measured = lines.select(*others, points, array_length(F.col(points)).alias("total")).withColumn("_wanted", wanted)
    return measured.select(*others, points, "_wanted", "total").mapInArrow(run, schema)


def line_samples(lines: DataFrame, step: float, least: int = 3, key: str = "id", points: str = "points") -> DataFrame:
    """m = max(least, floor(L / step)) points of each line at (j + 0.5) / m of its length: j, at, total, x, y."""
    m = F.greatest(F.lit(least), F.floor(F.col("total") / step)).cast("int")
    return _interpolated(lines, key, points, F.transform(F.sequence(F.lit(0), m - 1), lambda j: (j + 0.5) / m * F.col("total")))


def line_samples_inclusive(lines: DataFrame, step: float, key: str = "id", points: str = "points") -> DataFrame:
    """m = max(2, floor(L / step) + 1) points of each line from its first to its last point: j, at, total, x, y."""
    m = F.greatest(F.lit(2), F.floor(F.col("total") / step) + 1).cast("int")
    return _interpolated(lines, key, points, F.transform(F.sequence(F.lit(0), m - 1), lambda j: j / (m - 1) * F.col("total")))


def interval_samples(lines: DataFrame, step: float, key: str = "id", points: str = "points") -> DataFrame:
    """Points of each line at step / 2, 3 step / 2, … below its length: j, at, total, x, y."""
    n = F.ceil((F.col("total") - step / 2) / step).cast("int")
    where = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda j: (j + 0.5) * step)).otherwise(F.array().cast("array<double>"))
    return _interpolated(lines, key, points, where)


def ends(points: Column) -> Column:
    """struct<first, last>: the first and last vertex."""
    return F.struct(F.try_element_at(points, F.lit(1)).alias("first"), F.try_element_at(points, F.lit(-1)).alias("last"))


def direction_record(points: Column, decimals: int = 6) -> Column:
    """struct<from_x, from_y, to_x, to_y>, rounded."""
    e = ends(points)
    return F.struct(*[F.round(e[side][c], decimals).alias(f"{name}_{c}") for side, name in (("first", "from"), ("last", "to")) for c in ("x", "y")])


def centroid(lines: DataFrame, group: str, points: str = "points") -> DataFrame:
    """Mean over a group's lines of the mean of each line's vertices."""

    def mean(c: str) -> Column:
        return (F.aggregate(points, F.lit(0.0), lambda t, p: t + p[c]) / F.size(points)).alias(c)

    return lines.where(F.size(points) > 0).select(group, mean("x"), mean("y")).groupBy(group).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def split_at_shared_nodes(lines: DataFrame, key: str = "id", points: str = "points", digits: int = 7) -> DataFrame:
    """key, piece, pos, x, y: lines cut wherever a vertex is shared with another line or place.

    A vertex is a node by its coordinates rounded to `digits` decimals; a line's ends count twice, so they always
    split. Boundary vertices belong to both pieces; pieces without length are dropped.
    """
    verts = vertices(lines.select(key, points), key, points)
    node = [F.bround(F.col(c) * 10**digits, 0).cast("long").alias(f"n{c}") for c in ("x", "y")]
    verts = verts.select("*", *node)
    weight = F.when((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1), 2).otherwise(1)
    used = verts.groupBy("nx", "ny").agg(F.sum(weight).alias("uses"))
    marked = verts.join(used, ["nx", "ny"])
    inner = (F.col("uses") > 1) & (F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("cut", inner).withColumn("piece", F.sum(F.col("cut").cast("int")).over(before))
    both = F.when(F.col("cut"), F.array(F.col("piece") - 1, F.col("piece"))).otherwise(F.array("piece"))
    spread = numbered.withColumn("piece", F.explode(both))
    moved = Window.partitionBy(key, "piece")
    extent = (F.max("x").over(moved) > F.min("x").over(moved)) | (F.max("y").over(moved) > F.min("y").over(moved))
    return spread.withColumn("long", extent).where("long").select(key, F.col("piece").cast("int").alias("piece"), "pos", "x", "y")


def pieces(lines: DataFrame, length: float, vertices_each: int = 5, key: str = "id", points: str = "points") -> DataFrame:
    """key, piece and points: each line in n = max(1, round(L / length)) even pieces of vertices_each points."""
    n = F.greatest(F.lit(1), F.bround(F.col("total") / length, 0)).cast("int")
    each = vertices_each - 1
    wanted = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform(F.sequence(F.lit(0), F.lit(each)), lambda j: (k + j / each) / n * F.col("total"))))
    rows = _interpolated(lines.select(key, points), key, points, wanted)
    rows = rows.withColumn("piece", F.floor(F.col("j") / vertices_each).cast("int"))
    made = rows.groupBy(key, "piece").agg(F.array_sort(F.collect_list(F.struct("j", "x", "y"))).alias("p"))
    return made.select(key, "piece", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def first_per_cell(rows: DataFrame, group: str, x: Column, y: Column, size: float, order: list[str]) -> DataFrame:
    """Of the rows of a group in one cell of a grid, the first."""
    by = Window.partitionBy(group, F.floor(x / size), F.floor(y / size)).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def clip_to_box(lines: DataFrame, box: tuple[float, float, float, float], key: str = "id", points: str = "points") -> DataFrame:
    """key, pos, ax, ay, bx, by: what of each segment lies within (x0, y0, x1, y1) (Liang and Barsky's limits)."""
    x0, y0, x1, y1 = box
    segs = segments(lines.select(key, points), key, points)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    inside = F.lit(True)
    for d, a, low, high in ((dx, F.col("ax"), x0, x1), (dy, F.col("ay"), y0, y1)):
        t0, t1 = (F.try_divide(F.lit(edge) - a, F.nullif(d, F.lit(0.0))) for edge in (low, high))
        enter.append(F.coalesce(F.least(t0, t1), F.lit(0.0)))
        leave.append(F.coalesce(F.greatest(t0, t1), F.lit(1.0)))
        inside = inside & ((d != 0) | a.between(low, high))
    cut = segs.withColumns({"t0": F.greatest(*enter), "t1": F.least(*leave)}).where(inside & (F.col("t0") <= F.col("t1")))
    at = lambda c, t: F.col(f"a{c}") + F.col(t) * (F.col(f"b{c}") - F.col(f"a{c}"))
    return cut.select(key, "pos", at("x", "t0").alias("cx"), at("y", "t0").alias("cy"), at("x", "t1").alias("dx"), at("y", "t1").alias("dy")).toDF(key, "pos", "ax", "ay", "bx", "by")


def project(points: DataFrame, lines: DataFrame, on: str) -> DataFrame:
    """For each point (px, py, joined to a line by `on`): distance from the line, and how far along the nearest place is."""
    segs = segments(lines, on)
    p = [F.col("px"), F.col("py"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")]
    joined = points.join(segs, on)
    place = F.struct(point_segment_distance(*p).alias("distance"), (F.col("along") + position_on_segment(*p) * F.col("length")).alias("along"))
    best = joined.groupBy(*points.columns).agg(F.min(place).alias("best"))
    return best.select(*points.columns, "best.distance", "best.along")


def substring(points: Column, start: Column, end: Column) -> Column:
    """The part of a line between two distances along it, with interpolated ends; reversed if end < start."""
    low, high = F.least(start, end), F.greatest(start, end)
    state = "struct<at:double,last:struct<x:double,y:double>,out:array<struct<x:double,y:double>>>"
    begin = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast("struct<x:double,y:double>").alias("last"), F.array().cast("array<struct<x:double,y:double>>").alias("out")).cast(state)

    def step(st: Column, p: Column) -> Column:
        length = F.coalesce(hypot(p["x"] - st["last"]["x"], p["y"] - st["last"]["y"]), F.lit(0.0))
        after = st["at"] + length

        def at(d: Column) -> Column:
            f = F.coalesce(F.try_divide(d - st["at"], F.nullif(length, F.lit(0.0))), F.lit(0.0))
            return F.array(F.struct((st["last"]["x"] + f * (p["x"] - st["last"]["x"])).alias("x"), (st["last"]["y"] + f * (p["y"] - st["last"]["y"])).alias("y")))

        none = F.array().cast("array<struct<x:double,y:double>>")
        enters = F.when(st["last"].isNotNull() & (st["at"] < low) & (after > low), at(low)).otherwise(none)
        leaves = F.when(st["last"].isNotNull() & (st["at"] < high) & (after > high), at(high)).otherwise(none)
        own = F.when((after >= low) & (after <= high), F.array(F.struct(p["x"].alias("x"), p["y"].alias("y")))).otherwise(none)
        return F.struct(after.alias("at"), F.struct(p["x"].alias("x"), p["y"].alias("y")).alias("last"), F.concat(st["out"], enters, own, leaves).alias("out")).cast(state)

    part = F.aggregate(points, begin, step, lambda st: st["out"])
    return F.when(end < start, F.reverse(part)).otherwise(part)


def splice(first: Column, middle: Column, last: Column) -> Column:
    """A line's own end points around a replaced middle, without consecutive duplicates."""
    return without_repeats(F.concat(F.array(first), middle, F.array(last)))


def flagged(verts: DataFrame, key: str = "id") -> DataFrame:
    """Vertices with first, last (whether a line begins or ends there) and start (how far from its line's first one they are)."""
    order = Window.partitionBy(key).orderBy("pos")
    return verts.withColumns({"start": F.row_number().over(order) - 1, "last": F.lead("pos").over(order).isNull()}).withColumn("first", F.col("start") == 0)


def without_repeats(points: Column) -> Column:
    """The line without vertices equal to the one before."""
    return _let(points, lambda line: F.filter(line, lambda p, i: (i == 0) | (p != F.element_at(line, F.greatest(i, F.lit(1))))))


def shoelace(points: Column) -> Column:
    """Area of the ring of an array's vertices, closed if it isn't."""

    def cross(line: Column) -> Column:
        return F.zip_with(line, F.concat(_tails(line), F.slice(line, 1, 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])

    return F.abs(F.aggregate(_let(points, cross), F.lit(0.0), lambda t, c: t + c)) / 2


def quantised(points: Column, scale: float = 1e5) -> Column:
    """Whole multiples of 1 / scale, rounded half to even."""
    return F.transform(points, lambda p: F.struct(F.bround(p["x"] * scale, 0).cast("long").alias("x"), F.bround(p["y"] * scale, 0).cast("long").alias("y")))


def halved_jumps(points: Column, most: int = 30000, rounds: int = 18) -> Column:
    """Whole points with midpoints put in until no step is longer than `most`; 18 halvings reach any 32-bit step."""

    def step_in(line: Column) -> Column:
        pieces = F.transform(line, lambda p, i: F.when(i == 0, F.array(p)).otherwise(_with_middle(F.element_at(line, F.greatest(i, F.lit(1))), p, most)))
        return F.flatten(pieces)

    # A loop inside one expression: each round sees the last one's result.
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), points, lambda line, _: F.when(_too_long(line, most), step_in(line)).otherwise(line))


def _too_long(line: Column, most: int) -> Column:
    return F.exists(F.zip_with(_heads(line), _tails(line), lambda a, b: F.greatest(F.abs(b["x"] - a["x"]), F.abs(b["y"] - a["y"]))), lambda d: d > most)


def _with_middle(a: Column, b: Column, most: int) -> Column:
    long = (F.abs(b["x"] - a["x"]) > most) | (F.abs(b["y"] - a["y"]) > most)
    middle = F.struct(F.floor((a["x"] + b["x"]) / 2).alias("x"), F.floor((a["y"] + b["y"]) / 2).alias("y"))
    return F.when(long, F.array(middle, b)).otherwise(F.array(b))


def deltas(points: Column) -> Column:
    """Differences of whole points; the first stays."""

    def less(line: Column) -> Column:
        steps = F.zip_with(_heads(line), _tails(line), lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
        return F.concat(F.slice(line, 1, 1), steps)

    return _let(points, less)


def undeltas(steps: Column, scale: float = 1e5) -> Column:
    """Positions from differences of whole points."""
    begin = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.array().cast("array<struct<x:double,y:double>>").alias("out"))

    def step(st: Column, d: Column) -> Column:
        x, y = st["x"] + d["x"], st["y"] + d["y"]
        return F.struct(x.alias("x"), y.alias("y"), F.concat(st["out"], F.array(F.struct((x / scale).alias("x"), (y / scale).alias("y")))).alias("out"))

    return F.aggregate(steps, begin, step, lambda st: st["out"])


def timed_positions(steps: Column, t0: Column, t1: Column, scale: float = 1e5) -> Column:
    """array<struct<x, y, t>> of a coded trip: positions from differences, times by distance at even speed.

    Distances are on a plane that is right near each segment's first point, for positions in degrees.
    """

    def timed(line: Column) -> Column:
        lengths = F.zip_with(_heads(line), _tails(line), lambda a, b: equirectangular(a["x"], a["y"], b["x"], b["y"]))
        begin = F.struct(F.lit(0.0).alias("at"), F.array(F.lit(0.0)).alias("all"))
        run = F.aggregate(lengths, begin, lambda st, d: F.struct((st["at"] + d).alias("at"), F.concat(st["all"], F.array(st["at"] + d)).alias("all")))
        share = lambda d, total: F.coalesce(F.try_divide(d, F.nullif(total, F.lit(0.0))), F.lit(0.0))
        return _let(run, lambda r: F.zip_with(line, r["all"], lambda p, d: F.struct(p["x"].alias("x"), p["y"].alias("y"), (t0 + share(d, r["at"]) * (t1 - t0)).alias("t"))))

    return _let(undeltas(steps, scale), timed)


def _douglas_peucker(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        square = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / square, 0, 1) if square else 0.0
        away = np.hypot(px - t * dx, py - t * dy)
        k = int(np.argmax(away))
        if away[k] > tolerance:
            middle = a + 1 + k
            keep[middle] = True
            todo += [(a, middle), (middle, b)]
    return keep


def simplify(points: Column, tolerance: float) -> Column:
    """Douglas and Peucker's simplification; its recursion has no Catalyst form, so it runs on Arrow batches."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in batches:
            out = []
            for pts in lines:
                if pts is None or len(pts) < 3:
                    out.append(pts)
                    continue
                x, y = (np.array([p[c] for p in pts]) for c in ("x", "y"))
                keep = _douglas_peucker(x, y, tolerance)
                out.append([{"x": a, "y": b} for a, b in zip(x[keep], y[keep], strict=True)])
            yield pd.Series(out)

    return run(points)
