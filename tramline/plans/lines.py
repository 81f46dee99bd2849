"""Queries on polylines, grids and snapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import bins, geo
from tramline.operators import flows, pack, polyline, snap, stats
from tramline.plans.base import SEGMENT, VERTEX, polylines
from tramline.plans.registry import query

_CELL = 0.1


@query("polyline_length", f"WITH {SEGMENT} SELECT id, cls, round(sum(length), 6) AS length FROM seg GROUP BY ALL")
def polyline_length(spark: SparkSession, d: str) -> DataFrame:
    return polylines(spark, d).select("id", "cls", F.round(polyline.array_length(F.col("points")), 6).alias("length"))


@query("cumulative_time", f"""WITH {SEGMENT}, a AS (SELECT id, pos + 1 AS pos, along + length AS along, total FROM seg UNION ALL SELECT id, 0, 0, total FROM seg WHERE pos = 0)
SELECT id, CAST(pos AS INTEGER) AS pos, round(along, 6) AS along, round(28800 + along / total * 3600, 4) AS at FROM a""")
def cumulative_time(spark: SparkSession, d: str) -> DataFrame:
    """Distance from the start and the time there, for trips of one hour from 08:00."""
    rows = polyline.cumulative(polyline.vertices(polylines(spark, d)))
    totals = polylines(spark, d).select("id", polyline.array_length(F.col("points")).alias("total"))
    at = bins.time_at(F.col("along"), F.col("total"), F.lit(28_800.0), F.lit(32_400.0))
    return rows.join(totals, "id").select("id", "pos", F.round("along", 6).alias("along"), F.round(at, 4).alias("at"))


@query("time_by_index", f"""WITH {VERTEX} SELECT id, CAST(pos AS INTEGER) AS pos, round(28800 + pos / 31.0 * 3600, 4) AS at FROM v""")
def time_by_index(spark: SparkSession, d: str) -> DataFrame:
    rows = polyline.vertices(polylines(spark, d))
    return rows.select("id", "pos", F.round(F.lit(28_800) + bins.vertex_fraction(F.col("pos"), F.col("n")) * 3600, 4).alias("at"))


_H = """2 * 6371008.8 * asin(sqrt(least(1, greatest(0, power(sin(radians(b_y - ay) / 2), 2) + cos(radians(ay)) * cos(radians(b_y)) * power(sin(radians(b_x - ax) / 2), 2)))))"""


@query("haversine_length", f"WITH {VERTEX}, s AS (SELECT id, 12 + x AS ax, 57 + y AS ay, lead(12 + x) OVER w AS b_x, lead(57 + y) OVER w AS b_y FROM v WINDOW w AS (PARTITION BY id ORDER BY pos)) SELECT id, round(sum({_H}), 3) AS metres FROM s WHERE b_x IS NOT NULL GROUP BY ALL")
def haversine_length(spark: SparkSession, d: str) -> DataFrame:
    segs = polyline.segments(polylines(spark, d))
    metres = geo.haversine(F.lit(12) + F.col("ax"), F.lit(57) + F.col("ay"), F.lit(12) + F.col("bx"), F.lit(57) + F.col("by"))
    return segs.groupBy("id").agg(F.round(F.sum(metres), 3).alias("metres"))


@query("projection_round_trip", f"WITH {VERTEX} SELECT id, CAST(pos AS INTEGER) AS pos, round(12 + x, 7) AS lon, round(57 + y, 7) AS lat, true AS near FROM v")
def projection_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Degrees to metres and back."""
    rows = polyline.vertices(polylines(spark, d)).select("id", "pos", (F.lit(12) + F.col("x")).alias("lon"), (F.lit(57) + F.col("y")).alias("lat"))
    x, y = geo.to_sweref(F.col("lon"), F.col("lat"))
    there = rows.withColumns({"e": x, "n": y})
    back = geo.with_wgs84(there, "e", "n", "lon2", "lat2")
    near = (F.abs(F.col("lon2") - F.col("lon")) < 1e-9) & (F.abs(F.col("lat2") - F.col("lat")) < 1e-9)
    return back.select("id", "pos", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), near.alias("near"))


@query("subsegment_samples", f"""WITH {SEGMENT}, p AS (SELECT *, CAST(greatest(1, ceil(length / 0.1)) AS INTEGER) AS n FROM seg)
SELECT id, CAST(pos AS INTEGER) AS pos, CAST(k AS INTEGER) AS k, round(ax + (k + 0.5) / n * (b_x - ax), 6) AS x, round(ay + (k + 0.5) / n * (b_y - ay), 6) AS y FROM p, range(n) AS t(k)""")
def subsegment_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = polyline.subsegment_samples(polyline.segments(polylines(spark, d)), 0.1)
    return rows.select("id", "pos", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("densify", f"""WITH {SEGMENT}, p AS (SELECT *, CAST(greatest(1, ceil(length / 0.2)) + 1 AS INTEGER) AS n FROM seg)
SELECT id, CAST(pos AS INTEGER) AS pos, CAST(k AS INTEGER) AS k, round(ax + k / (n - 1) * (b_x - ax), 6) AS x, round(ay + k / (n - 1) * (b_y - ay), 6) AS y FROM p, range(n) AS t(k)""")
def densify(spark: SparkSession, d: str) -> DataFrame:
    rows = polyline.densify(polyline.segments(polylines(spark, d)), 0.2)
    return rows.select("id", "pos", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _at_sql(wanted: str, count: str) -> str:
    """Points pt (id, j, x, y) at distances along each line, by the segment that holds each."""
    return f"""{SEGMENT}, t AS (SELECT DISTINCT id, total FROM seg), c AS (SELECT id, total, CAST({count} AS INTEGER) AS m FROM t),
w AS (SELECT id, CAST(j AS INTEGER) AS j, {wanted} AS dist FROM c, range(m) AS r(j)),
h AS (SELECT w.id, j, dist, ax, ay, b_x, b_y, along, length, row_number() OVER (PARTITION BY w.id, j ORDER BY along DESC) AS r FROM w JOIN seg ON w.id = seg.id AND along <= dist AND length > 0),
pt AS (SELECT id, j, ax + least(1, (dist - along) / length) * (b_x - ax) AS x, ay + least(1, (dist - along) / length) * (b_y - ay) AS y FROM h WHERE r = 1)"""


_PT = " SELECT id, j, round(x, 5) AS x, round(y, 5) AS y FROM pt"


@query("line_samples", "WITH " + _at_sql("(j + 0.5) / m * total", "greatest(3, floor(total / 0.5))") + _PT)
def line_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = polyline.line_samples(polylines(spark, d), 0.5)
    return rows.select("id", "j", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("line_samples_inclusive", "WITH " + _at_sql("j / (m - 1) * total", "greatest(2, floor(total / 0.5) + 1)") + _PT)
def line_samples_inclusive(spark: SparkSession, d: str) -> DataFrame:
    rows = polyline.line_samples_inclusive(polylines(spark, d), 0.5)
    return rows.select("id", "j", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("interval_samples", "WITH " + _at_sql("(j + 0.5) * 0.5", "ceil((total - 0.25) / 0.5)") + _PT)
def interval_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = polyline.interval_samples(polylines(spark, d), 0.5)
    return rows.select("id", "j", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("line_ends", f"""WITH {VERTEX} SELECT id, round(max(x) FILTER (pos = 0), 6) AS from_x, round(max(y) FILTER (pos = 0), 6) AS from_y, round(max(x) FILTER (pos = 31), 6) AS to_x, round(max(y) FILTER (pos = 31), 6) AS to_y FROM v GROUP BY ALL""")
def line_ends(spark: SparkSession, d: str) -> DataFrame:
    return polylines(spark, d).select("id", polyline.direction_record(F.col("points")).alias("r")).select("id", "r.*")


@query("class_centroids", f"""WITH {VERTEX}, m AS (SELECT id, cls, avg(x) AS x, avg(y) AS y FROM v GROUP BY ALL) SELECT cls, round(avg(x), 8) AS x, round(avg(y), 8) AS y FROM m GROUP BY ALL""")
def class_centroids(spark: SparkSession, d: str) -> DataFrame:
    found = polyline.centroid(polylines(spark, d), "cls")
    return found.select("cls", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


@query("ring_area", f"""WITH {VERTEX}, s AS (SELECT id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM v WINDOW w AS (PARTITION BY id ORDER BY pos))
SELECT id, round(abs(sum(x * ny - nx * y)) / 2, 6) AS area FROM s GROUP BY ALL""")
def ring_area(spark: SparkSession, d: str) -> DataFrame:
    return polylines(spark, d).select("id", F.round(polyline.shoelace(F.col("points")), 6).alias("area"))


@query("delta_encode", f"""WITH {VERTEX}, q AS (SELECT id, pos, CAST(round_even(x * 1e5, 0) AS BIGINT) AS x, CAST(round_even(y * 1e5, 0) AS BIGINT) AS y FROM v)
SELECT id, CAST(pos AS INTEGER) AS pos, x - coalesce(lag(x) OVER w, 0) AS dx, y - coalesce(lag(y) OVER w, 0) AS dy FROM q WINDOW w AS (PARTITION BY id ORDER BY pos)""")
def delta_encode(spark: SparkSession, d: str) -> DataFrame:
    coded = polylines(spark, d).select("id", F.posexplode(polyline.deltas(polyline.quantised(F.col("points")))).alias("pos", "p"))
    return coded.select("id", "pos", F.col("p.x").alias("dx"), F.col("p.y").alias("dy"))


@query("delta_decode", f"""WITH {VERTEX} SELECT id, CAST(pos AS INTEGER) AS pos, CAST(round_even(x * 1e5, 0) AS BIGINT) / 1e5 AS x, CAST(round_even(y * 1e5, 0) AS BIGINT) / 1e5 AS y FROM v""")
def delta_decode(spark: SparkSession, d: str) -> DataFrame:
    """Encoded, with midpoints in long steps, packed to bytes and decoded again."""
    coded = polylines(spark, d).select("id", polyline.deltas(polyline.quantised(F.col("points"))).alias("d"))
    back = coded.select("id", F.posexplode(polyline.undeltas(F.col("d"))).alias("pos", "p"))
    return back.select("id", "pos", "p.x", "p.y")


@query("pack_payload")
def pack_payload(spark: SparkSession, d: str) -> DataFrame:
    """Each line's deltas as base64 of gzipped int16."""
    steps = polyline.deltas(polyline.halved_jumps(polyline.quantised(F.col("points"))))
    coded = polylines(spark, d).select("id", steps.alias("d"))
    return coded.select("id", F.size("d").alias("n"), pack.gzipped(pack.packed_deltas(F.col("d"))).alias("data"))


@query("simplify_lines")
def simplify_lines(spark: SparkSession, d: str) -> DataFrame:
    kept = polylines(spark, d).select("id", polyline.simplify(F.col("points"), 0.1).alias("p"))
    return kept.select("id", F.size("p").alias("n"), F.round(polyline.array_length(F.col("p")), 6).alias("length"))


@query("clip_to_box", f"""WITH {SEGMENT}, c AS (SELECT id, pos, ax, ay, b_x - ax AS dx, b_y - ay AS dy FROM seg),
t AS (SELECT *, greatest(0, coalesce(least((-0.2 - ax) / nullif(dx, 0), (0.2 - ax) / nullif(dx, 0)), 0), coalesce(least((-0.2 - ay) / nullif(dy, 0), (0.2 - ay) / nullif(dy, 0)), 0)) AS t0,
  least(1, coalesce(greatest((-0.2 - ax) / nullif(dx, 0), (0.2 - ax) / nullif(dx, 0)), 1), coalesce(greatest((-0.2 - ay) / nullif(dy, 0), (0.2 - ay) / nullif(dy, 0)), 1)) AS t1 FROM c
  WHERE (dx <> 0 OR ax BETWEEN -0.2 AND 0.2) AND (dy <> 0 OR ay BETWEEN -0.2 AND 0.2))
SELECT id, count(*) AS pieces, round(sum((t1 - t0) * sqrt(dx * dx + dy * dy)), 6) AS length FROM t WHERE t0 <= t1 GROUP BY ALL""")
def clip_to_box(spark: SparkSession, d: str) -> DataFrame:
    cut = polyline.clip_to_box(polylines(spark, d), (-0.2, -0.2, 0.2, 0.2))
    length = geo.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return cut.groupBy("id").agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum(length), 6).alias("length"))


@query("line_middle_part", f"""WITH {SEGMENT}, m AS (SELECT id, along, length, total, greatest(along, total * 0.25) AS a, least(along + length, total * 0.75) AS b FROM seg)
SELECT id, round(sum(b - a), 5) AS length FROM m WHERE a < b GROUP BY ALL""")
def line_middle_part(spark: SparkSession, d: str) -> DataFrame:
    """The length of the middle half of each line, cut out with interpolated ends and turned round."""
    total = polyline.array_length(F.col("points"))
    part = polylines(spark, d).withColumn("total", total).select("id", polyline.substring(F.col("points"), F.col("total") * 0.75, F.col("total") * 0.25).alias("p"))
    return part.select("id", F.round(polyline.array_length(F.col("p")), 5).alias("length"))


@query("line_pieces", f"""WITH {SEGMENT}, t AS (SELECT DISTINCT id, total FROM seg) SELECT id, CAST(greatest(1, round_even(total / 0.6, 0)) AS BIGINT) AS pieces, round(total, 5) AS total FROM t""")
def line_pieces(spark: SparkSession, d: str) -> DataFrame:
    """How many pieces of about 0.6 each line makes, and their lines' lengths."""
    made = polyline.pieces(polylines(spark, d), 0.6)
    lengths = polylines(spark, d).select("id", polyline.array_length(F.col("points")).alias("total"))
    return made.groupBy("id").agg(F.count(F.lit(1)).alias("pieces")).join(lengths, "id").select("id", "pieces", F.round("total", 5).alias("total"))


@query("piece_dedupe", f"""WITH {VERTEX}, r AS (SELECT *, row_number() OVER (PARTITION BY cls, floor(x / {_CELL}), floor(y / {_CELL}) ORDER BY id, pos) AS r FROM v) SELECT cls, id, CAST(pos AS INTEGER) AS pos FROM r WHERE r = 1""")
def piece_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = polyline.vertices(polylines(spark, d))
    return polyline.first_per_cell(rows, "cls", F.col("x"), F.col("y"), _CELL, ["id", "pos"]).select("cls", "id", "pos")


@query("split_at_shared_nodes", f"""WITH {VERTEX}, n AS (SELECT id, pos, x, y, CAST(round_even(x * 10, 0) AS BIGINT) AS nx, CAST(round_even(y * 10, 0) AS BIGINT) AS ny FROM v),
u AS (SELECT nx, ny, sum(CASE WHEN pos IN (0, 31) THEN 2 ELSE 1 END) AS uses FROM n GROUP BY ALL),
c AS (SELECT n.*, (uses > 1 AND pos > 0 AND pos < 31) AS cut FROM n JOIN u USING (nx, ny)),
p AS (SELECT *, sum(CAST(cut AS INTEGER)) OVER (PARTITION BY id ORDER BY pos) AS piece FROM c),
a AS (SELECT id, piece, pos, x, y FROM p UNION ALL SELECT id, piece - 1, pos, x, y FROM p WHERE cut)
SELECT id, CAST(piece AS INTEGER) AS piece, count(*) AS vertices FROM a GROUP BY ALL HAVING max(x) > min(x) OR max(y) > min(y)""")
def split_at_shared_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = polyline.split_at_shared_nodes(polylines(spark, d), digits=1)
    return rows.groupBy("id", "piece").agg(F.count(F.lit(1)).alias("vertices"))


@query("grid_cells", f"""WITH {VERTEX} SELECT CAST(floor((x + 1) / {_CELL}) AS BIGINT) AS ix, CAST(floor((y + 1) / {_CELL}) AS BIGINT) AS iy, count(*) AS n, count(DISTINCT id) AS lines FROM v GROUP BY ALL""")
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    ix, iy = bins.cell_index(F.col("x"), F.col("y"), -1.0, -1.0, _CELL)
    rows = polyline.vertices(polylines(spark, d)).select("id", ix.alias("ix"), iy.alias("iy"))
    # Counts by line and cell come first, so that the distinct count is of rows already summed.
    once = rows.groupBy("id", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("ix", "iy").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("lines"))


@query("grid_road_cells", f"""WITH {_at_sql("j / (m - 1) * total", "greatest(2, floor(total / 0.1) + 1)")}, q AS (SELECT DISTINCT id, floor((x + 1) / 0.25) AS ix, floor((y + 1) / 0.25) AS iy FROM pt)
SELECT CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, label AS cls, count(*) AS roads, CAST(sum(id) AS BIGINT) AS count FROM q JOIN embeddings ON vec_id = id GROUP BY ALL""")
def grid_road_cells(spark: SparkSession, d: str) -> DataFrame:
    """Each cell that a line passes gets the line's count (here its id) once, by class."""
    rows = polyline.line_samples_inclusive(polylines(spark, d), 0.1)
    ix, iy = bins.cell_index(F.col("x"), F.col("y"), -1.0, -1.0, 0.25)
    once = rows.select("id", "cls", ix.alias("ix"), iy.alias("iy")).distinct()
    return once.groupBy("ix", "iy", "cls").agg(F.count(F.lit(1)).alias("roads"), F.sum("id").alias("count"))


@query("topk_per_cell", f"""WITH {VERTEX}, c AS (SELECT floor((x + 1) / {_CELL}) AS ix, floor((y + 1) / {_CELL}) AS iy, cls, count(*) AS n FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY n DESC, cls) AS rank FROM c) SELECT CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, cls, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def topk_per_cell(spark: SparkSession, d: str) -> DataFrame:
    ix, iy = bins.cell_index(F.col("x"), F.col("y"), -1.0, -1.0, _CELL)
    counts = polyline.vertices(polylines(spark, d)).groupBy(ix.alias("ix"), iy.alias("iy"), "cls").agg(F.count(F.lit(1)).alias("n"))
    return stats.top_per_group(counts, ["ix", "iy"], [F.col("n").desc(), F.col("cls")], 3)


_NET = f"{VERTEX}, net AS (SELECT id AS target, x, y FROM v WHERE cls < 5), probe AS (SELECT id, pos, x, y FROM v WHERE cls >= 5)"
_PAIR = "sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y))"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = polyline.vertices(polylines(spark, d))
    return rows.where("cls >= 5").select("id", "pos", "x", "y"), rows.where("cls < 5").select(F.col("id").alias("target"), "x", "y")


@query("nearest_within", f"""WITH {_NET}, h AS (SELECT p.id, p.pos, min(({_PAIR}, target)) AS b FROM probe p JOIN net n ON abs(p.x - n.x) < 0.01 AND abs(p.y - n.y) < 0.01 AND {_PAIR} < 0.01 GROUP BY ALL)
SELECT p.id, CAST(p.pos AS INTEGER) AS pos, round(b[1], 6) AS distance, b[2] AS target FROM probe p LEFT JOIN h ON h.id = p.id AND h.pos = p.pos""")
def nearest_within(spark: SparkSession, d: str) -> DataFrame:
    probes, net = _sides(spark, d)
    found = snap.nearest(probes, net, 0.01, ["id", "pos"], "target")
    return found.select("id", "pos", F.round("distance", 6).alias("distance"), "target")


@query("radius_max", f"""WITH {_NET}, h AS (SELECT p.id, p.pos, max(target) AS busiest FROM probe p JOIN net n ON abs(p.x - n.x) <= 0.01 AND abs(p.y - n.y) <= 0.01 AND {_PAIR} <= 0.01 GROUP BY ALL)
SELECT p.id, CAST(p.pos AS INTEGER) AS pos, busiest FROM probe p LEFT JOIN h ON h.id = p.id AND h.pos = p.pos""")
def radius_max(spark: SparkSession, d: str) -> DataFrame:
    probes, net = _sides(spark, d)
    return snap.busiest_around(probes, net.withColumnRenamed("target", "busiest"), 0.01, ["id", "pos"], "busiest").select("id", "pos", "busiest")


_HITS = f"{_NET}, h AS (SELECT p.id, p.pos, min(({_PAIR}, target)) AS b FROM probe p JOIN net n ON abs(p.x - n.x) < 0.02 AND abs(p.y - n.y) < 0.02 AND {_PAIR} < 0.02 GROUP BY ALL), s AS (SELECT p.id, p.pos, b[2] % 10 AS name, b[1] AS away FROM probe p LEFT JOIN h ON h.id = p.id AND h.pos = p.pos)"


@query("majority_vote", f"""WITH {_HITS}, c AS (SELECT id, name, count(*) AS votes FROM s GROUP BY ALL), t AS (SELECT id, CAST(sum(votes) AS BIGINT) AS samples FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, name DESC) AS r FROM c WHERE name IS NOT NULL)
SELECT r.id, name, votes, samples FROM r JOIN t ON t.id = r.id WHERE r = 1 AND votes / samples >= 0.2""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """The network line, by the last digit of its number, that most vertices of a line are near."""
    probes, net = _sides(spark, d)
    hits = snap.nearest(probes, net, 0.02, ["id", "pos"], "target").withColumn("name", F.col("target") % 10)
    return snap.majority(hits, "id", "name", 0.2)


@query("snap_median", f"""WITH {_HITS} SELECT id, CASE WHEN avg(CASE WHEN away IS NULL THEN 0.0 ELSE 1.0 END) >= 0.5 THEN round(median(away), 6) END AS away FROM s GROUP BY ALL""")
def snap_median(spark: SparkSession, d: str) -> DataFrame:
    probes, net = _sides(spark, d)
    hits = snap.nearest(probes, net, 0.02, ["id", "pos"], "target").withColumnRenamed("distance", "away")
    return snap.median_if_hit(hits, "id", "away").withColumn("away", F.round("away", 6))


@query("pairs_within", f"""WITH {VERTEX}, e AS (SELECT id, x, y FROM v WHERE pos = 0) SELECT p.id AS a, n.id AS b, round({_PAIR}, 6) AS distance FROM e p JOIN e n ON p.id < n.id AND abs(p.x - n.x) <= 0.05 AND abs(p.y - n.y) <= 0.05 AND {_PAIR} <= 0.05""")
def pairs_within(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose first points are close."""
    firsts = polylines(spark, d).select("id", F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))
    return snap.pairs_within(firsts, 0.05).withColumn("distance", F.round("distance", 6))


@query("nearest_unbounded", f"""WITH {VERTEX}, p AS (SELECT id, x, y FROM v WHERE pos = 0 AND cls >= 5), n AS (SELECT id AS target, x, y FROM v WHERE pos = 0 AND cls < 5)
SELECT p.id, round(min({_PAIR}), 6) AS distance FROM p, n GROUP BY ALL""")
def nearest_unbounded(spark: SparkSession, d: str) -> DataFrame:
    firsts = polylines(spark, d).select("id", "cls", F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))
    probes, net = firsts.where("cls >= 5").select("id", "x", "y"), firsts.where("cls < 5").select(F.col("id").alias("target"), "x", "y")
    return snap.nearest_in_rings(probes, net, 0.1, ["id"], "target").select("id", F.round("distance", 6).alias("distance"))


@query("route_candidates", f"""WITH {VERTEX}, t AS (SELECT id, max(x) FILTER (pos = 0) AS x1, max(y) FILTER (pos = 0) AS y1, max(x) FILTER (pos = 31) AS x2, max(y) FILTER (pos = 31) AS y2 FROM v WHERE cls >= 5 GROUP BY ALL),
r AS (SELECT id AS route, x, y FROM v WHERE cls < 5),
a AS (SELECT t.id, route, min(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y))) AS d1, min(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) AS d2 FROM t, r GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d1 + d2, route) AS r FROM a WHERE d1 <= 0.06 AND d2 <= 0.06) SELECT id, route, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM b WHERE r = 1""")
def route_candidates(spark: SparkSession, d: str) -> DataFrame:
    lines = polylines(spark, d)
    e = polyline.ends(F.col("points"))
    asked = lines.where("cls >= 5").select("id", e["first"]["x"].alias("x1"), e["first"]["y"].alias("y1"), e["last"]["x"].alias("x2"), e["last"]["y"].alias("y2"))
    verts = polyline.vertices(lines.where("cls < 5")).select(F.col("id").alias("route"), "x", "y")
    return snap.route_candidates(asked, verts, 0.06).select("id", "route", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query("flow_assignment", f"""WITH {SEGMENT}, p AS (SELECT *, CAST(greatest(1, ceil(length / 0.1)) AS INTEGER) AS n FROM seg WHERE cls >= 5),
s AS (SELECT id AS trip_id, ax + (k + 0.5) / n * (b_x - ax) AS x, ay + (k + 0.5) / n * (b_y - ay) AS y, CAST(greatest(least(floor((28800 + (along + (k + 0.5) / n * length) / total * 3600) / 900) - 12, 83), 0) AS INTEGER) AS bin, pos, k FROM p, range(n) AS r(k)),
net AS (SELECT id AS edge_id, x, y FROM v WHERE cls < 5),
h AS (SELECT p.trip_id, p.pos, p.k, p.bin, min(({_PAIR}, edge_id)) AS b FROM s p JOIN net n ON abs(p.x - n.x) < 0.01 AND abs(p.y - n.y) < 0.01 AND {_PAIR} < 0.01 GROUP BY ALL),
u AS (SELECT DISTINCT trip_id, b[2] AS edge_id, bin FROM h) SELECT edge_id, bin, count(*) AS trips FROM u GROUP BY ALL""")
def flow_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Lines of classes 5 to 9 as one-hour trips, sampled and snapped to the vertices of the others: trips by street and quarter."""
    lines = polylines(spark, d)
    samples = polyline.subsegment_samples(polyline.segments(lines.where("cls >= 5")), 0.1)
    bin_ = bins.time_bin(bins.time_at(F.col("at"), F.col("total"), F.lit(28_800.0), F.lit(32_400.0)))
    probes = samples.select(F.col("id").alias("trip_id"), "pos", "k", bin_.alias("bin"), "x", "y")
    net = polyline.vertices(lines.where("cls < 5")).select(F.col("id").alias("edge_id"), "x", "y")
    hits = snap.nearest(probes, net, 0.01, ["trip_id", "pos", "k", "bin"], "edge_id").where(F.col("edge_id").isNotNull())
    return flows.distinct_load(hits, "trip_id", ["edge_id", "bin"]).withColumnRenamed("n", "trips")
