"""Queries that assign whole trips to a network, and on rows of lines and roads that are looked up one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import bins, geo, text
from tramline.operators import flows, graph, pack, polyline, snap, stats, views
from tramline.operators import roads as ops
from tramline.plans.base import COUNTS, ROAD, SEGMENT, TRIP, VERTEX, directed_roads, polylines, table, trips
from tramline.plans.registry import query
from tramline.plans.roads import undirected

# Junctions are vertices rounded to tenths. An edge is as long as its line's segment and the way between its junctions
# together, so no search finds a way that is shorter than the straight one.
_JUNCTION = f"""{SEGMENT}, js AS (SELECT id || ':' || pos AS edge_id, cls, CAST(round_even(ax * 10, 0) AS BIGINT) AS sx, CAST(round_even(ay * 10, 0) AS BIGINT) AS sy,
  CAST(round_even(b_x * 10, 0) AS BIGINT) AS tx, CAST(round_even(b_y * 10, 0) AS BIGINT) AS ty, length FROM seg),
jn AS (SELECT edge_id, cls, sx || ':' || sy AS src, tx || ':' || ty AS dst, length + sqrt((tx / 10.0 - sx / 10.0) * (tx / 10.0 - sx / 10.0) + (ty / 10.0 - sy / 10.0) * (ty / 10.0 - sy / 10.0)) AS length FROM js WHERE sx <> tx OR sy <> ty),
je AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min((length, edge_id)) AS e FROM jn WHERE {{where}} GROUP BY ALL),
arc AS (SELECT a, b, e[1] AS length, e[2] AS edge_id FROM je UNION ALL SELECT b, a, e[1], e[2] FROM je),
nd AS (SELECT DISTINCT a AS id, CAST(split_part(a, ':', 1) AS BIGINT) / 10.0 AS x, CAST(split_part(a, ':', 2) AS BIGINT) / 10.0 AS y FROM arc),
sp(source, node, dist) USING KEY (source, node) AS (SELECT id, id, CAST(0 AS DOUBLE) FROM nd
  UNION SELECT sp.source, arc.b, min(sp.dist + arc.length) FROM sp JOIN arc ON arc.a = sp.node LEFT JOIN recurring.sp AS r ON r.source = sp.source AND r.node = arc.b WHERE r.dist IS NULL OR sp.dist + arc.length < r.dist GROUP BY ALL),
pr AS (SELECT f.source, arc.b AS node, min((arc.a, arc.edge_id)) AS p FROM sp f JOIN arc ON arc.a = f.node JOIN sp t ON t.source = f.source AND t.node = arc.b AND f.dist + arc.length = t.dist GROUP BY ALL)"""


def _network(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Junctions (id, x, y) and edges (edge_id, src, dst, length), of parallel ones the shortest."""
    segs = polyline.segments(lines).select(F.concat_ws(":", "id", "pos").alias("edge_id"), "ax", "ay", "bx", "by", "length")
    nodes, edges = graph.junctions(segs)
    at = [nodes.select(F.col("id").alias(n), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y")) for n in ("src", "dst")]
    chord = geo.hypot(F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y"))
    edges = edges.join(at[0], "src").join(at[1], "dst").withColumn("length", F.col("length") + chord)
    least = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min(F.struct("length", "edge_id")).alias("b"))
    return nodes, least.select("b.edge_id", "src", "dst", "b.length")


@query("bounded_paths", f"""WITH RECURSIVE {_JUNCTION.format(where="true")}, en AS (SELECT id, max(CASE WHEN pos = 0 THEN round_even(x * 10, 0) END) AS sx, max(CASE WHEN pos = 0 THEN round_even(y * 10, 0) END) AS sy,
  max(CASE WHEN pos = 31 THEN round_even(x * 10, 0) END) AS tx, max(CASE WHEN pos = 31 THEN round_even(y * 10, 0) END) AS ty, max(CASE WHEN pos = 0 THEN x END) AS ax, max(CASE WHEN pos = 0 THEN y END) AS ay,
  max(CASE WHEN pos = 31 THEN x END) AS b_x, max(CASE WHEN pos = 31 THEN y END) AS b_y FROM v GROUP BY ALL),
pq AS (SELECT CAST(sx AS BIGINT) || ':' || CAST(sy AS BIGINT) AS src, CAST(tx AS BIGINT) || ':' || CAST(ty AS BIGINT) AS dst, max(sqrt((b_x - ax) * (b_x - ax) + (b_y - ay) * (b_y - ay))) AS chord FROM en GROUP BY ALL),
fd AS (SELECT src, dst FROM pq JOIN sp ON source = src AND node = dst WHERE src <> dst AND dist <= chord * 3.2 + 0.06),
pa(src, dst, node) AS (SELECT src, dst, dst FROM fd UNION ALL SELECT src, dst, p[1] FROM pa JOIN pr ON pr.source = src AND pr.node = pa.node WHERE pa.node <> src)
SELECT src, dst, count(*) - 1 AS edges FROM pa GROUP BY ALL""")
def bounded_paths(spark: SparkSession, d: str) -> DataFrame:
    """A* from the first to the last vertex of each line over the junctions of all, within 3.2 times the chord."""
    lines = polylines(spark, d)
    nodes, edges = _network(lines)
    e = polyline.ends(F.col("points"))
    name = lambda p: F.concat_ws(":", F.bround(p["x"] * 10, 0).cast("long"), F.bround(p["y"] * 10, 0).cast("long"))
    chord = geo.hypot(e["last"]["x"] - e["first"]["x"], e["last"]["y"] - e["first"]["y"])
    pairs = lines.select(name(e["first"]).alias("src"), name(e["last"]).alias("dst"), chord.alias("chord")).where("src != dst")
    paths = graph.bounded_paths(pairs, nodes, edges, factor=3.2, slack=0.06, tile=0.5)
    return paths.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("edges"))


_BIN = "CAST(greatest(least(floor((28800 + {at} / total * 3600) / 900) - 12, 83), 0) AS INTEGER)"


@query("whole_flow_assignment", f"""WITH RECURSIVE {_JUNCTION.format(where="cls < 5")}, pc AS (SELECT id AS trip, pos, ax, ay, b_x, b_y, length, along, total FROM seg WHERE cls >= 5),
fe AS (SELECT trip, pos, 'a' AS e, ax AS x, ay AS y FROM pc WHERE length > 0.3 UNION ALL SELECT trip, pos, 'b', b_x, b_y FROM pc WHERE length > 0.3),
jx AS (SELECT trip, pos, e, min((sqrt((fe.x - nd.x) * (fe.x - nd.x) + (fe.y - nd.y) * (fe.y - nd.y)), nd.id)) AS h FROM fe JOIN nd ON abs(fe.x - nd.x) <= 0.06 AND abs(fe.y - nd.y) <= 0.06 WHERE sqrt((fe.x - nd.x) * (fe.x - nd.x) + (fe.y - nd.y) * (fe.y - nd.y)) <= 0.06 GROUP BY ALL),
lp AS (SELECT a.trip, a.pos, a.h[2] AS src, b.h[2] AS dst FROM jx a JOIN jx b ON a.trip = b.trip AND a.pos = b.pos AND a.e = 'a' AND b.e = 'b' WHERE a.h[2] <> b.h[2]),
ok AS (SELECT lp.*, {_BIN.format(at="(along + length / 2)")} AS bin FROM lp JOIN pc ON pc.trip = lp.trip AND pc.pos = lp.pos JOIN sp ON source = src AND node = dst WHERE dist <= length * 3.2 + 0.06),
pa(src, dst, node, edge_id) AS (SELECT DISTINCT src, dst, dst, CAST(NULL AS VARCHAR) FROM ok UNION ALL SELECT src, dst, p[1], p[2] FROM pa JOIN pr ON pr.source = src AND pr.node = pa.node WHERE pa.node <> src),
sm AS (SELECT pc.trip, pc.pos, ax + (k + 0.5) / n * (b_x - ax) AS x, ay + (k + 0.5) / n * (b_y - ay) AS y, {_BIN.format(at="(along + (k + 0.5) / n * length)")} AS bin, k FROM (SELECT *, CAST(greatest(1, ceil(length / 0.1)) AS INTEGER) AS n FROM pc) pc, range(n) AS r(k)
  WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.trip = pc.trip AND ok.pos = pc.pos)),
net AS (SELECT id || ':' || pos AS edge_id, x, y FROM v WHERE cls < 5 AND pos < 31),
sn AS (SELECT s.trip, s.pos, s.k, s.bin, min((sqrt((s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y)), edge_id)) AS h FROM sm s JOIN net n ON abs(s.x - n.x) < 0.01 AND abs(s.y - n.y) < 0.01 AND sqrt((s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y)) < 0.01 GROUP BY ALL),
al AS (SELECT trip, h[2] AS edge_id, bin FROM sn UNION SELECT trip, edge_id, bin FROM ok JOIN pa USING (src, dst) WHERE edge_id IS NOT NULL)
SELECT edge_id, bin, count(*) AS trips FROM al GROUP BY ALL""")
def whole_flow_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Lines of classes 5 to 9 as one-hour trips on the network of the others: pieces up to 0.3 by snapping, longer ones by their
    path between junctions, and by snapping where there is none: trips by edge and quarter hour."""
    lines = polylines(spark, d)
    net = lines.where("cls < 5")
    nodes, edges = _network(net)
    points = polyline.segments(net).select(F.concat_ws(":", "id", "pos").alias("edge_id"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    pieces = polyline.segments(lines.where("cls >= 5")).withColumnsRenamed({"id": "trip_id", "pos": "piece"}).withColumns({"t0": F.lit(28_800.0), "t1": F.lit(32_400.0)})
    found = flows.assigned(pieces, points, nodes, edges, 0.3, 0.1, 0.01, 0.06, factor=3.2, slack=0.06, tile=0.5)
    return found.groupBy("edge_id", "bin").agg(F.count(F.lit(1)).alias("trips"))


_TRANSIT = f"""{VERTEX}, g AS (SELECT id, cls, pos, CAST(round_even(x / 0.1, 0) AS BIGINT) AS gx, CAST(round_even(y / 0.1, 0) AS BIGINT) AS gy FROM v WHERE cls < 5),
r AS (SELECT gx, gy, lead(gx) OVER w AS hx, lead(gy) OVER w AS hy FROM g WINDOW w AS (PARTITION BY id ORDER BY pos)),
n AS (SELECT DISTINCT gx, gy, gx || ':' || gy AS id, gx * CAST(0.1 AS DOUBLE) AS x, gy * CAST(0.1 AS DOUBLE) AS y FROM g),
e AS (SELECT gx || ':' || gy AS a, hx || ':' || hy AS b, CAST(round(1000 * round(sqrt((hx - gx) * (hx - gx) + (hy - gy) * (hy - gy)), 6), 0) AS BIGINT) AS w FROM r WHERE hx IS NOT NULL AND (hx <> gx OR hy <> gy)
  UNION ALL SELECT p.id, q.id, CAST(round(1000 * round(sqrt((p.gx - q.gx) * (p.gx - q.gx) + (p.gy - q.gy) * (p.gy - q.gy)), 6), 0) AS BIGINT) + 2500 FROM n p JOIN n q ON p.id < q.id AND (p.gx - q.gx) * (p.gx - q.gx) + (p.gy - q.gy) * (p.gy - q.gy) <= 4),
ed AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(w) AS weight FROM e GROUP BY ALL), arc AS (SELECT a, b, weight FROM ed UNION ALL SELECT b, a, weight FROM ed)"""


@query("network_routes", f"""WITH RECURSIVE {_TRANSIT}, o AS (SELECT id AS trip, max(CASE WHEN pos = 0 THEN x END) AS ax, max(CASE WHEN pos = 0 THEN y END) AS ay, max(CASE WHEN pos = 31 THEN x END) AS b_x, max(CASE WHEN pos = 31 THEN y END) AS b_y FROM v WHERE cls >= 5 GROUP BY ALL),
fe AS (SELECT trip, 'a' AS e, ax AS x, ay AS y FROM o WHERE ax < b_x UNION ALL SELECT trip, 'b', b_x, b_y FROM o WHERE ax < b_x),
jx AS (SELECT trip, e, min((sqrt((fe.x - n.x) * (fe.x - n.x) + (fe.y - n.y) * (fe.y - n.y)), n.id)) AS h FROM fe JOIN n ON sqrt((fe.x - n.x) * (fe.x - n.x) + (fe.y - n.y) * (fe.y - n.y)) < 0.2 GROUP BY ALL),
pq AS (SELECT a.trip, a.h[2] AS src, b.h[2] AS dst FROM jx a JOIN jx b ON a.trip = b.trip AND a.e = 'a' AND b.e = 'b' WHERE a.h[2] <> b.h[2]),
sp(source, node, dist) USING KEY (source, node) AS (SELECT DISTINCT src, src, CAST(0 AS BIGINT) FROM pq
  UNION SELECT sp.source, arc.b, min(sp.dist + weight) FROM sp JOIN arc ON arc.a = sp.node LEFT JOIN recurring.sp AS r ON r.source = sp.source AND r.node = arc.b WHERE r.dist IS NULL OR sp.dist + weight < r.dist GROUP BY ALL),
pr AS (SELECT f.source, arc.b AS node, min(arc.a) AS pred FROM sp f JOIN arc ON arc.a = f.node JOIN sp t ON t.source = f.source AND t.node = arc.b AND f.dist + weight = t.dist GROUP BY ALL),
pa(src, dst, node, k) AS (SELECT DISTINCT src, dst, dst, 0 FROM pq JOIN sp ON source = src AND node = dst UNION ALL SELECT src, dst, pred, k + 1 FROM pa JOIN pr ON pr.source = src AND pr.node = pa.node WHERE pa.node <> src),
wy AS (SELECT src, dst, count(*) AS nodes, sum(n.x) AS sx, sum(n.y * (1 + k)) AS sy FROM pa JOIN n ON n.id = pa.node GROUP BY ALL)
SELECT o.trip, CASE WHEN wy.src IS NULL THEN CASE WHEN ax < b_x THEN 'straight' ELSE 'osm_route' END ELSE 'osm_network' END AS match, CAST(CASE WHEN wy.src IS NULL THEN 32 ELSE wy.nodes + 2 END AS INTEGER) AS n,
  round(sx, 6) AS sx, round(sy, 6) AS sy FROM o LEFT JOIN pq ON pq.trip = o.trip LEFT JOIN wy ON wy.src = pq.src AND wy.dst = pq.dst""")
def network_routes(spark: SparkSession, d: str) -> DataFrame:
    """Trips (lines of classes 5 to 9) that go east count as not matched: where there is one, they get a way over the transit
    network of the other lines, with transfers. Its nodes are summed, the later ones with more weight."""
    lines = polylines(spark, d)
    verts = polyline.vertices(lines.where("cls < 5")).select(F.col("id").alias("route"), "pos", "x", "y")
    nodes, edges = _transit(verts)
    e = polyline.ends(F.col("points"))
    match = F.when(e["first"]["x"] < e["last"]["x"], "straight").otherwise("osm_route")
    asked = lines.where("cls >= 5").select(F.col("id").alias("trip_id"), match.alias("match"), "points")
    found = flows.network_routes(asked, nodes, edges, 0.2)
    rows = flows.rerouted(asked, found)
    inner = F.slice("points", 2, F.size("points") - 2)
    total = lambda c, w: F.when(F.col("match") == "osm_network", F.round(F.aggregate(F.transform(inner, w(c)), F.lit(0.0), lambda t, v: t + v), 6))
    plain = lambda c: lambda p: p[c]
    weighted = lambda c: lambda p, i: p[c] * (F.size("points") - 2 - i)
    return rows.select(F.col("trip_id").alias("trip"), "match", F.size("points").alias("n"), total("x", plain).alias("sx"), total("y", weighted).alias("sy"))


def _transit(verts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The transit graph with weights in whole thousandths of a grid step, so that ways of one length are ties in any engine."""
    nodes, edges = graph.transit_graph(verts, 0.1, 0.2000001, 1000.0)
    ride = F.col("weight") < 1000
    steps = F.round(F.when(ride, F.col("weight")).otherwise(F.col("weight") - 1000) / 0.1, 6) * 1000
    return nodes, edges.select("a", "b", (F.round(steps, 0).cast("long") + F.when(ride, 0).otherwise(2500)).alias("weight"))


@query("checked_flows", """SELECT l_partkey AS p_partkey, p_brand, count(*) AS trips FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def checked_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flows with their streets, of which none may be missing."""
    flow = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("trips"))
    return ops.checked_join(flow, table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").select("p_partkey", "p_brand", "trips")


@query("zero_filled_roads", """WITH f AS (SELECT l_partkey, sum(l_quantity) AS car FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY ALL) SELECT p_partkey, coalesce(car, 0) AS car FROM part LEFT JOIN f ON l_partkey = p_partkey""")
def zero_filled_roads(spark: SparkSession, d: str) -> DataFrame:
    cars = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("car"))
    return ops.with_zero(table(spark, d, "part").select("p_partkey"), cars, "p_partkey", "car")


@query("tagged_segments", """SELECT l_orderkey, l_linenumber, coalesce(p_type, '') AS tag FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25""")
def tagged_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments with the tags of their way, blank where it has none."""
    tags = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("tag"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(tags, "l_partkey", "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("tag", F.lit("")).alias("tag"))


@query("ordinal_lookup", """WITH n AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS o FROM (SELECT DISTINCT p_name FROM part)) SELECT l_orderkey, l_linenumber, p_name AS name FROM lineitem LEFT JOIN n ON o = l_suppkey % 60""")
def ordinal_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that stand for places in a sorted vocabulary; some are beyond its end."""
    names = table(spark, d, "part").select("p_name").distinct()
    starts = flows.row_starts(names, "p_name").select(F.col("ordinal").cast("long").alias("ordinal"), F.col("p_name").alias("name"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_suppkey", F.lit(60)).alias("o"))
    return ops.looked_up(rows, "o", starts, "name").drop("o")


@query("source_records", f"""WITH {ROAD}, rc AS (SELECT least(u, v) AS lo, greatest(u, v) AS hi, key, c0, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS r, px, py FROM
  (SELECT l_suppkey AS u, l_partkey % (SELECT count(*) FROM supplier) AS v, l_linenumber AS key, l_quantity AS c0, l_tax AS px, l_discount AS py, * FROM lineitem)),
s AS (SELECT lo, hi, key, count(*) AS n, string_agg(r, ' + ' ORDER BY r) AS rows, sum(c0) AS source_c0, min_by(px, r) AS x, min_by(py, r) AS y FROM rc GROUP BY ALL)
SELECT lo || '-' || hi || '-' || key AS pair, n AS n_directions, rows, source_c0, x, y, c0 = source_c0 AS matches FROM road JOIN s USING (lo, hi, key) WHERE x BETWEEN 0.02 AND 0.06 AND y BETWEEN 0.0 AND 0.05""")
def source_records(spark: SparkSession, d: str) -> DataFrame:
    """Roads beside the sum of their source records, of those whose first record lies in a box."""
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    items = flows.running_sum(table(spark, d, "lineitem"), [F.col(c) for c in order], F.lit(1).cast("long"), "r")
    n = table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))  # one row
    u, v = F.col("l_suppkey"), F.pmod("l_partkey", "n")
    pair = lambda lo, hi, key: F.concat_ws("-", lo, hi, key).alias("pair")
    records = items.join(F.broadcast(n)).select(pair(F.least(u, v), F.greatest(u, v), "l_linenumber"), "r", F.col("l_tax").alias("x"), F.col("l_discount").alias("y"), F.col("l_quantity").alias("c0"))
    roads = undirected(spark, d).select(pair("lo", "hi", "key"), "c0")
    found = ops.with_sources(roads, records, "pair", ["c0"], ["r"], (0.02, 0.0, 0.06, 0.05))
    return found.select("pair", "n_directions", "rows", "source_c0", "x", "y", "matches")


@query("phone_tooltip", f"""WITH {ROAD}, m AS (SELECT lo, hi, key FROM road WHERE c8 > 200 OR c8 > 0 ORDER BY c8 DESC, lo, hi, key LIMIT 1), t AS (SELECT greatest(1, sum(c0)) AS t0, greatest(1, sum(c8)) AS t8 FROM road)
SELECT lo || '-' || hi || '-' || key AS pair, CAST(c8 AS BIGINT) AS k, c8 < 5 AS thin, c0, CAST(key AS INTEGER) AS lanes, round(c8 / key, 6) AS per_lane, round((c0 / t0) / (c8 / t8), 6) AS slow_index, highway AS names FROM road JOIN m USING (lo, hi, key), t""")
def phone_tooltip(spark: SparkSession, d: str) -> DataFrame:
    """All that is known of the busiest road at the highest speed filter."""
    named = ops.undirected(directed_roads(spark, d), COUNTS, most=["ms"]).join(
        directed_roads(spark, d).groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "key").agg(F.min("highway").alias("names")), ["lo", "hi", "key"]
    )
    rows = ops.with_slow_index(named, "c0", "c8").withColumns({"pair": F.concat_ws("-", "lo", "hi", "key"), "lanes": F.col("key").cast("int")})
    best = rows.where("c8 > 0").orderBy(F.col("c8").desc(), "lo", "hi", "key").select("pair").first()[0]
    found = views.road_tooltip(rows, "pair", best, "c8", rows.select("pair", "names"))
    return found.select("pair", "k", "thin", "c0", "lanes", F.round("per_lane", 6).alias("per_lane"), F.round("slow_index", 6).alias("slow_index"), "names")


@query("packed_keys", f"""WITH {TRIP} SELECT trip_id, (person * 100 + CAST(floor(t_start / 900) AS BIGINT)) * 7 + trip_id % 7 AS packed, person AS a, CAST(floor(t_start / 900) AS BIGINT) AS b, trip_id % 7 AS c FROM trip""")
def packed_keys(spark: SparkSession, d: str) -> DataFrame:
    """Person, quarter hour and a digit packed into one number, and unpacked."""
    key = bins.packed_key([(F.col("person"), 1 << 40), (F.floor(F.col("t_start") / 900), 100), (F.pmod("trip_id", F.lit(7)), 7)])
    rows = trips(spark, d).select("trip_id", key.alias("packed"))
    return rows.select("trip_id", "packed", *[p.alias(n) for p, n in zip(bins.unpacked_key(F.col("packed"), [1 << 40, 100, 7]), "abc", strict=True)])


@query("fallback_routes", f"""WITH {VERTEX} SELECT id, CAST(CASE WHEN cls < 5 THEN 32 ELSE 2 END AS INTEGER) AS n, round(max(CASE WHEN pos = 0 THEN x END), 6) AS x0, round(max(CASE WHEN pos = 31 THEN y END), 6) AS y1 FROM v WHERE cls <> 9 GROUP BY ALL""")
def fallback_routes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of classes 5 to 8 have lost their route and get the straight one; those of class 9 their ends too, and go."""
    lost, gone = F.col("cls") >= 5, F.col("cls") == 9
    e = polyline.ends(F.col("points"))
    at = lambda side, c: F.when(~gone, e[side][c])
    route = text.route_or_straight(F.when(~lost, F.col("points")), (at("first", "x"), at("first", "y")), (at("last", "x"), at("last", "y")))
    rows = polylines(spark, d).select("id", route.alias("p")).where(F.col("p").isNotNull())
    return rows.select("id", F.size("p").alias("n"), F.round(F.col("p")[0]["x"], 6).alias("x0"), F.round(F.element_at("p", -1)["y"], 6).alias("y1"))


@query("vertex_flags", f"""WITH {VERTEX} SELECT id, CAST(pos AS INTEGER) AS pos, CAST(row_number() OVER w - 1 AS INTEGER) AS start, pos = 2 AS first, lead(pos) OVER w IS NULL AS last FROM v WHERE pos >= 2 AND pos % 3 = 2 WINDOW w AS (PARTITION BY id ORDER BY pos)""")
def vertex_flags(spark: SparkSession, d: str) -> DataFrame:
    """First and last flags and running numbers of every third vertex of each line."""
    rows = polyline.vertices(polylines(spark, d)).where("pos % 3 = 2")
    return polyline.flagged(rows).select("id", "pos", "start", "first", "last")


@query("top_maxima", """SELECT l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 25""")
def top_maxima(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_of_maxima(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice", 25)


@query("hit_share_by_band", f"""WITH {SEGMENT}, t AS (SELECT DISTINCT id, cls, total FROM seg) SELECT CASE WHEN total > 0 AND total <= 5 THEN 'short' WHEN total > 5 AND total <= 6 THEN 'middle' WHEN total > 6 THEN 'long' END AS band, count(*) AS n, round(avg(CASE WHEN cls < 5 THEN 1.0 ELSE 0.0 END), 6) AS share FROM t GROUP BY ALL""")
def hit_share_by_band(spark: SparkSession, d: str) -> DataFrame:
    """The share of lines of the first classes by length."""
    rows = polylines(spark, d).select("cls", polyline.array_length(F.col("points")).alias("total"))
    found = stats.share_by_band(rows, bins.banded(F.col("total"), [0, 5, 6, float("inf")], ["short", "middle", "long"]), F.col("cls") < 5)
    return found.withColumn("share", F.round("share", 6))


@query("reversed_lines", f"""WITH {VERTEX}, r AS (SELECT id, 31 - pos AS pos, x, y FROM v) SELECT id, CAST(pos AS INTEGER) AS pos, round(x, 6) AS x, round(y, 6) AS y FROM r""")
def reversed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines in the other direction."""
    total = polyline.array_length(F.col("points"))
    rows = polylines(spark, d).withColumn("total", total).select("id", polyline.substring(F.col("points"), F.col("total") + 1, F.lit(0.0)).alias("points"))
    return polyline.vertices(rows).select("id", "pos", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("spliced_lines", f"""WITH {VERTEX}, o AS (SELECT id, pos, x, y FROM v WHERE pos = 0 UNION ALL SELECT id + 1, pos + 100, x, y FROM v WHERE pos BETWEEN 10 AND 15 UNION ALL SELECT id, 1000, x, y FROM v WHERE pos = 31),
w AS (SELECT o.id, pos, x, y FROM o SEMI JOIN embeddings a ON a.vec_id = o.id SEMI JOIN embeddings b ON b.vec_id = o.id - 1)
SELECT id, count(*) AS n, round(sum(x * pos), 5) AS sx, round(sum(y), 6) AS sy FROM w GROUP BY ALL""")
def spliced_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each line's own ends around six vertices of the line before it, each of which stands there twice."""
    lines = polylines(spark, d)
    part = F.slice("points", 11, 6)
    middle = lines.select((F.col("id") + 1).alias("id"), F.flatten(F.transform(part, lambda p: F.array(p, p))).alias("middle"))
    joined = lines.join(middle, "id").select("id", polyline.splice(F.col("points")[0], F.col("middle"), F.element_at("points", -1)).alias("points"))
    rows = polyline.vertices(joined)
    place = F.when(F.col("pos") == 0, 0).when(F.col("pos") == F.col("n") - 1, 1000).otherwise(F.col("pos") + 109)
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x") * place), 5).alias("sx"), F.round(F.sum("y"), 6).alias("sy"))


_DEGREES = "sqrt(pow((b_x - ax) * 111320 * cos(radians(ay)), 2) + pow((b_y - ay) * 110540, 2))"


@query("trip_positions", f"""WITH {VERTEX}, q AS (SELECT id, pos, CAST(round_even(x * 1e5, 0) AS BIGINT) / 1e5 AS ax, CAST(round_even(y * 1e5, 0) AS BIGINT) / 1e5 AS ay FROM v),
s AS (SELECT id, pos, ax, ay, lead(ax) OVER w AS b_x, lead(ay) OVER w AS b_y FROM q WINDOW w AS (PARTITION BY id ORDER BY pos)), l AS (SELECT *, {_DEGREES} AS m FROM s),
c AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto, sum(m) OVER (PARTITION BY id) AS total FROM l)
SELECT id, CAST(pos AS INTEGER) AS pos, ax AS x, ay AS y, round(28800 + upto / total * 3600, 3) AS t FROM c""")
def trip_positions(spark: SparkSession, d: str) -> DataFrame:
    """Coded trips of an hour, decoded with the time at each vertex by distance."""
    coded = polylines(spark, d).select("id", polyline.deltas(polyline.quantised(F.col("points"))).alias("d"))
    rows = coded.select("id", F.posexplode(polyline.timed_positions(F.col("d"), F.lit(28_800.0), F.lit(32_400.0))).alias("pos", "p"))
    return rows.select("id", "pos", "p.x", "p.y", F.round("p.t", 3).alias("t"))


@query("geodesic_length", f"""WITH {VERTEX}, s AS (SELECT id, 12 + x AS ax, 57 + y AS ay, lead(12 + x) OVER w AS b_x, lead(57 + y) OVER w AS b_y FROM v WINDOW w AS (PARTITION BY id ORDER BY pos)),
u AS (SELECT id, atan((1 - 1 / 298.257223563) * tan(radians(ay))) AS b1, atan((1 - 1 / 298.257223563) * tan(radians(b_y))) AS b2, radians(b_x - ax) AS dl FROM s WHERE b_x IS NOT NULL),
h AS (SELECT *, 2 * asin(sqrt(least(1, pow(sin((b2 - b1) / 2), 2) + cos(b1) * cos(b2) * pow(sin(dl / 2), 2)))) AS s, (b1 + b2) / 2 AS p, (b2 - b1) / 2 AS q FROM u)
SELECT id, round(sum(6378137.0 * (s - 1 / 298.257223563 / 2 * ((s - sin(s)) * pow(sin(p) * cos(q), 2) / pow(cos(s / 2), 2) + (s + sin(s)) * pow(cos(p) * sin(q), 2) / pow(sin(s / 2), 2)))), 2) AS metres FROM h WHERE s > 0 GROUP BY ALL""")
def geodesic_length(spark: SparkSession, d: str) -> DataFrame:
    """Lengths on the ellipsoid."""
    segs = polyline.segments(polylines(spark, d))
    metres = geo.geodesic(F.lit(12) + F.col("ax"), F.lit(57) + F.col("ay"), F.lit(12) + F.col("bx"), F.lit(57) + F.col("by"))
    return segs.groupBy("id").agg(F.round(F.sum(metres), 2).alias("metres"))


@query("raster_cells", f"""WITH {VERTEX}, m AS (SELECT id, pos, 299000 + (x + 0.4) * 40000 AS e, 6383900 + (y + 0.4) * 40000 AS n FROM v), c AS (SELECT id, pos, CAST(floor((e - 299000) / 100) AS BIGINT) AS ix, CAST(floor((n - 6383900) / 100) AS BIGINT) AS iy FROM m)
SELECT ix, iy, CAST((ix + 0.5) * 100 + 299000 AS DOUBLE) AS e, CAST((iy + 0.5) * 100 + 6383900 AS DOUBLE) AS n, count(*) AS vertices FROM c WHERE ix BETWEEN 0 AND 360 AND iy BETWEEN 0 AND 334 GROUP BY ALL""")
def raster_cells(spark: SparkSession, d: str) -> DataFrame:
    """Vertices by cell of the raster with the cells' centres; those outside are dropped."""
    rows = polyline.vertices(polylines(spark, d)).select((F.lit(299_000) + (F.col("x") + 0.4) * 40_000).alias("e"), (F.lit(6_383_900) + (F.col("y") + 0.4) * 40_000).alias("n"))
    ix, iy = bins.cell_index(F.col("e"), F.col("n"))
    cells = rows.select(ix.alias("ix"), iy.alias("iy")).where(bins.in_raster(F.col("ix"), F.col("iy"))).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("vertices"))
    e, n = bins.cell_centre(F.col("ix"), F.col("iy"))
    return cells.select("ix", "iy", e.alias("e"), n.alias("n"), "vertices")


@query("saturated_casts", """SELECT l_orderkey, l_linenumber, CAST(least(greatest(floor(l_extendedprice), 0), 65535) AS INTEGER) AS wide, CAST(least(greatest(round_even(l_tax * 3200, 0) - 100, -128), 127) AS INTEGER) AS narrow FROM lineitem""")
def saturated_casts(spark: SparkSession, d: str) -> DataFrame:
    narrow = bins.saturating(F.bround(F.col("l_tax") * 3200, 0) - 100, -128, 127)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bins.saturating(F.floor("l_extendedprice"), 0, 65_535).alias("wide"), narrow.alias("narrow"))


@query("first_and_named", """SELECT conv_id, turn, string_split(coalesce(text, ''), ' ')[1] AS first, trim(coalesce(role, '')) AS role FROM conversations""")
def first_and_named(spark: SparkSession, d: str) -> DataFrame:
    """The first of a list's elements, and a name without outer white space, empty for none."""
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", text.first_of(F.split(F.coalesce("text", F.lit("")), " ")).alias("first"), text.street_name(F.col("role")).alias("role"))


@query("snap_coverage", f"""WITH {SEGMENT}, n AS (SELECT x, y FROM v WHERE cls < 5), s AS (SELECT id, pos, length, (ax + b_x) / 2 AS x, (ay + b_y) / 2 AS y FROM seg WHERE cls >= 5),
h AS (SELECT s.id, s.pos, max(s.length) AS length, bool_or(n.x IS NOT NULL) AS hit FROM s LEFT JOIN n ON abs(s.x - n.x) < 0.02 AND abs(s.y - n.y) < 0.02 AND sqrt((s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y)) < 0.02 GROUP BY ALL)
SELECT round(sum(CASE WHEN hit THEN length ELSE 0 END) / sum(length), 8) AS coverage FROM h""")
def snap_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of the length of the later classes' lines whose segments' middles are near a vertex of the others."""
    lines = polylines(spark, d)
    probes = polyline.segments(lines.where("cls >= 5")).select("id", "pos", "length", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    net = polyline.vertices(lines.where("cls < 5")).select(F.col("id").alias("target"), "x", "y")
    hits = snap.nearest(probes, net, 0.02, ["id", "pos"], "target")
    return snap.coverage(hits, F.col("target").isNotNull(), F.col("length")).select(F.round("coverage", 8).alias("coverage"))


@query("sorted_cube", """WITH c AS (SELECT p_brand AS segment, p_size AS bin, l_returnflag AS mode, count(*) AS trips FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY segment, bin, mode) AS place FROM c""")
def sorted_cube(spark: SparkSession, d: str) -> DataFrame:
    """The cube's rows with their places in the order of segment, bin and mode."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cube = rows.groupBy(F.col("p_brand").alias("segment"), F.col("p_size").alias("bin"), F.col("l_returnflag").alias("mode")).agg(F.count(F.lit(1)).alias("trips"))
    return flows.running_sum(cube, [F.col(c) for c in ("segment", "bin", "mode")], F.lit(1).cast("long"), "place")


@query("typed_arrays", f"""WITH {VERTEX} SELECT id, 64 AS bytes, CAST(sum(least(greatest(CAST(round_even(x * 1000, 0) AS BIGINT), -32768), 32767)) AS BIGINT) AS total FROM v GROUP BY ALL""")
def typed_arrays(spark: SparkSession, d: str) -> DataFrame:
    """x of each line as an array of 16-bit numbers, by its bytes and their sum."""
    values = F.transform("points", lambda p: bins.saturating(F.bround(p["x"] * 1000, 0), -32_768, 32_767))
    raw = polylines(spark, d).select("id", values.alias("v"), pack.typed_array(values, "i2").alias("raw"))
    whole = lambda i: F.conv(F.hex(F.concat(F.substring("raw", 2 * i + 2, F.lit(1)), F.substring("raw", 2 * i + 1, F.lit(1)))), 16, 10).cast("long")
    signed = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(whole(i) >= 32_768, whole(i) - 65_536).otherwise(whole(i)))
    return raw.select("id", F.length("raw").alias("bytes"), F.aggregate(signed, F.lit(0).cast("long"), lambda t, v: t + v).alias("total"))
