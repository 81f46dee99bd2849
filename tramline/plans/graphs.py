"""Queries on graphs: the network is that of all lines, with vertices put on a grid of a tenth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.operators import graph, polyline, sampling
from tramline.plans.base import VERTEX, polylines
from tramline.plans.registry import query

# A node is numbered by its grid place; a weight is the least length between two nodes in thousandths, at least 1.
_NODES = f"{VERTEX}, nd AS (SELECT id, pos, x, y, CAST((round_even(x * 10, 0) + 50) * 1000 + round_even(y * 10, 0) + 50 AS BIGINT) AS node FROM v)"
_EDGES = f"""{_NODES}, st AS (SELECT node AS a, lead(node) OVER w AS b, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM nd WINDOW w AS (PARTITION BY id ORDER BY pos)),
ed AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(1 + CAST(floor(1000 * sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS BIGINT)) AS weight FROM st WHERE b IS NOT NULL AND a <> b GROUP BY ALL),
arc AS (SELECT a, b, weight FROM ed UNION ALL SELECT b, a, weight FROM ed)"""

#: Source nodes of the sampled betweenness.
SOURCES = 400


def edges(spark: SparkSession, d: str) -> DataFrame:
    node = ((F.bround(F.col("x") * 10, 0) + 50) * 1000 + F.bround(F.col("y") * 10, 0) + 50).cast("long")
    rows = polyline.vertices(polylines(spark, d)).select("id", "pos", "x", "y", node.alias("node"))
    order = Window.partitionBy("id").orderBy("pos")
    step = rows.select(F.col("node").alias("a"), F.lead("node").over(order).alias("b"), (F.lead("x").over(order) - F.col("x")).alias("dx"), (F.lead("y").over(order) - F.col("y")).alias("dy"))
    weight = 1 + F.floor(1000 * F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return graph.least_weights(step.where(F.col("b").isNotNull()).select("a", "b", weight.alias("weight")))


def source(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).agg(F.min("a").alias("node"))  # one row


@query("junction_edges", f"WITH {_EDGES} SELECT a, b, weight FROM ed")
def junction_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


_SSSP = """, sp(node, distance) USING KEY (node) AS (SELECT min(a), CAST(0 AS BIGINT) FROM ed
  UNION SELECT b, min(sp.distance + weight) FROM sp JOIN arc ON arc.a = sp.node LEFT JOIN recurring.sp AS r ON r.node = b WHERE r.distance IS NULL OR sp.distance + weight < r.distance GROUP BY b)"""


@query("sssp", f"WITH RECURSIVE {_EDGES}{_SSSP} SELECT node, distance FROM sp")
def sssp(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_paths(edges(spark, d), source(spark, d)).select("node", "distance")


@query("bfs_hops", f"""WITH RECURSIVE {_EDGES}, sp(node, hops) USING KEY (node) AS (SELECT min(a), CAST(0 AS BIGINT) FROM ed
  UNION SELECT b, min(sp.hops + 1) FROM sp JOIN arc ON arc.a = sp.node LEFT JOIN recurring.sp AS r ON r.node = b WHERE r.hops IS NULL GROUP BY b) SELECT node, hops FROM sp""")
def bfs_hops(spark: SparkSession, d: str) -> DataFrame:
    return graph.hops(edges(spark, d), source(spark, d)).select("node", F.col("distance").alias("hops"))


@query("path_edges", f"""WITH RECURSIVE {_EDGES}{_SSSP}, pr AS (SELECT arc.b AS node, min(arc.a) AS pred FROM arc JOIN sp f ON f.node = arc.a JOIN sp t ON t.node = arc.b AND f.distance + weight = t.distance GROUP BY ALL),
pa(step, node) AS (SELECT 0, (SELECT max(node) FROM sp) UNION ALL SELECT step + 1, pred FROM pa JOIN pr ON pr.node = pa.node WHERE pa.node <> (SELECT min(a) FROM ed)) SELECT CAST(step AS INTEGER) AS step, node FROM pa""")
def path_edges(spark: SparkSession, d: str) -> DataFrame:
    """The path from the smallest to the largest node, from its end."""
    paths = graph.kept(graph.shortest_paths(edges(spark, d), source(spark, d)))
    target = paths.groupBy("source").agg(F.max("node").alias("target"))
    return graph.path_to(paths, target).select("step", "node")


@query("components", f"""WITH RECURSIVE {_EDGES}, co(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM arc
  UNION SELECT b, min(co.component) FROM co JOIN arc ON arc.a = co.node JOIN recurring.co AS r ON r.node = b WHERE co.component < r.component GROUP BY b) SELECT node, component FROM co""")
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(edges(spark, d))


@query("betweenness_sampled", f"""WITH RECURSIVE {_EDGES}, src AS (SELECT a AS node FROM (SELECT DISTINCT a FROM arc) ORDER BY md5('7:' || a), a LIMIT {SOURCES}),
sp(source, node, distance) USING KEY (source, node) AS (SELECT node, node, CAST(0 AS BIGINT) FROM src
  UNION SELECT sp.source, arc.b, min(sp.distance + weight) FROM sp JOIN arc ON arc.a = sp.node LEFT JOIN recurring.sp AS r ON r.source = sp.source AND r.node = arc.b WHERE r.distance IS NULL OR sp.distance + weight < r.distance GROUP BY ALL),
pr AS (SELECT f.source, arc.b AS node, min(arc.a) AS pred FROM sp f JOIN arc ON arc.a = f.node JOIN sp t ON t.source = f.source AND t.node = arc.b AND f.distance + weight = t.distance GROUP BY ALL),
wk(source, node) AS (SELECT source, node FROM sp WHERE node <> source UNION ALL SELECT wk.source, pred FROM wk JOIN pr ON pr.source = wk.source AND pr.node = wk.node WHERE pred <> wk.source),
cr AS (SELECT least(wk.node, pred) AS a, greatest(wk.node, pred) AS b, count(*) AS credit FROM wk JOIN pr ON pr.source = wk.source AND pr.node = wk.node GROUP BY ALL)
SELECT ed.a, ed.b, round(coalesce(credit, 0) / ((SELECT count(*) FROM src) * greatest((SELECT count(DISTINCT a) FROM arc) - 1, 1)), 9) AS betweenness FROM ed LEFT JOIN cr ON cr.a = ed.a AND cr.b = ed.b""")
def betweenness_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Edge betweenness from SOURCES nodes chosen by hash; from all, and so exact, where there are fewer."""
    found = edges(spark, d)
    nodes = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return graph.betweenness(found, sampling.sources(nodes, "node", SOURCES)).withColumn("betweenness", F.round("betweenness", 9))


@query("transit_graph", f"""WITH {VERTEX}, g AS (SELECT id, pos, CAST(round_even(x / 0.04, 0) AS BIGINT) AS gx, CAST(round_even(y / 0.04, 0) AS BIGINT) AS gy FROM v),
r AS (SELECT gx, gy, lead(gx) OVER w AS hx, lead(gy) OVER w AS hy FROM g WINDOW w AS (PARTITION BY id ORDER BY pos)),
n AS (SELECT DISTINCT gx, gy, gx || ':' || gy AS id FROM g),
e AS (SELECT gx || ':' || gy AS a, hx || ':' || hy AS b, sqrt((hx - gx) * (hx - gx) + (hy - gy) * (hy - gy)) * 0.04 AS w FROM r WHERE hx IS NOT NULL AND (hx <> gx OR hy <> gy)
  UNION ALL SELECT p.id, q.id, sqrt((p.gx - q.gx) * (p.gx - q.gx) + (p.gy - q.gy) * (p.gy - q.gy)) * 0.04 + 0.25 FROM n p JOIN n q ON p.id < q.id AND abs(p.gx - q.gx) <= 3 AND abs(p.gy - q.gy) <= 3 AND (p.gx - q.gx) * (p.gx - q.gx) + (p.gy - q.gy) * (p.gy - q.gy) <= 9)
SELECT least(a, b) AS a, greatest(a, b) AS b, round(min(w), 6) AS weight FROM e GROUP BY ALL""")
def transit_graph(spark: SparkSession, d: str) -> DataFrame:
    verts = polyline.vertices(polylines(spark, d)).select(F.col("id").alias("route"), "pos", "x", "y")
    _, found = graph.transit_graph(verts, 0.04, 0.125, 0.25)
    return found.withColumn("weight", F.round("weight", 6))
