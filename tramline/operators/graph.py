"""Junction graphs, shortest paths, betweenness and components.

Edges are rows (a, b, weight), undirected unless said otherwise. Distances from one source, or from a set of
sources at once, come from rounds of relaxation over DataFrames, each checkpointed; searches that are many, local and
bounded (A* between two junctions) run in Python on Arrow batches over the part of the graph that a search may
reach, which a grid join supplies. So no worker needs the whole network.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.prefix import kept
from tramline.operators.snap import pairs_within
from tramline.store import Parts


def junctions(segments: DataFrame, key: str = "edge_id", digits: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x, y) and edges (edge_id, src, dst, length) of segments (ax, ay, bx, by, length).

    A node is an end rounded to `digits` decimals, numbered by its place; loops are dropped.
    """
    scale = 10**digits
    node = lambda x, y: F.struct(F.bround(F.col(x) * scale, 0).cast("long").alias("x"), F.bround(F.col(y) * scale, 0).cast("long").alias("y"))
    keyed = segments.select(key, "length", node("ax", "ay").alias("s"), node("bx", "by").alias("t"))
    name = lambda c: F.concat_ws(":", F.col(f"{c}.x"), F.col(f"{c}.y"))
    edges = keyed.where(F.col("s") != F.col("t")).select(key, name("s").alias("src"), name("t").alias("dst"), "length")
    nodes = keyed.select(F.inline(F.array("s", "t"))).distinct()
    return nodes.select(F.concat_ws(":", "x", "y").alias("id"), (F.col("x") / scale).alias("x"), (F.col("y") / scale).alias("y")), edges


def transit_graph(vertices: DataFrame, grid: float = 40.0, reach: float = 160.0, penalty: float = 250.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x, y) and edges (a < b, weight) of routes' vertices (route, pos, x, y).

    Vertices are put on a grid (halves go to the even line); consecutive nodes of a route are joined by their
    distance, the least of parallel ones, and nodes within reach by a transfer of distance plus penalty.
    """
    snapped = vertices.select("route", "pos", F.bround(F.col("x") / grid, 0).cast("long").alias("gx"), F.bround(F.col("y") / grid, 0).cast("long").alias("gy"))
    named = snapped.withColumn("id", F.concat_ws(":", "gx", "gy"))
    order = Window.partitionBy("route").orderBy("pos")
    ride = named.select("id", F.lead("id").over(order).alias("to"), "gx", "gy", F.lead("gx").over(order).alias("hx"), F.lead("gy").over(order).alias("hy"))
    length = F.sqrt((F.pow(F.col("hx") - F.col("gx"), 2) + F.pow(F.col("hy") - F.col("gy"), 2)).cast("double")) * grid
    rides = ride.where(F.col("to").isNotNull() & (F.col("to") != F.col("id"))).select(F.col("id").alias("a"), F.col("to").alias("b"), length.alias("weight"))
    nodes = named.select("id", (F.col("gx") * grid).alias("x"), (F.col("gy") * grid).alias("y")).distinct()
    transfers = pairs_within(nodes, reach).select("a", "b", (F.col("distance") + penalty).alias("weight"))
    return nodes, least_weights(rides.unionByName(transfers))


def least_weights(edges: DataFrame) -> DataFrame:
    """a < b, weight: parallel edges collapse to the least; loops are dropped."""
    both = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").where(F.col("a") != F.col("b"))
    return both.groupBy("a", "b").agg(F.min("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def shortest_paths(edges: DataFrame, sources: DataFrame, limit: float | None = None, rounds: int = 10_000) -> DataFrame:
    """source, node, distance, pred: distances from each source; of equal predecessors the smallest.

    Each round relaxes only the rows that the last round improved, for all sources at once, and ends when a round
    improves nothing. What a round improves is written as a part of its own; nothing is written twice, and of the parts
    of a node the least distance counts.
    """
    arcs = kept(both_ways(least_weights(edges)))
    nothing = F.lit(None).cast(arcs.schema["a"].dataType)
    parts = Parts(edges.sparkSession, "distances")
    front = parts.add(sources.select(F.col("node").alias("source"), "node", F.lit(0).cast(arcs.schema["weight"].dataType).alias("distance")).distinct())
    for _ in range(rounds):
        reached = front.join(arcs, front["node"] == arcs["a"]).select("source", F.col("b").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"))
        if limit is not None:
            reached = reached.where(F.col("distance") <= limit)
        known = parts.all().select("source", "node", F.lit(True).alias("old"), "distance")
        # One sum over old and new rows: a node is improved if its least distance is none of the old ones.
        both = known.unionByName(reached.withColumn("old", F.lit(False)).select("source", "node", "old", "distance"))
        best = both.groupBy("source", "node").agg(F.min("distance").alias("distance"), F.min(F.when(F.col("old"), F.col("distance"))).alias("before"))
        front = parts.add(best.where(F.col("before").isNull() | (F.col("distance") < F.col("before"))).select("source", "node", "distance"))
        if front.isEmpty():
            break
    else:
        raise RuntimeError(f"not settled after {rounds} rounds")
    known = parts.all().groupBy("source", "node").agg(F.min("distance").alias("distance"))
    # Predecessors follow from final distances, so they don't depend on the order of relaxation.
    before = known.select("source", F.col("node").alias("a"), F.col("distance").alias("da"))
    via = before.join(arcs, "a").select("source", F.col("b").alias("node"), (F.col("da") + F.col("weight")).alias("distance"), "a")
    pred = via.groupBy("source", "node", "distance").agg(F.min("a").alias("pred"))
    joined = known.join(pred, ["source", "node", "distance"], "left")
    return joined.select("source", "node", "distance", F.when(F.col("node") == F.col("source"), nothing).otherwise(F.col("pred")).alias("pred"))


def hops(edges: DataFrame, sources: DataFrame, rounds: int = 10_000) -> DataFrame:
    """source, node, distance, pred in numbers of edges."""
    return shortest_paths(edges.withColumn("weight", F.lit(1).cast("long")), sources, None, rounds)


def path_to(paths: DataFrame, targets: DataFrame, most: int = 20_000) -> DataFrame:
    """source, target, step, node: the nodes from each source to each target (source, target), by step back from the target."""
    parts = Parts(paths.sparkSession, "path")
    at = parts.add(targets.select("source", "target", F.lit(0).alias("step"), F.col("target").alias("node")))
    for _ in range(most):
        back = at.join(paths.select("source", "node", "pred"), ["source", "node"]).where(F.col("pred").isNotNull())
        at = parts.add(back.select("source", "target", (F.col("step") + 1).alias("step"), F.col("pred").alias("node")))
        if at.isEmpty():
            return parts.all()
    raise RuntimeError(f"a path is longer than {most}")


def betweenness(edges: DataFrame, sources: DataFrame, normalise: bool = True) -> DataFrame:
    """a < b, betweenness: how many shortest-path tree paths from the sources use each edge.

    In the tree of a source every edge is credited once for each node at or below its far end. Subtree sizes are
    gathered level by level from the leaves, all sources at once; a level reads and writes its own rows alone. The walk
    ends at the source.
    """
    edges = least_weights(edges)
    tree = kept(shortest_paths(edges, sources))
    levels = _levels(tree)
    sizes = Parts(edges.sparkSession, "sizes")
    up = None
    for level in reversed(levels):
        own = level.select("source", "node", "pred", F.lit(1).cast("long").alias("size"))
        if up is not None:
            own = own.join(up, ["source", "node"], "left").select("source", "node", "pred", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        own = sizes.add(own)
        up = own.where(F.col("pred").isNotNull()).groupBy("source", F.col("pred").alias("node")).agg(F.sum("size").alias("more"))
    credit = sizes.all().where(F.col("pred").isNotNull()).groupBy(F.least("node", "pred").alias("a"), F.greatest("node", "pred").alias("b")).agg(F.sum("size").alias("credit"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().count()
    scale = sources.distinct().count() * max(nodes - 1, 1) if normalise else 1
    return edges.join(credit, ["a", "b"], "left").select("a", "b", (F.coalesce("credit", F.lit(0)) / F.lit(scale)).alias("betweenness"))


def _levels(tree: DataFrame) -> list[DataFrame]:
    """The rows of shortest-path trees by their number of edges from the source, a frame for each number."""
    parts = Parts(tree.sparkSession, "levels")
    found = [parts.add(tree.where(F.col("pred").isNull()).select("source", "node", "pred"))]
    while True:
        above = found[-1].select("source", F.col("node").alias("pred"))
        at = parts.add(tree.join(above, ["source", "pred"]).select("source", "node", "pred"))
        if at.isEmpty():
            return found
        found.append(at)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), by alternating large-star and small-star steps."""
    pairs = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = None
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs = kept(small.where("u != v").distinct())
        now = pairs.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if now == mark:
            break
        mark = now
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def longest_part(ways: DataFrame, group: str, length: Column) -> DataFrame:
    """Of each group's ways (way, a, b), those of the connected part of greatest length, the smaller of two."""
    scoped = ways.withColumns({"a": F.concat_ws("|", group, "a"), "b": F.concat_ws("|", group, "b")})
    parts = components(scoped.select("a", "b"))
    placed = scoped.join(parts, scoped["a"] == parts["node"], "left").withColumn("part", F.coalesce("component", "a"))
    sizes = placed.groupBy(group, "part").agg(F.sum(length).alias("size"))
    best = sizes.groupBy(group).agg(F.min(F.struct((-F.col("size")).alias("size"), "part")).alias("b")).select(group, F.col("b.part").alias("part"))
    return placed.join(best, [group, "part"]).select(*ways.columns)


def _astar(arcs: dict, xy: dict, start: str, goal: str, bound: float) -> list[tuple] | None:
    """(edge, forward) from start to goal, or None beyond the bound; ties by smaller node."""
    gx, gy = xy[goal]

    def ahead(node: str) -> float:
        x, y = xy[node]
        return ((x - gx) ** 2 + (y - gy) ** 2) ** 0.5

    best, came = {start: 0.0}, {}
    heap = [(ahead(start), start)]
    done = set()
    while heap:
        f, node = heapq.heappop(heap)
        if f > bound:
            return None
        if node == goal:
            path = []
            while node != start:
                before, edge, forward = came[node]
                path.append((edge, forward))
                node = before
            return path[::-1]
        if node in done:
            continue
        done.add(node)
        for to, length, edge, forward in arcs.get(node, ()):
            g = best[node] + length
            if g < best.get(to, float("inf")):
                best[to], came[to] = g, (node, edge, forward)
                heapq.heappush(heap, (g + ahead(to), to))
    return None


def bounded_paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, factor: float = 1.6, slack: float = 60.0, tile: float = 2000.0) -> DataFrame:
    """src, dst, step, edge_id, forward: A* between junctions, given up beyond factor × chord + slack.

    pairs: src, dst, chord (the longest of each distinct pair is taken). A search cannot leave the ellipse that its
    bound allows, so the pairs of a source are sent, by an equi-join on tiles, the edges of the tiles that meet one of
    their ellipses' boxes, each once; groups are single sources, so no worker holds the network. Edges beyond a pair's own
    ellipse are never gone along before its goal.
    """
    asked = pairs.groupBy("src", "dst").agg(F.max("chord").alias("chord")).withColumn("bound", F.col("chord") * factor + slack)
    ends = asked.join(nodes.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy")), "src")
    ends = ends.join(nodes.select(F.col("id").alias("dst"), F.col("x").alias("tx"), F.col("y").alias("ty")), "dst")
    reach = (F.col("bound") - F.col("chord")) / 2 + F.col("chord") / 2
    mid = {c: (F.col(f"s{c}") + F.col(f"t{c}")) / 2 for c in ("x", "y")}
    span = {c: F.sequence(F.floor((mid[c] - reach) / tile), F.floor((mid[c] + reach) / tile)) for c in ("x", "y")}
    tiles = ends.select(F.col("src").alias("_source"), F.explode(span["x"]).alias("cx"), span["y"].alias("_y")).select("_source", "cx", F.explode("_y").alias("cy")).distinct()
    placed = edges.join(nodes.select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay")), "src")
    placed = placed.join(nodes.select(F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by")), "dst")
    placed = placed.select("edge_id", F.col("src").alias("a"), F.col("dst").alias("b"), "length", "ax", "ay", "bx", "by")
    # An edge is in the tiles of both its ends.
    spots = F.array_distinct(F.array(*[F.struct(F.floor(F.col(f"{e}x") / tile).alias("cx"), F.floor(F.col(f"{e}y") / tile).alias("cy")) for e in "ab"]))
    tiled = placed.select("*", F.explode(spots).alias("t")).select(*placed.columns, "t.cx", "t.cy")
    sent = tiles.join(tiled, ["cx", "cy"]).drop("cx", "cy").distinct()

    def search(pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        arcs, xy = defaultdict(list), {}
        for e in rows.itertuples():
            xy[e.a], xy[e.b] = (e.ax, e.ay), (e.bx, e.by)
            arcs[e.a].append((e.b, e.length, e.edge_id, True))
            arcs[e.b].append((e.a, e.length, e.edge_id, False))
        for out in arcs.values():
            out.sort()
        steps = []
        for p in pairs.itertuples():
            found = _astar(arcs, xy, p.src, p.dst, p.bound) if p.src in xy and p.dst in xy else None
            steps += [(p.src, p.dst, i, e, f) for i, (e, f) in enumerate(found or [])]
        return pd.DataFrame(steps, columns=["src", "dst", "step", "edge_id", "forward"])

    kind = edges.schema["edge_id"].dataType.simpleString()
    return ends.select("src", "dst", "bound").groupBy("src").cogroup(sent.groupBy("_source")).applyInPandas(search, f"src string, dst string, step int, edge_id {kind}, forward boolean")
