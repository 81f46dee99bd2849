"""Graphs against plain Python."""

import heapq
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tramline.operators import graph


def dijkstra(edges, source):
    adj = defaultdict(list)
    for a, b, w in edges:
        adj[a].append((b, w))
        adj[b].append((a, w))
    best, heap = {source: 0}, [(0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        if d > best[n]:
            continue
        for m, w in adj[n]:
            if d + w < best.get(m, 1 << 60):
                best[m] = d + w
                heapq.heappush(heap, (d + w, m))
    pred = {n: min((a for a, w in adj[n] if best.get(a, 1 << 60) + w == best[n]), default=None) for n in best if n != source}
    return best, pred


def make(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, weight long")


def test_shortest_paths_and_betweenness(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30), rng.randrange(1, 9)) for _ in range(55)]
    df, sources = make(spark, edges), [0, 7]
    least = {}
    for a, b, w in edges:
        if a != b:
            k = (min(a, b), max(a, b))
            least[k] = min(least.get(k, w), w)
    plain = [(a, b, w) for (a, b), w in least.items()]
    asked = spark.createDataFrame([(s,) for s in sources], "node long")
    paths = graph.kept(graph.shortest_paths(df, asked))
    credit = defaultdict(int)
    for s in sources:
        best, pred = dijkstra(plain, s)
        got = {r.node: (r.distance, r.pred) for r in paths.where(F.col("source") == s).collect()}
        assert got == {n: (d, pred.get(n)) for n, d in best.items()}
        for n in best:
            while n != s:
                credit[min(n, pred[n]), max(n, pred[n])] += 1
                n = pred[n]
    nodes = {n for a, b, _ in plain for n in (a, b)}
    got = {(r.a, r.b): r.betweenness for r in graph.betweenness(df, asked).collect()}
    assert set(got) == set(least)
    for k, v in got.items():
        assert abs(v - credit[k] / (2 * (len(nodes) - 1))) < 1e-12
    far = max((d, n) for n, d in dijkstra(plain, 0)[0].items())[1]
    steps = graph.path_to(paths, spark.createDataFrame([(0, far)], "source long, target long")).orderBy("step").collect()
    pred, want, n = dijkstra(plain, 0)[1], [far], far
    while n != 0:
        n = pred[n]
        want.append(n)
    assert [r.node for r in steps] == want


def test_path_graph_credits(spark):
    got = {(r.a, r.b): r.betweenness for r in graph.betweenness(make(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 5)]), spark.createDataFrame([(1,)], "node long"), normalise=False).collect()}
    assert got == {(1, 2): 2, (2, 3): 1, (1, 3): 0}


def test_components_and_longest_part(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60), 1) for _ in range(40)] + [(100 + i, 101 + i, 1) for i in range(20)]
    parent = {n: n for a, b, _ in edges for n in (a, b)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    loops = {a for a, b, _ in edges if a == b}
    got = {r.node: r.component for r in graph.components(make(spark, edges)).collect()}
    assert all(got[n] == find(n) for n in got) and set(parent) - set(got) <= loops
    ways = spark.createDataFrame([("r", 1, "a", "b", 5.0), ("r", 2, "b", "c", 5.0), ("r", 3, "x", "y", 9.0)], "route string, way long, a string, b string, len double")
    assert {r.way for r in graph.longest_part(ways, "route", F.col("len")).collect()} == {1, 2}


def test_transfers_and_bounded_search(spark):
    verts = [("r", 0, 0.0, 0.0), ("r", 1, 400.0, 0.0), ("q", 0, 400.0, 100.0), ("q", 1, 800.0, 100.0)]
    nodes, edges = graph.transit_graph(spark.createDataFrame(verts, "route string, pos int, x double, y double"), penalty=250)
    got = {(r.a, r.b): r.weight for r in edges.collect()}
    assert got[("0:0", "10:0")] == 400
    # 100 m apart: on the grid the second lies at 80 m (2.5 goes to the even line).
    assert got[("10:0", "10:2")] == 330
    segs = [(1, 0.0, 0.0, 60.0, 0.0, 60.0), (2, 60.0, 0.0, 100.0, 0.0, 40.0), (3, 0.0, 0.0, 0.0, 500.0, 500.0), (4, 0.0, 500.0, 300.0, 0.0, 590.0)]
    nodes, edges = graph.junctions(spark.createDataFrame(segs, "edge_id long, ax double, ay double, bx double, by double, length double"))
    pairs = spark.createDataFrame([("0:0", "1000:0", 100.0), ("1000:0", "0:0", 100.0), ("0:0", "3000:0", 300.0)], "src string, dst string, chord double")
    got = graph.bounded_paths(pairs, nodes, edges, tile=100.0).orderBy("src", "dst", "step").collect()
    assert [(r.src, r.dst, r.edge_id, r.forward) for r in got] == [("0:0", "1000:0", 1, True), ("0:0", "1000:0", 2, True), ("1000:0", "0:0", 2, False), ("1000:0", "0:0", 1, False)]


def test_betweenness_query_takes_all_sources_of_a_small_graph(spark):
    import os

    import pytest

    from tramline.plans import graphs

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("needs the driver's tables")
    edges = [(r.a, r.b, r.weight) for r in graphs.edges(spark, d).collect()]
    nodes = {n for a, b, _ in edges for n in (a, b)}
    assert 12 < len(nodes) <= 400
    credit = defaultdict(int)
    for s in nodes:
        best, pred = dijkstra(edges, s)
        for n in best:
            while n != s:
                credit[min(n, pred[n]), max(n, pred[n])] += 1
                n = pred[n]
    got = {(r.a, r.b): r.betweenness for r in graphs.betweenness_sampled(spark, d).collect()}
    assert set(got) == {(a, b) for a, b, _ in edges}
    assert all(abs(v - credit[k] / (len(nodes) * (len(nodes) - 1))) < 1e-8 for k, v in got.items())


def test_pieces_are_not_broadcast_and_edges_go_to_sources(spark):
    from tramline.operators import flows

    pieces = spark.createDataFrame([(1, 0, "e", 3), (1, 1, "f", 3), (2, 0, None, 4)], "trip_id long, piece int, edge_id string, bin int")
    found = flows.assign(pieces.where("trip_id = 2"), pieces.where("piece = 0"), pieces)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(1, "e", 3), (1, "f", 3)}
    # Two hundred pairs of one source share its edges: one group each source, not one each pair.
    nodes = spark.createDataFrame([(f"{i:03}", float(i), 0.0) for i in range(200)], "id string, x double, y double")
    edges = spark.createDataFrame([(f"e{i:03}", f"{i:03}", f"{i + 1:03}", 1.0) for i in range(199)], "edge_id string, src string, dst string, length double")
    pairs = spark.createDataFrame([("000", f"{i:03}", float(i)) for i in range(1, 200)], "src string, dst string, chord double")
    paths = graph.bounded_paths(pairs, nodes, edges, 1.0, 0.5, 50.0)
    assert "CoGroups" in paths._jdf.queryExecution().executedPlan().toString()
    got = {r.dst: r.n for r in paths.groupBy("dst").count().withColumnRenamed("count", "n").collect()}
    assert got == {f"{i:03}": i for i in range(1, 200)}
