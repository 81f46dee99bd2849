"""Lines: hand-worked values and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import pack, polyline, snap

TYPE = "id long, points array<struct<x:double,y:double>>"


def lines(spark, *pts):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in enumerate(pts)], TYPE)


L = [(0, 0), (3, 4), (3, 10)]


def test_lengths(spark):
    df = lines(spark, L, [(1, 1)], [])
    assert [r[0] for r in df.orderBy("id").select(polyline.array_length(F.col("points"))).collect()] == [11, 0, 0]
    segs = polyline.segments(df).orderBy("pos").collect()
    assert [(s.length, s.along, s.total) for s in segs] == [(5, 0, 11), (6, 5, 11)]
    assert [r.along for r in polyline.cumulative(polyline.vertices(lines(spark, L))).orderBy("pos").collect()] == [0, 5, 11]


def test_sampling(spark):
    segs = polyline.segments(lines(spark, [(0, 0), (25, 0)]))
    assert [r.x for r in polyline.subsegment_samples(segs, 10).orderBy("k").collect()] == pytest.approx([25 / 6, 12.5, 125 / 6])
    segs = polyline.segments(lines(spark, [(0, 0), (5, 0)]))
    assert [r.x for r in polyline.densify(segs, 2).orderBy("k").collect()] == pytest.approx([0, 5 / 3, 10 / 3, 5])
    at = lambda df: [r.x for r in df.orderBy("j").collect()]
    assert at(polyline.line_samples(lines(spark, [(0, 0), (20, 0), (45, 0)]), 10)) == pytest.approx([45 * f for f in (0.125, 0.375, 0.625, 0.875)])
    assert polyline.line_samples(lines(spark, [(0, 0), (12, 0)]), 10).count() == 3
    assert at(polyline.line_samples_inclusive(lines(spark, [(0, 0), (80, 0)]), 25)) == pytest.approx([0, 80 / 3, 160 / 3, 80])
    assert at(polyline.interval_samples(lines(spark, [(0, 0), (26, 0)]), 10)) == pytest.approx([5, 15, 25])


def test_substring_splice_and_repeats(spark):
    df = lines(spark, L)
    get = lambda c: [(p["x"], p["y"]) for p in df.select(c.alias("p")).first().p]
    p = F.col("points")
    assert get(polyline.substring(p, F.lit(2.5), F.lit(8.0))) == [(1.5, 2), (3, 4), (3, 7)]
    assert get(polyline.substring(p, F.lit(8.0), F.lit(2.5))) == [(3, 7), (3, 4), (1.5, 2)]
    assert get(polyline.splice(p[0], F.slice(p, 1, 2), p[2])) == [(0, 0), (3, 4), (3, 10)]
    assert df.select(polyline.shoelace(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3))]))).first()[0] == 6


def test_split_at_shared_nodes(spark):
    a, b = [(0, 0), (1, 0), (2, 0)], [(1, -1), (1, 0), (1, 1)]
    got = polyline.split_at_shared_nodes(lines(spark, a, b)).groupBy("id", "piece").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("p")).collect()
    assert len(got) == 4 and all((1.0, 0.0) in [tuple(p) for p in r.p] for r in got)


def test_pieces_and_clip(spark):
    got = polyline.pieces(lines(spark, [(0, 0), (130, 0)]), 60).orderBy("piece").collect()
    assert [[p["x"] for p in r.points] for r in got] == [pytest.approx([0, 16.25, 32.5, 48.75, 65]), pytest.approx([65, 81.25, 97.5, 113.75, 130])]
    cut = polyline.clip_to_box(lines(spark, [(-5, 1), (5, 1), (5, 9)]), (0, 0, 6, 6)).orderBy("pos").collect()
    assert [(r.ax, r.ay, r.bx, r.by) for r in cut] == [(0, 1, 5, 1), (5, 1, 5, 6)]


def test_delta_coding_round_trip(spark):
    rng = random.Random(0)
    many = [[(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(rng.randrange(1, 9))] for _ in range(30)] + [[(11.968, 57.706), (11.96805, 57.7059)]]
    q = polyline.quantised(F.col("points"))
    rows = lines(spark, *many).select("id", "points", polyline.deltas(polyline.halved_jumps(q)).alias("d"))
    rows = rows.withColumn("b", pack.unpacked_deltas(pack.packed_deltas(F.col("d")))).withColumn("p", polyline.undeltas(F.col("b")))
    for r in rows.collect():
        assert [tuple(s) for s in r.b] == [tuple(s) for s in r.d]
        assert all(abs(c) <= 30000 for s in r.d[1:] for c in s)
        back = {(round(p["x"], 5), round(p["y"], 5)) for p in r.p}
        assert {(round(p["x"], 5) + 0.0, round(p["y"], 5) + 0.0) for p in r.points} <= {(x + 0.0, y + 0.0) for x, y in back} or len(r.p) >= len(r.points)
        assert (abs(r.p[-1]["x"] - r.points[-1]["x"]), abs(r.p[-1]["y"] - r.points[-1]["y"])) <= (1e-5, 1e-5)
    last = rows.where("id = 30").first().d
    assert [tuple(s) for s in last] == [(1196800, 5770600), (5, -10)]
    jump = lines(spark, [(0, 0), (0.60001, 0)]).select(polyline.deltas(polyline.halved_jumps(q)).alias("d")).first().d
    assert [s["x"] for s in jump[1:]] == [30000, 15000, 15001]


def test_simplify(spark):
    df = lines(spark, [(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], [(0, 0), (1, 1)])
    got = [[(p["x"], p["y"]) for p in r[0]] for r in df.orderBy("id").select(polyline.simplify(F.col("points"), 0.1)).collect()]
    assert got == [[(0, 0), (2, 0), (3, 5), (4, 0)], [(0, 0), (1, 1)]]


def points(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_nearest_is_strict_and_exact(spark):
    net = points(spark, [(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 100.0, 0.0)], "edge long, x double, y double")
    probes = points(spark, [(1, 4.0, 0.0), (2, 3.9, 0.0), (3, 99.0, 0.0), (4, -3.0, 2.0)], "id long, x double, y double")
    got = {r.id: r.edge for r in snap.nearest(probes, net, 4.0, ["id"], "edge").collect()}
    assert got == {1: None, 2: 1, 3: 2, 4: 1}
    rng = random.Random(1)
    net = [(i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(80)]
    asks = [(i, rng.uniform(-5, 55), rng.uniform(-5, 55)) for i in range(80)]
    want = {i: min((math.hypot(x - a, y - b), e) for e, a, b in net) for i, x, y in asks}
    frames = points(spark, asks, "id long, x double, y double"), points(spark, net, "edge long, x double, y double")
    for found in (snap.nearest_in_rings(*frames, 1.0, ["id"], "edge"), snap.nearest_of_few(*frames, ["id"], "edge")):
        assert {r.id: r.edge for r in found.collect()} == {i: e for i, (_, e) in want.items()}
    near = {r.id: r.edge for r in snap.nearest(*frames, 3.0, ["id"], "edge").collect()}
    assert near == {i: e if d < 3 else None for i, (d, e) in want.items()}


def test_votes_and_medians(spark):
    rows = [("s", "A")] * 5 + [("s", None)] * 5 + [("t", "A")] * 4 + [("t", None)] * 6 + [("u", "A"), ("u", "B")]
    got = {r.seg: r.name for r in snap.majority(points(spark, rows, "seg string, name string"), "seg", "name").collect()}
    assert got == {"s": "A", "u": "B"}
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)] + [("a", None)] * 5 + [("b", 1.0)] * 4 + [("b", None)] * 6
    assert {r.seg: r.v for r in snap.median_if_hit(points(spark, rows, "seg string, v double"), "seg", "v").collect()} == {"a": 3, "b": None}
    net = points(spark, [(3, "x", 0.0, 0.0), (9, "y", 20.0, 0.0)], "car long, name string, x double, y double")
    r = snap.busiest_around(points(spark, [(1, 5.0, 0.0)], "id long, x double, y double"), net, 25.0, ["id"], "car", "name").first()
    assert (r.car, r.name) == (9, "y")


def test_project_and_routes(spark):
    asked = points(spark, [(0, 3.0, 2.0)], "id long, px double, py double")
    r = polyline.project(asked, lines(spark, [(0, 0), (10, 0), (10, 10)]), "id").first()
    assert (r.distance, r.along) == (2, 3)
    trips = points(spark, [(1, 0.0, 0.0, 10.0, 0.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    verts = points(spark, [("far", 0.0, 1.0), ("far", 50.0, 0.0), ("near", 0.0, 2.0), ("near", 10.0, 1.0)], "route string, x double, y double")
    r = snap.route_candidates(trips, verts, 5.0).first()
    assert (r.route, r.d1, r.d2) == ("near", 2, 1)


def test_timed_positions(spark):
    steps = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in ((0, 0), (0, 100000), (0, 300000))])
    got = spark.range(1).select(polyline.timed_positions(steps, F.lit(0.0), F.lit(80.0)).alias("p")).first().p
    assert [(p["x"], p["y"], p["t"]) for p in got] == [(0, 0, 0), (0, 1, pytest.approx(20)), (0, 4, pytest.approx(80))]


def test_nearest_and_busiest_without_pairs(spark, monkeypatch):
    import random

    def brute(x, y, rows, reach, strict):
        away = [((x - a) * (x - a) + (y - b) * (y - b)) ** 0.5 for a, b, _ in rows]
        return [(d, r[2]) for d, r in zip(away, rows, strict=True) if (d < reach if strict else d <= reach)]

    monkeypatch.setattr(snap, "within", None)  # pairs of a crowded place would be too many
    rng = random.Random(5)
    at = lambda: (rng.gauss(6_400_000, 9), rng.gauss(-300, 9)) if rng.random() < 0.8 else (6_400_000 + rng.randrange(-40, 40) / 2, -300 + rng.randrange(-40, 40) / 2)
    net = [(*at(), f"{rng.randrange(300)}:{k}") for k in range(900)] + [(6_400_000.0, -300.0, f"h{k}") for k in range(300)] + [(6_400_050.0 + k / 5e3, -300.0, f"d{k}") for k in range(400)]
    probes = [(i, *at()) for i in range(500)] + [(500 + i, 6_400_000.0, -300.0) for i in range(200)] + [(700, None, 1.0), (701, float("nan"), 1.0), (702, float("inf"), 1.0), (703, 0.0, 0.0), (704, 6_400_050.01, -300.0)]
    odd = [(None, 1.0, "z"), (float("nan"), 1.0, "z"), (float("-inf"), 1.0, "z")]
    frames = points(spark, probes, "id long, x double, y double"), points(spark, [*net, *odd], "x double, y double, name string")
    for reach, strict in ((4.0, True), (0.5, False), (60.0, False)):
        got = {r.id: (r.distance, r.name) for r in snap.nearest(*frames, reach, ["id"], "name", strict).collect()}
        most = {r.id: r.name for r in snap.busiest_around(*frames, reach, ["id"], "name").collect()}
        assert len(got) == len(most) == len(probes)
        for i, x, y in probes:
            near = brute(x, y, net, reach, strict) if x is not None else []
            assert got[i] == (min(near) if near else (None, None)), (i, reach)
            near = brute(x, y, net, reach, False) if x is not None else []
            assert most[i] == (max(n for _, n in near) if near else None), (i, reach)
    none = frames[0].limit(0), frames[1].limit(0)
    assert snap.nearest(none[0], frames[1], 1.0, ["id"], "name").count() == 0
    assert {r.name for r in snap.nearest(frames[0], none[1], 1.0, ["id"], "name").collect()} == {None}


def test_route_candidates_in_doubling_radii(spark, monkeypatch):
    import random

    rng = random.Random(9)
    at = lambda: (rng.gauss(0, 1), rng.gauss(0, 1))
    routes = {k: [at() for _ in range(6)] for k in range(150)} | {150 + k: [(0.0, 0.0), (1.0, 1.0)] for k in range(50)}
    trips = [(i, *at(), *at()) for i in range(60)] + [(60 + i, 0.1, 0.0, 1.0, 0.9) for i in range(20)] + [(80, 30.0, 0.0, 0.0, 0.0), (81, None, 0.0, 0.0, 0.0)]
    seen, whole = [], snap.within
    monkeypatch.setattr(snap, "within", lambda *a, **k: seen.append(a[2]) or whole(*a, **k))
    frames = points(spark, trips, "id long, x1 double, y1 double, x2 double, y2 double"), points(spark, [(k, *p) for k, v in routes.items() for p in v], "route long, x double, y double")
    for tolerance in (0.3, 2.0):
        got = {r.id: (r.route, r.d1, r.d2) for r in snap.route_candidates(*frames, tolerance).collect()}
        want = {}
        for i, *e in trips:
            if e[0] is not None:
                away = [[min(((x - a) * (x - a) + (y - b) * (y - b)) ** 0.5 for a, b in v) for x, y in (e[:2], e[2:])] for v in routes.values()]
                best = min(((a + b, k, a, b) for k, (a, b) in zip(routes, away, strict=True) if a <= tolerance and b <= tolerance), default=None)
                if best:
                    want[i] = best[1:]
        assert got == want
    assert min(seen) < 0.3  # not all routes within the tolerance
