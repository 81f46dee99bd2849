"""Flows, roads, corridors, ranks and samples: hand-worked values."""

import math

import pytest
from pyspark.sql import functions as F

from tramline.functions import bins
from tramline.operators import corridors, flows, pack, roads, sampling, stats, views


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_under_way(spark):
    trips = frame(spark, [("Car", 28800.0, 30000.0), ("Car", 29400.0, 31200.0)], "mode string, t_start double, t_end double")
    got = {r.bin: r.n for r in flows.under_way(trips, ["mode"]).collect()}
    assert len(got) == 84 and {b: n for b, n in got.items() if n} == {20: 2, 21: 2, 22: 1}
    assert flows.moving_at(trips, 29400.0, ["mode"]).first().n == 2
    series = {r.bin: r.n for r in flows.interval_series(trips, ["mode"], 0.0, 86400.0, 24).collect()}
    assert series == {8: 2}


def test_distinct_load_and_hours(spark):
    points = frame(spark, [(1, 7, 4), (1, 7, 4), (1, 7, 5), (2, 7, 4)], "trip long, cell long, bin int")
    cube = flows.distinct_load(points, "trip", ["cell", "bin"])
    assert {(r.cell, r.bin): r.n for r in cube.collect()} == {(7, 4): 2, (7, 5): 1}
    # A trip in two quarters of an hour counts twice.
    assert [(r.hour, r.n) for r in flows.hourly(cube, ["cell"]).collect()] == [(1, 3)]


def test_assignment_day_and_time(spark):
    kind = "trip_id long, piece int, edge_id long, bin int"
    short = frame(spark, [(1, 0, 10, 3), (1, 1, 10, 3)], kind)
    long = frame(spark, [(1, 2, 11, 3)], kind)
    other = frame(spark, [(1, 2, 99, 3), (2, 0, 12, 4), (2, 1, None, 4)], kind)
    triples = flows.assign(short, long, other)
    assert sorted((r.trip_id, r.edge_id, r.bin) for r in triples.collect()) == [(1, 10, 3), (1, 11, 3), (2, 12, 4)]
    rich = triples.join(frame(spark, [(1, True, "Car"), (2, False, "Bus")], "trip_id long, plausible boolean, mode string"), "trip_id")
    day = {r.edge_id: (r.trips_all, r.trips, r["mode:Car"], r["mode:Bus"]) for r in flows.flow_day(rich, {"mode": ["Car", "Bus"]}).collect()}
    assert day == {10: (1, 1, 1, 0), 11: (1, 1, 1, 0), 12: (1, 0, 0, 0)}
    assert {(r.edge_id, r.mode, r.bin): r.trips for r in flows.flow_time(rich).collect()} == {(10, "Car", 3): 1, (11, "Car", 3): 1}


def test_budget_and_rows(spark):
    cube = frame(spark, [("a", 10)] * 5 + [("b", 5)] * 4 + [("c", 1)] * 3, "seg string, trips long")
    assert {r.seg for r in flows.budgeted(cube, "seg", F.col("trips"), 8).collect()} == {"a"}
    assert [tuple(r) for r in flows.row_starts(cube, "seg").orderBy("seg").collect()] == [("a", 0, 0, 5), ("b", 1, 5, 4), ("c", 2, 9, 3)]


def test_roads(spark):
    kind = "u long, v long, key int, c0 double, c8 double, name string, row int, ms int"
    directed = frame(spark, [(7, 3, 0, 2.0, 1.0, None, 0, 50), (3, 7, 0, 5.0, 0.0, "x", 1, 70), (7, 3, 0, 0.0, 0.0, "y", 2, 30)], kind)
    r = roads.undirected(directed, ["c0", "c8"], ["name"], ["ms"], ["row"]).first()
    assert (r.lo, r.hi, r.key, r.c0, r.c8, r.name, r.ms) == (3, 7, 0, 7, 1, "x", 70)
    pair = roads.both_directions(directed, "c0")
    assert [(r.u, r.v, r.there, r.back) for r in pair.collect()] == [(3, 7, 5, 2)]
    split = roads.direction_split(frame(spark, [(5.0, 5.0), (10.0, 0.0), (9.0, 3.0)], "there double, back double")).first()
    assert (split.n, split.equal_pct, split.one_way_pct, split.busier_share) == (3, pytest.approx(100 / 3), pytest.approx(100 / 3), 0.75)
    two = frame(spark, [(30.0, 10.0), (10.0, 30.0)], "c0 double, c8 double")
    assert [r.slow_index for r in roads.with_slow_index(two, "c0", "c8").orderBy("c8").collect()] == [3, pytest.approx(1 / 3)]
    assert {r["filter"]: (r.roads, r.crossings) for r in roads.sweep(two, ["c0", "c8"]).collect()} == {"c0": (2, 40), "c8": (2, 40)}


def test_corridors(spark):
    seg = frame(spark, [("a", 10.0, 100.0), ("a", 40.0, 300.0), ("b", 1.0, 1000.0)], "name string, v double, len double")
    got = {r.name: (r.m_mean, r.m_vkm, r.m_n) for r in corridors.weighted(seg, "name", "v", "len", "m").collect()}
    assert got == {"a": (32.5, 13, 2), "b": (1, 1, 1)}
    shares = corridors.with_shares(frame(spark, [("a", 3.0), ("b", 1.0)], "name string, v double"), ["v"])
    assert {r.name: r.v_share for r in shares.collect()} == {"a": 750, "b": 250}
    assert [r.name for r in corridors.top(shares, F.col("v"), 1, "name").collect()] == ["a"]
    assert [corridors.verdict(F.lit(v)) is not None for v in (2.0, None)] == [True, True]


def test_ranks(spark):
    df = frame(spark, [(10.0,), (20.0,), (20.0,), (40.0,), (None,)], "v double")
    got = sorted((r.v, r.p) for r in stats.with_percent_rank(df, "v", "p").where("v is not null").collect())
    assert [p for _, p in got] == [0.25, 0.625, 0.625, 1]
    pairs = [(float(i), float(i * i)) for i in range(1, 9)]
    seven, eight = (stats.spearman(frame(spark, pairs[:n], "a double, b double"), "a", "b").first() for n in (7, 8))
    assert (seven.n, seven.rho, seven.r_log) == (7, None, None) and (eight.n, eight.rho) == (8, 1.0)
    flat = stats.spearman(frame(spark, [(1.0, float(i)) for i in range(9)], "a double, b double"), "a", "b").first()
    assert flat.rho is None
    fit = stats.loglog_fit(frame(spark, [(x, 3 * x**2) for x in (1.0, 2.0, 5.0)], "x double, y double"), "x", "y")
    assert fit.first().slope == pytest.approx(2) and fit.first().intercept == pytest.approx(math.log(3))
    assert stats.predicted(frame(spark, [(4.0,)], "x double"), fit, "x").first().predicted == pytest.approx(48)


def test_quantiles(spark):
    df = frame(spark, [(float(i),) for i in range(1, 11)], "v double")
    assert stats.described(df, "v", (), (0.95,)).first().p95 == pytest.approx(9.55)
    assert stats.lower_quantile(df, "v", 0.95).first().value == 9
    assert stats.lower_quantile(df.where("v > 99"), "v", 0.95).first().value == 1


def test_samples(spark):
    rows = [(i, "a" if i < 900 else "b" if i < 999 else "c") for i in range(1000)]
    df = frame(spark, rows, "id long, mode string")
    got = {r.mode: r.n for r in sampling.stratified(df, "mode", "id", 100).groupBy("mode").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"a": 90, "b": 10, "c": 1}
    one, two = ({r.id for r in sampling.stratified(d, "mode", "id", 100).collect()} for d in (df, df.repartition(7)))
    assert one == two
    given = sampling.stochastic_counts(frame(spark, [(i,) for i in range(400)], "id long"), F.lit(1 / 400), 1000, F.col("id")).agg(F.sum("particles")).first()[0]
    assert abs(given - 1000) < 60


def test_views(spark):
    kind = "mode string, age string, plausible boolean"
    trips = frame(spark, [("Car", "25-44", True), ("Bus", "25-44", True), ("Car", "65+", False)], kind)
    assert trips.where(views.chosen({"age": []})).count() == 0
    got = {r["mode"]: (r.active, r.shown) for r in views.grouped(trips, "mode", ["Car"], {"age": ["25-44"]}, True).collect()}
    assert got == {"Car": (1, 1), "Bus": (1, 0)}
    assert views.share_lens(trips, "mode", {"mode": ["Car"], "age": ["65+"]}) is None
    assert views.share_lens(trips, "mode", {"age": ["65+", "25-44"]}) is None
    lens = {r["mode"]: r.share for r in views.share_lens(trips, "mode", {"age": ["65+"]}, 1).collect()}
    assert lens == {"Car": 0.5, "Bus": 0}


def test_profiles(spark):
    shape = frame(spark, [(h, "day" if 6 <= h < 18 else "night", float(1 + h % 3)) for h in range(24)], "hour int, period string, s double")
    periods = frame(spark, [("x", "day", 0.75), ("x", "night", 0.25)], "g string, period string, g2 double").withColumnRenamed("g", "cls").withColumnRenamed("g2", "g")
    got = flows.fitted_profile(shape, periods, "cls").collect()
    assert sum(r.share for r in got) == pytest.approx(1, abs=1e-5)
    assert sum(r.share for r in got if 6 <= r.hour < 18) == pytest.approx(0.75, abs=1e-5)
    links = frame(spark, [("a", float(v)) for v in range(10)] + [("b", 100.0)], "c string, v double")
    assert {r.c: r.used for r in flows.with_fallback(links, "c", "v").collect()} == {"a": 4.5, "b": 5.0}


def test_payload_round_trip(spark):
    df = frame(spark, [(i, i * 7 % 50) for i in range(20)], "id long, n long")
    columns = {"id": "u4", "n": "u2"}
    text = pack.payload({"first": 12}, {"modes": ["Car"]}, df, columns, ["id"])
    got = pack.decoded(text, columns)
    assert got["id"].tolist() == list(range(20)) and got["n"].tolist() == [i * 7 % 50 for i in range(20)]
    with pytest.raises(ValueError):
        pack.payload({}, {}, df, columns, ["id"], most=5)


def test_reconciliation(spark):
    a = frame(spark, [(1, 2.0), (2, None), (3, 1.0)], "k long, v double")
    b = frame(spark, [(1, 2.0), (2, None), (4, 1.0)], "k long, v double")
    assert tuple(stats.matches(a, b, ["k"], ["v"]).first()) == (3, 3, 2)
    assert bins.poisson_interval(0)[0] == 0


def test_running_sum_in_ranges(spark):
    from tramline.operators.prefix import running_sum

    df = frame(spark, [(i * 37 % 101, i % 5) for i in range(101)], "k long, w long")
    one, two = ({r.k: r.s for r in running_sum(df, [F.col("k").desc()], F.col("w"), "s", small).collect()} for small in (1 << 40, 0))
    assert one == two and len(one) == 101


def test_aligned_and_checked_joins(spark):
    a, b = frame(spark, [(0, "x"), (1, "y")], "source_row long, a string"), frame(spark, [(1, 2.0), (0, 1.0)], "source_row long, b double")
    assert {(r.a, r.b) for r in roads.positional_join(a, b).collect()} == {("x", 1.0), ("y", 2.0)}
    with pytest.raises(ValueError):
        roads.positional_join(a, b.where("b > 1"))
    assert {r.a: r.b for r in roads.with_zero(a, b.where("b > 1"), "source_row", "b").collect()} == {"x": 0, "y": 2}
    assert roads.checked_join(a, b, "source_row").count() == 2
    with pytest.raises(Exception, match="no street 0"):
        roads.checked_join(a, b.where("b > 1"), "source_row").collect()


def test_rerouted(spark):
    kind = "trip_id long, match string, points array<int>"
    trips = frame(spark, [(1, "straight", [1]), (2, "osm_route", [2]), (3, "straight", [3])], kind)
    new = frame(spark, [(1, [9]), (2, [9])], "trip_id long, points array<int>")
    assert {r.trip_id: (r.match, r.points) for r in flows.rerouted(trips, new).collect()} == {1: ("osm_network", [9]), 2: ("osm_route", [2]), 3: ("straight", [3])}


def test_spearman_of_values_that_change_with_each_evaluation(spark):
    import random

    # As sums of doubles do, whose last bits depend on the order of their rows.
    noise = F.udf(lambda i: i + random.random() / 2, "double").asNondeterministic()
    rows = spark.range(40).select(noise("id").alias("a"), F.col("id").cast("double").alias("b"))
    got = stats.spearman(rows, "a", "b").first()
    assert (got.n, got.rho) == (40, 1.0) and got.r_log > 0.9
    keyed = rows.withColumn("key", F.col("b"))
    residuals = stats.rank_residual(keyed, "key", "a", "b", F.lit(True)).collect()
    assert len(residuals) == 40 and all(r.residual == 0.0 for r in residuals)
