"""Hand-worked values of the scalar operators."""

import math

import pytest
from pyspark.sql import functions as F

from tramline.functions import bins, geo, text


def one(spark, *columns, data=((0,),), schema="i int"):
    return spark.createDataFrame(list(data), schema).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_activity_times(spark):
    df = spark.createDataFrame([("Start Time: 23:50:00, End Time: 00:10:30.5",), ("no time",), (None,)], "a string")
    start, end = text.activity_times(F.col("a"))
    assert [tuple(r) for r in df.select(start, end).collect()] == [(85800.0, 87030.5), (None, None), (None, None)]


def test_wkt(spark):
    df = spark.createDataFrame([("LINESTRING (0 0, 3 4, 3 10)",), ("LINESTRING (0 0)",), ("None",), (None,), ("LINESTRING (1 2, 3 4, 5)",), ("POINT (-1.5e2 7)",)], "w string")
    x, y = text.wkt_coordinates(F.col("w"))
    got = [tuple(r) for r in df.select(x, y).collect()]
    assert got[:5] == [([0, 3, 3], [0, 4, 10]), (None, None), (None, None), (None, None), ([1, 3], [2, 4])]
    px, py = text.wkt_point(F.col("w"))
    assert tuple(df.select(px, py).collect()[5]) == (-150.0, 7.0)
    assert one(spark, text.vertex_count(F.lit("a, b, c")))[0] == 3


def test_ages_and_maps(spark):
    rows = [("25-34 år", 99), (None, 70), (None, None), ("7 år", None), ("barn", 200)]
    df = spark.createDataFrame(rows, "g string, a int")
    assert [r[0] for r in df.select(text.age_band(F.col("g"), F.col("a"))).collect()] == ["25-44", "65+", "Unknown", "0-15", "65+"]
    assert tuple(one(spark, text.mapped(F.lit("Män"), text.SEXES, "Unknown"), text.mapped(F.lit(None).cast("string"), text.SEXES, "Unknown"), text.folded(F.lit("Taxi"), ["Car"]))) == ("Men", "Unknown", "Other")


def test_tags_and_numbers(spark):
    got = one(spark, *[text.first_number(F.lit(v)) for v in ("3;2", "3.5 m", "none")], text.first_of(F.array(F.lit(50), F.lit(70))), text.distinct_join(F.array(F.lit("b"), F.lit("a"), F.lit("b"))))
    assert tuple(got) == (3.0, 3.5, None, 50, "b | a")
    tags = F.create_map(F.lit("cycleway:left"), F.lit("lane"), F.lit("sidewalk"), F.lit("no"), F.lit("oneway"), F.lit("yes"))
    assert tuple(one(spark, text.any_tag(tags, "cycleway"), text.any_tag(tags, "sidewalk"), text.tag_is(tags, "oneway", "yes"), text.tag_is(tags, "x", "y"))) == (True, False, True, False)
    null = F.lit(None).cast("string")
    assert tuple(one(spark, text.allowed(null, ["path"]), text.allowed(F.lit("path"), ["path"]), text.street_name(null), text.street_name(F.lit(" a ")))) == (True, False, "", "a")
    roads = one(spark, text.road_number(F.lit(6), F.lit(0), F.lit(True)), text.road_number(F.lit(155), F.lit(2), F.lit(False)), text.road_number(F.lit(None).cast("int"), F.lit(2), F.lit(False)))
    assert tuple(roads) == ("E6", "155.2", None)


def test_text_forms(spark):
    assert one(spark, text.html_escape(F.lit('<a href="x">&'))) [0] == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert one(spark, text.url_parameters(F.lit("http://x/y?a=1&b=2&a=3#top")))[0] == {"b": "2", "a": "3"}
    assert tuple(one(spark, text.clock(F.lit(65)), text.clock(F.lit(1500)), text.clock(F.lit(-1)))) == ("01:05", "01:00", "23:59")
    assert str(one(spark, text.date_of(F.lit(20190331)))[0]) == "2019-03-31"
    df = spark.createDataFrame([("MalmÃ¶",), ("Malmö",), ("plain",), (None,), ("â‚¬ och Ã¥",)], "t string")
    assert [r[0] for r in df.select(text.repair_mojibake(F.col("t"))).collect()] == ["Malmö", "Malmö", "plain", None, "€ och å"]


def test_projection(spark):
    points = [(11.968, 57.706, 319350.527, 6400020.959), (11.5909, 57.5033, 295759.112, 6378540.357)]
    df = spark.createDataFrame(points, "lon double, lat double, x double, y double")
    x, y = geo.to_sweref(F.col("lon"), F.col("lat"))
    for r in df.select("x", "y", x.alias("e"), y.alias("n")).collect():
        assert abs(r.x - r.e) < 1e-3 and abs(r.y - r.n) < 1e-3
    back = geo.with_wgs84(spark.createDataFrame([(299000.0, 6383900.0)], "x double, y double"), "x", "y").first()
    assert abs(back.lon - 11.640467) < 1e-6 and abs(back.lat - 57.552810) < 1e-6
    assert abs(geo.meridian_quarter() - 10_001_965.729) < 1e-3


def test_distances(spark):
    lit = lambda *v: [F.lit(float(a)) for a in v]
    got = one(spark, geo.haversine(*lit(0, 0, 0, 1)), geo.point_segment_distance(*lit(5, 3, 0, 0, 10, 0)), geo.point_segment_distance(*lit(-3, 4, 0, 0, 10, 0)), geo.point_segment_distance(*lit(3, 4, 0, 0, 0, 0)), geo.equirectangular(*lit(0, 0, 1, 1)))
    assert got[0] == pytest.approx(geo.EARTH_RADIUS * math.pi / 180)
    assert tuple(got)[1:4] == (3, 5, 5)
    assert got[4] == pytest.approx(math.hypot(111320, 110540))


def test_bins(spark):
    times = [7200.0, 10800.0, 85800.0, 87030.5]
    assert [one(spark, bins.time_bin(F.lit(t)))[0] for t in times] == [0, 0, 83, 83]
    ix, iy = bins.cell_index(F.lit(299150.0), F.lit(6383950.0))
    assert tuple(one(spark, ix, iy, bins.in_raster(ix, iy), bins.in_raster(ix - 2, iy))) == (1, 0, True, False)
    cx, cy = bins.cell_centre(F.lit(1), F.lit(0))
    assert tuple(one(spark, cx, cy)) == (299150.0, 6383950.0)
    d = [F.lit(v) for v in (5.0, 11.0, 0.0, 110.0)]
    assert one(spark, bins.time_at(*d), bins.time_at(F.lit(0.0), F.lit(0.0), F.lit(7.0), F.lit(9.0)))[0] == 50
    assert one(spark, bins.vertex_fraction(F.lit(1), F.lit(3)) * 110)[0] == 55


def test_classes(spark):
    got = one(spark, bins.speed_class(F.lit(45)), bins.speed_class(F.lit(None).cast("int")), bins.speed_class(F.lit(float("nan"))), bins.speed_class(F.lit(500)))
    assert tuple(got) == (40, 50, 50, 120)
    got = one(spark, *[bins.plausible(F.lit(k), F.lit(m)) for k, m in ((5.0, "Walking"), (5.00001, "Walking"), (80.0, "Car"), (26.0, "Bicycle/E-bike"))])
    assert tuple(got) == (True, False, True, False)
    slow = lambda a, b: bins.slow_index(F.lit(a), F.lit(40), F.lit(b), F.lit(40))
    got = one(spark, slow(30, 10), slow(10, 30), slow(9, 0), slow(4, 4))
    assert got[0] == 3 and got[1] == pytest.approx(1 / 3) and got[2] is None and got[3] is None
    assert one(spark, bins.share_byte(F.lit(5), F.lit(510)), bins.share_byte(F.lit(9), F.lit(0)))[0] == 2
    bands = [bins.banded(F.lit(v), [0, 2000, 5000], ["<2k", "2-5k"]) for v in (0, 2000, 2001, 5001)]
    assert tuple(one(spark, *bands)) == (None, "<2k", "2-5k", None)
    assert tuple(one(spark, *[bins.interval_class(F.lit(k), F.lit(56)) for k in (1, 10, 11, 56)])) == (0, 0, 1, 5)
    assert one(spark, bins.log2_ratio(F.lit(0.0), F.lit(2.0)))[0] == pytest.approx(-20.93, abs=0.01)
    null = F.lit(None).cast("int")
    assert tuple(one(spark, bins.total_of([null, F.lit(2), null]), bins.total_of([null, null]), bins.saturating(F.lit(99999), 0, 65535), bins.per_lane(F.lit(10), F.lit(4)), bins.per_lane(F.lit(4), F.lit(4)))) == (2, None, 65535, 2.5, None)
    peak = F.lit(100.0)
    assert one(spark, bins.sqrt_byte(F.lit(25.0), peak))[0] == 128
    assert one(spark, bins.from_sqrt_byte(F.lit(255), peak))[0] == 100
    assert one(spark, bins.ramp(F.lit(0.5), [(0.0, (0, 0, 0)), (1.0, (200, 100, 0))]))[0] == [100, 50, 0]
    assert one(spark, bins.diverging(F.lit(-9.0), 2, (1, 2, 3), (0, 0, 0), (9, 9, 9)))[0] == [1, 2, 3]
    u = one(spark, bins.unit_hash(F.lit(1)))[0]
    assert 0 <= u < 1


def test_poisson():
    want = {0: (0, 3.6889), 1: (0.0253, 5.5716), 4: (1.0899, 10.2416), 10: (4.7954, 18.3904), 100: (81.364, 121.6268)}
    for k, (low, high) in want.items():
        assert bins.poisson_interval(k) == pytest.approx((low, high), abs=1e-3)


def test_poisson_join(spark):
    df = spark.createDataFrame([(0,), (4,), (400,), (None,)], "k long")
    got = {r.k: (r.lo95, r.hi95, r.rse) for r in bins.with_poisson(df, "k").collect()}
    assert got[4][2] == 0.5 and got[0][2] is None and got[400][:2] == pytest.approx((360.8, 439.2)) and got[None] == (None, None, None)


def test_geodesic(spark):
    # A degree of latitude at the equator and near a pole, and of longitude at the equator.
    args = [(0, 0, 0, 1, 110574.4), (0, 89, 0, 90, 111693.9), (0, 0, 1, 0, 111319.5), (5, 5, 5, 5, 0)]
    for *c, want in args:
        assert one(spark, geo.geodesic(*[F.lit(float(v)) for v in c]))[0] == pytest.approx(want, abs=3)
