"""Sources and sinks on small files."""

import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from tramline.sources import geometry, overpass, roaddb, sqlite, tables
from tramline.streaming import quarters


def test_sqlite(spark, tmp_path):
    for name, rows in (("od_north.db", [("u1", "Car", 1, 2.5), ("u2", None, None, None)]), ("od_south.db", [("u3", "Bus", 3, 1.0)])):
        with sqlite3.connect(tmp_path / name) as db:
            db.execute('CREATE TABLE od (uuid TEXT, "mode" VARCHAR(9), n INTEGER, d REAL)')
            db.executemany("INSERT INTO od VALUES (?, ?, ?, ?)", rows)
    spark.dataSource.register(sqlite.SqliteSource)
    df = spark.read.format("sqlite").option("path", f"{tmp_path}/*.db").option("table", "od").load()
    got = df.withColumn("place", sqlite.neighbourhood(F.col("file"), r"od_([^/]+)\.db$")).drop("file").orderBy("uuid").collect()
    assert [tuple(r) for r in got] == [("u1", "Car", 1, 2.5, "north"), ("u2", None, None, None, "north"), ("u3", "Bus", 3, 1.0, "south")]
    some = spark.read.format("sqlite").option("path", f"{tmp_path}/*.db").option("table", "od").option("columns", "n, uuid").load()
    assert some.columns == ["n", "uuid", "file"] and some.count() == 3
    assert sqlite.tables_of(str(tmp_path / "od_north.db"))["od"][2] == ("n", "INTEGER")


def test_geojson(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"name": "a", "n": 3}, "geometry": {"type": "LineString", "coordinates": [[0, 0, 9], [1, 1, 9]]}},
        {"type": "Feature", "properties": {"name": None, "n": 4}, "geometry": {"type": "Point", "coordinates": [50, 50]}},
        {"type": "Feature", "properties": {"name": "c"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [4, 0], [4, 3], [0, 0]]], [[[9, 9], [8, 8], [9, 8], [9, 9]]]]}},
    ]
    path = str(tmp_path / "x.geojson")
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:3006"}}, "features": features}, f)
    rows = geometry.read_geojson(spark, path, ["name", "n"]).orderBy("source_row").collect()
    assert [(r.source_row, r.name, r.n, r.geometry_type, len(r.parts)) for r in rows] == [(0, "a", "3", "LineString", 1), (1, None, "4", "Point", 1), (2, "c", None, "MultiPolygon", 2)]
    assert [tuple(p) for p in rows[0].parts[0]] == [(0, 0), (1, 1)]
    assert geometry.read_geojson(spark, path, ["n"], bbox=(40, 40, 60, 60)).first().n == "4"
    assert geometry.read_geojson(spark, path, ["n"], geometry=False, max_features=2).count() == 2
    assert geometry.read_geojson(spark, path).columns == ["source_file", "source_row", "n", "name", "geometry_type", "parts"]
    with open(tmp_path / "lines.geojson", "w") as f:
        f.write('{"type": "FeatureCollection", "features": [\n' + ",\n".join(map(json.dumps, features)) + "\n]}\n")
    one, two = (geometry.read_geojson(spark, p, ["name", "n"], lines=n).orderBy("source_row").collect() for p, n in ((path, False), (str(tmp_path / "lines.geojson"), True)))
    assert one == two
    geometry.write_geojson(geometry.read_geojson(spark, path, ["name", "n"]).where("geometry_type <> 'MultiPolygon'").coalesce(1), str(tmp_path / "out"), "geometry_type", "parts", ["name", "n"])
    assert geometry.read_geojson(spark, str(tmp_path / "out"), ["name", "n"], lines=True).orderBy("source_row").collect() == one[:2]
    info = geometry.geojson_info(spark, path).first()
    assert (info.features, info.crs, sorted(info.fields)) == (3, "EPSG:3006", ["n", "name"])


def test_wkb_round_trip(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    rows = [("Point", [[(1.0, 2.0)]]), ("LineString", [ring[:2]]), ("Polygon", [ring, ring]), ("MultiLineString", [ring[:2], ring]), (None, None)]
    df = spark.createDataFrame(rows, f"k string, p {geometry.PARTS}").withColumn("w", geometry.to_wkb(F.col("k"), F.col("p")))
    for r in df.withColumn("g", geometry.wkb_parts(F.col("w"))).collect():
        assert (r.g.geometry_type, r.g.parts) == (r.k, r.p)
    raw = struct.pack("<BII3d", 1, 0x80000000 | 0x20000000 | 1, 3006, 5, 6, 7)
    package = b"GP\x00\x02" + struct.pack("<i4d", 3006, 0, 0, 1, 1)[:4] + struct.pack("<4d", 0, 1, 0, 1) + raw
    got = spark.createDataFrame([(raw,), (package,), (struct.pack(">BIIdddd", 0, 2, 2, 0, 1, 2, 3),)], "w binary").select(geometry.wkb_parts(F.col("w")).alias("g")).collect()
    assert [[tuple(p) for p in r.g.parts[0]] for r in got] == [[(5, 6)], [(5, 6)], [(0, 1), (2, 3)]]


def test_overpass(spark, tmp_path):
    way = lambda i, name, kind="residential": {"type": "way", "id": i, "tags": {"highway": kind, "name": name}, "geometry": [{"lon": 1.0, "lat": 2.0}, {"lon": 3.0, "lat": 4.0}]}
    relation = {"type": "relation", "id": 9, "tags": {"route": "tram", "ref": "11"}, "members": [{"type": "way", "ref": 1, "role": "", "geometry": [{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 1.0}]}, {"type": "node", "ref": 2, "role": "stop"}]}
    (tmp_path / "a.json").write_text(json.dumps({"elements": [way(1, "old"), way(2, "x", "motorway")]}))
    (tmp_path / "b.json").write_text(json.dumps({"elements": [way(1, "new"), relation]}))
    got = overpass.ways(spark, str(tmp_path), ["motorway"]).collect()
    assert [(r.way_id, r.name, [tuple(p) for p in r.points]) for r in got] == [(1, "new", [(1, 2), (3, 4)])]
    (r,) = overpass.routes(spark, str(tmp_path)).collect()
    assert (r.route_id, r["mode"], r.ref, r.way, len(r.points)) == (9, "tram", "11", 0, 2)


def test_lookup_cache(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []
    table = [("1", "Gatunamn", '{"Namn": "Storgatan"}'), ("1", "Vägnummer", '{"Huvudnummer": 6, "Undernummer": 0, "Europaväg": true}'), ("2", "Gatunamn", '{"Namn": "X", "Deleted": true}')]

    def fetch(ids):
        wanted = sorted(r.rlid for r in ids.collect())
        asked.append(wanted)
        return spark.createDataFrame([t for t in table if t[0] in wanted] or [("none", "x", '{"Deleted": true}')], roaddb.CACHE)

    ids = spark.createDataFrame([("1",), ("2",), ("1",), (None,)], "rlid string")
    roaddb.extend(spark, path, ids, fetch)
    cache = roaddb.extend(spark, path, ids, fetch)
    assert asked == [["1", "2"], []]
    roads = spark.createDataFrame([("r", ["1", "2", "1"])], "pair string, rlids array<string>")
    r = roaddb.described(roads, cache, "pair", "rlids").first()
    assert (r.names, r.numbers, r.managers) == ("Storgatan", "E6", "")


def test_tables(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "å", 1.25)], "a int, b string, c double")
    path = str(tmp_path / "t.parquet")
    tables.write_parquet(df, path, df.select("b", F.col("a").cast("long")).schema)
    assert tables.read_parquet(spark, path, ["a"]).schema.simpleString() == "struct<a:bigint>"
    assert {r.name: r.type for r in tables.columns_of(spark, path).collect()} == {"b": "string", "a": "bigint"}
    with pytest.raises(ValueError):
        tables.write_parquet(df.drop("a"), str(tmp_path / "u"), df.schema)
    tables.write_csv(df.coalesce(1), str(tmp_path / "c"))
    (part,) = (tmp_path / "c").glob("part-*")
    assert part.read_bytes().decode("utf-8-sig").split() == ["a,b,c", "1,å,1.2500"] and part.read_bytes().startswith(b"\xef\xbb\xbf")
    assert tables.read_csv(spark, str(tmp_path / "c"), "a int, b string, c double").first().c == 1.25
    assert json.loads(tables.statistics_json(df)) == [{"a": 1, "b": "å", "c": 1.25}]
    assert tables.first_existing(spark, [str(tmp_path / "no"), path]) == path
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, [str(tmp_path / "no")])
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert tables.verified(spark, str(tmp_path / "f.bin"), "900150983cd24fb0d6963f7d28e17f72", 3) and not tables.verified(spark, str(tmp_path / "f.bin"), "0" * 32)
    (tmp_path / "j.json").write_text('{"x": {"y": [1, 2]}}')
    assert tables.read_json(spark, str(tmp_path / "j.json")).select("x.y").first().y == [1, 2]
    monkeypatch.delenv("MY_KEY", raising=False)
    (tmp_path / ".env").write_text("# c\nOTHER=1\nMY_KEY='abc'\n")
    assert tables.secret("MY_KEY", env_file=str(tmp_path / ".env")) == "abc" and tables.secret("NONE") is None
    monkeypatch.setenv("MY_KEY", "env")
    assert tables.secret("MY_KEY") == "env"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 3}:{i % 60:02d}:00", "a" if i % 4 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "t string, kind string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "kind")
    path = str(tmp_path / "e")
    df.repartition(3).write.parquet(path)
    got = {(r.kind, r.start): r.n for r in quarters.counted(spark, path, "ts", "kind").collect()}
    want = {}
    for r in df.collect():
        k = (r.kind, r.ts.replace(minute=r.ts.minute // 15 * 15))
        want[k] = want.get(k, 0) + 1
    assert got == want


def test_sources_dealt_by_ranges_stay_aligned(spark, tmp_path):
    from tramline.plans import catalog

    # More rows than are sampled for the bounds of the ranges.
    lines = spark.range(20_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: (F.col("id") % 97 + k).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = catalog.QUERIES["positional_join"](spark, str(tmp_path)).collect()
    assert len(rows) == 20_000 and all(r.flow == r.id + "0" or r.id == r.flow == "0" for r in rows)
