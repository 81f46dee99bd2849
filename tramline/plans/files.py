"""Queries that write a source's format to the shared folder and read it back."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.functions import bins
from tramline.operators import pack, polyline, roads
from tramline.plans.base import VERTEX, polylines, table
from tramline.plans.registry import query
from tramline.sources import geometry, roaddb, sqlite, tables
from tramline.store import scratch, stage

_FIRST = "round(max(x) FILTER (pos = 0), 6) AS x0, round(max(y) FILTER (pos = 31), 6) AS y1"


def _as_parts(spark: SparkSession, d: str) -> DataFrame:
    return polylines(spark, d).select("id", "cls", F.lit("LineString").alias("kind"), F.array("points").alias("parts"))


@query("geojson_scan", f"""WITH {VERTEX} SELECT CAST(id AS VARCHAR) AS id, CAST(cls AS VARCHAR) AS cls, 'LineString' AS kind, count(*) AS n, {_FIRST} FROM v GROUP BY ALL""")
def geojson_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as GeoJSON, a feature a line, and read in splits."""
    path = scratch(spark, "lines.geojson")
    geometry.write_geojson(_as_parts(spark, d), path, "kind", "parts", ["id", "cls"])
    rows = geometry.read_geojson(spark, path, ["id", "cls"], lines=True)
    p = F.col("parts")[0]
    return rows.select("id", "cls", F.col("geometry_type").alias("kind"), F.size(p).cast("long").alias("n"), F.round(p[0]["x"], 6).alias("x0"), F.round(F.element_at(p, -1)["y"], 6).alias("y1"))


@query("geojson_box", f"""WITH {VERTEX} SELECT CAST(id AS VARCHAR) AS id FROM v WHERE x BETWEEN 0.3 AND 0.6 AND y BETWEEN 0.1 AND 0.9 GROUP BY id""")
def geojson_box(spark: SparkSession, d: str) -> DataFrame:
    """Of lines written as whole collections, those with a vertex in a box, without their geometry."""
    path = scratch(spark, "boxed.geojson")
    geometry.write_geojson(_as_parts(spark, d), path, "kind", "parts", ["id"])
    return geometry.read_geojson(spark, path, ["id"], geometry=False, bbox=(0.3, 0.1, 0.6, 0.9), lines=True).select("id")


@query("positional_join", f"""WITH {VERTEX}, n AS (SELECT id, count(*) AS vertices, {_FIRST} FROM v GROUP BY ALL) SELECT CAST(id AS VARCHAR) AS id, CAST(id * 10 AS VARCHAR) AS flow, x0, y1 FROM n""")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of several files each, aligned by the place of their rows: lines with their flows."""
    # Written once: the bounds of ranges come from samples, which differ from one evaluation to the next.
    rows = stage(_as_parts(spark, d).withColumn("flow", F.col("id") * 10).repartitionByRange(4, "id").sortWithinPartitions("id"), "aligned")
    net, flow = scratch(spark, "network.geojson"), scratch(spark, "flows.geojson")
    geometry.write_geojson(rows, net, "kind", "parts", ["id"])
    point = F.array(F.slice(F.col("parts")[0], 1, 1))
    geometry.write_geojson(rows.select("flow", F.lit("Point").alias("kind"), point.alias("parts")), flow, "kind", "parts", ["flow"])
    a, b = geometry.read_geojson(spark, net, ["id"], lines=True), geometry.read_geojson(spark, flow, ["flow"], geometry=False, lines=True)
    p = F.col("parts")[0]
    return roads.positional_join(a, b).select("id", "flow", F.round(p[0]["x"], 6).alias("x0"), F.round(F.element_at(p, -1)["y"], 6).alias("y1"))


@query("geoparquet_scan", f"""WITH {VERTEX} SELECT id, 'LineString' AS kind, count(*) AS n, {_FIRST} FROM v GROUP BY ALL""")
def geoparquet_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as WKB in Parquet, and read."""
    path = scratch(spark, "lines.parquet")
    tables.write_parquet(_as_parts(spark, d).select("id", geometry.to_wkb(F.col("kind"), F.col("parts")).alias("geometry")), path)
    rows = tables.read_parquet(spark, path, ["id", "geometry"]).select("id", geometry.wkb_parts(F.col("geometry")).alias("g"))
    p = F.col("g.parts")[0]
    return rows.select("id", F.col("g.geometry_type").alias("kind"), F.size(p).cast("long").alias("n"), F.round(p[0]["x"], 6).alias("x0"), F.round(F.element_at(p, -1)["y"], 6).alias("y1"))


@query("csv_scan", """SELECT c_custkey, c_name, c_nationkey, round(c_acctbal / 3, 4) AS third FROM customer""")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV with four decimals and a byte order mark, and read by its schema."""
    path = scratch(spark, "customers.csv")
    tables.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", (F.col("c_acctbal") / 3).alias("third")), path)
    return tables.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, third double")


@query("parquet_sink", """SELECT CAST(l_partkey AS INTEGER) AS l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL""")
def parquet_sink(spark: SparkSession, d: str) -> DataFrame:
    """Rows written with a fixed schema, which puts their columns in order and casts them, and read in part."""
    path = scratch(spark, "items.parquet")
    schema = T.StructType([T.StructField("l_returnflag", T.StringType()), T.StructField("l_partkey", T.IntegerType()), T.StructField("l_quantity", T.FloatType())])
    tables.write_parquet(table(spark, d, "lineitem"), path, schema)
    return tables.read_parquet(spark, path, ["l_partkey", "l_returnflag"]).groupBy("l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("source_fallback", """SELECT s_suppkey, s_name FROM supplier""")
def source_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first file that exists of several names."""
    return tables.read_parquet(spark, tables.first_existing(spark, [f"{d}/suppliers_2030.parquet", f"{d}/supplier.geojson", f"{d}/supplier.parquet"]), ["s_suppkey", "s_name"])


@query("schema_listing", " UNION ALL ".join(
    f"SELECT '{t}' AS name, column_name AS \"column\", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'string' END AS type FROM (DESCRIBE SELECT * FROM {t})"
    for t in ("events", "orders", "part", "embeddings")
))
def schema_listing(spark: SparkSession, d: str) -> DataFrame:
    """Columns and types of four tables."""
    rows = [tables.columns_of(spark, f"{d}/{t}.parquet").select(F.lit(t).alias("name"), F.col("name").alias("column"), "type") for t in ("events", "orders", "part", "embeddings")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _databases(spark: SparkSession, d: str) -> str:
    """Customers in SQLite files of the shared folder, by market segment; SQLite needs a folder that executors can open."""
    folder = scratch(spark, "databases")
    if not folder.startswith(("file:", "/")):
        raise ValueError(f"SQLite files cannot be opened in {folder}")
    local = "/" + folder.removeprefix("file:").lstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(local, exist_ok=True)
        context = TaskContext.get()
        # Only a finished file has a name that is read, so a task that is run again does no harm.
        name = f"{local}/od_{context.partitionId()}"
        made = f"{name}.{context.taskAttemptId()}"
        with sqlite3.connect(made) as db:
            db.execute("CREATE TABLE person (uuid INTEGER, name VARCHAR(40), nation INT, balance REAL, segment TEXT)")
            db.execute("CREATE TABLE notes (line TEXT)")
            for batch in batches:
                db.executemany("INSERT INTO person VALUES (?, ?, ?, ?, ?)", zip(*(c.to_pylist() for c in batch.columns), strict=True))
        db.close()
        os.replace(made, f"{name}.db")
        yield pa.RecordBatch.from_arrays([pa.array([1])], ["done"])

    table(spark, d, "customer").repartition(4, "c_mktsegment").mapInArrow(write, "done long").count()
    spark.dataSource.register(sqlite.SqliteSource)
    return local


@query("sqlite_scan", """SELECT c_custkey AS uuid, c_acctbal AS balance, c_mktsegment AS segment FROM customer""")
def sqlite_scan(spark: SparkSession, d: str) -> DataFrame:
    """Some columns of a table that stands in several SQLite files."""
    return spark.read.format("sqlite").option("path", f"{_databases(spark, d)}/*.db").option("table", "person").option("columns", "uuid,balance,segment").load().drop("file")


@query("sqlite_persons", """SELECT c_custkey AS trip, c_name AS person, coalesce(c_mktsegment, 'Unknown') AS segment, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def sqlite_persons(spark: SparkSession, d: str) -> DataFrame:
    """Orders as trips with the attributes of their persons from all SQLite files."""
    people = spark.read.format("sqlite").option("path", f"{_databases(spark, d)}/*.db").option("table", "person").option("columns", "uuid,name,segment").load()
    trips = table(spark, d, "orders").select(F.col("o_custkey").alias("uuid"), "o_orderkey")
    joined = trips.join(people, "uuid")
    return joined.groupBy(F.col("uuid").alias("trip"), F.col("name").alias("person"), F.coalesce("segment", F.lit("Unknown")).alias("segment")).agg(F.count("o_orderkey").alias("n"))


@query("sqlite_catalog", """SELECT 'notes' AS name, 'line' AS "column", 'string' AS type UNION ALL SELECT 'person', unnest(['uuid', 'name', 'nation', 'balance', 'segment']), unnest(['bigint', 'string', 'bigint', 'double', 'string'])""")
def sqlite_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Tables and columns of SQLite files, from their catalogues."""
    folder = _databases(spark, d)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.db").load("file://" + folder).select("path")
    kind = "array<struct<name:string,column:string,type:string>>"

    @F.udf(kind)
    def listed(path: str) -> list[tuple]:
        return [(t, c, sqlite.spark_type(k)) for t, columns in sqlite.tables_of(path.removeprefix("file:")).items() for c, k in columns]

    return files.select(F.inline(listed("path"))).distinct()


@query("cache_anti", """SELECT 's' || s_suppkey AS rlid FROM supplier WHERE s_acctbal >= 0 EXCEPT SELECT 's' || l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09""")
def cache_anti(spark: SparkSession, d: str) -> DataFrame:
    """Reference ids that no record is cached for; those of some line items are."""
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string")).alias("rlid")
    asked = table(spark, d, "supplier").where("s_acctbal >= 0").select(name("s_suppkey"))
    seen = table(spark, d, "lineitem").where("l_quantity > 49 and l_discount > 0.09").select(name("l_suppkey"), F.lit("Gatunamn").alias("type"), F.lit("{}").alias("record"))
    path = scratch(spark, "road-cache")
    seen.write.parquet(path)
    return roaddb.missing(asked.unionByName(asked), roaddb.cached(spark, path))


@query("road_records", """WITH i AS (SELECT l_orderkey AS road, l_suppkey AS s, min(l_linenumber * 100000 + l_suppkey) AS p FROM lineitem GROUP BY ALL),
r AS (SELECT s_suppkey AS s, s_name AS name, 'E' || (s_nationkey + 1) || CASE WHEN s_suppkey % 3 > 0 THEN '.' || (s_suppkey % 3) ELSE '' END AS number,
  CASE WHEN s_acctbal < 0 THEN 'Enskild' ELSE s_name || ' (Kommun)' END AS manager, CAST(30 + 10 * (s_suppkey % 5) AS VARCHAR) AS lim FROM supplier),
j AS (SELECT road, p, name, number, manager, lim FROM i JOIN r USING (s)), f AS (SELECT road, col, v, min(p) AS p FROM (UNPIVOT j ON name, number, manager, lim INTO NAME col VALUE v) GROUP BY ALL)
SELECT road, string_agg(v, ' / ' ORDER BY p) FILTER (col = 'name') AS names, string_agg(v, ' / ' ORDER BY p) FILTER (col = 'number') AS numbers,
  string_agg(v, ' / ' ORDER BY p) FILTER (col = 'manager') AS managers, string_agg(v, ' / ' ORDER BY p) FILTER (col = 'lim') AS limits FROM f GROUP BY ALL""")
def road_records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as roads whose suppliers are reference ids: street names, road numbers, managers and speed limits from cached records,
    which a first call has to fetch."""
    s = table(spark, d, "supplier")
    rlid = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    record = lambda kind, *fields: F.struct(F.lit(kind).alias("type"), F.to_json(F.struct(*fields)).alias("record"))
    records = F.array(
        record("Gatunamn", F.col("s_name").alias("Namn")),
        record("Vägnummer", (F.col("s_nationkey") + 1).alias("Huvudnummer"), F.pmod("s_suppkey", F.lit(3)).alias("Undernummer"), F.lit(True).alias("Europaväg")),
        record("Väghållare", F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("Väghållarnamn"), F.when(F.col("s_acctbal") < 0, "Enskild").otherwise("Kommun").alias("Väghållartyp")),
        record("Hastighetsgräns", (F.lit(30) + 10 * F.pmod("s_suppkey", F.lit(5))).alias("Högsta_tillåtna_hastighet")),
    )
    known = s.select(rlid.alias("rlid"), F.inline(records))
    path = scratch(spark, "road-records")
    cache = roaddb.extend(spark, path, s.select(rlid.alias("rlid")), lambda ids: known.join(ids, "rlid"))
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("road"), "l_suppkey").agg(F.min(F.col("l_linenumber") * 100_000 + F.col("l_suppkey")).alias("p"))
    ids = items.groupBy("road").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "l_suppkey"))), lambda x: F.concat(F.lit("s"), x["l_suppkey"].cast("string"))).alias("ids"))
    return roaddb.described(ids, cache, "road", "ids")


@query("map_payload", """WITH c AS (SELECT p_brand AS segment, p_size AS bin, count(*) AS trips FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT *, CAST(round_even(255 * sqrt(trips / max(trips) OVER ()), 0) AS INTEGER) AS level, CAST(row_number() OVER (ORDER BY segment, bin) - 1 AS INTEGER) AS place FROM c""")
def map_payload(spark: SparkSession, d: str) -> DataFrame:
    """A cube packed as one document for a browser, sorted by segment and bin, and decoded again."""
    cube = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("trips"))
    peak = cube.agg(F.max("trips").alias("peak"))  # one row
    names = [r[0] for r in cube.select("p_brand").distinct().orderBy("p_brand").collect()]  # a vocabulary
    segment = F.array_position(F.array(*map(F.lit, names)), F.col("p_brand")) - 1
    rows = cube.join(F.broadcast(peak)).select(segment.alias("segment"), F.col("p_size").alias("bin"), "trips", bins.sqrt_byte(F.col("trips"), F.col("peak")).alias("level"))
    columns = {"segment": "u2", "bin": "u1", "trips": "u4", "level": "u1"}
    text = pack.payload({"unit": "trips"}, {"segment": names}, rows, columns, ["segment", "bin"])
    arrays = pack.decoded(text, columns)
    out = [(names[s], int(b), int(n), int(v), i) for i, (s, b, n, v) in enumerate(zip(*(arrays[c].tolist() for c in columns), strict=True))]
    return spark.createDataFrame(out, "segment string, bin int, trips long, level int, place int")


@query("statistics_sink", """SELECT l_returnflag AS flag, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY ALL""")
def statistics_sink(spark: SparkSession, d: str) -> DataFrame:
    """Statistics as a JSON document, and read from it."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"))
    path = scratch(spark, "statistics")
    spark.createDataFrame([(tables.statistics_json(rows),)], "value string").coalesce(1).write.text(path)
    return tables.read_json(spark, path, "flag string, n long, mean double")


@query("packed_lines", f"""WITH {VERTEX} SELECT id, CAST(pos AS INTEGER) AS pos, CAST(round_even(x * 1e4, 0) AS BIGINT) - coalesce(lag(CAST(round_even(x * 1e4, 0) AS BIGINT)) OVER w, 0) AS dx FROM v WINDOW w AS (PARTITION BY id ORDER BY pos)""")
def packed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each line's differences, at a scale at which none is split, packed to bytes and unpacked."""
    steps = polyline.deltas(polyline.halved_jumps(polyline.quantised(F.col("points"), 1e4)))
    # Written before and after, as the optimizer would mix the Python functions with expressions that cannot call them.
    coded = stage(polylines(spark, d).select("id", steps.alias("d")), "steps")
    back = stage(coded.select("id", pack.unpacked_deltas(pack.packed_deltas(F.col("d"))).alias("back")), "packed")
    return back.select("id", F.posexplode("back").alias("pos", "p")).select("id", "pos", F.col("p.x").alias("dx"))
