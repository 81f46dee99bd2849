"""Mobility tables as views of the driver's tables, in DataFrames and in SQL.

Trips are consecutive events of a user; lines are embeddings read as 32 points; road records are line items from a
supplier's to a part's number; segments are line items under their part's brand; count sites are orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import flows


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    seconds = f"datediff(cast({ts} as date), date'1970-01-01') * 86400L + hour({ts}) * 3600 + minute({ts}) * 60"
    return F.expr(f"({seconds}) * 1000000L + cast(extract(second from {ts}) * 1000000 as bigint)")


def trips(spark: SparkSession, d: str) -> DataFrame:
    found = flows.trips_from_events(table(spark, d, "events"), "user_id", micros(), "event_type", ["event_id"])
    return found.withColumnRenamed("event_id", "trip_id")


TRIP = """ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events),
le AS (SELECT *, lead(us) OVER w AS nx, lead(event_type) OVER w AS pt FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
trip AS (SELECT event_id AS trip_id, user_id AS person, event_type AS mode, event_type AS purpose_from, pt AS purpose_to,
  (us % 86400000000) / 1e6 AS t_start, (us % 86400000000) / 1e6 + (nx - us) / 1e6 AS t_end FROM le WHERE nx IS NOT NULL)"""


def bin_sql(t: str) -> str:
    return f"CAST(greatest(least(floor({t} / 900) - 12, 83), 0) AS INTEGER)"


def polylines(spark: SparkSession, d: str) -> DataFrame:
    """id, cls, points."""
    at = lambda k: F.element_at("embedding", k).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda k: F.struct(at(2 * k + 1).alias("x"), at(2 * k + 2).alias("y")))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cls"), points.alias("points"))


VERTEX = """v AS (SELECT vec_id AS id, label AS cls, k AS pos, CAST(embedding[2 * k + 1] AS DOUBLE) AS x, CAST(embedding[2 * k + 2] AS DOUBLE) AS y
  FROM embeddings, range(32) AS t(k))"""
SEGMENT = (
    VERTEX
    + """,
sg AS (SELECT id, cls, pos, x AS ax, y AS ay, lead(x) OVER w AS b_x, lead(y) OVER w AS b_y FROM v WINDOW w AS (PARTITION BY id ORDER BY pos)),
sl AS (SELECT *, sqrt((b_x - ax) * (b_x - ax) + (b_y - ay) * (b_y - ay)) AS length FROM sg WHERE b_x IS NOT NULL),
seg AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS along,
  sum(length) OVER (PARTITION BY id) AS total FROM sl)"""
)

#: Road counts: nine columns, each of the records whose discount is at least so many percent.
COUNTS = [f"c{i}" for i in range(9)]


def directed_roads(spark: SparkSession, d: str) -> DataFrame:
    """u, v, key, c0 to c8, ms, highway and all columns that order a line item."""
    n = table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))  # one row
    counts = {f"c{i}": F.when(F.col("l_discount") >= i / 100, F.col("l_quantity")).otherwise(0.0) for i in range(9)}
    ms = F.when(F.col("l_returnflag") == "A", 30).when(F.col("l_returnflag") == "N", 55).otherwise(95) + F.when(F.col("l_linestatus") == "F", 0).otherwise(15)
    rows = table(spark, d, "lineitem").join(F.broadcast(n))
    return rows.select(F.col("l_suppkey").alias("u"), F.pmod("l_partkey", "n").alias("v"), F.col("l_linenumber").alias("key"), *[c.alias(k) for k, c in counts.items()], ms.alias("ms"), F.concat("l_returnflag", "l_linestatus").alias("highway"))


DIRECTED = (
    "dr AS (SELECT l_suppkey AS u, l_partkey % (SELECT count(*) FROM supplier) AS v, l_linenumber AS key, "
    + ", ".join(f"CASE WHEN l_discount >= {i / 100} THEN l_quantity ELSE 0 END AS c{i}" for i in range(9))
    + """, CASE l_returnflag WHEN 'A' THEN 30 WHEN 'N' THEN 55 ELSE 95 END + CASE l_linestatus WHEN 'F' THEN 0 ELSE 15 END AS ms,
  l_returnflag || l_linestatus AS highway FROM lineitem)"""
)
ROAD = (
    DIRECTED
    + """,
road AS (SELECT least(u, v) AS lo, greatest(u, v) AS hi, key, """
    + ", ".join(f"sum(c{i}) AS c{i}" for i in range(9))
    + """, max(ms) AS ms, min(highway) AS highway FROM dr GROUP BY ALL)"""
)


def named_segments(spark: SparkSession, d: str) -> DataFrame:
    """name, class, length, flow, brandless suppkey: line items under their part's brand."""
    items = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("p_brand").alias("name"), F.col("p_type").alias("class"), F.col("l_quantity").alias("length"), F.col("l_extendedprice").alias("flow"), F.col("l_tax").alias("tax"), F.col("p_size").alias("lanes"), "l_suppkey", "l_partkey")


NAMED = """ns AS (SELECT p_brand AS name, p_type AS class, l_quantity AS length, l_extendedprice AS flow, l_tax AS tax, p_size AS lanes, l_suppkey, l_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
