"""The interactive map's queries, at a fixed state each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import bins
from tramline.operators import polyline, stats, views
from tramline.plans.base import TRIP, VERTEX, bin_sql, polylines, table, trips
from tramline.plans.registry import query


@query("filter_group_counts", f"""WITH {TRIP}, p AS (SELECT c_custkey, c_mktsegment FROM customer)
SELECT mode, count(*) AS active, count(*) FILTER (mode IN ('view', 'click')) AS shown FROM trip JOIN p ON c_custkey = person WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND purpose_to IN ('click', 'purchase', 'view') GROUP BY ALL""")
def filter_group_counts(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), "c_mktsegment")
    rows = trips(spark, d).join(people, "person")
    return views.grouped(rows, "mode", ["view", "click"], {"c_mktsegment": ["BUILDING", "MACHINERY"], "purpose_to": ["click", "purchase", "view"]})


def _cube(spark: SparkSession, d: str) -> DataFrame:
    rows = trips(spark, d).withColumn("bin", bins.time_bin(F.col("t_start")))
    return rows.groupBy(F.col("purpose_to").alias("segment"), "mode", "bin").agg(F.count(F.lit(1)).alias("trips"))


@query("bin_volumes", f"""WITH {TRIP} SELECT purpose_to AS segment, count(*) AS n FROM trip WHERE mode IN ('view', 'click') AND {bin_sql("t_start")} = 20 GROUP BY ALL""")
def bin_volumes(spark: SparkSession, d: str) -> DataFrame:
    return views.volumes(_cube(spark, d), "segment", ["view", "click"], 20)


@query("day_volumes", f"""WITH {TRIP} SELECT purpose_to AS segment, count(*) AS n FROM trip WHERE mode IN ('view', 'error') GROUP BY ALL""")
def day_volumes(spark: SparkSession, d: str) -> DataFrame:
    return views.volumes(_cube(spark, d), "segment", ["view", "error"])


@query("street_tooltip", f"""WITH {TRIP} SELECT mode, count(*) AS n FROM trip WHERE purpose_to = 'click' GROUP BY ALL""")
def street_tooltip(spark: SparkSession, d: str) -> DataFrame:
    streets = table(spark, d, "events").select(F.col("event_type").alias("segment")).distinct()
    return views.tooltip(streets, _cube(spark, d), "segment", "click").select(F.explode("by_mode").alias("mode", "n"))


@query("heat_surface", f"""WITH {VERTEX}, c AS (SELECT CAST(floor((x + 1) / 0.1) AS BIGINT) AS ix, CAST(floor((y + 1) / 0.1) AS BIGINT) AS iy, count(*) AS n FROM v GROUP BY ALL)
SELECT ix + i AS ix, iy + j AS iy, sum(n * CASE WHEN i = 0 AND j = 0 THEN 1.0 ELSE 0.5 END) AS heat FROM c, (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS j) b GROUP BY ALL""")
def heat_surface(spark: SparkSession, d: str) -> DataFrame:
    ix, iy = bins.cell_index(F.col("x"), F.col("y"), -1.0, -1.0, 0.1)
    cells = polyline.vertices(polylines(spark, d)).groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    return views.heat(cells, "n")


@query("draw_bands", f"""WITH {TRIP}, c AS (SELECT purpose_to, mode, count(*) AS n FROM trip GROUP BY ALL), s AS (SELECT n / sum(n) OVER () AS share FROM c)
SELECT CAST(CASE WHEN share >= 0.25 THEN 2 WHEN share >= 0.06 THEN 1 ELSE 0 END AS INTEGER) AS band, count(*) AS n FROM s GROUP BY ALL""")
def draw_bands(spark: SparkSession, d: str) -> DataFrame:
    counts = trips(spark, d).groupBy("purpose_to", "mode").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))  # one row
    rows = counts.join(F.broadcast(total)).select(stats.draw_band(F.col("n") / F.col("t")).alias("band"))
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("layer_legend", """SELECT count(*) FILTER (o_totalprice > 200000) AS large, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) AS total FROM orders""")
def layer_legend(spark: SparkSession, d: str) -> DataFrame:
    return views.legend(table(spark, d, "orders"), {"large": F.col("o_totalprice") > 200_000, "finished": F.col("o_orderstatus") == "F", "total": F.lit(True)})


@query("ramp_colours", """SELECT o_orderkey, CAST(round(255 * least(o_totalprice, 500000) / 500000, 0) AS INTEGER) AS red FROM orders""")
def ramp_colours(spark: SparkSession, d: str) -> DataFrame:
    colour = bins.ramp(F.col("o_totalprice"), [(0.0, (0, 0, 64)), (500_000.0, (255, 128, 0))])
    return table(spark, d, "orders").select("o_orderkey", colour[0].alias("red"))
