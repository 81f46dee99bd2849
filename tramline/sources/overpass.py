"""Files of an Overpass server's JSON: routes and ways. Fetching is left to others; tiles may overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_POINT = "struct<lon:double,lat:double>"
_ELEMENT = f"struct<type:string,id:bigint,tags:map<string,string>,geometry:array<{_POINT}>,nodes:array<bigint>,members:array<struct<type:string,ref:bigint,role:string,geometry:array<{_POINT}>>>>"


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of all files with the file they are from."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = F.from_json("value", f"struct<elements:array<{_ELEMENT}>>")
    return raw.select("file", F.explode(parsed["elements"]).alias("e")).select("file", "e.*")


def ways(spark: SparkSession, path: str, skip: list[str] = ()) -> DataFrame:
    """way_id, highway, name, tags, points: each way once, as the last file in order has it, without excluded classes."""
    found = elements(spark, path).where("type = 'way'")
    last = Window.partitionBy("id").orderBy(F.col("file").desc())
    once = found.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    kind = F.try_element_at("tags", F.lit("highway"))
    points = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    rows = once.select(F.col("id").alias("way_id"), kind.alias("highway"), F.try_element_at("tags", F.lit("name")).alias("name"), "tags", points.alias("points"))
    return rows.where(F.col("highway").isNotNull() & ~F.col("highway").isin(list(skip)))


def routes(spark: SparkSession, path: str) -> DataFrame:
    """route_id, mode, ref, name, operator, and a row for each member way: way, points."""
    found = elements(spark, path).where("type = 'relation'").dropDuplicates(["id"])
    tag = lambda t: F.try_element_at("tags", F.lit(t))
    rows = found.select(F.col("id").alias("route_id"), tag("route").alias("mode"), tag("ref").alias("ref"), tag("name").alias("name"), tag("operator").alias("operator"), F.posexplode("members").alias("way", "m"))
    points = F.transform("m.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return rows.where("m.type = 'way' and size(m.geometry) > 1").select("route_id", "mode", "ref", "name", "operator", "way", points.alias("points"))
