"""GeoJSON, WKB and GeoPackage geometries.

A geometry is an array of parts, each an array of (x, y); points and lines have one part. Further ordinates are
dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTS = "array<array<struct<x:double,y:double>>>"


def read_geojson(
    spark: SparkSession, path: str, columns: Sequence[str] = (), geometry: bool = True, bbox: tuple[float, float, float, float] | None = None, max_features: int | None = None, lines: bool = False
) -> DataFrame:
    """Features as rows: source_file, source_row, the properties asked for (all without any), and geometry_type and parts.

    bbox keeps features with a vertex within (x0, y0, x1, y1). source_file is the place of a feature's file among all by
    name and source_row its place there, so tables of aligned files can be joined on both. With lines, each feature
    stands on a line of its own, as most writers put them, between the lines of a collection or without any: files of any
    size are then read in splits. Without it a file is one row, as its features may lie in any way over its lines.
    """
    features = _numbered_lines(spark, path) if lines else _whole_files(spark, path)
    names = features.select("file").distinct()  # a row for each file
    ranked = names.withColumn("source_file", F.row_number().over(Window.orderBy("file")) - 1)
    features = features.join(F.broadcast(ranked), "file")
    props = F.get_json_object("f", "$.properties")
    rows = features.select("source_file", "source_row", F.get_json_object("f", "$.geometry.type").alias("geometry_type"), F.get_json_object("f", "$.geometry.coordinates").alias("c"), F.from_json(props, "map<string,string>").alias("p"))
    names = list(columns) or [r[0] for r in rows.select(F.explode(F.map_keys("p"))).distinct().orderBy("col").collect()]
    rows = rows.select("source_file", "source_row", *[F.try_element_at("p", F.lit(n)).alias(n) for n in names], "geometry_type", _parts(F.col("geometry_type"), F.col("c")).alias("parts"))
    if bbox is not None:
        x0, y0, x1, y1 = bbox
        rows = rows.where(F.exists("parts", lambda part: F.exists(part, lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1))))
    if max_features is not None:
        rows = rows.orderBy("source_file", "source_row").limit(max_features)
    return rows if geometry else rows.drop("geometry_type", "parts")


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file, source_row, f: the features of files that are read as a row each."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select("file", F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("source_row", "f"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, source_row, f: the features of files that have one on each of their lines.

    A split numbers its features; how many the splits before it have, a row for each split, gives their place in the file.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    line = F.regexp_replace(F.trim("value"), r",$", "")
    features = raw.select("file", "_block", line.alias("f")).where(F.get_json_object("f", "$.type") == "Feature").withColumn("_at", F.monotonically_increasing_id())
    splits = features.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = splits.select("file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return features.join(F.broadcast(shift), ["file", "_block"]).select("file", (F.col("_at") + F.col("_shift")).cast("int").alias("source_row"), "f")


def write_geojson(df: DataFrame, path: str, kind: str, parts: str, properties: Sequence[str]) -> None:
    """Features of points, lines, polygons and several lines, one on each line; read_geojson(lines=True) reads them."""
    point = lambda p: F.array(p["x"], p["y"])
    text = {
        "Point": F.to_json(point(F.col(parts)[0][0])), "LineString": F.to_json(F.transform(F.col(parts)[0], point)),
        "Polygon": F.to_json(F.transform(parts, lambda part: F.transform(part, point))),
    }
    coordinates = F.when(F.col(kind) == "Point", text["Point"]).when(F.col(kind) == "LineString", text["LineString"]).when(F.col(kind).isin("Polygon", "MultiLineString"), text["Polygon"])
    coordinates = F.coalesce(coordinates, F.raise_error(F.concat(F.lit("cannot write "), F.coalesce(kind, F.lit("null")))))
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    feature = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"'), F.col(kind), F.lit('","coordinates":'), coordinates, F.lit("}}"))
    df.select(feature.alias("value")).write.text(path)


def _points(pairs: Column) -> Column:
    return F.transform(pairs, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))


def _parts(kind: Column, coordinates: Column) -> Column:
    one = lambda t: F.from_json(coordinates, t)
    flat = F.transform(F.flatten(one("array<array<array<array<double>>>>")), _points)
    return (
        F.when(kind == "Point", F.array(_points(F.array(one("array<double>")))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(_points(one("array<array<double>>"))))
        .when(kind.isin("MultiLineString", "Polygon"), F.transform(one("array<array<array<double>>>"), _points))
        .when(kind == "MultiPolygon", flat)
    )


def geojson_info(spark: SparkSession, path: str) -> DataFrame:
    """features, crs, fields of files."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    fields = F.json_object_keys(F.get_json_object("value", "$.features[0].properties"))
    count = F.json_array_length(F.get_json_object("value", "$.features"))
    return raw.select("path", count.alias("features"), F.get_json_object("value", "$.crs.properties.name").alias("crs"), fields.alias("fields"))


def _read_wkb(raw: bytes, at: int = 0) -> tuple[str, list, int]:
    order = "<" if raw[at] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", raw, at + 1)
    at += 5
    if kind & 0x20000000:  # a reference system follows
        at += 4
    wide = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
    kind &= 0x0FFFFFFF
    wide = max(wide, {0: 2, 1: 3, 2: 3, 3: 4}[kind // 1000])
    kind %= 1000

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        return n

    def points(n: int) -> list:
        nonlocal at
        values = struct.unpack_from(f"{order}{n * wide}d", raw, at)
        at += 8 * n * wide
        return [{"x": values[i], "y": values[i + 1]} for i in range(0, n * wide, wide)]

    if kind == 1:
        return "Point", [points(1)], at
    if kind == 2:
        return "LineString", [points(count())], at
    if kind == 3:
        return "Polygon", [points(count()) for _ in range(count())], at
    name = {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}[kind]
    parts: list = []
    for _ in range(count()):
        _, inner, at = _read_wkb(raw, at)
        parts += inner
    return name, [[p for part in parts for p in part]] if kind == 4 else parts, at


def wkb_parts(data: Column) -> Column:
    """struct<geometry_type, parts> of WKB, or of a GeoPackage's geometry with its header."""

    @F.pandas_udf(f"geometry_type string, parts {PARTS}")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in values:
            if raw is None:
                rows.append((None, None))
                continue
            start = 0
            if raw[:2] == b"GP":  # flags say how long the envelope is
                start = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[raw[3] >> 1 & 7]
            rows.append(_read_wkb(raw, start)[:2])
        return pd.DataFrame(rows, columns=["geometry_type", "parts"])

    return run(data)


def to_wkb(kind: Column, parts: Column) -> Column:
    """WKB of points, lines and polygons, and of several lines."""

    # On Arrow arrays: pandas would make ragged lists of parts into numpy arrays, which fails.
    @F.arrow_udf("binary")
    def run(kinds: pa.Array, values: pa.Array) -> pa.Array:
        def flat(part) -> bytes:
            return b"".join(struct.pack("<2d", p["x"], p["y"]) for p in part)

        def one(kind: str, parts) -> bytes | None:
            if kind is None or parts is None:
                return None
            line = lambda p: struct.pack("<BII", 1, 2, len(p)) + flat(p)
            if kind == "Point":
                return struct.pack("<BI", 1, 1) + flat(parts[0])
            if kind == "LineString":
                return line(parts[0])
            if kind == "Polygon":
                return struct.pack("<BII", 1, 3, len(parts)) + b"".join(struct.pack("<I", len(p)) + flat(p) for p in parts)
            if kind == "MultiLineString":
                return struct.pack("<BII", 1, 5, len(parts)) + b"".join(line(p) for p in parts)
            raise ValueError(f"cannot write {kind}")

        return pa.array([one(k, p) for k, p in zip(kinds.to_pylist(), values.to_pylist(), strict=True)], pa.binary())

    return run(kind, parts)
