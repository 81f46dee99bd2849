"""Queries on text fields, tags, joins of attributes and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import bins, text
from tramline.operators import stats
from tramline.plans.base import polylines, table
from tramline.plans.registry import query


@query("wkt_parse", """SELECT vec_id AS id, 32 AS n, round(CAST(embedding[1] AS DOUBLE), 4) AS x0, round(CAST(embedding[64] AS DOUBLE), 4) AS y1 FROM embeddings""")
def wkt_parse(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as WKT and parsed again."""
    pair = F.transform("points", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    rows = polylines(spark, d).select("id", F.concat(F.lit("LINESTRING ("), F.array_join(pair, ", "), F.lit(")")).alias("w"))
    x, y = text.wkt_coordinates(F.col("w"))
    return rows.select("id", text.vertex_count(F.col("w")).alias("n"), F.round(x[0], 4).alias("x0"), F.round(F.element_at(y, -1), 4).alias("y1"))


@query("regex_numbers", r"""SELECT doc_id, CAST(nullif(regexp_extract(text, '\d+(?:\.\d+)?'), '') AS DOUBLE) AS first FROM documents""")
def regex_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.first_number(F.col("text")).alias("first"))


@query("json_tags", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) >= 0 AS has_k, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(json_extract(props, '$.k') AS INTEGER) = 7 AS is_seven FROM events""")
def json_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("tags", F.from_json("props", "map<string,string>"))
    return rows.select(
        "event_id", text.any_tag(F.col("tags"), "k").alias("has_k"), text.number(F.try_element_at("tags", F.lit("k"))).alias("k"), text.tag_is(F.col("tags"), "k", "7").alias("is_seven")
    )


@query("url_parameters", r"""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages""")
def url_parameters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", text.url_parameters(F.col("url")).alias("p"))
    return rows.select("page_id", F.nullif(F.try_element_at("p", F.lit("page")), F.lit("")).alias("page"), F.nullif(F.try_element_at("p", F.lit("ref")), F.lit("")).alias("ref"))


@query("html_escape", """SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS digest FROM pages""")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(text.html_escape(F.col("html")).cast("binary")).alias("digest"))


@query("mojibake_repair", """SELECT doc_id, replace(text, 'Í', chr(195) || chr(141)) AS text FROM documents""")
def mojibake_repair(spark: SparkSession, d: str) -> DataFrame:
    """Texts, damaged as if their bytes had been read as Windows-1252, and repaired. That has no character for the byte 0x8D
    of "Í", which so stays as it is."""
    rows = table(spark, d, "documents").select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text"))
    # Latin-1 and Windows-1252 differ from 0x80 to 0x9F, where the latter has other characters.
    cp1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
    damaged = F.translate("text", "".join(map(chr, range(0x80, 0xA0))), cp1252)
    return rows.select("doc_id", text.repair_mojibake(damaged).alias("text"))


@query("person_join_default", """WITH p AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_acctbal / 100) AS INTEGER) END AS age, c_mktsegment FROM customer),
t AS (SELECT o_orderkey, o_custkey + CASE WHEN o_totalprice > 400000 THEN 1000000 ELSE 0 END AS person FROM orders)
SELECT CASE WHEN age BETWEEN 0 AND 15 THEN '0-15' WHEN age BETWEEN 16 AND 24 THEN '16-24' WHEN age BETWEEN 25 AND 44 THEN '25-44' WHEN age BETWEEN 45 AND 64 THEN '45-64' WHEN age BETWEEN 65 AND 200 THEN '65+' ELSE 'Unknown' END AS age_band,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Working' WHEN 'AUTOMOBILE' THEN 'Studying' ELSE 'Other/Unknown' END AS status, count(*) AS n FROM t LEFT JOIN p ON c_custkey = person GROUP BY ALL""")
def person_join_default(spark: SparkSession, d: str) -> DataFrame:
    """Orders as trips of customers; dear ones are of persons that no file has, and get defaults."""
    people = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100)).alias("age"), "c_mktsegment")
    rows = table(spark, d, "orders").select((F.col("o_custkey") + F.when(F.col("o_totalprice") > 400_000, 1_000_000).otherwise(0)).alias("person"))
    # Not forced to broadcast: people grow with the input, so the optimizer chooses by their size.
    joined = rows.join(people, F.col("c_custkey") == F.col("person"), "left")
    band = text.age_band(F.lit(None).cast("string"), F.col("age"))
    status = text.mapped(F.col("c_mktsegment"), {"BUILDING": "Working", "AUTOMOBILE": "Studying"}, "Other/Unknown")
    return joined.groupBy(band.alias("age_band"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("plausible_flag", """SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_quantity <= CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 25 ELSE 80 END) AS plausible FROM lineitem GROUP BY ALL""")
def plausible_flag(spark: SparkSession, d: str) -> DataFrame:
    mode = text.mapped(F.col("l_returnflag"), {"A": "Walking", "N": "Bicycle/E-bike"}, "Car")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(bins.plausible(F.col("l_quantity"), mode)).alias("plausible"))


@query("mode_folding", """SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'Other' END AS mode, count(*) AS n FROM events GROUP BY ALL""")
def mode_folding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(text.folded(F.col("event_type"), ["view", "click"]).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query("class_exclusion", """SELECT p_type, count(*) AS n FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO') OR p_type IS NULL GROUP BY ALL""")
def class_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(text.allowed(F.col("p_type"), ["ECONOMY", "PROMO"])).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("union_sources", """WITH u AS (SELECT 'orders' AS source, o_totalprice AS adt FROM orders UNION ALL SELECT 'supplier', s_acctbal FROM supplier) SELECT source, count(adt) AS n, round(avg(adt), 4) AS mean, round(stddev(adt), 4) AS std, min(adt) AS min, round(quantile_cont(adt, 0.5), 4) AS p50, max(adt) AS max FROM u WHERE adt > 0 GROUP BY ALL""")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "orders").select(F.lit("orders").alias("source"), F.col("o_totalprice").alias("adt"))
    both = both.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_acctbal").alias("adt"))).where("adt > 0")
    found = stats.described(both, "adt", ["source"], (0.5,))
    return found.select("source", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", F.round("p50", 4).alias("p50"), "max")


@query("set_ops", """SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'all', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    one = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one("both", a.intersect(b)).unionByName(one("customers only", a.exceptAll(b.select("k")).join(b, "k", "left_anti").distinct())).unionByName(one("all", a.union(b).distinct()))


@query("multi_valued_lookup", """WITH k AS (SELECT DISTINCT o_orderkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey), j AS (SELECT o_orderkey, s_name FROM k LEFT JOIN supplier ON s_suppkey = l_suppkey)
SELECT o_orderkey, string_agg(DISTINCT s_name, ' | ' ORDER BY s_name) AS names, count(*) AS n FROM j GROUP BY ALL""")
def multi_valued_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Several ids in one text field, split, looked up and joined again."""
    ids = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_set(F.col("l_suppkey").cast("string")), " ").alias("ids"))
    rows = ids.select(F.col("l_orderkey").alias("o_orderkey"), F.explode(F.split("ids", " ")).alias("id")).select("o_orderkey", F.col("id").cast("long").alias("s_suppkey"))
    joined = rows.join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "left")
    found = joined.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_set("s_name")), " | ").alias("names"), F.count(F.lit(1)).alias("n"))
    return found.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")


@query("date_years", """SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY ALL""")
def date_years(spark: SparkSession, d: str) -> DataFrame:
    number = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    rows = table(spark, d, "orders").select(F.year(text.date_of(number)).cast("long").alias("year")).where("year >= 1997")
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
