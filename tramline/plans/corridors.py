"""Queries on corridors: segments of one name across sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import corridors as ops
from tramline.operators import flows, stats, views
from tramline.plans.base import NAMED, named_segments, table
from tramline.plans.registry import query

# The model's corridors are segments by brand, the observed ones those of tax above 0; counts are orders by customer's
# segment under a brand's number. A corridor is long enough from 400 on.
_TABLE = f"""{NAMED}, mo AS (SELECT name, count(*) AS model_n, sum(length) AS model_len, sum(flow * length) / sum(length) AS model_mean, sum(flow * length) / 1000 AS model_vkm FROM ns GROUP BY ALL),
ob AS (SELECT name, count(*) AS observed_n, sum(length) AS observed_len, sum(l_suppkey * length) / nullif(sum(length), 0) AS observed_mean, sum(l_suppkey * length) / 1000 AS observed_vkm FROM ns WHERE tax > 0.02 GROUP BY ALL),
ct AS (SELECT p_brand AS name, avg(p_retailprice) AS count_mean, count(*) AS count_n FROM part WHERE p_size > 25 GROUP BY ALL),
jt AS (SELECT mo.*, observed_n, observed_len, observed_mean, observed_vkm, count_mean, count_n FROM mo JOIN ob USING (name) LEFT JOIN ct USING (name) WHERE model_len >= 400),
tb AS (SELECT *, 1000 * model_vkm / sum(model_vkm) OVER () AS model_share, 1000 * observed_vkm / sum(observed_vkm) OVER () AS observed_share FROM jt)"""


def corridors(spark: SparkSession, d: str) -> DataFrame:
    rows = named_segments(spark, d)
    model = ops.weighted(rows, "name", "flow", "length", "model")
    observed = ops.weighted(rows.where("tax > 0.02"), "name", "l_suppkey", "length", "observed")
    sites = table(spark, d, "part").where("p_size > 25").groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_retailprice").alias("count_mean"), F.count(F.lit(1)).alias("count_n"))
    return ops.compare(model, observed, sites, "name", F.col("model_len") >= 400)


_SHOWN = "SELECT name, model_n, model_len, round(model_mean, 4) AS model_mean, round(observed_mean, 4) AS observed_mean, round(count_mean, 4) AS count_mean, count_n, round(model_share, 6) AS model_share, round(observed_share, 6) AS observed_share, round(log2(greatest(model_share, 1e-6) / greatest(observed_share, 1e-6)), 6) AS log2_ratio FROM tb"


@query("corridor_table", f"WITH {_TABLE} {_SHOWN}")
def corridor_table(spark: SparkSession, d: str) -> DataFrame:
    rows = corridors(spark, d).withColumnsRenamed({"model_vkm_share": "model_share", "observed_vkm_share": "observed_share"})
    rounded = [F.round(c, 4).alias(c) for c in ("model_mean", "observed_mean", "count_mean")]
    return rows.select("name", "model_n", "model_len", *rounded, "count_n", *[F.round(c, 6).alias(c) for c in ("model_share", "observed_share", "log2_ratio")])


@query("corridor_top15", f"WITH {_TABLE} SELECT name, round(model_share, 6) AS model_share, observed_n >= 100 AS well_observed FROM tb WHERE observed_n >= 100 ORDER BY model_share DESC, name LIMIT 15")
def corridor_top15(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.well_observed(corridors(spark, d), "observed_n", 100).where("well_observed")
    return ops.top(rows, F.col("model_vkm_share"), 15, "name").select("name", F.round("model_vkm_share", 6).alias("model_share"), "well_observed")


@query("corridor_verdicts", f"WITH {_TABLE}, r AS (SELECT log2(greatest(model_share, 1e-6) / greatest(observed_share, 1e-6)) AS r FROM tb) SELECT CASE WHEN r > 0.02 THEN 'model higher' WHEN r < -0.02 THEN 'observed higher' ELSE 'agree' END AS verdict, count(*) AS n FROM r GROUP BY ALL")
def corridor_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return corridors(spark, d).groupBy(ops.verdict(F.col("log2_ratio"), 0.02).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("corridor_agreement", f"""WITH {_TABLE}, b AS (SELECT model_mean AS a, observed_mean AS b FROM tb), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM b)
SELECT count(*) AS n, CASE WHEN count(*) >= 8 THEN round(corr(ra, rb), 3) END AS rho, CASE WHEN count(*) >= 8 THEN round(corr(ln(1 + a), ln(1 + b)), 3) END AS r_log FROM r""")
def corridor_agreement(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(corridors(spark, d), "model_mean", "observed_mean")


@query("class_vkm_shares", f"""WITH {NAMED}, c AS (SELECT class, sum(flow * length) / 1000 AS vkm, sum(length) AS len FROM ns GROUP BY ALL) SELECT class, len, round(vkm, 3) AS vkm, round(100 * vkm / sum(vkm) OVER (), 6) AS pct FROM c""")
def class_vkm_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.with_shares(ops.weighted(named_segments(spark, d), "class", "flow", "length", "c"), ["c_vkm"])
    return rows.select("class", F.col("c_len").alias("len"), F.round("c_vkm", 3).alias("vkm"), F.round(F.col("c_vkm_share") / 10, 6).alias("pct"))


@query("modal_class", f"WITH {NAMED}, c AS (SELECT name, class, count(*) AS n FROM ns GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, class DESC) AS r FROM c) SELECT name, class, n FROM r WHERE r = 1")
def modal_class(spark: SparkSession, d: str) -> DataFrame:
    return ops.modal(named_segments(spark, d), "name", "class")


_CUBE = f"{NAMED}, cu AS (SELECT name, class, lanes, count(*) AS trips FROM ns GROUP BY ALL)"


def cube(spark: SparkSession, d: str) -> DataFrame:
    return named_segments(spark, d).groupBy("name", "class", "lanes").agg(F.count(F.lit(1)).alias("trips"))


@query("budget_cube", f"""WITH {_CUBE}, s AS (SELECT name, count(*) AS rows, sum(trips) AS traffic FROM cu GROUP BY ALL),
b AS (SELECT name, sum(rows) OVER (ORDER BY traffic DESC, name ROWS UNBOUNDED PRECEDING) AS upto FROM s) SELECT cu.* FROM cu JOIN b ON cu.name = b.name AND upto <= 900""")
def budget_cube(spark: SparkSession, d: str) -> DataFrame:
    return flows.budgeted(cube(spark, d), "name", F.col("trips"), 900)


@query("csr_rows", f"""WITH {_CUBE}, s AS (SELECT name, count(*) AS rows FROM cu GROUP BY ALL)
SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS ordinal, CAST(sum(rows) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) - rows AS BIGINT) AS row_start, rows FROM s""")
def csr_rows(spark: SparkSession, d: str) -> DataFrame:
    return flows.row_starts(cube(spark, d), "name")


@query("flow_day_wide", """SELECT l_partkey AS edge_id, count(*) AS trips_all, count(*) FILTER (plausible) AS trips,
  count(*) FILTER (plausible AND flag = 'A') AS flag_A, count(*) FILTER (plausible AND flag = 'N') AS flag_N, count(*) FILTER (plausible AND flag = 'R') AS flag_R, count(*) FILTER (plausible AND status = 'F') AS status_F, count(*) FILTER (plausible AND status = 'O') AS status_O
FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity <= 40 AS plausible, l_returnflag AS flag, l_linestatus AS status FROM lineitem) GROUP BY ALL""")
def flow_day_wide(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("edge_id"), (F.col("l_quantity") <= 40).alias("plausible"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    wide = flows.flow_day(rows, {"flag": ["A", "N", "R"], "status": ["F", "O"]})
    return wide.toDF(*[c.replace(":", "_") for c in wide.columns])


@query("share_lens", """WITH s AS (SELECT l_partkey AS seg, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS hits FROM lineitem GROUP BY ALL), c AS (SELECT sum(hits) / sum(total) AS share FROM s)
SELECT seg, total, round(hits / total, 6) AS share, round(log2(greatest(hits / total, 1e-6) / greatest(c.share, 1e-6)) / 1.3, 6) AS lens FROM s, c WHERE total >= 30""")
def share_lens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("seg"), "l_returnflag", "l_linestatus")
    found = views.share_lens(rows, "seg", {"l_returnflag": ["R"], "l_linestatus": []}, 30)
    return found.select("seg", "total", F.round("share", 6).alias("share"), F.round("lens", 6).alias("lens"))


@query("ordered_distinct_join", """WITH o AS (SELECT l_suppkey, l_returnflag || l_linestatus AS v, min(l_shipdate) AS first FROM lineitem GROUP BY ALL) SELECT l_suppkey, string_agg(v, ' | ' ORDER BY first, v) AS names, string_agg(v, ' + ' ORDER BY v) AS sorted FROM o GROUP BY ALL""")
def ordered_distinct_join(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's flags in order of first appearance, and sorted: distinct values are found before they are gathered."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("v"), "l_shipdate")
    once = rows.groupBy("l_suppkey", "v").agg(F.min("l_shipdate").alias("first"))
    grouped = once.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("first", "v"))).alias("o"))
    values = F.transform("o", lambda s: s["v"])
    return grouped.select("l_suppkey", F.array_join(values, " | ").alias("names"), F.array_join(F.array_sort(values), " + ").alias("sorted"))
