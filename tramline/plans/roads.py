"""Queries on roads with counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import bins
from tramline.operators import roads as ops
from tramline.operators import stats, views
from tramline.plans.base import COUNTS, DIRECTED, ROAD, directed_roads, named_segments, table
from tramline.plans.registry import query


def undirected(spark: SparkSession, d: str) -> DataFrame:
    return ops.undirected(directed_roads(spark, d), COUNTS, most=["ms"])


@query("undirected_roads", f"WITH {ROAD} SELECT lo, hi, key, {', '.join(COUNTS)}, ms FROM road")
def undirected_roads(spark: SparkSession, d: str) -> DataFrame:
    return undirected(spark, d)


@query("direction_split", f"""WITH {DIRECTED}, s AS (SELECT u, v, key, sum(c0) AS n FROM dr GROUP BY ALL),
p AS (SELECT a.n AS there, b.n AS back FROM s a JOIN s b ON a.u = b.v AND a.v = b.u AND a.key = b.key WHERE a.u < a.v)
SELECT count(*) AS n, round(avg(CASE WHEN there = back THEN 100.0 ELSE 0.0 END), 4) AS equal_pct, round(avg(CASE WHEN (there = 0 OR back = 0) AND there + back > 0 THEN 100.0 ELSE 0.0 END), 4) AS one_way_pct,
  round(median(CASE WHEN there + back >= 10 THEN greatest(there, back) / (there + back) END), 6) AS busier_share FROM p""")
def direction_split(spark: SparkSession, d: str) -> DataFrame:
    found = ops.direction_split(ops.both_directions(directed_roads(spark, d), "c0"))
    return found.select("n", F.round("equal_pct", 4).alias("equal_pct"), F.round("one_way_pct", 4).alias("one_way_pct"), F.round("busier_share", 6).alias("busier_share"))


@query("reverse_semi", f"""WITH {DIRECTED}, s AS (SELECT DISTINCT u, v, key FROM dr) SELECT u, v, key FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE b.u = a.v AND b.v = a.u AND b.key = a.key)""")
def reverse_semi(spark: SparkSession, d: str) -> DataFrame:
    once = directed_roads(spark, d).select("u", "v", "key").distinct()
    return once.join(once.select(F.col("v").alias("u"), F.col("u").alias("v"), "key"), ["u", "v", "key"], "left_semi")


@query("speed_sweep_unpivot", f"WITH {ROAD} " + " UNION ALL ".join(f"SELECT '{c}' AS filter, count(*) FILTER ({c} > 0) AS roads, sum({c}) AS crossings FROM road" for c in COUNTS))
def speed_sweep_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return ops.sweep(undirected(spark, d), COUNTS)


_SLOW = f"{ROAD}, tt AS (SELECT greatest(1, sum(c0)) AS t0, greatest(1, sum(c8)) AS t8 FROM road), sx AS (SELECT road.*, CASE WHEN c8 > 0 AND (c0 >= 5 OR c8 >= 5) THEN (c0 / t0) / (c8 / t8) END AS slow FROM road, tt)"


@query("slow_index_by_limit", f"""WITH {_SLOW} SELECT ms, count(*) AS n, round(median(slow), 6) AS slow FROM sx WHERE slow IS NOT NULL GROUP BY ALL HAVING count(*) >= 150""")
def slow_index_by_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.with_slow_index(undirected(spark, d), "c0", "c8").where(F.col("slow_index").isNotNull())
    return rows.groupBy("ms").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("slow_index"), 6).alias("slow")).where("n >= 150")


_TABLE = ", ".join(f"({k}, {low!r}, {high!r})" for k in range(201) for low, high in [bins.poisson_interval(k)])


@query("poisson_ci", f"""WITH {ROAD}, p(k, low, high) AS (VALUES {_TABLE}) SELECT lo, hi, key, CAST(c8 AS BIGINT) AS k, round(coalesce(low, greatest(c8 - 1.96 * sqrt(c8), 0)), 6) AS lo95,
  round(coalesce(high, c8 + 1.96 * sqrt(c8)), 6) AS hi95, round(CASE WHEN c8 > 0 THEN 1 / sqrt(c8) END, 6) AS rse FROM road LEFT JOIN p ON k = CAST(c8 AS BIGINT)""")
def poisson_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = undirected(spark, d).select("lo", "hi", "key", F.col("c8").cast("long").alias("k"))
    return bins.with_poisson(rows, "k").select("lo", "hi", "key", "k", *[F.round(c, 6).alias(c) for c in ("lo95", "hi95", "rse")])


@query("volume_classes", f"""WITH {ROAD}, m AS (SELECT max(c0) AS m FROM road), c AS (SELECT CAST(least(5, floor((c0 - 1) / ceil(m / 6))) AS INTEGER) AS class, c0 FROM road, m WHERE c0 > 0)
SELECT class, count(*) AS roads, min(c0) AS low, max(c0) AS high FROM c GROUP BY ALL""")
def volume_classes(spark: SparkSession, d: str) -> DataFrame:
    return ops.volume_classes(undirected(spark, d), "c0")


@query("road_paint", f"""WITH {_SLOW} SELECT CASE WHEN c0 <= 0 THEN 'none' WHEN c0 < 5 THEN 'thin' WHEN slow > 1.25 THEN 'slow' WHEN slow < 0.8 THEN 'fast' ELSE 'even' END AS paint, count(*) AS roads FROM sx GROUP BY ALL""")
def road_paint(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.painted(ops.with_slow_index(undirected(spark, d), "c0", "c8"), "c0")
    return rows.groupBy("paint").agg(F.count(F.lit(1)).alias("roads"))


@query("per_lane", """SELECT p_size AS lanes, count(*) AS n, round(median(CASE WHEN p_size >= 1 AND l_quantity >= 5 THEN l_quantity / p_size END), 6) AS per_lane FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def per_lane(spark: SparkSession, d: str) -> DataFrame:
    rows = named_segments(spark, d).withColumn("p", bins.per_lane(F.col("length"), F.col("lanes")))
    return rows.groupBy("lanes").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("p"), 6).alias("per_lane"))


@query("lane_reference", """WITH p AS (SELECT l_quantity / p_size AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 1 AND l_quantity >= 5),
r AS (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM p WHERE v > 0) SELECT round(v, 6) AS reference FROM r WHERE r = floor(0.95 * (n - 1)) + 1""")
def lane_reference(spark: SparkSession, d: str) -> DataFrame:
    return views.lane_reference(named_segments(spark, d), "length", "lanes").select(F.round("value", 6).alias("reference"))


@query("speed_classes", f"""WITH {ROAD} SELECT CAST(CASE WHEN ms <= 35 THEN 30 WHEN ms <= 45 THEN 40 WHEN ms <= 55 THEN 50 WHEN ms <= 65 THEN 60 WHEN ms <= 75 THEN 70 WHEN ms <= 85 THEN 80
  WHEN ms <= 95 THEN 90 WHEN ms <= 105 THEN 100 WHEN ms <= 115 THEN 110 ELSE 120 END AS INTEGER) AS class, count(*) AS roads FROM road GROUP BY ALL""")
def speed_classes(spark: SparkSession, d: str) -> DataFrame:
    return undirected(spark, d).groupBy(bins.speed_class(F.col("ms")).alias("class")).agg(F.count(F.lit(1)).alias("roads"))


@query("ratio_bands", """WITH b AS (SELECT CASE WHEN o_totalprice > 0 AND o_totalprice <= 2000 THEN '<2k' WHEN o_totalprice > 2000 AND o_totalprice <= 50000 THEN '2-50k' WHEN o_totalprice > 50000 AND o_totalprice <= 200000 THEN '50-200k' WHEN o_totalprice > 200000 THEN '>200k' END AS band, o_totalprice, o_custkey FROM orders)
SELECT band, count(*) AS n, round(median(o_custkey / o_totalprice), 8) AS ratio, round(avg(CASE WHEN o_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS even_share FROM b GROUP BY ALL""")
def ratio_bands(spark: SparkSession, d: str) -> DataFrame:
    band = bins.banded(F.col("o_totalprice"), [0, 2_000, 50_000, 200_000, float("inf")], ["<2k", "2-50k", "50-200k", ">200k"])
    rows = table(spark, d, "orders").withColumn("band", band)
    return rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.median(F.col("o_custkey") / F.col("o_totalprice")), 8).alias("ratio"), F.round(F.avg((F.col("o_custkey") % 2 == 0).cast("double")), 6).alias("even_share")
    )


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@query("spearman_table", f"""WITH {ROAD}, b AS (SELECT c0 AS a, c8 AS b FROM road WHERE c0 > 0), r AS (SELECT a, b, {_RANK.format(c="a")} AS ra, {_RANK.format(c="b")} AS rb FROM b)
SELECT count(*) AS n, round(corr(ra, rb), 3) AS rho, round(corr(ln(1 + a), ln(1 + b)), 3) AS r_log FROM r""")
def spearman_table(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(undirected(spark, d).where("c0 > 0"), "c0", "c8")


@query("rank_residual", f"""WITH {ROAD}, b AS (SELECT lo, hi, key, c0, c8 FROM road WHERE c8 >= 5), n AS (SELECT count(*) AS n FROM b),
r AS (SELECT lo, hi, key, ({_RANK.format(c="c0")}) / n AS ra, ({_RANK.format(c="c8")}) / n AS rb FROM b, n) SELECT lo || '-' || hi || '-' || key AS pair, round(ra - rb, 9) AS residual FROM r""")
def rank_residual(spark: SparkSession, d: str) -> DataFrame:
    rows = undirected(spark, d).withColumn("pair", F.concat_ws("-", "lo", "hi", "key"))
    return stats.rank_residual(rows, "pair", "c0", "c8", F.col("c8") >= 5).withColumn("residual", F.round("residual", 9))


@query("loglog_fit", f"""WITH {ROAD} SELECT round(regr_slope(ln(c8), ln(greatest(c0, 1e-12))), 6) AS slope, round(regr_intercept(ln(c8), ln(greatest(c0, 1e-12))), 6) AS intercept FROM road WHERE c8 > 0""")
def loglog_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = stats.loglog_fit(undirected(spark, d), "c0", "c8")
    return fit.select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("reconciliation", f"""WITH {ROAD}, b AS (SELECT lo, hi, key, {", ".join(f"CASE WHEN key = 3 AND hi % 2 = 0 THEN c{i} + 1 ELSE c{i} END AS c{i}" for i in range(9))} FROM road WHERE key < 7)
SELECT count(*) AS rows_a, count(*) FILTER (key < 7) AS rows_b, count(*) FILTER (key < 7 AND NOT (key = 3 AND hi % 2 = 0)) AS matching FROM road""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Counts of roads, and the same computed again from the records, without the roads of one key and with counts of another
    too large by one: how many rows each has, and how many agree in all nine."""
    rows = directed_roads(spark, d).where("key < 7")
    again = rows.withColumns({"lo": F.array_min(F.array("u", "v")), "hi": F.array_max(F.array("u", "v"))}).groupBy("lo", "hi", "key").agg(*[F.sum(c).alias(c) for c in COUNTS])
    wrong = (F.col("key") == 3) & (F.col("hi") % 2 == 0)
    again = again.withColumns({c: F.col(c) + F.when(wrong, 1).otherwise(0) for c in COUNTS})
    return stats.matches(undirected(spark, d), again, ["lo", "hi", "key"], COUNTS)


@query("relative_flow_check", f"""WITH {ROAD}, m AS (SELECT max(c0) AS m FROM road), r AS (SELECT key, c0 / m AS share, round((CASE WHEN key = 7 THEN c2 ELSE c0 END) / m, 4) AS given FROM road, m)
SELECT key, count(*) AS n, count(*) FILTER (abs(share - given) <= 0.00006) AS close FROM r GROUP BY ALL""")
def relative_flow_check(spark: SparkSession, d: str) -> DataFrame:
    """Relative flows as they were given, to four decimals, against counts over the largest count; those of one key come from
    another column, so that only roads without slow traffic agree there."""
    rows = undirected(spark, d)
    peak = rows.agg(F.max("c0").alias("m"))  # one row
    given = F.round(F.when(F.col("key") == 7, F.col("c2")).otherwise(F.col("c0")) / F.col("m"), 4)
    return stats.close_shares(rows.join(F.broadcast(peak)).select("key", "c0", given.alias("given")), "key", "c0", "given")


@query("quantised_bytes", f"""WITH {ROAD}, m AS (SELECT max(c0) AS m, sum(c0) AS t FROM road) SELECT lo, hi, key, CAST(round_even(255 * sqrt(c0 / m), 0) AS INTEGER) AS root, CAST(least(greatest(round_even(c8 * 255.0 / nullif(c0, 0), 0), 0), 255) AS INTEGER) AS share FROM road, m WHERE c0 > 0""")
def quantised_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = undirected(spark, d).where("c0 > 0")
    peak = rows.agg(F.max("c0").alias("m"))  # one row
    return rows.join(F.broadcast(peak)).select("lo", "hi", "key", bins.sqrt_byte(F.col("c0"), F.col("m")).alias("root"), bins.share_byte(F.col("c8"), F.col("c0")).alias("share"))


@query("wide_row_sum", f"""WITH {ROAD} SELECT lo, hi, key, CASE WHEN c1 > 0 OR c4 > 0 OR c8 > 0 THEN coalesce(nullif(c1, 0), 0) + coalesce(nullif(c4, 0), 0) + coalesce(nullif(c8, 0), 0) END AS total FROM road""")
def wide_row_sum(spark: SparkSession, d: str) -> DataFrame:
    """Row sums where zero stands for missing: null only if all three are."""
    parts = [F.nullif(F.col(c), F.lit(0.0)) for c in ("c1", "c4", "c8")]
    return undirected(spark, d).select("lo", "hi", "key", bins.total_of(parts).alias("total"))
