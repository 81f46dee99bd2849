"""Queries on trips and times of day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions import bins, text
from tramline.operators import flows, sampling, stats
from tramline.plans.base import TRIP, bin_sql, table, trips
from tramline.plans.registry import query
from tramline.streaming import quarters


@query("trips_from_events", f"""WITH {TRIP} SELECT trip_id, person, mode, purpose_to, round(t_start, 3) AS t_start, round(t_end, 3) AS t_end FROM trip""")
def trips_from_events(spark: SparkSession, d: str) -> DataFrame:
    return trips(spark, d).select("trip_id", "person", "mode", "purpose_to", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"))


@query("trips_under_way", f"""WITH {TRIP}, e AS (SELECT mode, {bin_sql("t_start")} AS s, {bin_sql("t_end")} AS e FROM trip)
SELECT m.mode, CAST(b AS INTEGER) AS bin, CAST(count(e.s) AS BIGINT) AS n FROM (SELECT DISTINCT mode FROM trip) m CROSS JOIN range(84) AS t(b)
LEFT JOIN e ON e.mode = m.mode AND t.b BETWEEN e.s AND e.e GROUP BY ALL""")
def trips_under_way(spark: SparkSession, d: str) -> DataFrame:
    return flows.under_way(trips(spark, d), ["mode"])


@query("departure_hist", """SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY ALL""")
def departure_hist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


# A load cell is a pair of event types here: where a trip starts and where it goes.
_LOAD = f"""{TRIP}, q AS (SELECT DISTINCT person, purpose_from, purpose_to, {bin_sql("t_start")} AS bin FROM trip)"""


@query("load_bins_distinct", f"""WITH {_LOAD} SELECT purpose_from, purpose_to, bin, count(*) AS n FROM q GROUP BY ALL""")
def load_bins_distinct(spark: SparkSession, d: str) -> DataFrame:
    rows = trips(spark, d).withColumn("bin", bins.time_bin(F.col("t_start")))
    return flows.distinct_load(rows, "person", ["purpose_from", "purpose_to", "bin"])


@query("hourly_rollup", f"""WITH {_LOAD}, c AS (SELECT purpose_from, purpose_to, bin, count(*) AS n FROM q GROUP BY ALL)
SELECT purpose_from, purpose_to, CAST(bin // 4 AS INTEGER) AS hour, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL""")
def hourly_rollup(spark: SparkSession, d: str) -> DataFrame:
    return flows.hourly(load_bins_distinct(spark, d), ["purpose_from", "purpose_to"])


@query("moving_at_instant", f"""WITH {TRIP} SELECT mode, count(*) AS n FROM trip WHERE t_start <= 43200 AND t_end >= 43200 GROUP BY ALL""")
def moving_at_instant(spark: SparkSession, d: str) -> DataFrame:
    return flows.moving_at(trips(spark, d), 43_200, ["mode"])


@query("interval_series_96", f"""WITH {TRIP}, i AS (SELECT mode, greatest(floor((t_start - 10800) / 75600 * 96), 0) AS a, least(floor((t_end - 10800) / 75600 * 96), 95) AS b
  FROM trip WHERE t_end >= 10800 AND t_start < 86400)
SELECT mode, CAST(k AS INTEGER) AS bin, count(*) AS n FROM i JOIN range(96) AS t(k) ON k BETWEEN a AND b GROUP BY ALL""")
def interval_series_96(spark: SparkSession, d: str) -> DataFrame:
    return flows.interval_series(trips(spark, d), ["mode"], 10_800.0, 86_400.0, 96)


@query("trip_duration_stats", f"""WITH {TRIP}, t AS (SELECT mode, (t_end - t_start) / 60 AS m FROM trip)
SELECT mode, count(m) AS n, round(avg(m), 4) AS mean, round(stddev(m), 4) AS std, round(min(m), 4) AS min, round(quantile_cont(m, 0.25), 4) AS p25,
  round(quantile_cont(m, 0.5), 4) AS p50, round(quantile_cont(m, 0.75), 4) AS p75, round(max(m), 4) AS max FROM t GROUP BY ALL""")
def trip_duration_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = trips(spark, d).withColumn("m", (F.col("t_end") - F.col("t_start")) / 60)
    found = stats.described(rows, "m", ["mode"])
    return found.select("mode", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query("crosstab_pct", f"""WITH {TRIP}, c AS (SELECT mode, purpose_to, count(*) AS n FROM trip GROUP BY ALL)
SELECT mode, purpose_to, n, round(n * 100.0 / sum(n) OVER (PARTITION BY mode), 6) AS pct FROM c""")
def crosstab_pct(spark: SparkSession, d: str) -> DataFrame:
    return stats.crosstab(trips(spark, d), "mode", "purpose_to").withColumn("pct", F.round("pct", 6))


@query("stratified_sample", f"""WITH {TRIP}, s AS (SELECT mode, count(*) AS n FROM trip GROUP BY ALL),
w AS (SELECT mode, least(n, greatest(1, CAST(round_even(n * 1000 / (SELECT sum(n) FROM s), 0) AS BIGINT))) AS k FROM s),
r AS (SELECT trip_id, mode, row_number() OVER (PARTITION BY mode ORDER BY md5('42:' || trip_id), trip_id) AS r FROM trip)
SELECT trip_id, r.mode FROM r JOIN w ON r.mode = w.mode WHERE r.r <= w.k""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(trips(spark, d), "mode", "trip_id", 1000).select("trip_id", "mode")


@query("particle_allocation", f"""WITH {TRIP}, s AS (SELECT mode, purpose_to, count(*) AS n FROM trip GROUP BY ALL)
SELECT mode, purpose_to, CAST(floor(n / (SELECT sum(n) FROM s) * 45000 + CAST(('0x' || substr(md5('0:' || mode || '>' || purpose_to), 1, 8)) AS BIGINT) / 4294967296.0) AS BIGINT) AS particles FROM s""")
def particle_allocation(spark: SparkSession, d: str) -> DataFrame:
    counts = trips(spark, d).groupBy("mode", "purpose_to").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))  # one row
    rows = counts.join(F.broadcast(total))
    return sampling.stochastic_counts(rows, F.col("n") / F.col("t"), 45_000, F.concat_ws(">", "mode", "purpose_to")).select("mode", "purpose_to", "particles")


# An hourly shape of events, scaled so that each event type's day, evening and night have its own shares.
_PERIOD = "CASE WHEN h BETWEEN 6 AND 17 THEN 'day' WHEN h BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END"


@query("profile_fit", f"""WITH e AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS h FROM events), s AS (SELECT h, {_PERIOD} AS period, count(*) AS s FROM e GROUP BY ALL),
g AS (SELECT event_type, {_PERIOD} AS period, count(*) AS g FROM e GROUP BY ALL), r AS (SELECT event_type, h, s * g / sum(s) OVER (PARTITION BY event_type, period) AS raw FROM g JOIN s USING (period))
SELECT event_type, h AS hour, round(raw / sum(raw) OVER (PARTITION BY event_type), 6) AS share FROM r""")
def profile_fit(spark: SparkSession, d: str) -> DataFrame:
    period = F.when(F.col("hour").between(6, 17), "day").when(F.col("hour").between(18, 21), "evening").otherwise("night")
    rows = table(spark, d, "events").select("event_type", F.hour("ts").alias("hour")).withColumn("period", period)
    shape = rows.groupBy("hour", "period").agg(F.count(F.lit(1)).alias("s"))
    shares = rows.groupBy("event_type", "period").agg(F.count(F.lit(1)).alias("g"))
    return flows.fitted_profile(shape, shares, "event_type")


@query("hour_share_medians", """WITH c AS (SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT u.user_id, CAST(h AS INTEGER) AS hour, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(24) AS t(h) LEFT JOIN c ON c.user_id = u.user_id AND c.hour = h),
s AS (SELECT hour, n / sum(n) OVER (PARTITION BY user_id) AS share FROM p), m AS (SELECT hour, median(share) AS m FROM s GROUP BY ALL)
SELECT hour, round(m / sum(m) OVER (), 6) AS share FROM m""")
def hour_share_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median over users of each hour's share of the user's events, made to sum to 1."""
    wide = table(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.hour("ts") == h).alias(str(h)) for h in range(24)])
    long = wide.unpivot("user_id", [str(h) for h in range(24)], "hour", "n")
    shares = long.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    medians = shares.groupBy(F.col("hour").cast("int").alias("hour")).agg(F.median("share").alias("m"))
    total = medians.agg(F.sum("m").alias("t"))  # one row
    return medians.join(F.broadcast(total)).select("hour", F.round(F.col("m") / F.col("t"), 6).alias("share"))


@query("class_median_fallback", """WITH l AS (SELECT o_orderpriority AS class, o_totalprice AS value FROM orders), o AS (SELECT median(value) AS m FROM l),
g AS (SELECT class, median(value) AS value, count(*) AS n FROM l GROUP BY ALL) SELECT class, round(value, 4) AS value, n, round(CASE WHEN n >= 3000 THEN value ELSE o.m END, 4) AS used FROM g, o""")
def class_median_fallback(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "orders").select(F.col("o_orderpriority").alias("class"), F.col("o_totalprice").alias("value"))
    return flows.with_fallback(links, "class", "value", 3000).select("class", F.round("value", 4).alias("value"), "n", F.round("used", 4).alias("used"))


@query("regex_time", """WITH t AS (SELECT event_id, 'Start Time: ' || strftime(ts, '%H:%M:%S') || ', End Time: ' || strftime(ts + INTERVAL 50 MINUTE, '%H:%M:%S') AS a, ts FROM events)
SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS DOUBLE) AS t_start, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) + 3000 AS DOUBLE) AS t_end FROM t""")
def regex_time(spark: SparkSession, d: str) -> DataFrame:
    """Times are written as text and parsed again; those that end after midnight wrap."""
    at = lambda add: F.date_format(F.expr(f"ts + interval {add} minute"), "HH:mm:ss")
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("Start Time: "), at(0), F.lit(", End Time: "), at(50)).alias("a"))
    start, end = text.activity_times(F.col("a"))
    return rows.select("event_id", start.alias("t_start"), end.alias("t_end"))


@query("clock_labels", f"""WITH {TRIP} SELECT trip_id, strftime(TIMESTAMP '2000-01-01' + to_seconds(CAST(floor(t_start / 60) * 60 AS BIGINT)), '%H:%M') AS starts FROM trip""")
def clock_labels(spark: SparkSession, d: str) -> DataFrame:
    return trips(spark, d).select("trip_id", text.clock(F.col("t_start") / 60).alias("starts"))


@query("peak_bin", f"""WITH {TRIP}, c AS (SELECT mode, {bin_sql("t_start")} AS bin, count(*) AS n FROM trip GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY n DESC, bin) AS r FROM c) SELECT mode, bin AS peak, n FROM r WHERE r = 1""")
def peak_bin(spark: SparkSession, d: str) -> DataFrame:
    counts = trips(spark, d).groupBy("mode", bins.time_bin(F.col("t_start")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("mode").agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("m"))
    return best.select("mode", (-F.col("m.b")).alias("peak"), F.col("m.n").alias("n"))


@query("persons_in_files", """SELECT user_id, count(DISTINCT event_type) AS files FROM events GROUP BY ALL HAVING count(DISTINCT event_type) > 1""")
def persons_in_files(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("files"))
    return found.where("files > 1")


@query("streaming_bins", """SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY ALL""")
def streaming_bins(spark: SparkSession, d: str) -> DataFrame:
    """Quarter-hour counts by Structured Streaming over all files that are there, then read as a table."""
    return quarters.counted(spark, f"{d}/events.parquet", "ts", "event_type").select("event_type", "start", "n")


@query("duration_agreement", f"""WITH {TRIP}, t AS (SELECT mode, abs((t_end - t_start) - round((t_end - t_start) / 600) * 600) / 60 AS off FROM trip)
SELECT mode, round(median(off), 4) AS median_off, round(avg(CASE WHEN off <= 1 THEN 1.0 ELSE 0.0 END) * 100, 4) AS within_minute FROM t GROUP BY ALL""")
def duration_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far durations are from whole ten minutes."""
    length = F.col("t_end") - F.col("t_start")
    off = F.abs(length - F.round(length / 600) * 600) / 60
    return trips(spark, d).withColumn("off", off).groupBy("mode").agg(F.round(F.median("off"), 4).alias("median_off"), F.round(F.avg((F.col("off") <= 1).cast("double")) * 100, 4).alias("within_minute"))


