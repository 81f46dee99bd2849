"""Ranks, correlations, fits and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.prefix import kept, running_sum


def with_average_rank(df: DataFrame, value: str, out: str, by: list[str] = ()) -> DataFrame:
    """df with the mean rank of equal values, from 1; null values have none and count for none.

    Ranks come from the counts of distinct values, so the sort is over distinct values, not over rows. df is evaluated
    twice and joined by value: sums of doubles, which depend on the order of their rows, must be written before.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    if by:
        upto = counts.withColumn("_u", F.sum("_c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        upto = running_sum(counts, [F.col(value)], F.col("_c"), "_u")
    ranks = upto.withColumn(out, F.col("_u") - (F.col("_c") - 1) / 2).drop("_c", "_u")
    return df.join(ranks, [*by, value], "left")


def with_percent_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the mean rank of equal values over their number: in (0, 1]."""
    n = df.agg(F.count(value).alias("_n"))  # one row
    return with_average_rank(df, value, out).join(F.broadcast(n)).withColumn(out, F.col(out) / F.col("_n")).drop("_n")


def rank_residual(df: DataFrame, key: str, a: str, b: str, shown: Column) -> DataFrame:
    """key, residual: percent rank of a less that of b, both over the rows shown."""
    base = kept(df.where(shown & F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, a, b))
    ranked = with_percent_rank(with_percent_rank(base, a, "_ra"), b, "_rb")
    return ranked.select(key, (F.col("_ra") - F.col("_rb")).alias("residual"))


def _corr(a: str, b: str) -> Column:
    """Pearson's r; null where a column doesn't vary (corr itself raises or gives NaN)."""
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    centred = F.covar_pop(a, b)
    return F.when(varies, F.try_divide(centred, F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))))


def spearman(df: DataFrame, a: str, b: str, least: int = 8, digits: int = 3) -> DataFrame:
    """One row: n, rho, and r of log1p; only n where fewer than `least` rows have both."""
    both = kept(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")))
    ranked = with_average_rank(with_average_rank(both, "a", "ra"), "b", "rb").withColumns({"la": F.log1p("a"), "lb": F.log1p("b")})
    enough = F.count(F.lit(1)) >= least
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.when(enough, F.round(_corr("ra", "rb"), digits)).alias("rho"), F.when(enough, F.round(_corr("la", "lb"), digits)).alias("r_log"))


def loglog_fit(df: DataFrame, x: str, y: str, floor: float = 1e-12) -> DataFrame:
    """One row: slope and intercept of ln y on ln max(x, floor) over positive y."""
    logs = df.where((F.col(y) > 0) & F.col(x).isNotNull()).select(F.log(F.greatest(F.col(x).cast("double"), F.lit(floor))).alias("x"), F.log(F.col(y).cast("double")).alias("y"))
    slope = F.when(F.min("x") < F.max("x"), F.regr_slope("y", "x"))
    return logs.agg(slope.alias("slope"), F.when(F.min("x") < F.max("x"), F.regr_intercept("y", "x")).alias("intercept"))


def predicted(df: DataFrame, fit: DataFrame, x: str, floor: float = 1e-12) -> DataFrame:
    line = F.exp(F.col("slope") * F.log(F.greatest(F.col(x).cast("double"), F.lit(floor))) + F.col("intercept"))
    return df.join(F.broadcast(fit)).withColumn("predicted", line).drop("slope", "intercept")  # fit is one row


def described(df: DataFrame, value: str, by: list[str] = (), at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """n, mean, std, min, exact quantiles with linear interpolation, max."""
    rows = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    names = [f"p{round(q * 100)}" for q in at]
    found = quantiles(df, value, list(by), at).select(*[F.col(c).alias(f"_{c}") for c in by], *names)
    on = [rows[c].eqNullSafe(F.col(f"_{c}")) for c in by]
    joined = rows.join(found, on, "left") if by else rows.join(F.broadcast(found), how="left")  # one row each
    return joined.select(*by, "n", "mean", "std", "min", *names, "max")


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, n, pct of the row's total."""
    counts = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(row)))


def lower_quantile(df: DataFrame, value: str, q: float, default: float = 1.0) -> DataFrame:
    """One row: of the positive values in order, that at floor(q (n - 1)); the default without any.

    Counts of distinct values are summed, so a window runs over distinct values only.
    """
    counts = df.where(F.col(value) > 0).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n"))  # one row
    picked = running_sum(counts, [F.col("v")], F.col("c"), "upto").join(F.broadcast(total)).where(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1)))
    return picked.agg(F.coalesce(F.min("v"), F.lit(default)).alias("value"))


def quantiles(df: DataFrame, value: str, by: list[str], wanted: tuple[float, ...]) -> DataFrame:
    """by, and p25, … for wanted quantiles: exact, with linear interpolation between the two values around a place.

    Counts of distinct values are summed, so no task gathers a group's values; without `by` the sums go over ranges.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    if by:
        upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
        placed = upto.withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    else:
        total = counts.agg(F.sum("_c").alias("_n"))  # one row
        placed = running_sum(counts, [F.col("_v")], F.col("_c"), "_upto").join(F.broadcast(total))
    at = {q: F.lit(q) * (F.col("_n") - 1) for q in wanted}
    pick = [f(F.when(F.col("_upto") > side(at[q]), F.col("_v"))).alias(f"_{name}{i}") for i, q in enumerate(wanted) for f, side, name in ((F.min, F.floor, "low"), (F.min, F.ceil, "high"))]
    found = placed.groupBy(*by).agg(F.max("_n").alias("_n"), *pick)
    share = {q: at[q] - F.floor(at[q]) for q in wanted}
    return found.select(*by, *[(F.col(f"_low{i}") * (1 - share[q]) + F.col(f"_high{i}") * share[q]).alias(f"p{round(q * 100)}") for i, q in enumerate(wanted)])


def top_of_maxima(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """group, value: the n groups with the largest maxima, the smaller group of two."""
    return df.groupBy(group).agg(F.max(value).alias(value)).orderBy(F.col(value).desc(), group).limit(n)


def share_by_band(df: DataFrame, band: Column, hit: Column) -> DataFrame:
    """band, n, share: how many rows a band has, and the share of them that hit."""
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("share"))


def close_shares(df: DataFrame, by: str, count: str, given: str, within: float = 6e-5) -> DataFrame:
    """by, n, close: how many rows of a group have a given share that is their count over the largest of all, to `within`."""
    peak = df.agg(F.max(count).alias("_m"))  # one row
    near = F.abs(F.col(count) / F.col("_m") - F.col(given)) <= within
    return df.join(F.broadcast(peak)).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("close"))


def draw_band(share: Column) -> Column:
    """2 for busy, 1 for middling, 0 for quiet."""
    return F.when(share >= 0.25, 2).when(share >= 0.06, 1).otherwise(0)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; Spark limits each task's rows of a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def matches(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: rows of either side, and how many agree in all values. A reconciliation of two computations."""
    left = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(1).alias("in_a"))
    right = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(1).alias("in_b"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return left.join(right, keys, "full").agg(F.count("in_a").alias("rows_a"), F.count("in_b").alias("rows_b"), F.count_if(both & same).alias("matching"))
