"""Statistics of groups and pairs of columns, from moments, ranks and counts.

Effect sizes over all pairs come from ranks, so none is quadratic. Ranks over a
whole column use counts of distinct values: those are few after rounding, and
equal values are counted before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.workspace import Workspace


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def two_groups(df: DataFrame, first: Column, value: str) -> DataFrame:
    side = lambda f, c: f(F.when(c, F.col(value)))
    return df.agg(side(F.count, first).alias("n1"), side(F.count, ~first).alias("n2"), side(F.avg, first).alias("m1"), side(F.avg, ~first).alias("m2"), side(F.var_samp, first).alias("v1"), side(F.var_samp, ~first).alias("v2"))


def cohens_d(df: DataFrame, first: Column, value: str, digits: int = 6) -> DataFrame:
    """Difference of means over the pooled deviation, with its band."""
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.nullif(F.col("n1") + F.col("n2") - 2, F.lit(0)))
    d = F.round(F.when(pooled > 0, (F.col("m1") - F.col("m2")) / pooled).otherwise(0.0), digits)
    size = F.abs("d")
    return two_groups(df, first, value).select("n1", "n2", d.alias("d")).withColumn("band", F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large"))


def t_tests(df: DataFrame, first: Column, value: str, digits: int = 6) -> DataFrame:
    """Student's (pooled) and Welch's t with their degrees of freedom."""
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif(n1 + n2 - 2, F.lit(0))
    diff = F.col("m1") - F.col("m2")
    a, b = v1 / n1, v2 / n2
    r = lambda c: F.round(c, digits)
    return two_groups(df, first, value).select(r(diff / F.sqrt(F.nullif(pooled * (1 / n1 + 1 / n2), F.lit(0.0)))).alias("t_pooled"), (n1 + n2 - 2).alias("df_pooled"), r(diff / F.sqrt(F.nullif(a + b, F.lit(0.0)))).alias("t_welch"), r((a + b) * (a + b) / F.nullif(a * a / (n1 - 1) + b * b / (n2 - 1), F.lit(0.0))).alias("df_welch"))


def average_ranks(ws: Workspace, df: DataFrame, value: str, *also: Column) -> DataFrame:
    """(value, n, also..., before, rank): distinct values with their counts, the count of smaller ones, and the mean rank.

    Only distinct values are ordered, dealt by ranges that hold equally many of
    them, with the counts of lower ranges added.
    """
    counts = ws.save(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), *also), "counts")
    tasks = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ws.save(counts.repartitionByRange(tasks, "value").withColumn("_part", F.spark_partition_id()), "ranges")
    # One row for each range: their number is the setting.
    parts = placed.groupBy("_part").agg(F.sum("n").alias("_n")).withColumn("_lower", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("_inside", inside).join(parts, "_part").withColumn("before", F.col("_inside") + F.col("_lower"))
    return ranked.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2).drop("_part", "_inside", "_lower")


def mann_whitney(df: DataFrame, first: Column, value: str, digits: int = 6) -> DataFrame:
    """U of the first group, Cliff's delta, AUC, rank-biserial r, and z with corrections for ties and continuity."""
    ws = Workspace(df.sparkSession, "ranks")
    rows = ws.save(df.select(F.col(value).alias("v"), first.alias("first")), "rows")
    ranks = average_ranks(ws, rows.where("first is not null"), "v", F.count_if("first").alias("n_first"))
    n1, n2, u = F.col("n1"), F.col("n2"), F.col("u")
    n = n1 + n2
    all_ = ranks.agg(F.sum(F.col("n_first") * F.col("rank")).alias("r"), F.sum("n_first").alias("n1"), F.sum(F.col("n") - F.col("n_first")).alias("n2"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    some = all_.withColumn("u", F.col("r") - n1 * (n1 + 1) / 2)
    spread = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0))))
    off = u - n1 * n2 / 2.0
    delta = F.round(2 * u / F.nullif(n1 * n2, F.lit(0)) - 1, digits)
    size = F.abs("delta")
    out = some.select("n1", "n2", u.alias("u"), delta.alias("delta"), F.round(u / F.nullif(n1 * n2, F.lit(0)), digits).alias("auc"), F.round((F.abs(off) - 0.5) / F.nullif(spread, F.lit(0.0)) * F.signum(off), digits).alias("z"))
    return out.withColumn("band", F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large"))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    return df.groupBy(row, column).agg(F.count("*").alias("n"))


def chi_squared(df: DataFrame, row: str, column: str, digits: int = 6) -> DataFrame:
    """Chi squared (with Yates' correction for two by two), degrees of freedom, Cramer's V, and whether an expected count is under five."""
    cells = contingency(df.where(F.col(row).isNotNull() & F.col(column).isNotNull()), row, column)
    rows = cells.groupBy(row).agg(F.sum("n").alias("r"))
    columns = cells.groupBy(column).agg(F.sum("n").alias("c"))
    total = cells.agg(F.sum("n").alias("t"), F.count_distinct(row).alias("nr"), F.count_distinct(column).alias("nc"))
    # Labels of two dimensions, and one row of totals.
    grid = rows.crossJoin(columns).join(cells, [row, column], "left").crossJoin(total)
    e, o = F.col("r") * F.col("c") / F.col("t"), F.coalesce("n", F.lit(0))
    gap = F.when((F.col("nr") == 2) & (F.col("nc") == 2), F.greatest(F.abs(o - e) - 0.5, F.lit(0.0))).otherwise(F.abs(o - e))
    sums = grid.agg(F.sum(gap * gap / e).alias("chi2"), F.sum((o - e) * (o - e) / e).alias("plain"), F.min(e).alias("least"), F.first("t").alias("n"), F.first("nr").alias("nr"), F.first("nc").alias("nc"))
    v = F.sqrt(F.col("plain") / (F.col("n") * F.nullif(F.least("nr", "nc") - 1, F.lit(0))))
    return sums.select(F.round("chi2", digits).alias("chi2"), ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("dof"), F.round(v, digits).alias("cramers_v"), (F.col("least") < 5).alias("exact_needed"))


def spearman(df: DataFrame, x: str, y: str, digits: int = 6) -> DataFrame:
    """Correlation of average ranks, of the rows that have both values."""
    ws = Workspace(df.sparkSession, "spearman")
    rows = ws.save(df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null"), "rows")
    rx = average_ranks(ws, rows, "x").select(F.col("value").alias("x"), F.col("rank").alias("rx"))
    ry = average_ranks(ws, rows, "y").select(F.col("value").alias("y"), F.col("rank").alias("ry"))
    return rows.join(rx, "x").join(ry, "y").agg(F.round(F.corr("rx", "ry"), digits).alias("rho"), F.count("*").alias("n"))


def unit_draw(*parts: Column | int) -> Column:
    """A number of 0 to 1 for each combination of parts, by MD5, so that every engine draws the same."""
    named = F.concat_ws(":", *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
    return (F.conv(F.left(F.md5(named), F.lit(7)), 16, 10).cast("long") + 0.5) / float(1 << 28)


#: Statistics of values v that count k times each.
STATISTICS = {
    "mean": lambda v, k: F.sum(k * v) / F.nullif(F.sum(k), F.lit(0)),
    "std": lambda v, k: F.sqrt(F.greatest(F.lit(0.0), F.sum(k * v * v) / F.nullif(F.sum(k), F.lit(0)) - F.pow(F.sum(k * v) / F.nullif(F.sum(k), F.lit(0)), F.lit(2)))),
    "median": lambda v, k: F.percentile(v, F.lit(0.5), k),
}


def _poisson(u: Column) -> Column:
    """How often a row counts in a draw: a Poisson number of mean one from a number of 0 to 1."""
    steps, p, c = [], math.exp(-1), 0.0
    for k in range(9):
        c += p
        steps.append((c, k))
        p /= k + 1
    return F.coalesce(*(F.when(u < F.lit(c), F.lit(k)) for c, k in steps), F.lit(9))


def bootstrap(df: DataFrame, id: str, value: str, draws: int = 1000, level: float = 0.95, seed: int = 42, statistic: str = "mean", first: Column | None = None) -> DataFrame:
    """(point, low, high): a statistic ("mean", "std", "median") and its interval over Poisson resamples.

    A row counts k times in a draw, k told by a hash of its ``id`` and the
    draw: ids must differ, or rows move together. With ``first`` it is the
    statistic of the first group less that of the others. Every draw is a group
    of partial sums, so rows are never copied through a shuffle. Null values
    take no part; without values all three are null.
    """
    f = STATISTICS[statistic]
    rows = df.select(F.col(id).alias("_id"), F.col(value).cast("double").alias("v"), (F.lit(True) if first is None else first).alias("first")).where("v is not null and first is not null")
    of = lambda k: f(F.col("v"), F.when(F.col("first"), k).otherwise(0)) if first is None else f(F.col("v"), F.when(F.col("first"), k).otherwise(0)) - f(F.col("v"), F.when(F.col("first"), 0).otherwise(k))
    each = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("k", _poisson(unit_draw(F.col("_id"), F.col("draw"), seed)))
    found = each.groupBy("draw").agg(of(F.col("k")).alias("m"))
    half = (1 - level) / 2
    interval = found.agg(F.percentile("m", F.lit(half)).alias("low"), F.percentile("m", F.lit(1 - half)).alias("high"))
    # Both have one row.
    return rows.agg(of(F.lit(1)).alias("point")).crossJoin(interval)


def permutation_test(df: DataFrame, id: str, first: Column, value: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(difference, p_value): difference of the groups' means, and the share of random splits with one as large.

    A hash of ``id`` and the draw deals each row to a side with the first
    group's share: ids must differ. Null values and rows of no group take no
    part; a split that leaves a side empty has no difference.
    """
    rows = df.select(F.col(id).alias("_id"), F.col(value).cast("double").alias("v"), first.alias("first")).where("v is not null and first is not null")
    real = rows.agg((F.avg(F.when(F.col("first"), F.col("v"))) - F.avg(F.when(~F.col("first"), F.col("v")))).alias("difference"), F.avg(F.col("first").cast("double")).alias("share"))
    # One row.
    each = rows.crossJoin(real).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    side = unit_draw(F.col("_id"), F.col("draw"), seed) < F.col("share")
    split = each.withColumn("side", side).groupBy("draw").agg((F.avg(F.when(F.col("side"), F.col("v"))) - F.avg(F.when(~F.col("side"), F.col("v")))).alias("d"), F.first("difference").alias("difference"))
    extreme = F.count_if(F.abs(F.coalesce("d", F.lit(0.0))) >= F.abs("difference") - 1e-12)
    return split.agg(F.first("difference").alias("difference"), ((extreme + 1) / (F.count("*") + 1)).alias("p_value"))


def adjusted_rand(df: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    """Agreement of two labelings, corrected for chance."""
    pairs = lambda n: n * (n - 1) / 2.0
    cells = contingency(df, a, b)
    rows, columns = cells.groupBy(a).agg(F.sum("n").alias("n")), cells.groupBy(b).agg(F.sum("n").alias("n"))
    one = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), pairs(F.sum("n")).alias("t")).crossJoin(rows.agg(F.sum(pairs(F.col("n"))).alias("x"))).crossJoin(columns.agg(F.sum(pairs(F.col("n"))).alias("y")))
    expected = F.col("x") * F.col("y") / F.nullif(F.col("t"), F.lit(0.0))
    return one.select(F.round((F.col("s") - expected) / F.nullif((F.col("x") + F.col("y")) / 2 - expected, F.lit(0.0)), digits).alias("ari"))


def share_entropy(df: DataFrame, group: str, label: str, classes: int, digits: int = 6) -> DataFrame:
    """Entropy of a group's labels over that of ``classes`` equal shares."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(group)))
    return shares.groupBy(group).agg(F.round(-F.sum(F.col("p") * F.log2("p")) / math.log2(classes) + 0.0, digits).alias("diversity"), F.sum("n").alias("n"), F.max_by(label, F.struct("n", F.hash(label))).alias("dominant"))
