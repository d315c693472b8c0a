"""One report of the tests that compare two groups.

Rows are (test, metric, n1, n2, statistic, p, effect, band, note): the
distribution of labels by Fisher's exact test where a two by two table expects
few, else by chi squared, and each metric by ranks or by Welch's t.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import tails
from narrata.operators import statistics

COLUMNS = ("test", "metric", "n1", "n2", "statistic", "p", "effect", "band", "note")


def _row(df: DataFrame, digits: int, **columns: Column) -> DataFrame:
    none = {"metric": F.lit(None).cast("string"), "note": F.lit(None).cast("string"), "effect": F.lit(None).cast("double")}
    every = none | columns
    return df.select(*((F.round(every[c].cast("double"), digits) if c in ("statistic", "p", "effect") else every[c].cast("long") if c in ("n1", "n2") else every[c]).alias(c) for c in COLUMNS))


def labels(df: DataFrame, first: Column, label: str, digits: int = 6) -> DataFrame:
    """Whether the labels of two groups are differently distributed. Labels are few: their counts are one row."""
    counts = df.where(first.isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count_if(first).alias("x"), F.count_if(~first).alias("y"))
    sums = counts.agg(F.sum("x").alias("n1"), F.sum("y").alias("n2"), F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct("label", "x", "y"))).alias("cells"))
    both = F.flatten(F.transform("cells", lambda c: F.array(*(F.struct(c[o].cast("double").alias("o"), ((c["x"] + c["y"]) * F.col(n) / F.greatest(F.col("n1") + F.col("n2"), F.lit(1))).alias("e")) for o, n in (("x", "n1"), ("y", "n2"))))))
    told = sums.withColumn("both", both).withColumns({
        "least": F.array_min(F.transform("both", lambda c: c["e"])),
        # Yates' correction, for two by two only.
        "chi2": F.aggregate("both", F.lit(0.0), lambda s, c: s + F.pow(F.when(F.col("k") == 2, F.greatest(F.abs(c["o"] - c["e"]) - F.least(F.lit(0.5), F.abs(c["o"] - c["e"])), F.lit(0.0))).otherwise(c["o"] - c["e"]), F.lit(2)) / F.greatest(c["e"], F.lit(1e-300))),
    })
    cell = lambda i, side: F.get("cells", F.lit(i))[side]
    a, b, c, d = cell(0, "x"), cell(1, "x"), cell(0, "y"), cell(1, "y")
    enough = (F.col("k") > 1) & (F.col("n1") > 0) & (F.col("n2") > 0)
    small, exact = F.col("least") < 5, (F.col("least") < 5) & (F.col("k") == 2)
    v = F.sqrt(F.col("chi2") / F.greatest(F.col("n1") + F.col("n2"), F.lit(1)))
    return _row(
        told, digits,
        test=F.when(~enough, "labels").when(exact, "fisher").otherwise("chi_squared"), metric=F.lit(label), n1=F.coalesce("n1", F.lit(0)), n2=F.coalesce("n2", F.lit(0)),
        statistic=F.when(~enough, 0.0).when(exact, F.try_divide(a * d, b * c)).otherwise(F.col("chi2")),
        p=F.when(~enough, 1.0).when(exact, tails.fisher(a, b, c, d)).otherwise(tails.p_chi_squared(F.col("chi2"), F.col("k") - 1)),
        effect=F.when(enough & ~exact, v), band=F.when(enough & ~exact, F.when(v < 0.1, "negligible").when(v < 0.3, "small").when(v < 0.5, "medium").otherwise("large")),
        note=F.when(~enough, "too few labels or rows").when(small & ~exact, "few are expected in a cell"),
    )


def metric(df: DataFrame, first: Column, value: str, parametric: bool = False, digits: int = 6) -> DataFrame:
    """Whether a value differs between two groups; its nulls take no part."""
    rows = df.where(F.col(value).isNotNull() & first.isNotNull())
    enough = (F.col("n1") > 1) & (F.col("n2") > 1)
    if parametric:
        sides = statistics.two_groups(rows, first, value)
        told = sides.join(statistics.t_tests(rows, first, value, 12)).join(statistics.cohens_d(rows, first, value, 12).select("d", "band"))
        statistic, p, effect, name = F.col("t_welch"), tails.p_student(F.col("t_welch"), F.col("df_welch")), F.col("d"), "welch"
    else:
        told = statistics.mann_whitney(rows, first, value, 12)
        statistic, p, effect, name = F.col("u"), F.when(F.col("z").isNull(), 1.0).otherwise(tails.p_normal(F.greatest(F.abs("z"), F.lit(0.0)))), F.col("delta"), "mann_whitney"
    return _row(
        told, digits, test=F.lit(name), metric=F.lit(value), n1=F.coalesce("n1", F.lit(0)), n2=F.coalesce("n2", F.lit(0)),
        statistic=F.when(enough, statistic).otherwise(0.0), p=F.when(enough, F.coalesce(p, F.lit(1.0))).otherwise(1.0), effect=F.when(enough, effect), band=F.when(enough, F.col("band")), note=F.when(~enough, "too few rows"),
    )


def report(df: DataFrame, first: Column, label: str, metrics: list[str], parametric: bool = False, digits: int = 6) -> DataFrame:
    """The labels' row and a row for each metric, with ``significant`` at a twentieth."""
    rows = [labels(df, first, label, digits), *(metric(df, first, m, parametric, digits) for m in metrics)]
    return functools.reduce(DataFrame.unionByName, rows).withColumn("significant", F.col("p") < 0.05)
