"""Comparisons of series: summaries of one, pairs of several, and what two of them share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import series as S

#: Rules of :func:`entropy_structure` for entropies in bits.
SPIKE, HIGH, DROP, RISE, EVEN = 0.5, 8.0, 2.0, 0.01, 0.8


def _first_at(x: Column, value: Column) -> Column:
    return (F.array_position(x, value) - 1) / F.size(x)


def _mean_between(x: Column, start: Column, end: Column) -> Column:
    """Mean of x[start:end], counted from 0; null for none."""
    return F.when(end > start, S.mean(F.slice(x, start + 1, F.greatest(end - start, F.lit(1)))))


def entropy_metrics(df: DataFrame, series: str) -> DataFrame:
    """The columns of ``df`` without ``series``, and metrics of it; rows with an empty series go.

    Means of quarters that have no value are null. The tail is the last tenth,
    rounded up.
    """
    x, n = F.col("_x"), F.col("n")
    others = [c for c in df.columns if c != series]
    base = df.select(*others, F.transform(series, lambda v: F.round(v, 9)).alias("_x")).withColumn("n", F.size("_x")).where("n > 0")
    whole = base.withColumns({"mean": S.mean(x), "variance": S.variance(x), "highest": F.array_max(x), "lowest": F.array_min(x), "slope": S.slope(x), "first": F.get(x, F.lit(0)), "last": F.get(x, n - 1)})
    cuts = [F.lit(0), F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int"), F.floor(3 * n / 4).cast("int"), n]
    parts = {f"q{k + 1}": _mean_between(x, cuts[k], cuts[k + 1]) for k in range(4)}
    placed = whole.withColumns({**parts, "highest_at": _first_at(x, F.col("highest")), "lowest_at": _first_at(x, F.col("lowest")), "tail": _mean_between(x, n - F.ceil(n / 10).cast("int"), n)})
    q = [F.col(f"q{k}") for k in range(1, 5)]
    return placed.withColumns({"uniformity": 1 / (1 + F.col("variance")), "change": F.col("last") - F.col("first"), "cliff": F.col("last") - F.col("mean"), "spike": q[2] - (q[0] + q[1]) / 2, "resolution": F.col("highest") - F.col("last")}).drop("_x")


def entropy_structure(spike: float = SPIKE, high: float = HIGH, drop: float = DROP, rise: float = RISE, even: float = EVEN) -> Column:
    """What :func:`entropy_metrics` tell of a structure: the first rule that holds. Nulls hold no rule."""
    digits = lambda c: F.round(c, 6)
    return (
        F.when((digits("spike") > spike) & (digits(F.col("q4") - F.col("q3")) < 0), "kishotenketsu").when((digits("mean") > high) & (digits("resolution") > drop), "mystery")
        .when((digits("slope") > rise) & (F.col("change") > 0), "tragedy").when((F.col("lowest_at") > 0.3) & (F.col("lowest_at") < 0.7) & (F.col("last") > F.col("lowest")), "man_in_hole")
        .when(digits("uniformity") > even, "slice_of_life").otherwise("unclassified")
    )


def peak_places(x: Column) -> Column:
    """Places, from 0, of values above both neighbours."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(x) - 2, F.lit(1))), lambda i: (S.at(x, i) > S.at(x, i - 1)) & (S.at(x, i) > S.at(x, i + 1)))


def peak_alignment(p: Column, q: Column, n: int) -> Column:
    """1 less the mean distance of p's peaks to the nearest of q's, over n; 0 if one has none."""
    nearest = F.transform(p, lambda i: F.array_min(F.transform(q, lambda j: F.abs(i - j))).cast("double"))
    return F.when((F.size(p) > 0) & (F.size(q) > 0), 1 - S.mean(nearest) / n).otherwise(0.0)


def presence(counts: DataFrame, left: str, right: str) -> DataFrame:
    """Two arrays of counts for each window, over the larger of their maxima, and the left one's share of both."""
    most = F.greatest(F.array_max(left), F.array_max(right), F.lit(1))
    each = F.posexplode(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))).alias("win_idx", "_c")
    others = [c for c in counts.columns if c not in (left, right)]
    rows = counts.withColumn("_most", most).select(*others, "_most", each)
    n, m = F.col("_c.l"), F.col("_c.r")
    return rows.select(*others, "win_idx", (n / F.col("_most")).alias(left), (m / F.col("_most")).alias(right), (n / F.greatest(n + m, F.lit(1))).alias("share"))


def way(arrows: DataFrame, features: list[str], id: str = "doc_id") -> DataFrame:
    """(id, steps, far, ends): Euclidean lengths of a document's transitions, the farthest from the first state, and first to last."""
    order = Window.partitionBy(id).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    length = lambda columns: F.sqrt(sum((c * c for c in columns), F.lit(0.0)))
    rows = arrows.withColumns({f"_{f}": F.sum(f"d_{f}").over(order) for f in features})
    rows = rows.select(id, "idx", length([F.col(f"d_{f}") for f in features]).alias("step"), length([F.col(f"_{f}") for f in features]).alias("from_first"))
    return rows.groupBy(id).agg(F.sum("step").alias("steps"), F.max("from_first").alias("far"), F.max_by("from_first", "idx").alias("ends"))


def roles(found: DataFrame, last: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, name, mentions, coverage, place, role) of names in sentences; ``last`` has each document's last sentence.

    Coverage is from the first to the last mention, over the document. Equal
    counts rank by name. A document's names, not its mentions, meet in a task.
    """
    each = found.groupBy(id, "name").agg(F.count("*").alias("mentions"), F.min("sent").alias("_a"), F.max("sent").alias("_b"))
    placed = each.join(last, id).withColumn("coverage", (F.col("_b") - F.col("_a")) / F.greatest("last", F.lit(1)))
    ranked = placed.withColumns({"place": F.row_number().over(Window.partitionBy(id).orderBy(F.desc("mentions"), "name")), "_most": F.max("mentions").over(Window.partitionBy(id))})
    ratio = F.col("mentions") / F.col("_most")
    role = F.when((F.col("place") == 1) & (F.col("coverage") > 0.7), "protagonist").when((ratio > 0.3) & (F.col("coverage") > 0.5), "major").when(ratio > 0.1, "supporting").otherwise("minor")
    return ranked.select(id, "name", "mentions", "coverage", "place", role.alias("role"))
