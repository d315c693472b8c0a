"""Null models: how often a detector accepts series that have no structure.

Series are generated on the executors from hashes of their number, so a run
gives the same rows wherever it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.functions import series as S
from narrata.operators import detectors
from narrata.workspace import Workspace


def unit(*parts: Column | int) -> Column:
    """A number in 0..1 for each combination of parts."""
    return F.pmod(F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def null_series(spark: SparkSession, count: int, length: int = 100, seed: int = 42) -> DataFrame:
    """(series_id, kind, x): uniform noise, Brownian paths, and smoothed noise."""
    base = spark.range(count).withColumnRenamed("id", "series_id")
    noise = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: unit(F.col("series_id"), i, seed))
    rows = base.withColumn("noise", noise).withColumns({"random": F.col("noise"), "brownian": S.minmax(S.compound(F.col("noise")), 0.5), "smooth": S.savitzky_golay(F.col("noise"))})
    return rows.select("series_id", F.explode(F.create_map(*(c for k in ("random", "brownian", "smooth") for c in (F.lit(k), F.col(k))))).alias("kind", "x"))


def shuffled(x: Column, key: Column, parts: int = 10, seed: int = 42) -> Column:
    """Equal chunks in a random order; what is left over goes."""
    each = (F.size(x) / parts).cast("int")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(unit(key, i, seed).alias("u"), i.alias("i"))))
    return F.flatten(F.transform(order, lambda s: F.slice(x, s.getField("i") * each + 1, each)))


def shape_series(spark: SparkSession, count: int, curves: dict[str, list[float]], noise: float = 0.08, seed: int = 42) -> DataFrame:
    """(shape, series_id, x): canonical curves with a triangular noise."""
    kinds = F.explode(F.create_map(*(c for k, v in curves.items() for c in (F.lit(k), F.array(*(F.lit(float(y)) for y in v)))))).alias("shape", "curve")
    rows = spark.range(count).select(F.col("id").alias("series_id"), kinds)
    shaken = F.transform("curve", lambda y, i: y + noise * 2.45 * (unit(F.col("series_id"), F.col("shape"), i, seed) + unit(F.col("series_id"), F.col("shape"), i, seed + 1) - 1))
    return rows.select("shape", "series_id", shaken.alias("x"))


def _scores(df: DataFrame, names: tuple[str, ...], *columns: str) -> DataFrame:
    """(columns..., model, score): each detector's score of series x, 0 for one too short."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.coalesce(F.col(f"{n}.score"), F.lit(0.0)).alias("score")) for n in names)))
    return detectors.with_detectors(df, "x", names).select(*columns, each.alias("_s")).select(*columns, "_s.*")


def _areas(scored: DataFrame, first: Column, second: Column) -> DataFrame:
    """(model, auc): how probably a score of the first kind is above one of the second, ties half.

    Scores have six digits, so the distinct ones of a detector are few.
    """
    counts = scored.groupBy("model", "score").agg(F.count_if(first).alias("a"), F.count_if(second).alias("b"))
    below = F.coalesce(F.sum("b").over(Window.partitionBy("model").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = counts.withColumn("won", F.col("a") * (below + F.col("b") / 2))
    return won.groupBy("model").agg((F.sum("won") / F.nullif(F.sum("a") * F.sum("b"), F.lit(0))).alias("auc"))


def falsifiability(real: DataFrame, null: DataFrame, names: tuple[str, ...] = detectors.DETECTORS, threshold: float = 0.5) -> DataFrame:
    """How each detector tells real series (id, x) from series without structure (kind, x), from chunks in disorder, and from time reversed.

    One row for each detector: rejection and pass rates, AUC against random
    series, the weighted score, its grade, and what follows from it.
    """
    ws = Workspace(real.sparkSession, "falsifiability")
    kinds = {"real": F.col("x"), "shuffled": shuffled(F.col("x"), F.col("id")), "reversed": F.reverse("x")}
    own = real.select("id", "x").select(F.explode(F.create_map(*(c for k, v in kinds.items() for c in (F.lit(k), v)))).alias("kind", "x"))
    scored = ws.save(_scores(own.unionByName(null.select("kind", "x")), names, "kind"), "scores")
    share = lambda *of: F.avg(F.when(F.col("kind").isin(*of), (F.col("score") > threshold).cast("double")))
    rates = scored.groupBy("model").agg((1 - share("random")).alias("random_rejected"), (1 - share("brownian", "smooth")).alias("noise_rejected"), share("real").alias("real_passed"), share("shuffled").alias("shuffled_passed"), share("reversed").alias("reversed_passed"))
    one = rates.join(_areas(scored, F.col("kind") == "real", F.col("kind") == "random"), "model")
    total = 0.3 * F.col("random_rejected") + 0.2 * F.col("noise_rejected") + 0.25 * (1 - F.col("shuffled_passed")) + 0.1 * (1 - F.col("reversed_passed")) + 0.15 * 2 * (F.col("auc") - 0.5)
    graded = one.withColumn("score", F.round(S.clip(total), 6))
    grade = F.when(F.col("score") > 0.7, "GOOD").when(F.col("score") > 0.5, "MODERATE").when(F.col("score") > 0.3, "WEAK").otherwise("POOR")
    notes = F.concat_ws(", ", F.when(F.col("score") < 0.3, "too loose"), F.when(F.col("shuffled_passed") > 0.5, "ignores order"), F.when(F.col("score") > 0.6, "recommended"))
    return graded.withColumns({"grade": grade, "notes": notes})


def discrimination(series: DataFrame, group: str, a: str, b: str, names: tuple[str, ...] = detectors.DETECTORS) -> DataFrame:
    """(model, effect): size of the rank-biserial correlation of two groups' scores, for each detector; ``series`` is (group, x)."""
    scored = _scores(series.where(F.col(group).isin(a, b)).select(F.col(group).alias("_group"), "x"), names, "_group")
    areas = _areas(scored, F.col("_group") == a, F.col("_group") == b)
    return areas.select("model", F.round(F.abs(2 * F.col("auc") - 1), 6).alias("effect"))


def redundancy(scores: DataFrame, detectors: list[str], least: float = 0.7) -> DataFrame:
    """(a, b, r, redundant): correlations of detectors' score columns."""
    pairs = [(a, b) for i, a in enumerate(detectors) for b in detectors[i + 1 :]]
    row = scores.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 4).alias("r")) for a, b in pairs)).alias("p"))
    return row.select(F.explode("p").alias("p")).select("p.*", (F.abs("p.r") > least).alias("redundant"))


def thresholds(features: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, feature, mean, std, min, max, median) for each group."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns)))
    return features.select(label, each.alias("f")).groupBy(label, "f.feature").agg(F.round(F.avg("f.v"), 6).alias("mean"), F.round(F.stddev_pop("f.v"), 6).alias("std"), F.min("f.v").alias("min"), F.max("f.v").alias("max"), F.round(F.percentile("f.v", F.lit(0.5)), 6).alias("median"))


