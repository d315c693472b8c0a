"""Distances between series, clusters and classifiers of shapes.

Corpora are clustered by pyspark.ml on resampled series, which scales with the
rows. Exact dynamic time warping compares series with a fixed number of
prototypes: that is what grows with the corpus, not pairs of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.functions import series as S
from narrata.workspace import Workspace

#: Series that are compared with all others at most.
MOST_PROTOTYPES = 256
#: Series of one length that are compared with the prototypes at once.
AT_ONCE = 1024


def warp(a: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact warping distances of one series to the rows of ``others``, all at once."""
    cost = np.abs(a[:, None, None] - others.T[None])
    n, m, k = cost.shape
    last = np.full((m + 1, k), np.inf)
    last[0] = 0
    for i in range(n):
        row = np.full((m + 1, k), np.inf)
        for j in range(m):
            row[j + 1] = cost[i, j] + np.minimum(np.minimum(last[j + 1], row[j]), last[j])
        last = row
    return last[m]


def to_prototypes(df: DataFrame, id: str, series: str, prototypes: dict[int, list[float]]) -> DataFrame:
    """(id, prototype, distance): exact warping distance of each series to each prototype."""
    if len(prototypes) > MOST_PROTOTYPES:
        raise ValueError(f"more than {MOST_PROTOTYPES} prototypes")
    names, table = list(prototypes), np.array(list(prototypes.values()), dtype=float)
    schema = T.StructType([df.schema[id], T.StructField("prototype", T.LongType()), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            series_ = batch.column(1)
            sizes = pc.list_value_length(series_).to_numpy(zero_copy_only=False)
            found = np.full((batch.num_rows, len(names)), np.inf)
            # Series of one length are compared at once.
            for n in np.unique(sizes[sizes > 0]).astype(int):
                for rows in np.array_split(at := np.flatnonzero(sizes == n), -(-len(at) // AT_ONCE)):
                    found[rows] = warps(series_.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n), table)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), len(names)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.tile(names, batch.num_rows), pa.int64()), pa.array(found.ravel())], names=schema.fieldNames())

    return df.select(id, series).mapInArrow(run, schema)


def warps(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact warping distances of each row to each row of ``others``, all at once."""
    last = [np.full((len(rows), len(others)), np.inf) for _ in range(others.shape[1] + 1)]
    last[0][:] = 0
    for i in range(rows.shape[1]):
        row = [np.full((len(rows), len(others)), np.inf)]
        for j in range(others.shape[1]):
            row.append(np.abs(rows[:, i, None] - others[None, :, j]) + np.minimum(np.minimum(last[j + 1], row[j]), last[j]))
        last = row
    return last[-1]


def _near(x: np.ndarray, medoids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's cluster, its distance, and the distance of the second-nearest medoid."""
    d = warps(x, medoids) if len(medoids) else np.ones((len(x), 1))
    own = d.argmin(1)
    return own, d.min(1), np.partition(d, 1, axis=1)[:, 1] if d.shape[1] > 1 else np.full(len(x), np.inf)


def _pass(df: DataFrame, medoids: np.ndarray, pool: np.ndarray, slots: int, salt: str) -> tuple[dict, list]:
    """One pass over all rows (id, x): total cost of each swap of a medoid for a series of the pool, (-1, -1) for none, and new candidates.

    Each cluster draws ``slots`` series: half of them evenly, half of them in
    proportion to the squared distance. Candidates are (weighted, key, id, series).
    """
    schema = f"j int, m int, cost double, key double, id {df.schema['id'].dataType.simpleString()}, x array<double>"
    names = ["j", "m", "cost", "key", "id", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, h = np.array(batch.column(1).to_pylist(), dtype=float), batch.column(2).to_numpy()
            own, near, second = _near(x, medoids)
            out = [(-1, -1, float(near.sum()), None, None)]
            if len(pool):
                d = warps(x, pool)
                least = np.minimum(d, near[:, None])
                for m in range(len(medoids)):
                    mine = own == m
                    costs = least.sum(0) + (np.minimum(d[mine], second[mine, None]) - least[mine]).sum(0)
                    out += [(j, m, float(c), None, None) for j, c in enumerate(costs)]
            slot = (h & 2047) % slots
            with np.errstate(divide="ignore"):
                key = -np.log((((h >> 11) & ((1 << 53) - 1)) + 0.5) / (1 << 53)) / np.where(slot % 2, near**2, 1.0)
            place = own * slots + slot
            order = np.lexsort((key, place))
            for i in order[np.unique(place[order], return_index=True)[1]]:
                if np.isfinite(key[i]):
                    out.append((-2 - int(slot[i]), int(own[i]), None, float(key[i]), int(i)))
            j, m, cost, keys, rows = zip(*out, strict=True)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(m, pa.int32()), pa.array(cost, pa.float64()), pa.array(keys, pa.float64()), batch.column(0).take(rows), batch.column(1).take(rows)], names=names)

    sent = df.select("id", "x", F.xxhash64(F.col("id"), F.lit(salt)).alias("h")).mapInArrow(run, schema)
    drawn = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "id", "x"))).alias("drawn")
    found = sent.groupBy("j", "m").agg(F.sum("cost").alias("cost"), drawn).collect()
    costs = {(r.j, r.m): r.cost for r in found if r.j >= -1}
    return costs, sorted((bool(r.j % 2), r.drawn.key, r.drawn.id, list(r.drawn.x)) for r in found if r.j < -1)


def k_medoids(df: DataFrame, id: str, series: str, k: int, rounds: int = 100, candidates: int = 5, seed: int = 42, patience: int = 3) -> DataFrame:
    """(id, cluster, distance): medoids under warping distance, from all series; series have one length.

    First medoids are drawn one after the other in proportion to the squared
    distance to those before. Then each round draws ``candidates`` series from
    every cluster and makes the swap that lowers the total distance of all rows
    most; after ``patience`` rounds without such a swap, none is looked for.
    """
    rows = Workspace(df.sparkSession, "medoids").save(df.select(F.col(id).alias("id"), F.col(series).alias("x")), "series")
    ids, medoids = [], np.zeros((0, 0))
    for i in range(k):
        _, drawn = _pass(rows, medoids, medoids[:0], 2, f"{seed}:first:{i}")
        drawn = [c for c in drawn if c[0] or not ids]
        if not drawn:
            break
        _, _, name, x = min(drawn, key=lambda c: c[1])
        ids, medoids = [*ids, name], np.array([*medoids.tolist(), x])
    pool, idle = [], 0
    for i in range(rounds):
        costs, drawn = _pass(rows, medoids, np.array([c[3] for c in pool]), candidates, f"{seed}:{i}")
        best = min(costs, key=lambda at: (costs[at], at), default=(-1, -1))
        if best[0] >= 0 and costs[best] < costs[-1, -1] * (1 - 1e-9):
            idle = 0
            ids[best[1]], medoids[best[1]] = pool[best[0]][2], pool[best[0]][3]
        elif pool:
            idle += 1
        pool = drawn
        if idle >= patience or not pool:
            break
    schema = T.StructType([df.schema[id], T.StructField("cluster", T.LongType()), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, near, _ = _near(np.array(batch.column(1).to_pylist(), dtype=float), medoids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids[c] for c in own], pa.int64()), pa.array(near)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def patterns(df: DataFrame, id: str, series: str, k_range: tuple[int, int] = (2, 7), n: int = 20, seed: int = 42, method: str = "kmeans") -> tuple[DataFrame, int, float]:
    """(id, cluster), the number of clusters with the best silhouette, and that silhouette."""
    rows = df.select(id, array_to_vector(S.resample(S.minmax(F.col(series)), n)).alias("raw")).where("raw is not null")
    ws = Workspace(df.sparkSession, "patterns")
    rows = ws.save(rows, "raw")
    rows = ws.save(StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows).drop("raw"), "features")
    best = None
    for k in range(*k_range):
        model = (KMeans if method == "kmeans" else BisectingKMeans)(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
        quality = ClusteringEvaluator(predictionCol="cluster").evaluate(model.transform(rows))
        if best is None or quality > best[2]:
            best = (model, k, quality)
    model, k, quality = best
    return model.transform(rows).select(id, "cluster"), k, quality


def named(features: DataFrame, cluster: str) -> DataFrame:
    """Names of clusters from the means of net change, peaks, volatility."""
    m = features.groupBy(cluster).agg(F.avg("net").alias("net"), F.avg("peaks").alias("peaks"), F.avg("volatility").alias("volatility"), F.count("*").alias("n"))
    trend = F.when(F.col("net") > 0.3, "Rising").when(F.col("net") < -0.3, "Falling").otherwise("Oscillating")
    form = F.when(F.col("peaks") >= 2, "Multi-Peak").otherwise("Single-Peak")
    mood = F.when(F.col("volatility") > 0.1, "Turbulent").when(F.col("volatility") < 0.03, "Smooth").otherwise("")
    return m.select(cluster, "n", F.trim(F.concat_ws(" ", trend, form, mood)).alias("name"))


MODELS = {"forest": lambda: RandomForestClassifier(numTrees=20, seed=42), "logistic": lambda: LogisticRegression(maxIter=50)}


def classify(features: DataFrame, columns: list[str], label: str, id: str, model: str = "forest", folds: int = 3) -> DataFrame:
    """(fold, n, accuracy, f1): cross-validated quality; folds by a hash of the id."""
    # Written once: each fit and each judgement reads the rows again.
    rows = Workspace(features.sparkSession, "classify").save(features.select(id, label, *columns, F.pmod(F.xxhash64(id), F.lit(folds)).alias("_fold")).where(F.col(label).isNotNull()), "features")
    steps = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip"), VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip"), MODELS[model]()])
    out = []
    for fold in range(folds):
        found = steps.fit(rows.where(F.col("_fold") != fold)).transform(rows.where(F.col("_fold") == fold)).select("label", "prediction")
        judged = [MulticlassClassificationEvaluator(metricName=m).evaluate(found) for m in ("accuracy", "f1")]
        out.append((fold, found.count(), *judged))
    return features.sparkSession.createDataFrame(out, "fold int, n long, accuracy double, f1 double")


def transfer(features: DataFrame, columns: list[str], label: str, group: str, a: str, b: str, model: str = "forest") -> DataFrame:
    """Accuracy of a model of group a on both groups, the gap, and how universal that makes it."""
    steps = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip"), VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip"), MODELS[model]()])
    # Written once: the fit and both judgements read the rows again.
    features = Workspace(features.sparkSession, "transfer").save(features.select(group, label, *columns), "features")
    fitted = steps.fit(features.where(F.col(group) == a))
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    home, away = (judge.evaluate(fitted.transform(features.where(F.col(group) == g))) for g in (a, b))
    gap = home - away
    verdict = "universal" if gap < 0.10 else "partial" if gap < 0.20 else "specific"
    return features.sparkSession.createDataFrame([(a, b, home, away, gap, verdict)], "trained string, tested string, home double, away double, gap double, verdict string")


def silhouette(pairs: DataFrame, id: str) -> DataFrame:
    """Mean silhouette from (id, own cluster's distance, next cluster's distance)."""
    s = (F.col("other") - F.col("own")) / F.greatest("own", "other")
    return pairs.agg(F.avg(s).alias("silhouette"))


def nearest(df: DataFrame, id: str) -> DataFrame:
    """The two nearest prototypes of each series: (id, own, other)."""
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy(id).orderBy("distance", "prototype"))).where("r <= 2")
    return ranked.groupBy(id).agg(F.min("distance").alias("own"), F.max("distance").alias("other"))
