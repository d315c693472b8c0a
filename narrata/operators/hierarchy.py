"""Ward's hierarchy over micro-clusters.

One pass over the rows makes micro-clusters: equal vectors, or, where there are
more different ones than ``most``, the cells of a grid over the axes that vary
most, as fine as that number allows. A micro-cluster is a count, sums and sums
of squares, which is all that Ward's criterion needs. The chain of nearest
neighbours over these (a bounded number) gives the merges, and rows take the
cluster of their cell.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.operators.density import axes
from narrata.workspace import Workspace

#: Micro-clusters at most, axes of the grid, and halvings of its width that are tried.
MOST, AXES, HALVINGS = 1024, 4, 24


def chain(sizes: np.ndarray, centers: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(a, b, height, size) of each merge in the order of heights: numbers from len(sizes) on are earlier merges.

    Heights are sqrt(2 |A| |B| / (|A| + |B|)) times the distance of the means; distances to a merged cluster follow
    from those to its parts, by the formula of Lance and Williams.
    """
    m = len(sizes)
    n = np.array(sizes, float)
    square = ((centers[:, None] - centers[None]) ** 2).sum(2) * 2 * n[:, None] * n[None] / np.maximum(n[:, None] + n[None], 1)
    np.fill_diagonal(square, np.inf)
    live, path, found = np.ones(m, bool), [], []
    for _ in range(m - 1):
        if not path:
            path = [int(np.flatnonzero(live)[0])]
        while True:
            at = path[-1]
            best = int(square[at].argmin())
            # The one before comes first among equally near ones, so that the chain ends.
            if len(path) > 1 and square[at, path[-2]] <= square[at, best]:
                break
            path.append(best)
        a, b = sorted((path.pop(), path.pop()))
        found.append((a, b, float(square[a, b])))
        others = live.copy()
        others[[a, b]] = False
        total = n[a] + n[b] + n
        merged = ((n[a] + n) * square[a] + (n[b] + n) * square[b] - n * square[a, b]) / total
        square[a, others] = square[others, a] = merged[others]
        square[b, :] = square[:, b] = np.inf
        live[b], n[a] = False, n[a] + n[b]
    # In the order of heights; a place in the table stands for the last cluster made there.
    at, out = list(range(m)), []
    count = np.array(sizes, np.int64)
    for i in sorted(range(len(found)), key=lambda i: (found[i][2], i)):
        a, b, height = found[i]
        count[a] += count[b]
        out.append((min(at[a], at[b]), max(at[a], at[b]), float(np.sqrt(max(height, 0.0))), int(count[a])))
        at[a] = m + len(out) - 1
    return out


def cut(merges: list[tuple[int, int, float, int]], m: int, k: int) -> list[int]:
    """A cluster from 0 for each of m micro-clusters, in the order of their first members, when k clusters are left."""
    up = list(range(m + len(merges)))
    for i, (a, b, _, _) in enumerate(merges[: max(m - k, 0)]):
        up[a] = up[b] = m + i
    top = []
    for x in range(m):
        while up[x] != x:
            x = up[x]
        top.append(x)
    names: dict[int, int] = {}
    return [names.setdefault(x, len(names)) for x in top]


def micro_clusters(df: DataFrame, vector: str, most: int = MOST) -> tuple[DataFrame, str]:
    """``df`` with a column ``cell``, at most ``most`` different ones, and what they are: ``exact`` or a grid's width."""
    if df.select(vector).distinct().limit(most + 1).count() <= most:
        return df.withColumn("cell", F.col(vector)), "exact"
    some = axes(df, vector, AXES)
    coordinates = [F.get(vector, F.lit(i)) for i in some]
    first = df.agg(F.max(F.greatest(*(F.abs(c) for c in coordinates)) if len(coordinates) > 1 else F.abs(coordinates[0]))).first()[0] or 1.0
    grid = lambda h: F.array(*(F.floor(c / (2 * first / 2**h)).cast("double") for c in coordinates))
    about = df.agg(*(F.approx_count_distinct(grid(h)).alias(f"h{h}") for h in range(HALVINGS))).first()
    best = max((h for h in range(HALVINGS) if about[h] <= most), default=0)
    while best and df.select(grid(best)).distinct().limit(most + 1).count() > most:
        best -= 1
    return df.withColumn("cell", grid(best)), f"width {2 * first / 2**best:g}"


def ward(df: DataFrame, id: str, vector: str, k: int, most: int = MOST, ws: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, micro), and (step, a, b, height, size, micro): the rows' clusters when k are left, and all merges.

    ``micro`` says what the micro-clusters are; where it is ``exact`` the hierarchy is that of the rows, with equal rows merged
    at height 0 before the first step. Rows with a null vector are left out; clusters are numbered by their first micro-cluster.
    """
    spark = df.sparkSession
    ws = ws or Workspace(spark, "ward")
    rows = ws.save(df.where(F.col(vector).isNotNull()).select(id, F.transform(vector, lambda x: x.cast("double") + 0.0).alias("v")), "rows")
    celled, micro = micro_clusters(rows, "v", most)
    x = array_to_vector(F.col("v"))
    sums = celled.groupBy("cell").agg(F.count("*").alias("n"), vector_to_array(Summarizer.sum(x)).alias("sum"))
    # At most ``most`` rows.
    features = sorted(((tuple(r.cell), r.n, r.sum) for r in sums.collect()), key=lambda r: r[0])
    sizes = np.array([r[1] for r in features], np.int64)
    centers = np.array([r[2] for r in features], float).reshape(len(features), -1) / np.maximum(sizes, 1)[:, None] if features else np.zeros((0, 0))
    merges = chain(sizes, centers)
    named = spark.createDataFrame([(list(map(float, r[0])), c) for r, c in zip(features, cut(merges, len(features), k), strict=True)], "cell array<double>, cluster int")
    clusters = celled.join(named, "cell").select(id, "cluster", F.lit(micro).alias("micro"))
    steps = spark.createDataFrame([(i, *merge, micro) for i, merge in enumerate(merges)], "step int, a int, b int, height double, size long, micro string")
    return clusters, steps
