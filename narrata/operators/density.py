"""Density clusters: core points, what they reach, and the rest as noise.

Equal vectors are one point with a weight. Points lie in the cells of a grid of
width epsilon over the axes that vary most, so that whatever is within epsilon
is in a neighbouring cell; cells are cut into blocks of bounded size, and
blocks of neighbouring cells meet whose boxes are near enough. A task that has
two blocks returns sums of weights, or links that connect core points and each
other point's nearest core: never all near pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.operators.components import components
from narrata.workspace import Workspace

#: Axes of the grid, and points of a block about.
AXES, BLOCK = 3, 512


def axes(df: DataFrame, vector: str, most: int) -> list[int]:
    """The places that vary most, of equal ones the first; none without rows."""
    if not df.take(1):
        return []
    spread = df.agg(vector_to_array(Summarizer.variance(array_to_vector(F.col(vector)))).alias("s")).first().s
    return sorted(range(len(spread or ())), key=lambda i: (-spread[i], i))[:most]


def _near(a: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows within a squared distance, and that distance: those that a product of matrices can't tell are judged by differences."""
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    slack = 1e-9 * (1 + (a**2).sum(1).max(initial=0) + (b**2).sum(1).max(initial=0))
    i, j = np.nonzero(square <= limit + slack)
    exact = np.concatenate([((a[i[s : s + 4096]] - b[j[s : s + 4096]]) ** 2).sum(1) for s in range(0, len(i), 4096)] or [np.zeros(0)])
    keep = exact <= limit
    return i[keep], j[keep], exact[keep]


def _columns(items: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flat = items.values
    nodes = flat.field("node").to_numpy(zero_copy_only=False)
    return nodes, flat.field("n").to_numpy(zero_copy_only=False), flat.field("core").to_numpy(zero_copy_only=False), flat.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(nodes), -1)


def _weights(pairs: DataFrame, limit: float) -> DataFrame:
    """(node, n): weight within the distance, of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, left, right in zip(batch.column("own").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
                a, n, _, x = _columns(left)
                b, m, _, y = _columns(right)
                i, j, _ = _near(x, y, limit)
                sums = [(a, np.bincount(i, m[j], len(a)))] + ([] if own else [(b, np.bincount(j, n[i], len(b)))])
                for nodes, total in sums:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(total.astype(np.int64))], names=["node", "n"])

    return pairs.mapInArrow(run, "node bigint, n bigint")


def _links(pairs: DataFrame, limit: float) -> DataFrame:
    """(a, b, far): links between core points that connect them within each pair of blocks (far is null), and each other point with its nearest core and the squared distance."""

    def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, None]]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((x, y, None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                a, _, c, x = _columns(left)
                b, _, d, y = _columns(right)
                if not (c.any() or d.any()):
                    continue
                i, j, far = _near(x, y, limit)
                both = c[i] & d[j] & (a[i] != b[j])
                out: list[tuple] = spanning(a[i[both]], b[j[both]])
                for point, core, keep in ((a[i], b[j], ~c[i] & d[j]), (b[j], a[i], ~d[j] & c[i])):
                    p, q, f = point[keep], core[keep], far[keep]
                    order = np.lexsort((q, f, p))
                    first = order[np.unique(p[order], return_index=True)[1]]
                    out += zip(p[first].tolist(), q[first].tolist(), f[first].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "far"])

    return pairs.mapInArrow(run, "a bigint, b bigint, far double")


def dbscan(df: DataFrame, id: str, vector: str, eps: float, least: int, ws: Workspace | None = None, block: int = BLOCK) -> DataFrame:
    """(id, cluster, core): the smallest id of the core rows of a row's cluster; null for noise.

    A row is core if ``least`` rows, itself included, are within ``eps``. Other rows within ``eps`` of a core go with the
    nearest one, of equally near ones that with the smallest id. Rows with a null id or vector, or a component that is null
    or not finite, are left out; equal rows are rows of their own; vectors of several lengths are refused.
    """
    ws = ws or Workspace(df.sparkSession, "density")
    whole = df.select(F.col(id).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double") + 0.0).alias("v"))
    rows = ws.save(whole.where(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))), "rows")
    if rows.select(F.size("v")).distinct().limit(2).count() > 1:
        raise ValueError("vectors of one length")
    points = ws.save(rows.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("n")), "points")
    some = axes(points, "v", AXES)
    cell = F.array(*(F.floor(F.get("v", F.lit(i)) / eps).cast("long") for i in some)) if some else F.array().cast("array<bigint>")
    celled = points.withColumn("cell", cell)
    counts = celled.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    # A block's number is that of the written table.
    dealt = celled.join(counts, "cell").groupBy("cell", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    blocks = ws.save(dealt.agg(F.collect_list(F.struct("node", "n", "v")).alias("items")).withColumn("block", F.monotonically_increasing_id()), "blocks")
    dims = F.sequence(F.lit(0), F.size(F.get("items", F.lit(0))["v"]) - 1)
    # Least and most of each place in a block.
    edge = lambda f: F.transform(dims, lambda d: f(F.transform("items", lambda x: F.get(x["v"], d))))
    boxes = ws.save(blocks.select("block", "cell", edge(F.array_min).alias("low"), edge(F.array_max).alias("high")), "boxes")
    steps = F.array(*(F.array(*map(F.lit, s)) if s else F.array().cast("array<int>") for s in itertools.product((-1, 0, 1), repeat=len(some))))
    around = boxes.withColumn("step", F.explode(steps)).withColumn("cell", F.zip_with("cell", "step", lambda c, s: c + s)).drop("step")
    other = boxes.select("cell", F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    gap = F.zip_with(F.zip_with("low2", "high", lambda a, b: a - b), F.zip_with("low", "high2", lambda a, b: a - b), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    met = around.join(other, "cell").where("block <= other").where(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps * (1 + 1e-9))
    met = ws.save(met.select("block", "other"), "met")

    def paired(items: DataFrame) -> DataFrame:
        left, right = items.select("block", F.col("items").alias("left")), items.select(F.col("block").alias("other"), F.col("items").alias("right"))
        return met.join(left, "block").join(right, "other").select((F.col("block") == F.col("other")).alias("own"), "left", "right")

    plain = blocks.select("block", F.transform("items", lambda x: F.struct(x["node"].alias("node"), x["n"].alias("n"), F.lit(False).alias("core"), x["v"].alias("v"))).alias("items"))
    near = ws.save(_weights(paired(plain), eps * eps).groupBy("node").agg(F.sum("n").alias("near")), "near")
    flagged = blocks.select("block", F.explode("items").alias("p")).select("block", "p.*").join(near, "node").withColumn("core", F.col("near") >= least)
    judged = ws.save(flagged.groupBy("block").agg(F.collect_list(F.struct("node", "n", "core", "v")).alias("items")), "judged")
    links = ws.save(_links(paired(judged), eps * eps), "links")
    parts = components(ws, links.where("far is null").select("a", "b")).toDF("node", "part")
    cores = ws.save(near.where(F.col("near") >= least).select("node").join(parts, "node", "left").select("node", F.coalesce("part", "node").alias("cluster"), F.lit(True).alias("core")), "cores")
    nearest = links.where("far is not null").groupBy(F.col("a").alias("point")).agg(F.min(F.struct("far", "b")).alias("m")).select("point", F.col("m.b").alias("node"))
    border = nearest.join(cores, "node").select(F.col("point").alias("node"), "cluster", F.lit(False).alias("core"))
    named = ws.save(cores.union(border), "named")
    of_rows = rows.join(points.select("v", "node"), "v").select("id", "node")
    return of_rows.join(named, "node", "left").select("id", "cluster", F.coalesce("core", F.lit(False)).alias("core"))
