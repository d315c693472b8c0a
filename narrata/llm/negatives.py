"""Hard negatives by a Voronoi-partitioned nearest-neighbour join.

Vectors become integers and get one more component that makes all candidates
equally long, so that the largest inner product is the smallest distance: a
candidate x is (x, sqrt(M - |x|^2)) with M the largest squared length, an
anchor q is (q, 0), and |q - x|^2 = |q|^2 + M - 2 qx. Candidates belong to the
nearest of a few pivots, and are dealt to blocks in the order of their distance
from it, so that a block is a ring of a cell. Anchors are groups, near anchors
together. By the triangle inequality each anchor bounds how far from a pivot
those can be that may serve it: a ring goes only to groups whose bounds it
meets, and is compared there exactly, with integers.

It is done twice: for positives, within a distance that the nearest same-label
members of each cell guarantee, and for negatives, between the distances that
belong to the scores that the anchor's positives allow.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part; vectors meet those of the same length only; rows with
the anchor's own id never serve it; repeated rows are candidates of their own,
while of anchors with equal ids the first by label and vector is taken; ties go
to the smaller id; an anchor without positives, or a positive without
negatives, has no rows; an empty table gives none. Scores are exact for
components of any size; one that a long cannot hold is given as the nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.ranks import partitions, ranked
from narrata.llm.topk import LONG, _matrix, _scores, integers
from narrata.workspace import Workspace

#: Pivots of each vector length, lengths that have pivots (those of other lengths meet unpruned), rows of a ring, anchors of a group.
PIVOTS, MOST_DIMS, RING, GROUP = 32, 64, 1024, 512
#: Relative slack of distances, which are floating-point.
SLACK = 1e-6


class Window_(NamedTuple):
    """Scores between low/100 and high/100 of the positive's."""

    low: int
    high: int


def _far(rows: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows, with their further component, from pivots that have theirs."""
    with np.errstate(all="ignore"):
        square = ((rows[:, None, :] - pivots[None, :, :-1]) ** 2).sum(2) + (extra[:, None] - pivots[None, :, -1]) ** 2
        return np.sqrt(square)


class Geometry:
    """Pivots by vector length; distances from them."""

    def __init__(self, pivots: dict[int, list[list[float]]], most: float):
        self.most = most
        self.pivots = {dim: np.array([[*p, self.extra(np.array([p]))[0]] for p in each], float) for dim, each in pivots.items()}

    def extra(self, rows: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.sqrt(np.maximum(self.most - (rows**2).sum(1), 0))

    def candidates(self, rows: np.ndarray) -> np.ndarray:
        """Distances of candidates from the pivots of their length."""
        return self._apart(rows, self.extra(rows))

    def anchors(self, rows: np.ndarray) -> np.ndarray:
        return self._apart(rows, np.zeros(len(rows)))

    def _apart(self, rows: np.ndarray, extra: np.ndarray) -> np.ndarray:
        pivots = self.pivots.get(rows.shape[1])
        if pivots is None:
            return np.full((len(rows), 1), np.nan)
        return np.concatenate([_far(rows[i : i + 256], extra[i : i + 256], pivots) for i in range(0, len(rows), 256)] or [np.zeros((0, len(pivots)))])

    def from_score(self, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance of an anchor from a candidate with the score."""
        with np.errstate(all="ignore"):
            return np.sqrt(np.maximum((rows**2).sum(1) + self.most - 2 * scores, 0))


def _per_vector(df: DataFrame, space: Geometry) -> DataFrame:
    """Add ``cell``, the nearest pivot (0 if there is none), and ``far``, the distance from it as a candidate (null: not known)."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, far = np.zeros(len(dims), np.int32), np.full(len(dims), np.nan)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                d = space.candidates(batch.column("v").take(pa.array(at)).flatten().to_numpy().reshape(-1, dim))
                clean = np.where(np.isfinite(d), d, np.inf)
                cell[at] = clean.argmin(1)
                far[at] = d[np.arange(len(at)), cell[at]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(cell), pa.array(far, from_pandas=True)], names=[*columns, "cell", "far"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, cell int, far double")


def _needs(groups: DataFrame, space: Geometry, bounds: Callable[[Geometry, np.ndarray, list[dict]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(dim, grp, cell, low, high): distances from each pivot between which candidates may serve a group; null: no bound.

    ``bounds`` gives the least and most distance of candidates from each anchor, by its vector and row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for dim, grp, anchors in zip(batch.column("dim").to_pylist(), batch.column("grp").to_pylist(), batch.column("anchors"), strict=True):
                _, rows = _matrix(anchors, dim)
                near, far = bounds(space, rows, anchors.as_py())
                d = space.anchors(rows)
                slack = SLACK * (1 + np.abs(d) + np.where(np.isfinite(far), far, 0)[:, None])
                with np.errstate(all="ignore"):
                    low = np.maximum(d - far[:, None], near[:, None] - d) - slack
                    high = d + far[:, None] + slack
                served = far >= near
                if not served.any():
                    continue
                low, high = low[served].min(0), high[served].max(0)
                out += [(dim, grp, c, a if np.isfinite(a) else None, b if np.isfinite(b) else None) for c, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True))]
            types = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["dim", "grp", "cell", "low", "high"])

    return groups.mapInArrow(run, "dim int, grp bigint, cell int, low double, high double")


def _met(rings: DataFrame, needs: DataFrame, groups: DataFrame) -> DataFrame:
    """(dim, items, anchors): each ring with each group that it may serve."""
    reaches = (F.col("low").isNull() | F.col("most").isNull() | (F.col("most") >= F.col("low"))) & (F.col("high").isNull() | F.col("least").isNull() | (F.col("least") <= F.col("high")))
    return rings.join(needs, ["dim", "cell"]).where(reaches).select("dim", "grp", "items").join(groups, ["dim", "grp"]).select("dim", "items", "anchors")


def _key(score: int, largest: int, wide: int) -> bytes:
    """A score as bytes in its order."""
    return (int(score) + largest).to_bytes(wide, "big")


FOUND = "anchor bigint, place int, id bigint, score bigint, key binary, positive bigint, positive_score bigint"


def _local(pairs: DataFrame, k: int, largest: int, window: Window_ | None) -> DataFrame:
    """The best k of each ring for each anchor, of its label, or, with a ``window``, of other labels for each of its positives."""
    wide = (2 * largest).bit_length() // 8 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        for batch in batches:
            for dim, items, anchors in zip(*(batch.column(c) for c in ("dim", "items", "anchors")), strict=True):
                ids, c = _matrix(items, dim.as_py())
                labels = items.values.field("label").to_numpy(zero_copy_only=False)
                asking, q = _matrix(anchors, dim.as_py())
                own = anchors.values.field("label").to_numpy(zero_copy_only=False)
                scores, out = _scores(q, c), []

                def best(i: int, may: np.ndarray, place: int, positive: int, base: int) -> None:
                    order = may[np.lexsort((ids[may], -scores[i][may]))] if scores.dtype != object else np.array(sorted(may, key=lambda j: (-scores[i][j], ids[j])), int)  # noqa: B023
                    for j in order[:k]:
                        s = int(scores[i][j])  # noqa: B023
                        out.append((int(asking[i]), place, int(ids[j]), max(-LONG, min(LONG - 1, s)), _key(s, largest, wide), positive, max(-LONG, min(LONG - 1, base))))  # noqa: B023

                goals = anchors.values.field("goals") if window else None
                for i in range(len(asking)):
                    if not window:
                        best(i, np.flatnonzero((labels == own[i]) & (ids != asking[i])), 0, 0, 0)
                        continue
                    other = (labels != own[i]) & (ids != asking[i])
                    for goal in goals[i].as_py() or ():
                        base = int.from_bytes(goal["key"], "big") - largest
                        # Whole scores s with low * base <= 100 * s <= high * base.
                        least, most = -(-window.low * base // 100), window.high * base // 100
                        if least <= most:
                            best(i, np.flatnonzero(other & (scores[i] >= least) & (scores[i] <= most)), goal["place"], goal["id"], base)
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in enumerate(types)], names=["anchor", "place", "id", "score", "key", "positive", "positive_score"])

    return pairs.mapInArrow(run, FOUND)


def _grouped(anchors: DataFrame, *more: str) -> DataFrame:
    return anchors.groupBy("dim", "grp").agg(F.collect_list(F.struct("id", "v", "label", *more)).alias("anchors"))


def mine(df: DataFrame, id: str, vector: str, label: Column, anchors: Column, positives: int, negatives: int, low: int = 50, high: int = 95, scale: int = 256, ws: Workspace | None = None, ring: int = RING, group: int = GROUP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank).

    Each row for which ``anchors`` holds has its best ``positives`` other rows of the same label, and each of those
    the best ``negatives`` rows of another label with low/100 to high/100 of the positive's score.
    """
    spark = df.sparkSession
    ws = ws or Workspace(spark, "negatives")
    whole = df.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), integers(F.col(vector), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    good = ws.save(whole.where("id is not null and label is not null and v is not null").withColumn("dim", F.size("v")).where("dim > 0").withColumn("draw", F.xxhash64("id", "label")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    most, largest, count, asked = good.agg(F.max(square), F.max(F.array_max(F.transform("v", F.abs)) * F.sqrt("dim")), F.count("*"), F.count_if("asks")).first()
    bound = (int(largest or 0) + 1) ** 2 + 1
    # A bounded sample: the first of each length in the order of a hash.
    first = Window.partitionBy("dim").orderBy("draw", "id")
    drawn = good.select("dim", "draw", "id", "v").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= PIVOTS)
    sample = drawn.orderBy("dim", "_n").limit(PIVOTS * MOST_DIMS).select("dim", "v").collect()
    by_dim: dict[int, list[list[float]]] = {}
    for row in sample:
        by_dim.setdefault(row.dim, []).append(row.v)
    space = Geometry(by_dim, float(most or 0))
    placed = ws.save(_per_vector(good.select("id", "label", "v", "asks", "dim"), space), "placed")
    in_cell = ranked(ws, placed.select("dim", "cell", "far", "id", "label", "v"), ["dim", "cell", "far", "id"], ["dim", "cell"], partitions(df, count or 0, 20_000), "_rank")
    rings = ws.save(in_cell.groupBy("dim", "cell", (F.col("_rank") / ring).cast("long").alias("ring")).agg(F.min("far").alias("least"), F.max("far").alias("most"), F.count_if(F.col("far").isNull()).alias("_odd"), F.collect_list(F.struct("id", "v", "label")).alias("items"))
                    .withColumns({c: F.when(F.col("_odd") == 0, F.col(c)) for c in ("least", "most")}).drop("_odd", "ring"), "rings")
    one = Window.partitionBy("id").orderBy("label", "v")
    asks = placed.where("asks").withColumn("_n", F.row_number().over(one)).where("_n = 1").select("dim", "cell", "far", "id", "label", "v")
    near = ranked(ws, asks, ["dim", "cell", "far", "id"], ["dim"], partitions(df, asked or 0, 20_000), "_rank")
    asks = ws.save(near.withColumn("grp", (F.col("_rank") / group).cast("long")).select("dim", "grp", "id", "label", "v"), "anchors")

    # Each cell's nearest members of a label promise so many positives within some distance; one may be the anchor itself.
    nearest = Window.partitionBy("dim", "label", "cell").orderBy("far")
    few = placed.where("far is not null").select("dim", "label", "cell", "far").withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= positives + 1)
    members = ws.save(few.groupBy("dim", "label").agg(F.collect_list(F.struct("cell", "far")).alias("promise")), "members")
    withs = ws.save(_grouped(_promised(asks.join(members, ["dim", "label"], "left"), space, positives), "within"), "groups")
    found = _local(_met(rings, _needs(withs, space, _by_promise), withs), positives, bound, None)
    order = Window.partitionBy("anchor").orderBy(F.desc("key"), "id")
    goals = ws.save(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).groupBy("anchor").agg(F.collect_list(F.struct("place", "id", "key", "score")).alias("goals")), "positives")

    aims = ws.save(_grouped(asks.join(goals.withColumnRenamed("anchor", "id"), "id"), "goals"), "groups")
    window = Window_(low, high)
    hard = _local(_met(rings, _needs(aims, space, _by_window(window)), aims), negatives, bound, window)
    last = Window.partitionBy("anchor", "place").orderBy(F.desc("key"), "id")
    kept = hard.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
    return kept.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("place").alias("positive_rank"))


def _promised(asks: DataFrame, space: Geometry, k: int) -> DataFrame:
    """(dim, grp, id, label, v, within): the distance within which k rows of its label are known to be (null: not so many are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            within: list[float | None] = []
            for dim, v, promise in zip(batch.column("dim").to_pylist(), batch.column("v").to_pylist(), batch.column("promise").to_pylist(), strict=True):
                d = space.anchors(np.array([v], float).reshape(1, dim))[0]
                reach = np.sort([d[p["cell"]] + p["far"] for p in promise or ()])
                within.append(float(reach[k]) if len(reach) > k and np.isfinite(reach[k]) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("dim", "grp", "id", "label", "v")), pa.array(within, pa.float64())], names=["dim", "grp", "id", "label", "v", "within"])

    return asks.select("dim", "grp", "id", "label", "v", "promise").mapInArrow(run, "dim int, grp bigint, id bigint, label bigint, v array<double>, within double")


def _by_promise(space: Geometry, rows: np.ndarray, anchors: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(len(rows)), np.array([np.inf if a["within"] is None else a["within"] for a in anchors])


def _by_window(window: Window_) -> Callable[[Geometry, np.ndarray, list[dict]], tuple[np.ndarray, np.ndarray]]:
    def bounds(space: Geometry, rows: np.ndarray, anchors: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        # A negative score has no window: low percent of it are more than high percent.
        some = [[g["score"] for g in a["goals"] if g["score"] >= 0] for a in anchors]
        least = np.array([min(s) * window.low / 100 if s else np.nan for s in some], float)
        most = np.array([max(s) * window.high / 100 if s else np.nan for s in some], float)
        near, far = space.from_score(rows, most), space.from_score(rows, least)
        capped = np.array([any(abs(x) >= LONG - 1 for x in s) for s in some])
        return np.where(capped, 0, np.where(np.isfinite(near) | np.isnan(most), near, 0)), np.where(capped, np.inf, np.where(np.isfinite(far) | np.isnan(least), far, np.inf))

    return bounds
