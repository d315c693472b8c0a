"""Exact top-k inner products by distributed histogram selection.

Vectors become integers, queries and candidates become blocks, and each task
scores one block of queries against one block of candidates with a matrix
product. Scores are never kept: each round scores everything anew and returns
counts of scores in bins of an interval that holds each query's kth score; the
interval shrinks to the bin that holds it until bins are single values. A task
returns only the bins down to its own kth score, since the global one is no
smaller. The last round returns the scores from the kth value up, at most k of
a block, and ties go to the smaller id.

Defined results: vectors that are null, or hold null or non-finite components,
take no part (nor those with a component that is not finite when scaled);
vectors meet those of the same length only; a query never meets candidates with
its own id; with fewer than k candidates all are returned; repeated rows are
candidates of their own; no queries or candidates, no rows. Components of any
size are ranked by their exact scores; a score that a long cannot hold is given
as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.ranks import partitions, ranked
from narrata.workspace import Workspace

#: Bins of a histogram, and rows of a block of queries and of candidates.
BINS = 4096
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 2048
#: Doubles up to this are all the integers.
EXACT = 2.0**53
#: Bits of a score that histograms are over, at most.
BITS = 61
LONG = 1 << 63

FOUND = T.StructType([*(T.StructField(n, T.LongType()) for n in ("query_id", "x", "y")), T.StructField("key", T.BinaryType())])


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as a double, which holds it exactly; null if the vector takes no part."""
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    # From 2**53 on a double is an integer.
    whole = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
    good = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(good, F.transform(scaled, whole))


def blocks(ws: Workspace, df: DataFrame, columns: list[str], rows: int, count: int) -> DataFrame:
    """Rows of ``df`` (id, dim, ...) as lists of at most ``rows``, by dimension and place in the order of ids."""
    placed = ranked(ws, df, ["dim", "id"], ["dim"], partitions(df, count, 20_000), "_rank")
    return placed.groupBy("dim", (F.col("_rank") / rows).cast("long").alias("block")).agg(F.collect_list(F.struct(*columns)).alias("items"))


def _matrix(items: pa.ListScalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    flat = items.values
    return flat.field("id").to_numpy(zero_copy_only=False), flat.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers: by floating point where every sum is exact in it, for larger rows by integers of any size."""
    small = np.sqrt(EXACT / max(q.shape[1], 1))
    big_q, big_c = (np.abs(x).max(1, initial=0) >= small for x in (q, c))
    out = (np.where(big_q[:, None], 0, q) @ np.where(big_c[:, None], 0, c).T).astype(np.int64)
    if not (big_q.any() or big_c.any()):
        return out
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    out = out.astype(object)
    out[big_q] = whole(q[big_q]) @ whole(c).T
    out[:, big_c] = whole(q) @ whole(c[big_c]).T
    return out


def top_k(df: DataFrame, id: str, vector: str, queries: Column, k: int, scale: int = 256, ws: Workspace | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each row for which ``queries`` holds."""
    ws = ws or Workspace(df.sparkSession, "topk")
    rows = df.select(F.col(id).cast("long").alias("id"), integers(F.col(vector), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    good = ws.save(rows.where("id is not null and v is not null").withColumn("dim", F.size("v")).where("dim > 0"), "vectors")
    count, asked, most, most_dim = good.agg(F.count("*"), F.count_if("asks"), F.max(F.array_max(F.transform("v", F.abs))), F.max("dim")).first()
    largest = int(most or 0) ** 2 * (most_dim or 1) + 1
    # Histograms are over scores without the low bits that no long has room for.
    shift = max(0, largest.bit_length() - BITS)
    bound, wide = (largest >> shift) + 1, (2 * largest).bit_length() // 8 + 1
    candidates = ws.save(blocks(ws, good, ["id", "v"], CANDIDATE_BLOCK, count or 0), "candidates")
    asks = ws.save(ranked(ws, good.where("asks").select("id", "v", "dim"), ["dim", "id"], ["dim"], partitions(df, asked or 0, 20_000), "_rank"), "asks")
    numbered = asks.withColumn("block", (F.col("_rank") / QUERY_BLOCK).cast("long")).drop("_rank")
    counts = {r["dim"]: r["n"] for r in numbered.groupBy("dim").agg((F.max("block") + 1).alias("n")).collect()}
    here = F.lit(0).cast("long")
    for dim, n in counts.items():
        here = F.when(F.col("dim") == dim, F.lit(n)).otherwise(here)
    # Each block of candidates once for each block of queries.
    met = candidates.withColumn("_blocks", here).where("_blocks > 0").withColumn("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks", "block")
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, min(2000, (count or 0) * max(1, (asked or 0) // QUERY_BLOCK) // 20_000))

    def scored(state: DataFrame, kind: str) -> DataFrame:
        """Histogram counts (query_id, bin, n), or the best scores (query_id, vec_id, score)."""
        sides = numbered.join(state, "id").groupBy("dim", F.col("block").alias("asked")).agg(F.collect_list(F.struct("id", "v", "base", "top", "width", "need")).alias("_q"))
        pairs = met.join(sides, ["dim", "asked"]).select("dim", "items", "_q").repartition(tasks)
        best = kind == "best"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, items, asking in zip(*batch.columns, strict=True):
                    ids, c = _matrix(items, dim.as_py())
                    query, q = _matrix(asking, dim.as_py())
                    base, top, width, need = (asking.values.field(f).to_numpy(zero_copy_only=False) for f in ("base", "top", "width", "need"))
                    out, keys = [[], [], []], []
                    whole = _scores(q, c)
                    scores = (whole >> shift).astype(np.int64)
                    for i in range(len(query)):
                        # Values under ``base`` lie below the kth; those from ``top`` on are counted already.
                        may = np.flatnonzero((scores[i] >= base[i]) & (scores[i] < top[i]) & (ids != query[i]))
                        if best:
                            # A whole score that a long may not hold goes along as bytes in its order.
                            order = np.lexsort((ids[may], -scores[i][may])) if not shift else sorted(range(len(may)), key=lambda j: (-whole[i][may[j]], ids[may[j]]))
                            chosen = may[order[: need[i]]].astype(np.int64)
                            a, b = ids[chosen], scores[i][chosen]
                            if shift:
                                exact = whole[i][chosen].tolist()
                                b = np.array([max(-LONG, min(LONG - 1, v)) for v in exact], np.int64)
                                keys += [(v + largest).to_bytes(wide, "big") for v in exact]
                        else:
                            a, b = np.unique((scores[i][may] - base[i]) // width[i], return_counts=True)
                            keep = np.searchsorted(np.cumsum(b[::-1]), need[i]) + 1
                            a, b = a[::-1][:keep], b[::-1][:keep]
                        for held, x in zip(out, (np.full(len(a), query[i]), a, b), strict=True):
                            held.append(x)
                    numbers = [pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in out]
                    yield pa.RecordBatch.from_arrays([*numbers, pa.array(keys, pa.binary()) if best and shift else pa.nulls(len(numbers[0]), pa.binary())], names=FOUND.fieldNames())

        return pairs.mapInArrow(run, FOUND)

    width = max(1, -(-(2 * bound + 1) // BINS))
    state = numbered.select("id").distinct().select("id", F.lit(-bound).cast("long").alias("base"), F.lit(bound + 1).cast("long").alias("top"), F.lit(width).cast("long").alias("width"), F.lit(k).cast("long").alias("need"))
    state = ws.save(state, "state")
    while asked:
        counted = scored(state, "bins").groupBy(F.col("query_id").alias("id"), F.col("x").alias("bin")).agg(F.sum("y").alias("n"))
        down = Window.partitionBy("id").orderBy(F.desc("bin"))
        sums = counted.withColumn("upto", F.sum("n").over(down))
        found = sums.join(state, "id").where("upto >= need").groupBy("id").agg(F.max_by(F.struct("bin", (F.col("need") - F.col("upto") + F.col("n")).alias("need")), "bin").alias("hit"))
        # Without a hit there are fewer than k candidates in all, and the base stays at the bottom.
        finer = max(1, -(-width // BINS))
        low = F.coalesce(F.col("base") + F.col("hit.bin") * F.col("width"), "base")
        state = ws.save(state.join(found, "id", "left").select("id", low.alias("base"), F.when(F.col("hit").isNull(), F.col("top")).otherwise(F.least("top", low + F.col("width"))).alias("top"), F.when(F.col("hit").isNull(), F.col("width")).otherwise(F.lit(finer).cast("long")).alias("width"), F.coalesce("hit.need", "need").alias("need")), "state")
        if width == 1:
            break
        width = finer
    final = scored(state.withColumns({"need": F.lit(k).cast("long"), "top": F.lit(bound + 1).cast("long")}), "best").withColumnRenamed("x", "vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), F.desc("y"), "vec_id")
    return final.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("y").alias("score"))
