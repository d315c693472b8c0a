"""Contiguous shards of atomic groups with the smallest possible largest shard.

Groups (rows that must stay together) lie in a fixed order. The smallest
capacity for which a greedy walk needs at most ``shards`` shards is found by
search over capacities; several capacities are walked at once, and each step
of the walk is one aggregation over the running sizes. Only DataFrame
operations are used.

Defined results: a null text has no bytes and counts as an empty one; equal
texts form a group, nulls in ``id`` come first in the order; repeated rows get
slots of their own; with fewer groups than shards the last shards stay empty;
columns that have the name of an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.ranks import partitions, ranked
from narrata.llm.rows import nest, unnest
from narrata.workspace import Workspace

#: Capacities that are tried in one pass.
TRIED = 24


def running(ws: Workspace, df: DataFrame, order: list[str], size: str, n: int, out: str) -> DataFrame:
    """Add the running sum of ``size`` in ``order``, this row included, by ranges and the sums of earlier ranges."""
    dealt = ws.save(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum(size).alias("_sum"))
    # One row for each range: their number is the setting n.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ws.save(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum"), "offsets")
    inside = F.sum(size).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_inside", inside).join(offsets, "_range").withColumn(out, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")


def reached(ends: DataFrame, limits: list[int], largest: int) -> list[int]:
    """For each limit the last group end up to it (0: none), in one pass over the ends that can matter."""
    near = ends.where(F.col("end").between(min(limits) - largest, max(limits)))
    row = near.agg(*(F.max(F.when(F.col("end") <= x, F.col("end"))).alias(f"r{i}") for i, x in enumerate(limits))).first()
    return [x or 0 for x in row]


def walk(ends: DataFrame, capacities: list[int], shards: int, largest: int) -> list[list[int]]:
    """The cuts of the greedy walk with each capacity: as far as it comes with ``shards`` shards."""
    cuts = [[0] for _ in capacities]
    for _ in range(shards):
        at = reached(ends, [c[-1] + x for c, x in zip(cuts, capacities, strict=True)], largest)
        for c, x in zip(cuts, at, strict=True):
            c.append(max(x, c[-1]))
    return [c[1:] for c in cuts]


def minimax(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and its cuts."""
    low = max(largest, -(-total // shards))
    high = max(low, -(-total // shards) + largest)  # always feasible
    while low < high:
        step = -(-(high - low) // (TRIED + 1))
        tried = list(range(low, high, max(step, 1)))
        fits = [cuts[-1] >= total for cuts in walk(ends, tried, shards, largest)]
        if any(fits):
            high = tried[fits.index(True)]
            low = tried[fits.index(True) - 1] + 1 if fits.index(True) else low
        else:
            low = tried[-1] + 1
    return low, walk(ends, [low], shards, largest)[0]


def shard(df: DataFrame, id: str, group: Column, size: Column, shards: int, ws: Workspace | None = None) -> DataFrame:
    """Add shard (from 0) and slot (from 0 in each shard) to ``df``; groups are ordered by their smallest ``id``."""
    ws = ws or Workspace(df.sparkSession, "shard")
    base = ws.save(nest(df, group.alias("_group"), size.cast("long").alias("_size"), F.col(id).alias("_id")), "rows")
    groups = ws.save(base.groupBy("_group").agg(F.sum("_size").alias("_size"), F.count("*").alias("_rows"), F.min("_id").alias("_first")), "groups")
    count, rows, total, largest = groups.agg(F.count("*"), F.sum("_rows"), F.sum("_size"), F.max("_size")).first()
    ends = ws.save(running(ws, groups, ["_first", "_group"], "_size", partitions(df, count), "end"), "ends")
    _, cuts = minimax(ends.select("end"), total or 0, largest or 0, shards)
    which = sum(((F.col("end") > c).cast("int") for c in cuts[:-1]), F.lit(0))
    placed = ws.save(ends.select("_group", "_first", which.alias("shard")), "placed")
    spread = base.join(placed, "_group")
    slots = ranked(ws, spread, ["shard", "_first", "_group", "_id"], ["shard"], partitions(df, rows or 0), "slot")
    return unnest(slots, df.columns, "shard", "slot")
