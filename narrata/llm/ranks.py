"""Positions in a global order without a global task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.workspace import Workspace


def partitions(df: DataFrame, rows: int, rows_each: int = 100_000) -> int:
    """So many range partitions that each holds about ``rows_each`` rows, and every core has one."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_each))


def ranked(ws: Workspace, df: DataFrame, order: list[str], within: list[str], n: int, out: str = "rank") -> DataFrame:
    """Add ``out``: the row's position (from 0) by ``order`` among the rows that agree in ``within``.

    ``within`` must be a prefix of ``order``. Rows are dealt by ranges of the
    whole order, so a group of any size is spread over many tasks; each range
    counts its own rows, and the counts of earlier ranges are added.
    """
    if order[: len(within)] != within:
        raise ValueError("within must be a prefix of order")
    dealt = ws.save(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_w{i}") for i, c in enumerate(within)]
    names = [f"_w{i}" for i in range(len(within))]
    # At most one row for each range and one more for each group that starts in it.
    counts = dealt.groupBy("_range", *key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ws.save(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "offsets")
    inside = Window.partitionBy("_range", *names).orderBy(*order)
    keyed = dealt.select("*", *key).withColumn("_inside", F.row_number().over(inside) - 1)
    return keyed.join(offsets, ["_range", *names]).withColumn(out, (F.col("_inside") + F.col("_before")).cast("long")).drop("_range", "_inside", "_before", *names)
