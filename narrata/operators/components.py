"""Connected components by joins and grouped minima.

Every node with a smaller neighbour points to the smallest one; pointers are
followed to their ends by joins with themselves; edges between the ends are
the next round's. A round leaves at most half of the nodes, pointers are
followed in steps that double, and each table is written to the shared folder,
so a lost executor costs a stage and not the run. Degrees may have any size:
minima are taken before the shuffle and joins read stored tables, whose large
partitions Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.workspace import Workspace


def _none(df: DataFrame) -> bool:
    return not df.take(1)


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): component is the smallest node that it reaches.

    Null ends and loops link nothing; repeated edges count once; no edges, no rows.
    """
    a, b = F.col("a"), F.col("b")
    left = ws.save(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    labels = ws.save(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("component")), "labels")
    while not _none(left):
        points = ws.save(left.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")), "points")
        while True:
            far = points.select(F.col("from").alias("to"), F.col("to").alias("_far"))
            jumped = ws.save(points.join(far, "to", "left").select("from", F.coalesce("_far", "to").alias("to"), F.col("_far").isNotNull().alias("moved")), "jumped")
            points = jumped.select("from", "to")
            if _none(jumped.where("moved")):
                break
        ends_a, ends_b = points.toDF("a", "end_a"), points.toDF("b", "end_b")
        moved = left.join(ends_b, "b").join(ends_a, "a", "left").select(F.coalesce("end_a", "a").alias("x"), F.col("end_b").alias("y"))
        left = ws.save(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        labels = ws.save(labels.join(points.toDF("component", "_end"), "component", "left").select("node", F.coalesce("_end", "component").alias("component")), "labels")
    return labels
