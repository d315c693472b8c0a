"""How well a sequence of vectors follows an ordered list of steps.

Each window is likened to each step once; a document's likenesses are then one
array. Nearest steps give scores of order, completeness and place; beside them,
the best assignment of steps that never goes back is found by dynamic
programming over the windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import series as S

#: Steps at most: their vectors go to every task.
MOST_STEPS = 256


def likeness(df: DataFrame, id: str, place: str, vector: str, steps: list[list[float]]) -> DataFrame:
    """(id, windows): a document's inner products with each step, window by window. Rows with a null vector, or one of another length, are left out."""
    if len(steps) > MOST_STEPS:
        raise ValueError(f"more than {MOST_STEPS} steps")
    table = np.array(steps, float)
    rows = df.where(F.size(vector) == table.shape[1]).select(F.col(id).alias("id"), F.col(place).cast("long").alias("place"), F.transform(vector, lambda x: x.cast("double")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, table.shape[1]) @ table.T
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(table))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("place"), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=["id", "place", "s"])

    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, place bigint, s array<double>")
    return scored.groupBy(F.col("id").alias(id)).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]).alias("windows"))


def nearest(windows: Column) -> Column:
    """The step that each window is most like, from 0; of equally like ones the first."""
    return F.transform(windows, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))


@S.bound
def order_score(steps: Column, count: int) -> Column:
    """Share of the moves that stay or go on by one step, the first coming after the last; 0 for fewer than two windows."""
    last = F.size(steps) - 1
    good = lambda i: S.let(F.get(steps, i + 1) - F.get(steps, i), lambda d: F.pmod(d, F.lit(count)).isin(0, 1).cast("double"))
    return F.when(last > 0, S.total(F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), good)) / last).otherwise(0.0)


def completeness(steps: Column, count: int) -> Column:
    return F.size(F.array_distinct(steps)) / F.lit(count)


@S.bound
def position_score(steps: Column, ordered: tuple[int, ...]) -> Column:
    """Share of the windows whose step belongs where they are: the ``ordered`` steps to the outer parts, the others between.

    The outer parts are before 0.3 and behind 1.7 times the middle of the windows.
    """
    middle = F.floor(F.size(steps) / 2)
    outer = lambda i: (i < middle * 0.3) | (i > middle * 1.7)
    return F.when(F.size(steps) > 0, S.total(F.transform(steps, lambda s, i: (s.isin(*ordered) == outer(i)).cast("double"))) / F.size(steps)).otherwise(0.0)


@S.bound
def ordered_score(windows: Column) -> Column:
    """Largest sum of likenesses of an assignment that never goes back to an earlier step."""

    def add(best: Column, s: Column) -> Column:
        # What each step could have come from at best.
        upto = F.transform(best, lambda _, i: F.array_max(F.slice(best, 1, i + 1)))
        return F.zip_with(upto, s, lambda a, b: a + b)

    return F.array_max(F.aggregate(windows, F.transform(F.get(windows, F.lit(0)), lambda _: F.lit(0.0)), add))


def assigned(df: DataFrame, windows: str) -> DataFrame:
    """Add ``assigned``: the steps of the best assignment that never goes back; of equally good ones that with the earlier steps at the end."""
    columns = df.columns

    def one(likenesses: list[list[float]]) -> list[int]:
        s = np.array(likenesses, float)
        best, came = s[0], []
        for row in s[1:]:
            upto = np.maximum.accumulate(best)
            # The first step that has the most so far.
            came.append(np.maximum.accumulate(np.where(best == upto, np.arange(len(best)), 0) * np.concatenate([[True], upto[1:] > upto[:-1]])))
            best = upto + row
        at = int(best.argmax())
        out = [at]
        for back in reversed(came):
            out.append(at := int(back[at]))
        return out[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x) if x else [] for x in batch.column(windows).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*columns, "assigned"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, assigned array<int>")


def scores(df: DataFrame, windows: str, count: int, ordered: tuple[int, ...]) -> DataFrame:
    """Add ``steps``, ``order_score``, ``completeness``, ``position_score``, ``total`` (their mean), and ``ordered_score`` for each window."""
    told = df.withColumn("steps", nearest(F.col(windows)))
    parts = told.withColumns({"order_score": order_score(F.col("steps"), count), "completeness": completeness(F.col("steps"), count), "position_score": position_score(F.col("steps"), ordered), "ordered_score": ordered_score(F.col(windows)) / F.size(windows)})
    return parts.withColumn("total", (F.col("order_score") + F.col("completeness") + F.col("position_score")) / 3)
