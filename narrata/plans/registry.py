"""Named queries, and the same in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from narrata.workspace import Workspace, modified

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: A table with fewer bytes for each core has fewer row groups than cores.
LEAST_BYTES = 4 << 20
_dealt: dict[tuple, DataFrame] = {}


def forget() -> None:
    """Deal small tables again at their next use."""
    _dealt.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. A task reads whole row groups, so a small table is written anew, once, with a file for each core.

    (A shuffle in the plan would not do: filters are pushed below it, and with
    them what they compute.) Larger tables are read where they are.
    """
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= cores * LEAST_BYTES:
        return df
    key = (spark.sparkContext.applicationId, path, modified(spark, path))
    if key not in _dealt:
        _dealt[key] = Workspace(spark, name).save(df.repartition(cores), "dealt")
    return _dealt[key]
