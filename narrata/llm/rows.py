"""Rows that pass through an operator, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without(df: DataFrame, *outputs: str) -> DataFrame:
    """``df`` without columns that have the name of an output: an operator replaces them."""
    taken = {o.lower() for o in outputs}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def nest(df: DataFrame, *inputs: Column) -> DataFrame:
    """Whole rows as column ``row``, out of the way of the names that an operator uses itself."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *inputs)


def unnest(df: DataFrame, columns: list[str], *outputs: str) -> DataFrame:
    """The rows' own columns, but for replaced ones, and the outputs."""
    taken = {o.lower() for o in outputs}
    return df.select(*(F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken), *outputs)
