"""Streams of texts and events (an extension: batch results, kept up to date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.operators.functors import lexical_entropy
from narrata.operators.windows import windowed

EVENTS = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING"
DOCUMENTS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def arrivals(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """New Parquet files of a folder, so many a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def scored_arrivals(docs: DataFrame, size: int = 50, overlap: int = 25) -> DataFrame:
    """Each arriving text with its entropy series: no state, so any batch plan works on the stream."""
    return windowed(docs, size, overlap).withColumn("series", F.transform("windows", lexical_entropy)).drop("windows", "text")


def event_windows(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums by time window and kind; events later than ``late`` are dropped in a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    sums = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """A user's events without a pause of ``gap``."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


TENSION = T.StructType([T.StructField("key", T.LongType()), T.StructField("at", T.LongType()), T.StructField("tension", T.DoubleType())])


def smooth(values: DataFrame, keep: float = 0.3) -> DataFrame:
    """(key, at, tension): values (key, at, value) of a stream, smoothed with the key's last one; the state is one number."""

    def step(key, frames, state):
        last = state.get[0] if state.exists else None
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values("at")
        out = []
        for v in rows["value"]:
            last = min(1.0, max(0.0, v if last is None else (1 - keep) * v + keep * last))
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({"key": key[0], "at": rows["at"].to_numpy(), "tension": out})

    return values.groupBy("key").applyInPandasWithState(step, TENSION, "last DOUBLE", "append", "NoTimeout")
