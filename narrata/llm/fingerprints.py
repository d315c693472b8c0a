"""MinHash fingerprints of documents.

A fingerprint holds, for each of ``PERMUTATIONS`` universal hash functions,
the smallest image of the document's word shingles, computed in numpy for many
documents at once. The likeness of two fingerprints, the share of equal
places, estimates the Jaccard likeness of the shingle sets. Near-duplicates
are found by bands: documents meet if some band of their fingerprints is
equal, and the Jaccard likeness of those that meet is verified on full sets.

Letters A to Z count as a to z. Defined results: null text counts as empty;
texts without words have the fingerprint of the empty set, which is like
itself alone; a text with fewer words than a shingle is one shingle; equal
texts have equal fingerprints, whatever the other columns.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm import near
from narrata.llm.rows import without
from narrata.llm.words import CHUNK_BYTES, Permutations, Words, chunks, shingles
from narrata.workspace import Workspace

PERMUTATIONS = 128
#: Bands of 4 places: of pairs with a likeness of 0.8, all but one in ten million share one.
BAND = 4
WORDS = 5
#: Ranges of ids that are dealt to tasks, for each shuffle partition.
RANGES_EACH = 4


def signatures(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    values, begins = shingles(Words(texts, lower=True), words)
    return Permutations(PERMUTATIONS).minima(values, begins)


def shown(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u4").tobytes()).decode()


def fingerprint(df: DataFrame, text: str, out: str = "signature", words: int = WORDS) -> DataFrame:
    """Add the fingerprint of column ``text`` as array<long>."""
    df = without(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, text):
                flat = pa.array(signatures(texts, words).astype(np.int64).ravel())
                ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * PERMUTATIONS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, flat)], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.LongType(), False), False)]))


def bands(ws: Workspace, classes: DataFrame) -> DataFrame:
    """(key, node): the bands of each class (node, signature)."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS // BAND - 1)), lambda k: F.xxhash64(k, F.slice("signature", k * BAND + 1, F.lit(BAND))))
    return ws.save(classes.select(F.explode(parts).alias("key"), "node").distinct(), "bands")


def near_duplicates(df: DataFrame, id: str, text: str, words: int = WORDS, num: int = 80, den: int = 100, ws: Workspace | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept): documents joined by equal bands of their fingerprints, with the Jaccard likeness verified.

    Documents with equal word sequences are one class, so copies are not paired
    with each other.
    """
    return near.near_duplicates(df, id, text, words, num, den, ws or Workspace(df.sparkSession, "bands"), bands, PERMUTATIONS)


def followed(df: DataFrame, id: str, text: str, ws: Workspace) -> DataFrame:
    """(id, text, range, ghost): the rows dealt by ranges of ids and sorted in them, each range followed by a copy of the next range's first row.

    After the last range comes the first row of all. A row finds the next one
    right behind it, and texts are shuffled once. Null ids come first.
    """
    n = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(id).cast("double"), F.lit(float("-inf"))).alias("_at"))
    parts = RANGES_EACH * n
    steps = rows.where(F.col(id).isNotNull()).approxQuantile("_at", [i / parts for i in range(1, parts)], 0.25 / parts)
    splits = [float("-inf"), *sorted(set(steps)), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_at", outputCol="_range").transform(rows) if len(splits) > 2 else rows.withColumn("_range", F.lit(0.0))
    ranged = ranged.select("id", "text", F.col("_range").cast("int").alias("_range"))
    # One row for each range: their number is a setting.
    lowest = ranged.groupBy("_range").agg(F.min(F.struct("id")).alias("_low"))
    order = Window.orderBy("_range")
    everyone = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = lowest.select(F.col("_range"), F.col("_low.id").alias("id"), F.coalesce(F.lag("_range").over(order), F.last("_range").over(everyone)).alias("_before"))
    heads = ws.save(heads, "heads")
    joined = ranged.join(F.broadcast(heads), (ranged["_range"] == heads["_range"]) & ranged["id"].eqNullSafe(heads["id"])).select(ranged["id"], "text", "_before")
    ghosts = joined.groupBy("_before").agg(F.min_by("text", F.struct("id", "text")).alias("text"), F.min("id").alias("id"))
    both = ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts.select("id", "text", F.col("_before").alias("_range"), F.lit(True).alias("ghost")))
    return both.repartitionByRange(n, "_range").sortWithinPartitions("_range", "ghost", "id", "text")


def edited(text: str, follower: str) -> str:
    """The last quarter of a text's code points replaced by the first ones of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + follower[:n]


def compared(df: DataFrame, id: str, text: str, words: int = WORDS, ws: Workspace | None = None) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and the likeness to both that and the next row's."""
    ws = ws or Workspace(df.sparkSession, "fingerprints")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[tuple]) -> pa.RecordBatch:
            """All but the last of the rows, which are followed by their next ones; a ghost's own row is nobody's."""
            own = signatures([t.encode() for _, t, _, _ in held], words)
            pairs = [i for i in range(len(held) - 1) if not held[i][3]]
            changed = [edited(held[i][1], held[i + 1][1]).encode() for i in pairs]
            other = signatures(changed, words)
            rows = [(held[i][0], len(held[i][1]), hashlib.sha256(c).hexdigest(), shown(own[i]), shown(o), float((own[i] == o).mean()), float((own[i] == own[i + 1]).mean())) for i, c, o in zip(pairs, changed, other, strict=True)]
            return pa.RecordBatch.from_pydict({k: [r[j] for r in rows] for j, k in enumerate(names)}, schema=pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True))))

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "_range", "ghost")), strict=True):
                held.append(row)
                size += len(row[1])
                if size >= CHUNK_BYTES and len(held) > 1:
                    yield close(held)
                    held, size = held[-1:], len(row[1])
        if len(held) > 1:
            yield close(held)

    return followed(df, id, text, ws).mapInArrow(run, schema)
