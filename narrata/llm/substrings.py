"""Repeated word sequences across documents, by recompression.

Two rounds of recompression turn each document's words into phrases. A round
names runs of equal symbols and then pairs of neighbours of which the first is
in one half of all symbols and the second in the other. Names are fingerprints
of what they stand for, so they are the same in every task without a common
dictionary, and where a phrase ends depends on at most three words to either
side: equal word sequences get the same phrases but for three words at each
end. Every window of ``window`` words takes the smallest interior phrase as its
anchor; windows with the same anchor are posted once, under the fingerprint of
the phrase and the three words on both sides. (A window without an interior
phrase, say in a long run, is posted under its own fingerprint.) A global
aggregation finds the postings that documents share; they reveal all windows
that may repeat, and only those are compared, by two independent fingerprints of
the whole window (128 bits): another aggregation tells the first document of
each. Words of such windows in later documents are removed.

Documents with a text that occurs in an earlier one (equal SHA-256) repeat all
of it, so they need no postings to be compared.

Defined results: null or empty texts have no words; texts with fewer words
than a window, and repeats inside one document only, lose nothing; rows with a
null id neither remove nor lose words; rows with equal ids do not remove each
other's words, and each is judged by its own text; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.rows import nest, unnest
from narrata.llm.words import U, Words, chunks, mix, sequences
from narrata.workspace import Workspace

#: Words on either side of a phrase that decide where it ends.
CONTEXT = 3
#: Longest run that is told from longer ones.
LONG_RUN = 7
NONE = np.iinfo(np.uint64).max
OFFSET = U(255)

POSTINGS = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())])
WINDOWS = T.StructType([T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), T.StructField("id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("at", T.IntegerType())])


def _half(names: np.ndarray, salt: int) -> np.ndarray:
    """Which half of all symbols each is in."""
    return mix(names ^ U(salt)) >> U(63) == 0


def phrases(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each phrase after two rounds, and its name; ``text`` tells the words of different texts apart."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), hashes
    near = text[1:] == text[:-1]
    equal = near & (hashes[1:] == hashes[:-1])
    run = np.zeros(n, bool)
    run[1:] |= equal
    run[:-1] |= equal
    first = _half(hashes, 0x51)
    pair = near & ~run[1:] & ~run[:-1] & first[:-1] & ~first[1:]
    begin = np.flatnonzero(np.concatenate([[True], ~(equal | pair)]))
    end = np.append(begin[1:], n) - 1
    size = end - begin + 1
    paired = mix(hashes[begin] * U(3) + hashes[end] * U(0x9E3779B97F4A7C15))
    names = np.where(run[begin], mix(hashes[begin] + np.minimum(size, LONG_RUN).astype(U)), np.where(size == 2, paired, hashes[begin]))
    # The second round: runs stay as they are.
    alone = run[begin]
    first = _half(names, 0xA7)
    pair = (text[begin[1:]] == text[begin[:-1]]) & ~alone[1:] & ~alone[:-1] & first[:-1] & ~first[1:]
    head = np.flatnonzero(np.concatenate([[True], ~pair]))
    tail = np.append(head[1:], len(begin)) - 1
    names = np.where(tail > head, mix(names[head] * U(5) + names[tail] * U(0xD1342543DE82EF95)), names[head])
    return begin[head], end[tail], names


def postings(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, text, first window and number of windows of each posting; windows are counted from the text's first word."""
    hashes, n = words.hashes, len(words.hashes)
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)
    begin, end, names = phrases(hashes, text)
    weight, last = np.full(n, NONE, U), np.zeros(n, np.int64)
    weight[begin] = mix(names ^ U(0x5A)) & ~OFFSET
    last[begin] = end
    reach = last - np.arange(n)
    best = np.full(n, NONE, U)
    for offset in range(CONTEXT, min(window - CONTEXT, n)):
        inside = reach[offset:] <= window - CONTEXT - 1 - offset
        np.minimum(best[: n - offset], np.where(inside & (weight[offset:] != NONE), weight[offset:] | U(offset), NONE), out=best[: n - offset])
    starts = np.flatnonzero(np.arange(n) + window <= words.first[1:][text]) if n else np.zeros(0, np.int64)
    best = best[starts]
    found = best != NONE
    anchor = np.where(found, starts + (best & OFFSET).astype(np.int64), -1 - starts)
    fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1])])) if len(anchor) else np.zeros(0, np.int64)
    size = np.diff(np.append(fresh, len(anchor)))
    at = starts[fresh]
    low = np.where(found[fresh], anchor[fresh] - CONTEXT, at)
    length = np.where(found[fresh], last[np.maximum(anchor[fresh], 0)] - anchor[fresh] + 1 + 2 * CONTEXT, window) if n else size
    keys = sequences(hashes, length, low)
    return keys, text[at], at - words.first[:-1][text[at]], size


def _post(df: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                key, text, at, n = postings(Words(texts), window)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column("id").take(rows), part.column("text_key").take(rows), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=POSTINGS.fieldNames())

    return df.mapInArrow(run, POSTINGS)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the values of a column of lists."""
    sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _windows(df: DataFrame, window: int) -> DataFrame:
    """Two independent fingerprints of each window that the ranges ``found`` of (at, n) name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                words = Words(texts)
                row, ranges = _flat(part.column("found"))
                at, n = (ranges.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "n"))
                of = np.repeat(np.arange(len(at)), n)
                starts = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                text = row[of]
                places = words.first[:-1][text] + starts
                h, g = words.sequences(window, places).view(np.int64), sequences(words.seconds, window, places).view(np.int64)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), part.column("id").take(rows), part.column("text_key").take(rows), pa.array(starts.astype(np.int32))], names=WINDOWS.fieldNames())

    return df.mapInArrow(run, WINDOWS)


#: Which text of an id a row has: 60 bits of its digest.
TEXT_KEY = "cast(conv(substr(sha2(text, 256), 1, 15), 16, 10) as bigint)"


def repeated(ws: Workspace, docs: DataFrame, window: int) -> DataFrame:
    """(id, text_key, starts, whole): first words of the windows of each text that an earlier document has; whole, if its text is an earlier one's."""
    named = docs.where("id is not null and text is not null")
    digests = ws.save(named.select("id", "text_key", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    first = ws.save(digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    later = ws.save(digests.join(first, "digest").where("id > first").select("id", "text_key").distinct(), "later")
    posted = ws.save(_post(named, window), "postings")
    shared = ws.save(posted.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key"), "shared")
    ws.tidy()
    found = posted.join(shared, "key").drop("key").join(later, ["id", "text_key"], "left_anti")
    ranges = ws.save(found.groupBy("id", "text_key").agg(F.collect_set(F.struct("at", "n")).alias("found")), "ranges")
    ws.drop(posted)
    ws.tidy()
    windows = ws.save(_windows(named.join(ranges, ["id", "text_key"]), window), "windows")
    ws.tidy()
    owners = ws.save(windows.groupBy("h", "g").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high"), "owners")
    ws.tidy()
    hits = windows.join(owners, ["h", "g"]).where("id > low")
    starts = ws.save(hits.groupBy("id", "text_key").agg(F.collect_set("at").alias("starts")), "starts")
    ws.drop(windows)
    ws.tidy()
    return starts.join(later.withColumn("whole", F.lit(True)), ["id", "text_key"], "full")


def remove_repeats(df: DataFrame, id: str, text: str, window: int = 13, ws: Workspace | None = None) -> DataFrame:
    """Add n_words, n_removed and kept, the words that stay, joined by one space; columns of these names are replaced."""
    if not 2 * CONTEXT < window < 256:
        raise ValueError("window must be 7 to 255 words")
    ws = ws or Workspace(df.sparkSession, "substrings")
    docs = nest(df, F.col(id).cast("long").alias("id"), F.col(text).alias("text")).withColumn("text_key", F.expr(TEXT_KEY))
    marked = docs.join(repeated(ws, docs.drop("row"), window), ["id", "text_key"], "left").select("row", "starts", "whole")
    schema = T.StructType([docs.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The text is read out of the row here, so that it is not sent twice.
            for part, texts in chunks(batch.append_column("text", batch.column("row").field(text)), "text"):
                words = Words(texts)
                counts = np.diff(words.first)
                row, starts = _flat(part.column("starts"))
                begin = words.first[:-1][row] + starts.to_numpy(zero_copy_only=False).astype(np.int64)
                cover = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                whole = part.column("whole").fill_null(False).to_numpy(zero_copy_only=False) & (counts >= window)
                gone |= np.repeat(whole, counts)
                removed = np.add.reduceat(np.append(gone, False), words.first[:-1]) * (counts > 0) if len(texts) else counts
                stay = np.flatnonzero(~gone)
                cuts = np.searchsorted(stay, words.first).tolist()
                left = [words.items[i] for i in stay.tolist()]
                kept = [b" ".join(left[p:q]) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], names=schema.fieldNames())

    return unnest(marked.mapInArrow(run, schema), df.columns, "n_words", "n_removed", "kept")
