"""Language identification by prediction by partial matching.

For each language, counts of bytes after contexts of up to ``ORDER`` bytes
form a context tree. A byte that was seen n times after a context that was
followed by t bytes, d of them distinct, has the probability n / (t + d); an
unseen one costs the escape d / (t + d) and is coded after the context that is
a byte shorter; at the end all 256 are alike. The trees are frozen: the code
length of a text under each of them is exact, and the shortest one wins. All
languages share one tree of nodes that carries a vector of code lengths, so a
text is walked once.

The trees are learnt from a sample: the labelled texts of each language in the
order of a hash of id and text, until there are ``SAMPLE_BYTES`` bytes; one at
least, and the last one is cut at the bound. Where the tree would have more than
``MOST_NODES`` nodes, or ``MOST_CELLS`` with one for each language, the rarest
contexts are left out. All else covers every row.

Defined results: a null text, or one without a letter, is ``und`` with score
0, and so is every text if nothing could be learnt; ties go to the first
language in order; null labels teach nothing; repeated rows are predicted one
by one; whole texts are coded, in steps of bounded memory; columns that have
the name of an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.rows import without
from narrata.llm.words import CHUNK_BYTES, chunks
from narrata.workspace import Workspace

ORDER = 3
SAMPLE_BYTES = 400_000
#: Nodes of the common tree: bounds what is sent to the workers.
MOST_NODES = 2_000_000
#: Nodes times languages.
MOST_CELLS = 8_000_000
LETTER = regex.compile(r"\p{L}")

COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Each run of ``size`` bytes as a number."""
    out = np.zeros(max(len(data) - size + 1, 0), np.int64)
    for k in range(size):
        out = out << 8 | data[k : k + len(out)]
    return out


def counted(labelled: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, size, gram, n): how often each run of 1 to ORDER + 1 bytes occurs in a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                of: dict[str, list[bytes]] = {}
                for name, body in zip(part.column("lang").to_pylist(), texts, strict=True):
                    of.setdefault(name, []).append(body)
                for name, bodies in of.items():
                    for size in range(1, ORDER + 2):
                        gram, n = np.unique(np.concatenate([_grams(np.frombuffer(b, np.uint8), size) for b in bodies]), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(np.full(len(gram), size, np.int32)), pa.array(gram), pa.array(n.astype(np.int64))], names=COUNTS.fieldNames())

    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(run, COUNTS)
    return rows.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def first_bytes(text: Column, n: Column) -> Column:
    """The longest head of a text with at most ``n`` bytes and whole characters."""
    raw = text.cast("binary")
    whole = (F.when(~F.hex(F.substring(raw, n - k + 1, F.lit(1))).between("80", "BF"), n - k) for k in range(4))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.substring(raw, F.lit(1), F.coalesce(*whole, n)).cast("string"))


def sample(df: DataFrame, id: str, text: str, lang: str, bytes_each: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, text): texts of each language in the order of a hash until ``bytes_each`` bytes; one at least, the last one cut there."""
    most = F.lit(bytes_each)
    draw = F.shiftrightunsigned(F.xxhash64(id, text), 11) / F.lit(float(1 << 53))
    rows = df.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(F.col(lang).alias("lang"), F.col(id).alias("id"), F.col(text).alias("text"), draw.alias("draw"))
    # Level k has the draws from 2^-(k+1) to 2^-k: each one about doubles those above it, so the levels that are needed hold little more than the bound.
    rows = rows.withColumn("level", F.when(F.col("draw") > 0, F.floor(-F.log2("draw"))).otherwise(53).cast("int"))
    # At most 54 rows for each language.
    levels = rows.groupBy("lang", "level").agg(F.sum(F.octet_length("text")).alias("bytes"))
    upper = F.sum("bytes").over(Window.partitionBy("lang").orderBy(F.desc("level")))
    cuts = levels.withColumn("upper", upper).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upper") >= most, F.col("level"))), F.lit(0)).alias("cut"))
    near = rows.join(F.broadcast(cuts), "lang").where("level >= cut").select("lang", "id", "draw", first_bytes(F.col("text"), most).alias("text"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("draw", "id", "text").rowsBetween(Window.unboundedPreceding, -1))
    left = (most - F.coalesce(before, F.lit(0))).cast("int")
    return near.withColumn("left", left).where("left > 0").select(F.col("lang").alias(lang), first_bytes(F.col("text"), F.col("left")).alias(text))


def most_frequent(counts: DataFrame) -> DataFrame:
    """The counts, without the rarest runs of bytes where the tree would have too many nodes or cells.

    The rarest in all languages go first, and longer ones among equals. A
    run's head and tail are shorter and as frequent at least, so they stay with it.
    """
    totals = counts.groupBy("size", "gram").agg(F.sum("n").alias("total"))
    cells = totals.groupBy("total", "size").agg(F.count("*").alias("k")).orderBy(F.desc("total"), "size").collect()
    nodes, most = 1, min(MOST_NODES, MOST_CELLS // max(counts.select("lang").distinct().count(), 1))
    for total, size, k in cells:
        nodes += k
        if nodes > most:
            kept = totals.where((F.col("total") > total) | (F.col("total") == total) & (F.col("size") < size))
            return counts.join(kept, ["size", "gram"], "left_semi").select(*counts.columns)
    return counts


class Trees:
    """Code lengths of texts, in bits, under the frozen context trees of all languages."""

    def __init__(self, counts: list[tuple[str, int, int, int]]):
        self.languages = sorted({c[0] for c in counts})
        width = len(self.languages)
        place = {name: i for i, name in enumerate(self.languages)}
        #: For runs of k bytes, at [k]: the node below a node of k - 1 bytes (0: none), code lengths of the last byte, escapes after the run.
        self.below, self.cost, self.escape = [np.zeros(0, np.int32)], [np.full((1, width), 8.0)], []
        columns = [np.array([c[1] for c in counts], np.int64), np.array([c[2] for c in counts], np.int64), np.array([c[3] for c in counts], np.float64), np.array([place[c[0]] for c in counts], np.int64)]
        grams, tables = [np.zeros(1, np.int64)], []
        for size in range(1, ORDER + 2):
            gram, n, lang = (c[columns[0] == size] for c in columns[1:])
            found = np.unique(gram)
            grams.append(found)
            table = np.zeros((len(found), width))
            table[np.searchsorted(found, gram), lang] = n
            tables.append(table)
        if sum(map(len, grams)) > MOST_NODES:
            raise ValueError("the sample has too many contexts; lower its size")
        for size in range(1, ORDER + 2):
            found, n = grams[size], tables[size - 1]
            above = np.searchsorted(grams[size - 1], found >> 8) if size > 1 else np.zeros(len(found), np.int64)
            total, kinds = np.zeros((len(grams[size - 1]), width)), np.zeros((len(grams[size - 1]), width))
            np.add.at(total, above, n)
            np.add.at(kinds, above, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                own = np.log2((total + kinds)[above] / n)
            shorter = found & ((1 << 8 * (size - 1)) - 1)
            lower = self.cost[size - 1][np.searchsorted(grams[size - 1], shorter) + 1] if size > 1 else np.full((len(found), width), 8.0)
            self.cost.append(np.concatenate([np.zeros((1, width)), np.where(n > 0, own, escape[above] + lower)]))
            # The root is the node for runs of no bytes; of others, node 0 is none and has no escapes.
            self.escape.append(escape if size == 1 else np.concatenate([np.zeros((1, width)), escape]))
            below = np.zeros((1 if size == 1 else len(grams[size - 1]) + 1) * 256, np.int32)
            below[(above + (size > 1)) * 256 + (found & 255)] = np.arange(1, len(found) + 1)
            self.below.append(below)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Row per text, column per language."""
        if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
            whole = texts[0]
            steps = range(0, len(whole), CHUNK_BYTES)
            return sum(self._bits([whole[max(a - ORDER, 0) : a + CHUNK_BYTES]], min(a, ORDER)) for a in steps)
        return self._bits(texts, 0)

    def _bits(self, texts: list[bytes], warm: int) -> np.ndarray:
        """``warm``: bytes at the start that are context only."""
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int32)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(data):
            return out
        behind = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        nodes = [np.zeros(len(data), np.int32)]
        for size in range(1, ORDER + 2):
            at = self.below[size][data] if size == 1 else np.concatenate([[0], self.below[size][nodes[-1][:-1] * 256 + data[1:]]])
            nodes.append(np.where(behind >= size - 1, at, 0))
        total = np.zeros((len(data), len(self.languages)))
        left = np.arange(len(data))
        for size in range(ORDER + 1, 0, -1):
            node = nodes[size][left]
            hit = node > 0
            total[left[hit]] += self.cost[size][node[hit]]
            left = left[~hit]
            if not len(left):
                break
            if size > 1:
                # The context of size - 1 bytes ends before this byte; it is none at the start of a text.
                before = np.where(behind[left] >= size - 1, nodes[size - 1][left - 1], 0)
                total[left] += self.escape[size - 1][before]
            else:
                total[left] += self.escape[0][0] + 8.0
        if warm:
            total[:warm] = 0
        some = np.flatnonzero(sizes)
        out[some] = np.add.reduceat(total, (ends - sizes)[some], axis=0)
        return out


def learn(df: DataFrame, id: str, text: str, lang: str, bytes_each: int = SAMPLE_BYTES) -> Trees:
    """Trees from a sample of the labelled rows; their size is bounded by the sample's."""
    ws = Workspace(df.sparkSession, "languages")
    rows = most_frequent(ws.save(counted(sample(df, id, text, lang, bytes_each), lang, text), "counts")).toArrow()
    return Trees(list(zip(*(rows.column(c).to_pylist() for c in COUNTS.fieldNames()), strict=True)))


def predict(df: DataFrame, text: str, trees: Trees) -> DataFrame:
    """Add lang_pred, score (the language's share of the probability that all give the text) and bits_per_byte under it."""
    df = without(df, "lang_pred", "score", "bits_per_byte")
    extra = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("bits_per_byte", T.DoubleType(), False)]
    sent = df.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part, texts in chunks(batch, text):
                known = np.array([bool(model.languages and t and LETTER.search(t.decode())) for t in texts])
                names, scores, rates = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                if known.any():
                    chosen = np.flatnonzero(known)
                    bits = model.bits([texts[i] for i in chosen])
                    best = bits.argmin(1)
                    least = bits.min(1)
                    scores[chosen] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                    rates[chosen] = least / [len(texts[i]) for i in chosen]
                    for i, k in zip(chosen.tolist(), best.tolist(), strict=True):
                        names[i] = model.languages[k]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names), pa.array(scores), pa.array(rates)], names=[*part.schema.names, *(f.name for f in extra)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra]))


def held_out(id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 1 modulo 3 (a null id: not held out)."""
    return F.coalesce(F.crc32(id.cast("string")) % 3 == 1, F.lit(False))
