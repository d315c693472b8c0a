"""Phrase collocations, by bounded-depth suffix automata of shards.

Texts become pieces and pieces words. A task writes the words of what it reads,
each with its number, and the texts as runs of words that stand alone. A task
that reads runs back takes ``SHARD_WORDS`` words as a shard. A shard's
automaton has the words' sequences up to the longest phrase as states, with
their numbers of end positions, transitions by one word more, and suffix links
to the sequence without its first word. States of one length are made from two
of the length before, which their prefix transition and their suffix link lead
to: a state is made only if both may be frequent in the whole language, since no
rarer sequence can be a candidate or a part of one. So each round is one
length: shards count, counts are summed over shards in Spark, and the frequent
sequences are told to all shards as bits of buckets (hashes that many share), at
most 2**26 for each length. A state that is let in by a bucket it only shares is
counted like the others, and left out then. Pairs and triples of words, which
are most, are counted in buckets while texts are read, too; one in a bucket with
too few is left out early. Texts are not shuffled; words and states are, once.

Links of the frequent sequences make the rest: the first words of a phrase are
reached by prefixes, the last ones by suffix links, and a phrase that ends or
begins in a longer one of the same count is subsumed by it (one that lies
inside a longer phrase of the same count also lies in one that is a word
longer, with that count).

Counts are exact: a sequence is named by the hashes of its words in turn, and
words are read again with other hashes if two words of a language, frequent
together, have one (words are compared themselves). Defined results: null and
empty texts have no words; rows are counted as often as they are repeated; a
null language is ``und``; languages without a candidate, and empty tables, give
no rows; ids and further columns are unused.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.words import mix
from narrata.workspace import Workspace

#: Words of a shard (a longer piece is one shard).
SHARD_WORDS = 1 << 22
#: Text bytes that are worked on at once, and words of a stored run (a longer piece is one run).
CHUNK_BYTES, RUN_WORDS = 1 << 22, (1 << 16) - 1

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

SHARDS = "lang string, length int, at int, word binary, key binary, n bigint, ids binary"
STATES = "lang string, key binary, n bigint"
#: Bytes of text that a bucket stands for; powers of two that their number lies between; buckets of a stored range; words of the longest sequences that are counted in buckets.
BUCKET_BYTES, FEWEST, MOST, RANGE, BUCKETED = 128, 16, 26, 1 << 16, 3

U = np.uint64


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of sequences from those of all but the last word and all but the first."""
    return mix(first * U(0x9E3779B97F4A7C15) + mix(second))


def bucket(hashes: np.ndarray, power: int) -> np.ndarray:
    return (hashes >> U(64 - power)).astype(np.int64)


class Buckets:
    """How many sequences of each length fall in each bucket, up to 255."""

    def __init__(self, power: int, lengths: Iterable[int]):
        self.power, self.counts = power, {k: np.zeros(1 << power, np.uint8) for k in lengths}

    def add(self, length: int, hashes: np.ndarray) -> None:
        at, n = np.unique(bucket(hashes, self.power), return_counts=True)
        self.counts[length][at] = np.minimum(n + self.counts[length][at], 255)

    def take(self, ids: np.ndarray, hashes: np.ndarray) -> None:
        """Sequences of two words and more in texts of names; -1 parts pieces."""
        valid, current = ids >= 0, hashes[np.maximum(ids, 0)] if len(hashes) else np.zeros(len(ids), U)
        for length in range(2, BUCKETED + 1):
            valid, current = valid[:-1] & valid[1:], joined(current[:-1], current[1:])
            self.add(length, current[valid])

    def rows(self) -> Iterator[tuple]:
        """Ranges: (length, at, counts)."""
        for length, counts in self.counts.items():
            for low in range(0, len(counts), RANGE):
                if (part := counts[low : low + RANGE]).any():
                    yield length, low // RANGE, zlib.compress(part.tobytes(), 1)


def longs(values: np.ndarray) -> pa.Array:
    """The rows of a table of hashes, each as bytes."""
    rows, width = values.shape
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * np.int32(8 * width)), pa.py_buffer(np.ascontiguousarray(values))])


def cut(ids: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Parts of at most ``size`` that end with a piece's end (-1), or with that of a longer piece."""
    ends, low = np.flatnonzero(ids < 0) + 1, 0
    while low < len(ids):
        at = np.searchsorted(ends, [low + size, low], "right")
        high = ends[max(at[0] - 1, at[1])]
        yield ids[low:high]
        low = high


class Shard:
    """Words of one language, named in the order of their coming; -1 ends a piece."""

    def __init__(self, seed: int):
        self.names: dict[bytes, int] = {}
        self.hashes = np.zeros(0, U)
        self.runs: list[np.ndarray] = []
        self.size, self.seed = 0, seed

    def add(self, texts: bytes) -> np.ndarray:
        """Take ``texts``, which end with a break each, and return the names of their words."""
        low = texts.translate(_LOWER)
        kind = _KIND[np.frombuffer(low, np.uint8)]
        edge = np.flatnonzero(np.diff((kind == 0).astype(np.int8), prepend=0, append=0))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.zeros(0, np.int32)
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        body = np.frombuffer(low, np.uint8)[kind == 0].tobytes()
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        known = len(self.names)
        own = np.array([self.names.setdefault(w, len(self.names)) for w in words.dictionary.to_pylist()], np.int32)
        fresh = itertools.islice(self.names, known, None)
        self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh64_intdigest(w, self.seed) for w in fresh], U)])
        cuts = np.flatnonzero(np.diff(np.cumsum(kind == 2)[starts])) + 1
        ids = np.append(np.insert(own[words.indices.to_numpy()], cuts, -1), np.int32(-1))
        self.runs.append(ids)
        self.size += len(starts)
        return ids

    def batches(self, lang: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Rows of ``SHARDS``: words (word, key, n), and runs (key: the hashes of its words; ids: their places there, the highest number for -1)."""
        ids = np.concatenate(self.runs)
        words, counts = list(self.names), np.bincount(ids[ids >= 0], minlength=len(self.names))
        for low in range(0, len(words), 1 << 14):
            part = slice(low, low + (1 << 14))
            yield _batch(schema, lang=[lang] * len(words[part]), word=words[part], key=longs(self.hashes[part, None]), n=counts[part])
        for run in cut(ids, RUN_WORDS):
            names, place = np.unique(run[run >= 0], return_inverse=True)
            kind = np.uint16 if len(names) < (1 << 16) - 1 else np.uint32
            packed = np.full(len(run), np.iinfo(kind).max, kind)
            packed[run >= 0] = place
            yield _batch(schema, lang=[lang], key=[self.hashes[names].tobytes()], ids=[packed.tobytes()])


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """Columns that are not given are null."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.nulls(size, f.type) if f.name not in columns else c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def sharded(df: DataFrame, text: str, lang: str, words: int, power: int, seed: int) -> DataFrame:
    """Rows of ``SHARDS``: words of shards, their texts as runs; without a language, a task's counts of buckets (length, at, ids)."""
    schema = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("at", pa.int32()), ("word", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Shard] = {}
        buckets = Buckets(power, range(2, BUCKETED + 1))

        def close() -> Iterator[pa.RecordBatch]:
            while open_:
                name, shard = open_.popitem()
                if shard.size:
                    yield from shard.batches(name, schema)

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for name in pc.unique(batch.column("lang")).to_pylist():
                mine = texts.filter(pc.equal(batch.column("lang"), name)).to_pylist()
                held, size = [], 0
                for i, t in enumerate(mine):
                    held.append(t)
                    size += len(t)
                    if size >= CHUNK_BYTES or i == len(mine) - 1:
                        shard = open_.setdefault(name, Shard(seed))
                        buckets.take(shard.add(b"\n".join([*held, b""])), shard.hashes)
                        held, size = [], 0
                        if sum(s.size for s in open_.values()) >= words:
                            yield from close()
        yield from close()
        for length, at, counts in buckets.rows():
            yield _batch(schema, length=[length], at=[at], ids=[counts])

    whole = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return whole.mapInArrow(run, SHARDS)


#: For each length, the power of two of a number of buckets, and their bits.
Bits = dict[int, tuple[int, np.ndarray]]


def full_buckets(counts: DataFrame, power: int, lengths: Iterable[int], least: int, tasks: int) -> Bits:
    """Whether the sequences of each bucket (length, at, ids) are ``least`` in all: one in a bucket that isn't can't be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(RANGE, np.uint16)

        def told() -> pa.RecordBatch:
            bits = np.packbits(total >= least).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([bits])], names=["length", "at", "bits"])

        for batch in batches:
            for length, own, packed in zip(*(batch.column(c).to_pylist() for c in ("length", "at", "ids")), strict=True):
                if (length, own) != at and at is not None:
                    yield told()
                    total = np.zeros(RANGE, np.uint16)
                at, part = (length, own), np.frombuffer(zlib.decompress(packed), np.uint8)
                total[: len(part)] = np.minimum(total[: len(part)] + part, 255)
        if at is not None:
            yield told()

    found = {k: (power, np.zeros((1 << power) // 8, np.uint8)) for k in lengths}
    parts = min(tasks, len(found) * max(1, (1 << power) // RANGE))
    for row in counts.select("length", "at", "ids").repartition(parts, "length", "at").sortWithinPartitions("length", "at").mapInArrow(run, "length int, at int, bits binary").collect():
        part = found[row.length][1][row.at * RANGE // 8 : (row.at + 1) * RANGE // 8]
        part[:] = np.frombuffer(row.bits, np.uint8)[: len(part)]
    return found


def held(bits: Bits, length: int, hashes: np.ndarray) -> np.ndarray:
    """Whether the buckets of sequences of ``length`` words have their bits."""
    power, packed = bits[length]
    at = bucket(hashes, power)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def told(level: DataFrame, length: int, tasks: int) -> Bits:
    """Bits of the buckets of a level's sequences (key)."""
    power = min(MOST, max(FEWEST, (16 * level.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(power, [length])
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column("key").to_pylist()), U).reshape(-1, length)
            while hashes.shape[1] > 1:
                hashes = joined(hashes[:, :-1], hashes[:, 1:])
            buckets.add(length, hashes[:, 0])
        for k, at, counts in buckets.rows():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([counts], pa.binary())], names=["length", "at", "ids"])

    return full_buckets(level.select("key").mapInArrow(run, "length int, at int, ids binary"), power, [length], 1, tasks)


class Automaton:
    """States of one length; ``state[e]`` is the state of the sequence that ends at e, or -1; ``words`` and ``hashes`` of each state."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray):
        self.state, self.words, self.hashes = ids, hashes[:, None], hashes

    def keep(self, states: np.ndarray) -> None:
        self.state = np.where((self.state >= 0) & states[self.state], self.state, -1)

    def step(self, may: Callable[[np.ndarray], np.ndarray] | None) -> np.ndarray:
        """Go on to the states that are a word longer, by the prefix and the suffix link of each; their numbers of end positions.

        ``may`` tells of hashes whether their sequences may be frequent.
        """
        before = np.concatenate([np.full(1, -1, np.int64), self.state[:-1]])
        full = np.flatnonzero((before >= 0) & (self.state >= 0))
        if may is not None:
            full = full[may(joined(self.hashes[before[full]], self.hashes[self.state[full]]))]
        pairs, made, counts = np.unique(before[full] * (len(self.hashes) + 1) + self.state[full], return_inverse=True, return_counts=True)
        prefix, link = pairs // (len(self.hashes) + 1), pairs % (len(self.hashes) + 1)
        self.state = np.full(len(self.state), -1, np.int64)
        self.state[full] = made
        self.words = np.column_stack([self.words[prefix], self.words[link, -1]])
        self.hashes = joined(self.hashes[prefix], self.hashes[link])
        return counts


def stepped(runs: DataFrame, length: int, full: Broadcast, heard: Broadcast, words: int) -> DataFrame:
    """Each shard's states of ``length`` words (lang, key, n), of runs (lang, key, ids).

    ``full`` has the bits of pairs and triples, ``heard`` those of the frequent sequences of each shorter length.
    """
    schema = pa.schema([("lang", pa.string()), ("key", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            while open_:
                lang, parts = open_.popitem()
                firsts = itertools.accumulate((len(h) for h, _ in parts), initial=0)
                names, place = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
                ids = np.concatenate([np.append(place[low : low + len(h)], -1)[np.minimum(i, len(h))] for low, (h, i) in zip(firsts, parts, strict=False)])
                found = Automaton(ids, names)
                found.keep(held(heard.value, 1, names))
                for k in range(2, length):
                    found.step(lambda hashes, k=k: held(heard.value, k, hashes))
                n = found.step((lambda hashes: held(full.value, length, hashes)) if length <= BUCKETED else None)
                for low in range(0, len(n), 1 << 16):
                    part = slice(low, low + (1 << 16))
                    yield _batch(schema, lang=[lang] * len(n[part]), key=longs(found.words[part]), n=n[part])

        for batch in batches:
            for lang, key, ids in zip(*(batch.column(c) for c in ("lang", "key", "ids")), strict=True):
                hashes = np.frombuffer(key.as_buffer(), U)
                own = np.frombuffer(ids.as_buffer(), np.uint16 if len(hashes) < (1 << 16) - 1 else np.uint32)
                open_.setdefault(lang.as_py(), []).append((hashes.copy(), own.copy()))
                size += len(own)
                if size >= words:
                    yield from close()
                    size = 0
        yield from close()

    return runs.select("lang", "key", "ids").mapInArrow(run, STATES)


def frequent_phrases(df: DataFrame, text: str, lang: str, depth: int, least: int, ws: Workspace, words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Every sequence of at most ``depth`` words that occurs ``least`` times in its language, and the words of each language.

    (key, lang, length, prefix, link, n, phrase, firsts, lasts): ``prefix`` and ``link`` are the keys of the
    phrase without its last and its first word, ``firsts`` and ``lasts`` the counts of its first and of its last words, by their number.
    """
    tasks = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    context = ws.spark.sparkContext
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    power = min(MOST, max(FEWEST, (size // BUCKET_BYTES).bit_length()))
    empty, none = F.array().cast("array<bigint>"), F.lit(None).cast("binary")
    for seed in itertools.count(42):
        stored = ws.save(sharded(df, text, lang, words, power, seed), "shards")
        local = stored.where("word is not null").select("lang", "key", "word", "n")
        summed = local.repartition(tasks, "lang", "key").groupBy("lang", "key").agg(F.sum("n").alias("n"), F.min("word").alias("least"), F.max("word").alias("most")).where(F.col("n") >= least)
        heard = ws.save(summed, "heard")
        # Two words of one hash: others are taken.
        if not heard.where("least <> most").take(1):
            break
        ws.drop(stored, heard)
    totals = ws.save(local.groupBy("lang").agg(F.sum("n").alias("words")), "totals")
    full = context.broadcast(full_buckets(stored.where("lang is null"), power, range(2, BUCKETED + 1), min(least, 255), tasks))
    word = F.col("least").cast("string")
    level = heard.select("key", "lang", F.lit(1).alias("length"), none.alias("prefix"), none.alias("link"), "n", word.alias("phrase"), empty.alias("firsts"), empty.alias("lasts"), word.alias("word"))
    # What the words' shuffle wrote is not read again.
    del summed
    ws.tidy()
    runs, levels, bits = stored.where("word is null and lang is not null"), [level], {}
    for k in range(2, depth + 1):
        bits |= told(level, k - 1, tasks)
        counted = stepped(runs, k, full, context.broadcast(bits), words).repartition(tasks, "key").groupBy("lang", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        # The prefix has all but the last word, the suffix link all but the first.
        found = counted.withColumns({"prefix": F.expr(f"substring(key, 1, {8 * k - 8})"), "link": F.expr("substring(key, 9)")})
        left = level.select(F.col("key").alias("prefix"), "lang", F.col("phrase").alias("_head"), F.concat("firsts", F.array("n")).alias("firsts"))
        right = level.select(F.col("key").alias("link"), "lang", F.concat("lasts", F.array("n")).alias("lasts"), "word")
        named = found.join(left, ["lang", "prefix"]).join(right, ["lang", "link"])
        level = ws.save(named.select("key", "lang", F.lit(k).alias("length"), "prefix", "link", "n", F.concat_ws(" ", "_head", "word").alias("phrase"), "firsts", "lasts", "word"), "frequent")
        levels.append(level)
        ws.tidy()
        if not level.take(1):
            break
    ws.drop(stored)
    whole = levels[0]
    for x in levels[1:]:
        whole = whole.unionByName(x)
    return whole.drop("word"), totals


def collocations(df: DataFrame, text: str, lang: str, longest: int = 5, least: int = 100, share: int = 100, most: int = 2000, ws: Workspace | None = None, words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best candidates of each language.

    A candidate has 2 to ``longest`` words and at least ``least`` occurrences, and no longer candidate that it lies
    in has ``share`` percent of them; that follows links, so only a share of 100 is supported.
    """
    if share != 100:
        raise ValueError("links tell of longer phrases with the same count only")
    ws = ws or Workspace(df.sparkSession, "phrases")
    found, totals = frequent_phrases(df, text, lang, longest, least, ws, words)
    longer = found.where("length > 2")
    ends = [longer.select("lang", F.col(end).alias("key"), "n") for end in ("prefix", "link")]
    kept = found.where("length > 1").join(ends[0].union(ends[1]), ["lang", "key", "n"], "left_anti")

    def judged(k: Column) -> Column:
        """The cut after k words: ``firsts`` and ``lasts`` have a count for each number of words."""
        left, right = F.get("firsts", k - 1), F.get("lasts", F.col("length") - k - 1)
        return F.struct(score(F.col("n"), F.col("words"), left, right).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    cuts = F.transform(F.sequence(F.lit(1), F.col("length") - 1), judged)
    scored = kept.join(totals, "lang").withColumn("best", F.array_min(cuts)).select("lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", F.col("words").alias("n"), "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exactly: counts have at most 17 digits, and 38 hold the products."""
    a, n, left, right = (c.cast("decimal(17,0)") for c in (a, n, left, right))
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * a * n, left * right)
