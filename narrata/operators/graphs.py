"""Graphs of characters and of narrative states."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.functions import lexicon as L
from narrata.functions import text as X

#: Pairs of mentions that are counted at once.
STEP_PAIRS = 200_000


def sentence_names(docs: DataFrame, names: Column, id: str = "doc_id") -> DataFrame:
    """(id, sent, sentence, name): each name once per sentence; ``names`` reads column ``sentence``."""
    each = docs.select(id, F.posexplode(X.sentences(F.col("text"))).alias("sent", "sentence"))
    return each.select(id, "sent", "sentence", F.explode(F.array_distinct(names)).alias("name"))


def cooccurrence(found: DataFrame, id: str = "doc_id", speech: tuple[str, ...] = L.SPEECH, action: tuple[str, ...] = L.ACTION) -> DataFrame:
    """(id, c1, c2, weight): pairs of names in a sentence, 1 each, 1.5 more with a speech verb, 2 more with an action verb.

    A sentence's names are one array, so pairs are made within the row; their
    number is bounded by the sentence's length.
    """
    text = F.lower("sentence")
    has = lambda verbs: F.exists(X.tokens(text), lambda t: t.isin(*verbs)).cast("int")
    weight = 1.0 + 1.5 * has(speech) + 2.0 * has(action)
    rows = found.groupBy(id, "sent", "sentence").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1).withColumn("w", weight)
    firsts = rows.select(id, "w", "names", F.posexplode("names").alias("i", "c1"))
    pairs = firsts.select(id, "w", "c1", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("c2"))
    return pairs.groupBy(id, "c1", "c2").agg(F.sum("w").alias("weight"))


def mirrored(edges: DataFrame, id: str = "doc_id") -> DataFrame:
    return edges.select(id, F.col("c1").alias("a"), F.col("c2").alias("b"), "weight").union(edges.select(id, "c2", "c1", "weight"))


def degrees(edges: DataFrame, id: str = "doc_id") -> DataFrame:
    return mirrored(edges, id).groupBy(id, F.col("a").alias("name")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def open_triads(edges: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, name, triads): pairs of a node's neighbours that have no edge, counted from degrees and triangles.

    Open ones are all pairs of neighbours less the closed ones; closed ones are
    edges joined with edges, not pairs of neighbours.
    """
    both = mirrored(edges, id).select(id, "a", "b")
    corner = both.join(edges.select(id, F.col("c1").alias("b"), F.col("c2").alias("c")), [id, "b"]).where("c <> a")
    closed = corner.join(both.select(id, "a", F.col("b").alias("c")), [id, "a", "c"]).groupBy(id, F.col("a").alias("name")).agg(F.count("*").alias("closed"))
    return degrees(edges, id).join(closed, [id, "name"], "left").select(id, "name", "degree", "strength", (F.col("degree") * (F.col("degree") - 1) / 2 - F.coalesce("closed", F.lit(0))).cast("long").alias("triads"))


def connectivity(edges: DataFrame, mentions: DataFrame, id: str = "doc_id") -> DataFrame:
    """Index 0..100 of mentions, degree, strength, mean weight and open triads, each over the document's largest."""
    nodes = mentions.join(open_triads(edges, id), [id, "name"], "left").fillna(0, ["degree", "strength", "triads"]).withColumn("weighted", F.when(F.col("degree") > 0, F.col("strength") / F.col("degree")).otherwise(0.0))
    of_doc = Window.partitionBy(id)
    parts = {"mentions": 0.25, "degree": 0.20, "strength": 0.25, "weighted": 0.15, "triads": 0.15}
    score = sum((w * F.coalesce(F.try_divide(F.col(c), F.max(c).over(of_doc)), F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    return nodes.withColumn("score", F.round(100 * score, 4))


def near_names(docs: DataFrame, pattern: str, reach: int, id: str = "doc_id") -> DataFrame:
    """(id, n1, n2, n): pairs of different names with mentions less than ``reach`` characters apart.

    A text is read once, in its row, and meets its own mentions only.
    """

    def found(batch: pa.RecordBatch) -> Iterator[list[tuple[str, int]]]:
        rule = regex.compile(pattern)
        for i in range(batch.num_rows):
            yield [(m.group(), m.start()) for m in rule.finditer(batch.column(1)[i].as_py() or "")]

    return _near(docs.select(id, "text"), found, reach, id)


def near_mentions(df: DataFrame, mentions: str, reach: int, id: str = "doc_id") -> DataFrame:
    """The same for mentions that are known: an array of (place, name) by place."""

    def found(batch: pa.RecordBatch) -> Iterator[list[tuple[str, int]]]:
        for i in range(batch.num_rows):
            yield [(m["name"], m["place"]) for m in batch.column(1)[i].as_py() or ()]

    return _near(df.select(id, mentions), found, reach, id)


def _near(rows: DataFrame, mentions: Callable[[pa.RecordBatch], Iterator[list[tuple[str, int]]]], reach: int, id: str) -> DataFrame:
    """Pairs are counted in steps of ``STEP_PAIRS``, which bounds memory for a text of any length and density; a step's counts are added in the shuffle."""
    schema = T.StructType([rows.schema[id], *(T.StructField(c, T.StringType()) for c in ("n1", "n2")), T.StructField("n", T.LongType())])

    def packed(batch: pa.RecordBatch, met: list[tuple]) -> pa.RecordBatch:
        at, n1, n2, n = zip(*met, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), pa.concat_arrays(n1), pa.concat_arrays(n2), pa.array(np.concatenate(n).astype(np.int64))], names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met, held = [], 0
            for i, places in enumerate(mentions(batch)):
                names = sorted({name for name, _ in places})
                code = {name: k for k, name in enumerate(names)}
                which, at = np.array([code[name] for name, _ in places], np.int64), np.array([p for _, p in places], np.int64)
                table = pa.array(names, pa.string())
                # Each mention meets the ones behind it that are in reach.
                after = np.searchsorted(at, at + reach) - np.arange(len(at)) - 1
                total = np.cumsum(after)
                start = 0
                while start < len(at):
                    end = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + STEP_PAIRS, "right")), start + 1)
                    for lo in range(0, int(after[start:end].max()), STEP_PAIRS):
                        some = np.clip(after[start:end] - lo, 0, STEP_PAIRS)
                        a = np.repeat(np.arange(start, end), some)
                        b = a + 1 + lo + np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some)
                        a, b = which[a], which[b]
                        key, n = np.unique((np.minimum(a, b) * len(names) + np.maximum(a, b))[a != b], return_counts=True)
                        if len(key):
                            met.append((np.full(len(key), i), table.take(pa.array(key // len(names))), table.take(pa.array(key % len(names))), n))
                            if (held := held + len(key)) > STEP_PAIRS:
                                yield packed(batch, met)
                                met, held = [], 0
                    start = end
            if met:
                yield packed(batch, met)

    return rows.mapInArrow(run, schema).groupBy(id, "n1", "n2").agg(F.sum("n").alias("n"))


def states(docs: DataFrame, n: int, features: dict[str, Column], id: str = "doc_id") -> DataFrame:
    """(id, state_idx, position, features...) of documents with a column ``segments``; features read column ``segment``."""
    each = docs.select(id, F.posexplode("segments").alias("state_idx", "segment"))
    return each.select(id, "state_idx", (F.col("state_idx") / (n - 1)).alias("position"), *(f.alias(k) for k, f in features.items()))


def morphisms(found: DataFrame, features: list[str], id: str = "doc_id") -> DataFrame:
    """(id, idx, position, type, intensity, d_...): transitions between states that follow each other."""
    order = Window.partitionBy(id).orderBy("state_idx")
    nxt = {f: F.round(F.lead(f).over(order) - F.col(f), 6) for f in features}
    rows = found.withColumns({f"d_{f}": c for f, c in nxt.items()}).withColumn("_next", F.lead("position").over(order)).where("_next is not null")
    intensity = F.greatest(*(F.abs(f"d_{f}") for f in features)) if len(features) > 1 else F.abs(f"d_{features[0]}")
    d = F.col(f"d_{features[0]}")
    kind = F.when(F.col("_next") > 0.9, "denouement").when((F.col("_next") > 0.7) & (F.col("_next") <= 0.85), "climax").when(d > 0.3, "rising").when(d < -0.3, "falling").otherwise("development")
    return rows.select(id, F.col("state_idx").alias("idx"), F.col("_next").alias("position"), kind.alias("type"), intensity.alias("intensity"), *(f"d_{f}" for f in features))


def composed(arrows: DataFrame, features: list[str], id: str = "doc_id") -> DataFrame:
    """The composition of a document's transitions: sums of changes, the largest intensity, and the type of the first with it."""
    first = F.max_by("type", F.struct("intensity", -F.col("idx")))
    return arrows.groupBy(id).agg(F.count("*").alias("length"), F.max("intensity").alias("intensity"), first.alias("type"), *(F.round(F.sum(f"d_{f}"), 6).alias(f"d_{f}") for f in features))


def laws(arrows: DataFrame, features: list[str], id: str = "doc_id") -> DataFrame:
    """(id, arrows, triples, associative, identity): the laws of composition on each three transitions in turn."""
    order = Window.partitionBy(id).orderBy("idx")
    steps = {f"{f}{k}": F.lead(f"d_{f}", k).over(order) for f in features for k in (1, 2)}
    near = lambda f: F.abs((F.col(f"d_{f}") + F.col(f"{f}1")) + F.col(f"{f}2") - (F.col(f"d_{f}") + (F.col(f"{f}1") + F.col(f"{f}2")))) < 1e-9
    each = arrows.withColumns(steps)
    both = lambda f: functools.reduce(lambda a, b: a & b, (f(x) for x in features))
    return each.groupBy(id).agg(F.count("*").alias("arrows"), F.count(f"{features[0]}2").alias("triples"), F.coalesce(F.bool_and(both(near)), F.lit(True)).alias("associative"), F.bool_and(both(lambda f: F.col(f"d_{f}") + 0.0 == F.col(f"d_{f}"))).alias("identity"))


def path_to_top(arrows: DataFrame, feature: str, id: str = "doc_id") -> DataFrame:
    """(id, length, d_feature, intensity): the composition of the transitions up to the first state where the feature is largest."""
    order = Window.partitionBy(id).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    sums = arrows.withColumns({"_sum": F.round(F.sum(f"d_{feature}").over(order), 6), "_most": F.max("intensity").over(order)})
    best = F.max(F.struct("_sum", -F.col("idx"), F.struct("idx", "_most").alias("at")))
    top = sums.groupBy(id).agg(best.alias("b"))
    return top.select(id, (F.col("b.at.idx") + 1).alias("length"), (F.col("b._sum") + 0.0).alias(f"d_{feature}"), F.col("b.at._most").alias("intensity"))


def transformations(long: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, f, g, n, mean_eta, r): difference and correlation of each two functors over a document's windows."""
    other = long.select(id, "win_idx", F.col("functor").alias("g"), F.col("value").alias("v2"))
    met = long.select(id, "win_idx", F.col("functor").alias("f"), F.col("value").alias("v1")).join(other, [id, "win_idx"]).where("f < g")
    return met.groupBy(id, "f", "g").agg(F.count("*").alias("n"), F.round(F.avg(F.col("v2") - F.col("v1")), 5).alias("mean_eta"), F.round(F.corr("v1", "v2"), 4).alias("r"))
