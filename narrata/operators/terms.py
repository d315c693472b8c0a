"""Large lexicons: terms found in texts at a cost that does not grow with their number.

A lexicon is a table (term, value). It goes to every task, as a prefix tree or
a dictionary, so its size is bounded (``MOST_TERMS``, ``MOST_BYTES``) and
checked. Terms are found either anywhere in a text, the leftmost first and of
those the longest, without overlap, as scripts without spaces need it; or as
the longest term that begins a word, as inflected languages need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import series as S

#: Terms of a lexicon, and bytes of all of them, at most.
MOST_TERMS, MOST_BYTES = 2_000_000, 64 << 20


def shared(lexicon: DataFrame, term: str = "term", value: str = "value") -> Broadcast:
    """A lexicon for every task. Null and empty terms are left out; of equal ones the largest value counts."""
    rows = lexicon.where(F.length(term) > 0).groupBy(F.col(term).alias("term")).agg(F.max(F.col(value).cast("double")).alias("value"))
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    if count > MOST_TERMS or (size or 0) > MOST_BYTES:
        raise ValueError(f"a lexicon of {count} terms and {size} bytes is too large to share: {MOST_TERMS} terms and {MOST_BYTES} bytes at most")
    return lexicon.sparkSession.sparkContext.broadcast({r.term: r.value for r in rows.collect()})


def found(docs: DataFrame, text: str, lexicon: Broadcast, id: str = "doc_id", negations: tuple[str, ...] = ()) -> DataFrame:
    """(id, found): leftmost-longest terms of each text as (start, stop, value), in turn. A null text has none.

    The value of a term right behind which one of ``negations`` stands is
    turned. That is told where the text is, at a cost that does not grow with
    the term's place in it, and no text is joined with its terms.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = lexicon.value
        sizes, values = np.array([len(t) for t in terms], np.int64), np.array(list(terms.values()), np.float64)
        tree = ahocorasick.Automaton()
        for place, term in enumerate(terms):
            tree.add_word(term, place)
        tree.make_automaton()
        for batch in batches:
            counts, last, places, turned = [0], [], [], []
            for body in batch.column("text").to_pylist():
                hits = list(tree.iter_long(body)) if body and terms else []
                counts.append(len(hits))
                last += [end for end, _ in hits]
                places += [place for _, place in hits]
                if negations:
                    turned += [body.startswith(negations, end + 1) for end, _ in hits]
            stop, place = np.array(last, np.int64) + 1, np.array(places, np.int64)
            value = np.where(np.array(turned, bool), -values[place], values[place]) if negations else values[place]
            hits = pa.StructArray.from_arrays([pa.array(stop - sizes[place]), pa.array(stop), pa.array(value)], ["start", "stop", "value"])
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), hits)], names=[id, "found"])

    return docs.select(id, F.col(text).alias("text")).mapInArrow(run, f"{id} {kind}, found array<struct<start:bigint,stop:bigint,value:double>>")


def longest_prefix(word: str, terms: dict[str, float], shortest: int, longest: int) -> float | None:
    for n in range(min(longest, len(word)), shortest - 1, -1):
        if (value := terms.get(word[:n])) is not None:
            return value
    return None


def word_values(docs: DataFrame, words: Column, lexicon: Broadcast, id: str = "doc_id") -> DataFrame:
    """(id, values): for each word of a document the value of the longest term that begins it; null for none."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = lexicon.value
        shortest, longest = min(map(len, terms), default=1), max(map(len, terms), default=0)
        for batch in batches:
            lists = batch.column("words")
            # Each different word of a batch is looked up once.
            names = lists.flatten().dictionary_encode()
            values = pa.array([longest_prefix(w, terms, shortest, longest) if w is not None else None for w in names.dictionary.to_pylist()], pa.float64())
            sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.ListArray.from_arrays(pa.array(ends), values.take(names.indices))], names=[id, "values"])

    return docs.select(id, F.coalesce(words, F.array().cast("array<string>")).alias("words")).mapInArrow(run, f"{id} {kind}, values array<double>")


@S.bound
def balance(values: Column, rest: float = 15.0) -> Column:
    """(P - N) / (P + N + rest) of positive and negative values for each hundred words."""
    size = F.greatest(F.size(values), F.lit(1)) / 100.0
    part = lambda sign: S.total(F.transform(values, lambda v: F.greatest(F.coalesce(v, F.lit(0.0)) * sign, F.lit(0.0)))) / size
    return S.lets(lambda p, n: (p - n) / (p + n + rest), lambda: part(1.0), lambda _: part(-1.0))


@S.bound
def negated(found_: Column, text: Column, negations: tuple[str, ...]) -> Column:
    """The values of :func:`found` terms; one right behind which a negation stands is turned."""
    follows = lambda t: F.exists(F.array(*map(F.lit, negations)), lambda x: F.substr(text, (t["stop"] + 1).cast("int"), F.length(x)) == x) if negations else F.lit(False)
    return F.transform(found_, lambda t: F.when(follows(t), -t["value"]).otherwise(t["value"]))


def compound(values: Column, most: float = 5.0) -> Column:
    """Mean value over the largest possible one, between -1 and 1; 0 for none."""
    return F.when(F.size(values) > 0, S.clip(S.mean(values) / most, -1.0)).otherwise(0.0)
