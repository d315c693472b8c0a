"""Characters of a text: names, their aliases, and what is told of them.

Names are capitalised words, pairs of them, words after a title, and words
beside a verb of speech; a name counts once for each rule that finds it. Names
of a document are resolved to characters by greedy leaders: in the order of
their counts, a name joins the first leader that it is related to, or else
becomes one. Texts are read in whole Arrow batches; what is shuffled are
mentions, by document.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators import graphs

#: Characters of text that are looked at at once.
AT_ONCE = 1 << 22
_WORD, _UPPER, _LOWER, _WHITE = 1, 2, 4, 8

# Titles and verbs of speech that go with English names.
TITLES = (
    "mr", "mrs", "ms", "miss", "dr", "doctor", "prof", "professor", "sir", "lord", "lady", "captain", "colonel", "general", "major",
    "king", "queen", "prince", "princess", "duke", "duchess", "count", "countess", "baron", "baroness", "father", "mother",
    "brother", "sister", "uncle", "aunt", "reverend", "pastor", "monsieur", "madame", "mademoiselle", "herr", "frau", "don", "dona",
)
SPEECH = (
    "said", "replied", "asked", "answered", "exclaimed", "shouted", "whispered", "muttered", "cried", "continued", "added", "remarked",
    "observed", "declared", "announced", "called", "interrupted", "began", "responded", "inquired",
)
#: Capitalised words that begin sentences and are no names; a corpus has its own.
STOPWORDS = (
    "the", "and", "but", "for", "with", "from", "was", "were", "has", "had", "have", "not", "all", "his", "her", "she", "they", "you", "your", "our", "this", "that", "these", "those",
    "what", "which", "who", "when", "where", "why", "how", "now", "then", "here", "there", "yes", "after", "before", "again", "once", "never", "one", "two", "three", "chapter", "part", "book",
)


@functools.cache
def _kinds() -> np.ndarray:
    """What each code point is: part of a word (letters, numbers and ``_``), a capital, a small letter, white space."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(len(kinds)):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LN":
            kinds[c] = _WORD | {"Lu": _UPPER, "Ll": _LOWER}.get(kind, 0)
    kinds[ord("_")] = _WORD
    kinds[[ord(c) for c in " \t\n\r"]] = _WHITE
    return kinds


def _named(texts: list[str], titles: frozenset[str], verbs: frozenset[str], stopwords: frozenset[str]) -> list[tuple[np.ndarray, pa.Array, np.ndarray, str, pa.Array]]:
    """For each rule: whose text, name, place, rule and title of its mentions."""
    # What ends a text is neither a word nor white space.
    body = "\0".join([*texts, ""])
    codes = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[codes]
    edge = np.flatnonzero(np.diff(kind & _WORD, prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return []
    so_far = lambda k: np.concatenate([[0], np.cumsum((kind & k) > 0)])
    small, white = so_far(_LOWER), so_far(_WHITE)
    cap = ((kind[start] & _UPPER) > 0) & (end - start > 1) & (small[end] - small[start + 1] == end - start - 1)
    # White space alone before a word, and a full stop and white space; none before the first word and behind the last.
    before = np.concatenate([[0], end[:-1]])
    blank = lambda low: (start > low) & (white[start] - white[np.minimum(low, start)] == start - low)
    gap = blank(before)
    dotted = (codes[before] == ord(".")) & blank(before + 1)
    gap[0] = dotted[0] = False
    joined = cap & np.concatenate([[False], cap[:-1]]) & gap
    after = np.concatenate([gap[1:], [False]])
    at = np.flatnonzero(cap)
    spot = at - np.maximum.accumulate(np.where(joined, 0, np.arange(len(start))))[at]
    more = np.concatenate([joined[1:], [False]])[at]
    word = lambda t: body[start[t] : end[t]]
    names = [word(t) for t in at.tolist()]
    stop = np.array([n.lower() in stopwords for n in names], bool)
    # The word after one that has more is the next capitalised one.
    pairs = lambda i: [f"{names[k]} {names[k + 1]}" for k in i.tolist()]
    heads = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(heads, start[at], "right") - 1
    place = start[at] - heads[doc]
    last = codes[start[at] - 1]
    free = np.where(spot == 0, (place > 0) & ~np.isin(last, [ord(c) for c in ".!?\n"]), last != ord("\n"))
    begins, ends = np.flatnonzero((spot == 0) & (gap | dotted)[at]), np.flatnonzero(~more & after[at])
    prior = {i: word(at[i] - 1) for i in begins.tolist()} | {i: names[i - 1] for i in np.flatnonzero(spot > 0).tolist()}
    titled = {i: w.lower() for i, w in prior.items() if w.lower() in titles}
    spoken = [i for i in begins.tolist() if gap[at[i]] and prior[i] in verbs], [i for i in ends.tolist() if word(at[i] + 1) in verbs]
    single, double = np.flatnonzero((end - start)[at] >= 3), np.flatnonzero(more & (spot % 2 == 0) & free & ~stop)
    following = np.concatenate([stop[1:], [False]])

    def told(i: np.ndarray, rule: str, title: list[str] | None = None, name: list[str] | None = None) -> tuple:
        named = [names[k] for k in i.tolist()] if name is None else name
        return doc[i], pa.array(named, pa.string()), place[i], rule, pa.nulls(len(i), pa.string()) if title is None else pa.array(title, pa.string())

    pair, called = double[~following[double]], np.array(sorted(titled), np.int64)
    whole = [f"{names[k]} {names[k + 1]}" if more[k] else names[k] for k in called.tolist()]
    speech = [i[~stop[i]] for i in (np.array(s, np.int64) for s in spoken)]
    return [told(single[~stop[single]], "word"), told(pair, "pair", name=pairs(pair)), told(called, "title", [titled[k] for k in called.tolist()], whole), *(told(i, "speech") for i in speech)]


def mentions(docs: DataFrame, titles: tuple[str, ...] = TITLES, verbs: tuple[str, ...] = SPEECH, stopwords: tuple[str, ...] = STOPWORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, name, place, rule, title): every mention and where it begins; ids are unique.

    ``rule`` is word, pair, title or speech; ``title`` is the one before the name, in small letters, and ``size`` the
    text's length. Texts are read in whole Arrow batches, ``AT_ONCE`` characters (one text at least) at once.
    """
    lists = frozenset(titles), frozenset(verbs), frozenset(stopwords)
    names = [id, "size", "name", "place", "rule", "title"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int32)
            chunk = np.cumsum(sizes, dtype=np.int64) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                for doc, name, place, rule, title in _named(texts[low:high], *lists):
                    own = doc + low
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(sizes[own]), name, pa.array(place, pa.int64()), pa.array([rule] * len(own), pa.string()), title], names=names)

    return docs.select(id, text).mapInArrow(run, f"{id} {docs.schema[id].dataType.simpleString()}, size int, name string, place bigint, rule string, title string")


def counted(found: DataFrame, least: int = 3, id: str = "doc_id") -> DataFrame:
    """(id, name, n, first, last, speech) of names with ``least`` mentions."""
    return found.groupBy(id, "name").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.count_if(F.col("rule") == "speech").alias("speech")).where(F.col("n") >= least)


def heads(name: str) -> Iterator[str]:
    """What begins with a word of the name: names that it may contain."""
    for start in (i for i in range(len(name)) if i == 0 or name[i - 1] == " "):
        for end in range(start + 2, len(name) + 1):
            yield name[start:end]


def leaders(names: Iterable[str]) -> list[str]:
    """The leader of each name in turn: the first that has its first word (and more words), its last word (both have more), or contains it or lies in it; or itself."""
    order: list[str] = []
    whole: dict[str, int] = {}
    firsts: dict[str, int] = {}
    lasts: dict[str, int] = {}
    inside: dict[str, int] = {}
    out = []
    for name in names:
        first, last = name.split(" ")[0], name.split(" ")[-1]
        long = " " in name
        met = [firsts.get(first), inside.get(name), lasts.get(last) if long else None, *(whole.get(h) for h in heads(name))]
        best = min((m for m in met if m is not None), default=len(order))
        if best == len(order):
            order.append(name)
            whole[name] = best
            if long:
                firsts.setdefault(first, best)
                lasts.setdefault(last, best)
            for h in heads(name):
                inside.setdefault(h, best)
        out.append(order[best])
    return out


def aliases(names: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, alias, character) of names (id, name, n): leaders come by count, equal counts by name. A document's names meet in a task, its text does not."""
    of_doc = names.groupBy(id).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "name"))).alias("names")).select(id, F.transform("names", lambda x: x["name"]).alias("names"))
    schema = f"{id} {names.schema[id].dataType.simpleString()}, alias array<string>, character array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([leaders(x) for x in lists], pa.list_(pa.string()))], names=[id, "alias", "character"])

    both = of_doc.mapInArrow(run, schema)
    return both.select(id, F.explode(F.arrays_zip("alias", "character")).alias("z")).select(id, "z.*")


def characters(found: DataFrame, names: DataFrame, resolved: DataFrame, most: int = 30, id: str = "doc_id") -> DataFrame:
    """(id, character, place, mentions, aliases, first, last, speech, title, role) of each document's ``most`` mentioned characters.

    ``first`` and ``last`` are shares of the text; the title is the one that its names have most often, of equal ones the first.
    """
    sizes = found.groupBy(id).agg(F.first("size").alias("size"))
    summed = resolved.join(names.withColumnRenamed("name", "alias"), [id, "alias"]).groupBy(id, "character").agg(
        F.sum("n").alias("mentions"), F.array_sort(F.collect_list("alias")).alias("aliases"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("speech").alias("speech"))
    titled = found.where("title is not null").groupBy(id, F.col("name").alias("alias"), "title").agg(F.count("*").alias("n")).join(resolved, [id, "alias"])
    titles = titled.groupBy(id, "character", "title").agg(F.sum("n").alias("n")).groupBy(id, "character").agg(F.min(F.struct((-F.col("n")).alias("n"), "title")).alias("t")).select(id, "character", "t.title")
    of_doc = Window.partitionBy(id)
    placed = summed.join(sizes, id).withColumns({"place": F.row_number().over(of_doc.orderBy(F.desc("mentions"), "character")), "ratio": F.col("mentions") / F.max("mentions").over(of_doc), "first": F.col("first") / F.col("size"), "last": F.col("last") / F.col("size")})
    covers = F.col("last") - F.col("first")
    role = F.when((F.col("place") == 1) & (covers > 0.7), "protagonist").when((F.col("ratio") > 0.3) & (covers > 0.5), "major").when(F.col("ratio") > 0.1, "supporting").otherwise("minor")
    kept = placed.withColumn("role", role).where(F.col("place") <= most).join(titles, [id, "character"], "left")
    return kept.select(id, "character", "place", "mentions", "aliases", "first", "last", "speech", "title", "role")


def ties(found: DataFrame, resolved: DataFrame, reach: int = 1200, id: str = "doc_id") -> DataFrame:
    """(id, n1, n2, n): pairs of mentions of two characters less than ``reach`` characters of text apart."""
    named = found.join(resolved.withColumnRenamed("alias", "name"), [id, "name"]).groupBy(id).agg(F.array_sort(F.collect_list(F.struct("place", F.col("character").alias("name")))).alias("mentions"))
    return graphs.near_mentions(named, "mentions", reach, id)


def scenes(found: DataFrame, resolved: DataFrame, size: int = 6000, id: str = "doc_id") -> DataFrame:
    """(id, scene, character, m): mentions of each character in each scene, a window of ``size`` characters of text; windows overlap by half."""
    step = size // 2
    last = F.floor(F.col("place") / step).cast("int")
    both = F.filter(F.array(last - 1, last), lambda k: k >= 0)
    named = found.join(resolved.withColumnRenamed("alias", "name"), [id, "name"])
    return named.select(id, "character", F.explode(both).alias("scene")).groupBy(id, "scene", "character").agg(F.count("*").alias("m"))


def orbits(met: DataFrame, docs: DataFrame, events: dict[str, str], size: int = 6000, digits: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, character, total, scenes, satellites, events) from :func:`scenes`.

    ``satellites`` are the characters met in the same scenes with the sum of sqrt(m1 * m2), the product of the sparse
    scene vectors' roots; ``scenes`` are in order; ``events`` counts what happens in them. Who meets is bounded by a
    scene's length.
    """
    step = size // 2
    other = met.select(id, "scene", F.col("character").alias("other"), F.col("m").alias("n"))
    drawn = met.join(other, [id, "scene"]).where("character <> other").groupBy(id, "character", "other").agg(F.round(F.sum(F.sqrt(F.col("m") * F.col("n"))) + 1e-9, digits).alias("weight"))
    satellites = drawn.groupBy(id, "character").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("order"), "other", "weight"))).alias("s")).select(id, "character", F.transform("s", lambda x: F.struct(x["other"].alias("name"), x["weight"].alias("weight"))).alias("satellites"))
    # Steps of the text in turn: a substring would be sought from the text's start each time.
    pieces = docs.where(F.length(text) > 0).select(id, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_p"))
    joint = lambda v, k: F.concat(v, *(F.coalesce(F.get("_p", k + j), F.lit("")) for j in (1, 2)))
    window = pieces.select(id, F.posexplode(F.transform("_p", lambda v, k: F.left(joint(v, k), F.lit(size)))).alias("scene", "_w"))
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.regexp_count(F.lower("_w"), F.lit(pattern)).alias("n")) for kind, pattern in events.items()))
    happened = window.select(id, "scene", F.explode(F.filter(kinds, lambda k: k["n"] > 0)).alias("e")).select(id, "scene", "e.*")
    told = met.join(happened, [id, "scene"]).groupBy(id, "character", "kind").agg(F.sum("n").alias("n")).groupBy(id, "character").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("events"))
    own = met.groupBy(id, "character").agg(F.sum("m").alias("total"), F.array_sort(F.collect_list("scene")).alias("scenes"))
    return own.join(satellites, [id, "character"], "left").join(told, [id, "character"], "left").select(id, "character", "total", "scenes", "satellites", "events")
