"""Near-duplicate documents by an inverted join of MinHash coordinates.

Documents are sets of word shingles; two are linked if the Jaccard likeness of
their sets is at least num/den. Documents with equal word sequences are one
class, and only classes go on. Each class posts under its coordinate-value
pairs. A match needs ``MATCH`` of ``COORDINATES`` equal coordinates. Pairs that
one class alone has are skipped; of the others, in the order of their
frequency, a class that could still match must meet its partner within the
first few (the prefix), so it is merged there only, and frequent pairs are
skipped. All that meet under a pair meet in the group of the pair's smallest
class, the hub.

Groups are settled in two passes. First each member is compared with the hub:
one comparison for each member, in blocks, so that a group of any size is dealt
over many tasks. Members that the hub's component has need not be compared with
each other. The others are compared with all of the group, block against block:
a task merges the blocks' postings to count collisions and confirms those above
the match threshold on the full sets. Only links that connect something are
returned, never all pairs. Components of the links are the result.

Likeness is always confirmed on the shingles themselves, not on hashes. A link
is missed only if fewer than MATCH of 64 coordinates agree: with 24, at a
likeness of exactly 0.8, a probability of 2.2e-14 (binomial), and less above.

Defined results: null or empty texts, and those without words, have empty sets
and are linked with nothing; rows with a null id are not linked and are kept,
with a null component; rows with equal ids are one document with the links of
each; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.components import components
from narrata.llm.words import Permutations, Words, chunks, shingle_set, shingles, split
from narrata.workspace import Workspace

COORDINATES, MATCH = 64, 24
#: Members of a block, and shingles of its members, after which a group is cut into more blocks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Columns of the incidence matrices that are multiplied at once.
STEP = 1 << 13

SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.ArrayType(T.IntegerType(), False))])
STARS = T.StructType([T.StructField("hub", T.LongType()), T.StructField("node", T.LongType()), T.StructField("linked", T.BooleanType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def digest_of(words: list[bytes]) -> bytes:
    """Digest of a word sequence; words hold no space."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def shingled(df: DataFrame, id: str, text: str, words: int, coordinates: int = COORDINATES) -> DataFrame:
    """(id, n, digest, signature): each document's number of shingles, its word sequence's digest, and its MinHash coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = Permutations(coordinates)
        for batch in batches:
            for part, texts in chunks(batch, text):
                found = Words(texts, lower=True)
                values, begins = shingles(found, words)
                flat = pa.array(draw.minima(values, begins).view(np.int32).ravel())
                ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * coordinates)
                lists = [found.of(i) for i in range(len(texts))]
                sizes = pa.array([len(shingle_set(w, words)) for w in lists], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(id), sizes, pa.array([digest_of(w) for w in lists], pa.binary()), pa.ListArray.from_arrays(ends, flat)], names=SETS.fieldNames())

    return df.select(F.col(id).cast("long").alias(id), text).mapInArrow(run, SETS)


def prefixes(ws: Workspace, classes: DataFrame) -> DataFrame:
    """(key, node): the rarest shared coordinate-value pairs of each class (node, signature), as many as a match needs."""
    each = classes.select("node", F.posexplode("signature").alias("_at", "_value"))
    posted = each.select("node", (F.shiftleft(F.col("_at").cast("long"), 32) + F.col("_value").cast("long")).alias("key"))
    often = ws.save(posted.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"), "often")
    shared = posted.join(often, "key")
    of_class = Window.partitionBy("node")
    ranked = shared.withColumn("_m", F.count("*").over(of_class)).withColumn("_rank", F.row_number().over(of_class.orderBy("often", "key")))
    return ws.save(ranked.where((F.col("_m") >= MATCH) & (F.col("_rank") <= F.col("_m") - MATCH + 1)).select("key", "node"), "prefixes")


def collisions(left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two signature tables with at least ``least`` equal coordinates.

    Postings are merged for the rarest coordinates only: a pair that none of
    them has cannot have enough. The frequent ones are looked up for the pairs
    that have met.
    """
    n, m = len(left), len(right)
    merges = []
    for k in range(left.shape[1]):
        order = np.argsort(left[:, k], kind="stable")
        posted = left[order, k]
        low, high = np.searchsorted(posted, right[:, k], "left"), np.searchsorted(posted, right[:, k], "right")
        merges.append((int((high - low).sum()), k, order, low, high - low))
    merges.sort(key=lambda x: x[:2])
    prefix = left.shape[1] - least + 1
    counts = np.zeros(n * m, np.int32)
    for total, _, order, low, size in merges[:prefix]:
        inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        counts[order[np.repeat(low, size) + inside] * m + np.repeat(np.arange(m), size)] += 1
    met = np.flatnonzero(counts)
    a, b, found = met // m, met % m, counts[met]
    for _, k, *_ in merges[prefix:]:
        found += left[a, k] == right[b, k]
    return a[found >= least], b[found >= least]


def common(left: list[set], right: list[set]) -> np.ndarray:
    """Size of the intersection of each set with each set of the other list."""
    names: dict = {}
    for s in itertools.chain.from_iterable(left):
        names.setdefault(s, len(names))
    shared = [np.array([names[s] for s in x if s in names], np.int64) for x in right]
    used = np.unique(np.concatenate([*shared, np.zeros(0, np.int64)]))
    place = np.full(len(names), -1)
    place[used] = np.arange(len(used))
    sides = []
    for sets in ([np.array([names[s] for s in x], np.int64) for x in left], shared):
        row, column = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), place[np.concatenate([*sets, np.zeros(0, np.int64)])]
        order = np.argsort(column, kind="stable")
        sides.append((row[order], column[order]))
    out = np.zeros((len(left), len(right)))
    for low in range(0, len(used), STEP):
        tables = []
        for (row, column), n in zip(sides, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(column, [low, low + STEP])
            tables.append(np.zeros((n, STEP), np.float32))
            tables[-1][row[a:b], column[a:b] - low] = 1
        out += tables[0] @ tables[1].T
    return out


class _Side:
    """Members of a block: their components, sets and signatures."""

    def __init__(self, rows: list[tuple[int, int, list[bytes]]], k: int):
        self.nodes, self.parts = [r[0] for r in rows], [r[1] for r in rows]
        self.sets = [shingle_set(r[2], k) for r in rows]
        self.sizes = np.array([len(s) for s in self.sets])
        values, begins = shingles(Words([b" ".join(r[2]) for r in rows]), k)
        self.signatures = Permutations(COORDINATES).minima(values, begins)


def links_of(left: _Side, right: _Side, num: int, den: int) -> list[tuple[int, int]]:
    """Links between the members of two blocks (or of one, given twice) that connect what was not connected yet."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    a, b = collisions(left.signatures, right.signatures, MATCH)
    if left is right:
        a, b = a[a > b], b[a > b]
    apart = np.array(left.parts)[a] != np.array(right.parts)[b]
    # The smaller of two sets has num/den of the larger one's members at least.
    near = (right.sizes[b] * den >= left.sizes[a] * num) & (left.sizes[a] * den >= right.sizes[b] * num)
    a, b = a[apart & near], b[apart & near]
    if not len(a):
        return []
    both = common(left.sets, right.sets)[a, b]
    real = den * both >= num * (left.sizes[a] + right.sizes[b] - both)
    found = []
    for i, j in zip(a[real].tolist(), b[real].tolist(), strict=True):
        x, y = find(left.parts[i]), find(right.parts[j])
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((left.nodes[i], right.nodes[j]))
    return found


def _stars(rows: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(hub, node, linked) from rows (hub, block, node, digest, text) in that order, each block's hub first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, center, last, out = None, set(), None, []
        for batch in batches:
            body = batch.column("text").cast(pa.binary()).to_pylist()
            for hub, block, node, digest, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "block", "node", "digest")), body, strict=True):
                found = split(text or b"", lower=True)
                # Another text with the same id, or a repeated row.
                if digest_of(found) != digest or (hub, block, node) == last:
                    continue
                last, mine = (hub, block, node), shingle_set(found, words)
                if (hub, block) != at:
                    at, center = (hub, block), mine
                if node == hub:
                    continue
                both = len(center & mine) if min(len(center), len(mine)) * den >= max(len(center), len(mine)) * num else 0
                out.append((hub, node, den * both >= num * (len(center) + len(mine) - both)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=STARS.fieldNames())
            out = []

    return rows.mapInArrow(run, STARS)


def _blocks(rows: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): links in each pair of blocks, from rows (hub, low, high, own, node, part, digest, text) in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            sides = {own: _Side(list(rows.values()), words) for own, rows in held.items()}
            found = links_of(sides[at[1]], sides[at[2]], num, den) if {at[1], at[2]} <= sides.keys() else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=LINKS.fieldNames())

        at, held = None, {}
        for batch in batches:
            body = batch.column("text").cast(pa.binary()).to_pylist()
            for hub, low, high, own, node, part, digest, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "low", "high", "own", "node", "part", "digest")), body, strict=True):
                if (hub, low, high) != at:
                    if at:
                        yield close()
                    at, held = (hub, low, high), {}
                found = split(text or b"", lower=True)
                if digest_of(found) == digest:
                    held.setdefault(own, {})[node] = (node, part, found)
        if at:
            yield close()

    return rows.mapInArrow(run, LINKS)


def _count(rows: str, shingles_: str) -> str:
    return f"cast(greatest(ceil({rows} / {BLOCK}), ceil({shingles_} / {BLOCK_SHINGLES}), 1) as int)"


def links(ws: Workspace, met: DataFrame, classes: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): verified links that connect the classes (node, id, n, digest) that meet under a key; ``met`` is (key, node), ``docs`` (id, text)."""
    tasks = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    hubs = ws.save(met.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"), "hubs")
    about = classes.select("node", "id", "n", "digest")
    members = ws.save(met.join(hubs, "key").select("hub", "node").distinct().join(about, "node"), "members")
    sizes = ws.save(members.groupBy("hub").agg(F.count("*").alias("n"), F.sum("n").alias("s")).selectExpr("hub", _count("n", "s") + " as blocks"), "sizes")
    # A hub meets each block of its group.
    each = members.join(sizes, "hub").withColumn("_all", F.sequence(F.lit(0), F.col("blocks") - 1))
    mine = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = each.withColumn("block", F.explode(F.when(F.col("node") == F.col("hub"), F.col("_all")).otherwise(mine)))
    order = ["hub", "block", F.col("node") != F.col("hub"), "node"]
    starred = dealt.select("hub", "block", "node", "id", "digest").join(docs, "id").select("hub", "block", "node", "digest", "text").repartition(tasks, "hub", "block").sortWithinPartitions(*order)
    stars = ws.save(_stars(starred, words, num, den), "stars")
    close = stars.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    parts = components(ws, close)
    named = members.join(parts.toDF("node", "_part"), "node", "left").withColumn("part", F.coalesce("_part", "node")).drop("_part")
    centers = named.where("node = hub").select("hub", F.col("part").alias("center"))
    rest = F.col("part") != F.col("center")
    placed = ws.save(named.where("node <> hub").join(centers, "hub").withColumn("rest", rest), "placed")
    counts = placed.groupBy("hub").agg(*(f(F.when(c, F.col("n"))).alias(k) for k, f, c in (("rn", F.count, F.col("rest")), ("rs", F.sum, F.col("rest")), ("sn", F.count, ~F.col("rest")), ("ss", F.sum, ~F.col("rest")))))
    # Members that the hub's component lacks meet all others but the hub.
    some = ws.save(counts.where("rn > 0 and rn + sn > 1").selectExpr("hub", _count("rn", "rs") + " as r", f"if(sn = 0, 0, {_count('sn', 'ss')}) as s"), "some")
    hashed = F.xxhash64("node")
    own = F.when(F.col("rest"), F.pmod(hashed, F.col("r"))).otherwise(F.col("r") + F.pmod(hashed, F.greatest("s", F.lit(1)))).cast("int")
    last = F.when(F.col("rest"), F.col("r") + F.col("s")).otherwise(F.col("r")) - 1
    paired = placed.join(some, "hub").withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    both = paired.select("hub", F.least("own", "_other").alias("low"), F.greatest("own", "_other").alias("high"), "own", "node", "part", "id", "digest")
    grouped = both.join(docs, "id").drop("id").repartition(tasks, "hub", "low", "high").sortWithinPartitions("hub", "low", "high", "own", "node")
    more = ws.save(_blocks(grouped, words, num, den), "links")
    return close.union(more)


def near_duplicates(df: DataFrame, id: str, text: str, words: int = 5, num: int = 80, den: int = 100, ws: Workspace | None = None, meet: Callable[[Workspace, DataFrame], DataFrame] = prefixes, coordinates: int = COORDINATES) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: kept is the smallest id of each component.

    ``meet`` makes (key, node) of classes (node, signature): those under a key are compared.
    """
    if 5 * num < 4 * den:
        raise ValueError("the signatures are made for a likeness of 0.8 or more")
    ws = ws or Workspace(df.sparkSession, "near")
    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sets = ws.save(shingled(docs, "id", "text", words, coordinates), "sets")
    full = sets.where("n > 0 and id is not null")
    first = ws.save(full.groupBy("digest").agg(F.min("id").alias("first")), "first")
    one = full.join(first, "digest").where("id = first").drop("first").dropDuplicates(["digest"])
    # The numbers are those of the written table.
    classes = ws.save(one.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = links(ws, meet(ws, classes), classes, docs.where("id is not null"), words, num, den)
    light = sets.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    rows = ws.save(light.join(classes.select("digest", "node"), "digest", "left").select("id", "n", "node"), "rows")
    # Rows with equal ids are one document.
    least = rows.where("node is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("_most")).where("a < _most").select("id", "a")
    same = ws.save(rows.join(least, "id").select("a", F.col("node").alias("b")).distinct(), "same")
    parts = components(ws, found.union(same))
    named = ws.save(classes.select("node", "id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    heads = ws.save(named.join(least, "component").select("node", "component_id"), "heads")
    out = rows.join(heads, "node", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
