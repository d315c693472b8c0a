"""Nearest series under time warping, by bounds that spare most exact comparisons.

A candidate's envelope (least and most value within the reach of each place)
bounds its warping distance from below, as do the end points. Rows are put in
an order of course, where each query meets the rows around it: that gives a
distance that the kth neighbour cannot exceed. Then every chunk of queries
meets every part of the rows, a page at once: bounds first, then warping in
whole numbers that are never above the distance, and what is left exactly.
A chunk is sent to each part once and a row to each chunk once; pairs are never
rows, a task holds one chunk and one page, and nothing is collected.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import series as S
from narrata.workspace import Workspace

#: Powers of two of the rows that give limits and of the queries of a chunk; rows of a page.
BLOCK, GROUP, PAGE = 14, 15, 2048
#: Queries of about one limit that share a scale, those that are bounded at once, and pairs that are warped at once.
ALIKE, BOUNDED, PAIRS = 128, 32, 1 << 13
#: Neighbours in the order that give a query its first limit; bits of each quarter's class; pairs of rows of a task.
FIRST, CELL_BITS, TASK_PAIRS = 32, 4, 1 << 29


def envelope(x: np.ndarray, reach: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Least and most value within ``reach`` of each place of each row; of the whole row without a reach."""
    n = x.shape[1]
    if reach is None or reach >= n - 1:
        return np.repeat(x.min(1, keepdims=True), n, 1), np.repeat(x.max(1, keepdims=True), n, 1)
    wide = np.pad(x, ((0, 0), (reach, reach)), mode="edge")
    near = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1, axis=1)
    return near.min(2), near.max(2)


def bound(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What each query's distance from series in each envelope is at least: its values' distances from the envelope, the end points' from the ends."""
    least = np.zeros((len(q), len(low)))
    # Place by place: a block of pairs stays in the cache.
    for v, a, b in zip(q.T, low.T.copy(), high.T.copy(), strict=True):
        least += np.maximum(np.maximum(v[:, None] - b, a - v[:, None]), 0)
    return least


def ends(low: np.ndarray, high: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Envelopes with the series' own values at both ends, which every warping matches with each other."""
    low, high = low.copy(), high.copy()
    low[:, [0, -1]] = high[:, [0, -1]] = x[:, [0, -1]]
    return low, high


def warped(a: np.ndarray, b: np.ndarray, reach: int | None = None) -> np.ndarray:
    """Exact warping distance of each row of ``a`` and the same row of ``b``, places at most ``reach`` apart being matched."""
    n = a.shape[1]
    r = n if reach is None else reach
    a, b = a.T.copy(), b.T.copy()
    last = np.full((n + 1, a.shape[1]), np.inf)
    last[0] = 0
    for i in range(n):
        row = np.full((n + 1, a.shape[1]), np.inf)
        for j in range(max(0, i - r), min(n, i + r + 1)):
            row[j + 1] = np.abs(a[i] - b[j]) + np.minimum(np.minimum(last[j + 1], row[j]), last[j])
        last = row
    return last[n]


def _whole(x: np.ndarray, middle: float, step: float, edge: int, kind: type) -> np.ndarray:
    """Values in steps from the middle, cut at the edge. Neither rounding nor cutting moves two values apart by more than a step."""
    with np.errstate(over="ignore"):
        out = x - middle
        out /= step
    return np.clip(np.rint(out, out=out), -edge, edge, out=out).astype(kind)


def _extremes(b: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Envelopes of columns, with their own values at both ends."""
    out = []
    for f in (np.minimum, np.maximum):
        if r >= len(b) - 1:
            around = np.repeat(f.reduce(b)[None], len(b), 0)
        else:
            around = b.copy()
            for o in range(1, r + 1):
                f(around[:-o], b[o:], out=around[:-o])
                f(around[o:], b[:-o], out=around[o:])
        around[[0, -1]] = b[[0, -1]]
        out.append(around)
    return out[0], out[1]


def _warped_whole(a: np.ndarray, b: np.ndarray, r: int) -> np.ndarray:
    """Warping distance of columns of whole numbers. A sum over the largest number begins again at zero, so what is found is never above the distance."""
    n, m = a.shape
    plain = np.dtype(f"u{a.dtype.itemsize}")
    most = np.iinfo(plain).max
    last, row = np.full((n + 1, m), most, plain), np.full((n + 1, m), most, plain)
    last[0] = 0
    gaps = np.empty((min(n, 2 * r + 1), m), a.dtype)
    for i in range(n):
        low, high = max(0, i - r), min(n, i + r + 1)
        row[low] = most
        gap = gaps[: high - low]
        np.abs(np.subtract(a[i], b[low:high], out=gap), out=gap)
        np.minimum(last[low:high], last[low + 1 : high + 1], out=row[low + 1 : high + 1])
        for j in range(low, high):
            t = row[j + 1]
            np.minimum(t, row[j], out=t)
            t += gap[j - low].view(plain)
        last, row = row, last
    return last[n]


def near(q: np.ndarray, c: np.ndarray, most: np.ndarray, reach: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of columns of ``q`` and ``c``, all that are at most ``most`` of the query apart and few others.

    Values are whole numbers of steps. A step adds one at most to each difference, so limits are wider by one for each
    place, or for each pair of places that a warping matches. Sums that pass the largest number begin again at zero:
    that keeps a pair too much, never loses one.
    """
    n, known = len(q), np.isfinite(most)
    kind, plain, edge = (np.int16, np.uint16, 16_000) if n <= 64 else (np.int32, np.uint32, 1 << 29)
    r = n if reach is None else min(reach, n)
    top = float(most[known].max(initial=0.0))
    with np.errstate(over="ignore"):
        least, greatest = np.quantile(q, (0.02, 0.98))
        step = min(max(top / (np.iinfo(plain).max // (2 * n)), (greatest - least + 2 * top) / (2 * edge), 1e-300), 1e300)
    a, b = (_whole(x, least / 2 + greatest / 2, step, edge, kind) for x in (q, c))
    low, high = _extremes(b, r)
    base = (low - high).sum(0, dtype=kind)
    limit = np.floor(np.where(known, most, 0.0) / step)
    bounds, sums = (np.where(known, limit + more, np.iinfo(plain).max).astype(plain) for more in (n + 1, 2 * n + 1))
    found_i, found_j = [], []
    for s in range(0, a.shape[1], BOUNDED):
        v = a[:, s : s + BOUNDED, None]
        total = np.repeat(base[None], v.shape[1], 0)
        part = np.empty_like(total)
        for k in range(n):
            np.maximum(v[k], high[k], out=part)
            total += part
            np.minimum(v[k], low[k], out=part)
            total -= part
        at = np.flatnonzero(total.view(plain) <= bounds[s : s + BOUNDED, None])
        found_i.append(at // c.shape[1] + s)
        found_j.append(at % c.shape[1])
    i, j = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_i, found_j))
    kept = [np.zeros(0, bool)]
    for p in range(0, len(i), PAIRS):
        x, y = i[p : p + PAIRS], j[p : p + PAIRS]
        kept.append(_warped_whole(a.take(x, 1), b.take(y, 1), r) <= sums[x])
    kept = np.concatenate(kept)
    return i[kept], j[kept]


class Search:
    """The nearest rows of a chunk of queries, while pages of rows come. ``most`` is what their kth distance is at most."""

    def __init__(self, names: np.ndarray, q: np.ndarray, most: np.ndarray, k: int, reach: int | None):
        order = np.argsort(most, kind="stable")
        self.names, self.q, self.most, self.k, self.reach = names[order], q[order], most[order], k, reach
        self.compared = np.zeros(len(q), np.int64)
        self.who, self.ids, self.distances = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, ids: np.ndarray, c: np.ndarray) -> None:
        places = c.T.copy()
        for s in range(0, len(self.q), ALIKE):
            i, j = near(self.q[s : s + ALIKE].T, places, self.most[s : s + ALIKE], self.reach)
            i += s
            other = self.names[i] != ids[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            self.compared += np.bincount(i, minlength=len(self.q))
            d = np.concatenate([warped(self.q[i[p : p + PAIRS]], c[j[p : p + PAIRS]], self.reach) for p in range(0, len(i), PAIRS)])
            kept = d <= self.most[i]
            self._take(i[kept], ids[j[kept]], d[kept])

    def _take(self, who: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> None:
        who, ids, distances = np.concatenate([self.who, who]), np.concatenate([self.ids, ids]), np.concatenate([self.distances, distances])
        order = np.lexsort((ids, distances, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        last = order[place == self.k - 1]
        self.most[who[last]] = np.minimum(self.most[who[last]], _limit(distances[last]))
        kept = order[place < self.k]
        self.who, self.ids, self.distances = who[kept], ids[kept], distances[kept]


def _limit(distance: np.ndarray) -> np.ndarray:
    """Bounds and distances are rounded differently."""
    return distance * (1 + 1e-9) + 1e-12


def _first_limits(x: np.ndarray, asks: np.ndarray, k: int, reach: int | None) -> np.ndarray:
    """The kth distance of asking rows from those beside them."""
    wide = min(2 * FIRST + 1, len(x))
    if wide <= k:
        return np.full(len(asks), np.inf)
    beside = np.clip(asks - FIRST, 0, len(x) - wide)[:, None] + np.arange(wide)[None]
    i, j = np.repeat(asks, wide), beside.ravel()
    d = np.concatenate([np.zeros(0)] + [warped(x[i[s : s + PAIRS]], x[j[s : s + PAIRS]], reach) for s in range(0, len(i), PAIRS)])
    d[i == j] = np.inf
    return _limit(np.partition(d.reshape(len(asks), wide), k - 1, 1)[:, k - 1])


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


def _quarters() -> list[Column]:
    """Means of four parts of a series."""
    n = F.size("x")
    start = [F.floor(n * d / 4).cast("int") for d in range(5)]
    each = [F.slice("x", a + 1, F.greatest(b - a, F.lit(1))) for a, b in zip(start[:-1], start[1:], strict=True)]
    return [S.mean(part) for part in each]


def _cell(df: DataFrame) -> Column:
    """Where a series lies by the means of its quarters, each in one of ``1 << CELL_BITS`` classes of about as many rows: bits of the four in turn, so that neighbours in this order lie near each other."""
    shares = [k / (1 << CELL_BITS) for k in range(1, 1 << CELL_BITS)]
    cuts = df.select(*(F.percentile_approx(q, shares, 1000) for q in _quarters())).first()
    code = F.lit(0)
    for d, (quarter, edges) in enumerate(zip(_quarters(), cuts, strict=True)):
        place = S.let(quarter, lambda q: F.size(F.filter(F.array(*map(F.lit, edges or [0.0])), lambda e: e < q)))  # noqa: B023
        for b in range(CELL_BITS):
            code = code + F.shiftleft(F.shiftright(place, b).bitwiseAND(1), 4 * b + d)
    return code


def _ordered(df: DataFrame, cell: Column, parts: int) -> DataFrame:
    """Rows of about one course after another."""
    level = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    order = ["_cell", "_level", "id"]
    return df.withColumns({"_cell": cell, "_level": level}).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_cell", "_level")


def _gathered(batches: Iterator[pa.RecordBatch], rows: int, *more: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, series and more columns of so many rows in turn."""
    waiting, many = [], 0
    for batch in batches:
        for s in range(0, len(batch), rows):
            part = batch.slice(s, rows)
            if waiting and many + len(part) > rows:
                yield _columns(waiting, *more)
                waiting, many = [], 0
            waiting.append(part)
            many += len(part)
    if waiting:
        yield _columns(waiting, *more)


def _columns(batches: list[pa.RecordBatch], *more: str) -> tuple[np.ndarray, ...]:
    whole = pa.Table.from_batches(batches).combine_chunks()
    column = lambda name: whole.column(name).combine_chunks()
    return column("id").to_numpy(zero_copy_only=False), _matrix(column("x")), *(column(name).to_numpy(zero_copy_only=False) for name in more)


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[tuple[int, bool], np.ndarray, np.ndarray, np.ndarray]]:
    """What :func:`_gathered` gives, with its task and whether it asks: rows of one task and kind are together, pages end with them."""
    for key, run in itertools.groupby(_cut(batches), key=lambda pair: pair[0]):
        for columns in _gathered((batch for _, batch in run), rows, "most"):
            yield key, *columns


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, bool], pa.RecordBatch]]:
    """Batches cut where the task or the kind changes."""
    for batch in batches:
        task, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "asks"))
        edges = np.concatenate([[0], np.flatnonzero((task[1:] != task[:-1]) | (asks[1:] != asks[:-1])) + 1, [len(task)]])
        for a, b in itertools.pairwise(edges):
            if b > a:
                yield (int(task[a]), bool(asks[a])), batch.slice(a, b - a)


def nearest_series(df: DataFrame, id: str, series: str, queries: Column, k: int, reach: int | None = None, ws: Workspace | None = None) -> DataFrame:
    """(query_id, rank, id, distance, compared) of the k nearest other series of each row for which ``queries`` holds.

    ``compared`` is how many of the others the query was exactly compared with. Series have one length; rows with a null
    id or series, or a value that is null or not finite, are left out; ids are unique; ties go to the smaller id.
    """
    spark = df.sparkSession
    ws = ws or Workspace(spark, "warping")
    whole = df.select(F.col(id).cast("long").alias("id"), F.transform(series, lambda v: v.cast("double")).alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    good = ws.save(whole.where(F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))), "series")
    if good.select(F.size("x")).distinct().limit(2).count() > 1:
        raise ValueError("series of one length")
    sizes = good.agg(F.count("*"), F.count_if("asks")).first()
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block, page = 1 << BLOCK, PAGE

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def limits(ids: np.ndarray, x: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
            search = Search(ids[asks], x[asks], _first_limits(x, asks, k, reach), k, reach)
            for s in range(0, len(x), page):
                search.meet(ids[s : s + page], x[s : s + page])
            return pa.RecordBatch.from_arrays([pa.array(search.names), _lists(search.q), pa.array([m if np.isfinite(m) else None for m in search.most], pa.float64())], names=["id", "x", "most"])

        for ids, x, asks in _gathered(batches, block, "asks"):
            if asks.any():
                yield limits(ids, x, np.flatnonzero(asks))

    asked = ws.save(_ordered(good, _cell(good), least).mapInArrow(at_home, "id bigint, x array<double>, most double"), "asked")

    # Every chunk of queries meets every part of the rows, in a task of its own.
    chunks = max(1, -(-sizes[1] >> GROUP))
    parts = max(1, -(-2 * least // chunks), -(-sizes[0] * sizes[1] // (chunks * TASK_PAIRS)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = asked.select(every(parts).alias("part"), dealt(chunks).alias("chunk"), F.lit(True).alias("asks"), "id", "x", "most")
    others = good.select(dealt(parts).alias("part"), every(chunks).alias("chunk"), F.lit(False), "id", "x", F.lit(None).cast("double"))
    task = F.col("chunk") * parts + F.col("part")
    met = asking.union(others).select(task.alias("task"), "asks", "id", "x", "most").repartitionById(chunks * parts, F.col("task")).sortWithinPartitions("task", F.desc("asks"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(search: Search) -> pa.RecordBatch:
            # One more row for each query that was compared carries the number of its comparisons.
            some = np.flatnonzero(search.compared)
            names = np.concatenate([search.names[search.who], search.names[some]])
            ids = np.concatenate([search.ids, np.zeros(len(some), np.int64)])
            distances = pa.array(search.distances.tolist() + [None] * len(some), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids), distances, pa.array(np.concatenate([np.zeros(len(search.who), np.int64), search.compared[some]]))], names=["query_id", "id", "distance", "compared"])

        search, now, waiting = None, None, []
        for kind, ids, x, most in _runs(batches, page):
            if kind[1]:
                if kind[0] != now:
                    if search is not None:
                        yield told(search)
                    search, now, waiting = None, kind[0], []
                waiting.append((ids, x, np.where(np.isnan(most), np.inf, most)))
            elif kind[0] == now:
                if search is None:
                    search = Search(*(np.concatenate(w) for w in zip(*waiting, strict=True)), k, reach)
                search.meet(ids, x)
        if search is not None:
            yield told(search)

    found = ws.save(met.mapInArrow(meet, "query_id bigint, id bigint, distance double, compared bigint"), "found")
    counts = found.where("distance is null").groupBy("query_id").agg(F.sum("compared").alias("compared"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    best = found.where("distance is not null").drop("compared").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(counts, "query_id").select("query_id", "rank", "id", "distance", "compared")
