"""Density clusters, Ward's hierarchy and nearest series against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.operators import density, hierarchy, warping


def brute_dbscan(rows, eps, least):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    near = [[j for j, (_, w) in enumerate(good) if ((v - w) ** 2).sum() <= eps * eps] for _, v in good]
    core = [len(n) >= least for n in near]
    part = list(range(len(good)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, n in enumerate(near):
        for j in n:
            if core[i] and core[j]:
                part[find(i)] = find(j)
    smallest = {}
    for i, (name, _) in enumerate(good):
        if core[i]:
            smallest[find(i)] = min(smallest.get(find(i), name), name)
    out = []
    for i, (name, v) in enumerate(good):
        if core[i]:
            out.append((name, smallest[find(i)], True))
            continue
        reached = [(((v - good[j][1]) ** 2).sum(), good[j][0], j) for j in near[i] if core[j]]
        out.append((name, smallest[find(min(reached)[2])] if reached else None, False))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [512, 4])
def test_density_clusters(spark, block):
    draw = random.Random(1)
    rows = [(i, [float(draw.randrange(40)), float(draw.randrange(40)), float(draw.randrange(2)), 1.0]) for i in range(300)]
    # Many copies, a chain, a border between two cores, and rows that take no part.
    rows += [(1000 + i, [100.0, 100.0, 0.0, 1.0]) for i in range(40)] + [(2000 + i, [200.0 + 2 * i, 0.0, 0.0, 1.0]) for i in range(30)] + [(3000, [-50.0, -0.0, 0.0, 1.0]), (3000, [-50.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows + [(None, [1.0] * 4), (5000, None), (5001, [1.0, None, 1.0, 1.0]), (5002, [float("nan")] * 4)], "i long, v array<double>").repartition(3)
    found = density.dbscan(df, "i", "v", 2.0, 4, block=block).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_dbscan(rows, 2.0, 4)


def test_density_of_few(spark):
    assert density.dbscan(spark.createDataFrame([], "i long, v array<double>"), "i", "v", 1.0, 2).collect() == []
    assert [tuple(r) for r in density.dbscan(spark.createDataFrame([(1, [0.0])], "i long, v array<double>"), "i", "v", 1.0, 1).collect()] == [(1, 1, True)]
    with pytest.raises(ValueError):
        density.dbscan(spark.createDataFrame([(1, [0.0]), (2, [0.0, 1.0])], "i long, v array<double>"), "i", "v", 1.0, 1)


def brute_ward(points):
    """Heights of merges, each time of the pair whose union adds least to the sum of squares."""
    parts, heights = [[p] for p in points], []
    cost = lambda a, b: 2 * len(a) * len(b) / (len(a) + len(b)) * ((np.mean(a, 0) - np.mean(b, 0)) ** 2).sum()
    while len(parts) > 1:
        c, i, j = min((cost(a, b), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j)
        heights.append(math.sqrt(c))
        parts[i] = parts[i] + parts.pop(j)
    return heights


def test_ward_heights_and_clusters(spark):
    draw = np.random.default_rng(2)
    points = [*draw.normal(0, 1, (25, 3)), *draw.normal(8, 1, (15, 3)), *draw.normal((0, 20, 0), 1, (10, 3))]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(99, None)], "i long, v array<double>").repartition(4)
    clusters, merges = hierarchy.ward(df, "i", "v", 3)
    steps = merges.orderBy("step").collect()
    assert np.allclose([s.height for s in steps], brute_ward(points), rtol=1e-9)
    assert steps[-1].size == 50 and {s.micro for s in steps} == {"exact"}
    of = {r.i: r.cluster for r in clusters.collect()}
    assert len(of) == 50 and sorted(map(len, ({i for i in of if of[i] == c} for c in set(of.values())))) == [10, 15, 25]
    assert len({of[i] for i in range(25)}) == 1


def test_ward_of_copies_and_of_many(spark):
    rows = [(i, [float(i % 4), 0.0]) for i in range(40)]
    clusters, merges = hierarchy.ward(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v", 2)
    assert merges.count() == 3 and np.allclose(sorted(r.height for r in merges.collect()), brute_ward([np.array(v) for _, v in rows])[-3:])
    draw = np.random.default_rng(5)
    far = [(i, (draw.normal(0, 1, 5) + 30 * (i % 3)).tolist()) for i in range(600)]
    clusters, merges = hierarchy.ward(spark.createDataFrame(far, "i long, v array<double>"), "i", "v", 3, most=100)
    of = {r.i: r.cluster for r in clusters.collect()}
    assert merges.count() < 100 and merges.first().micro.startswith("width") and all(of[i] == of[i % 3] for i in of) and len(set(of.values())) == 3
    none, steps = hierarchy.ward(spark.createDataFrame([], "i long, v array<double>"), "i", "v", 3)
    assert none.collect() == [] and steps.collect() == []


def warp(a, b, reach):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            if reach is None or abs(i - j) <= reach:
                d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


@pytest.mark.parametrize("reach", [None, 2])
def test_nearest_series(spark, monkeypatch, reach):
    monkeypatch.setattr(warping, "BLOCK", 4)
    monkeypatch.setattr(warping, "GROUP", 2)
    monkeypatch.setattr(warping, "PAGE", 3)
    draw = np.random.default_rng(7)
    rows = [(i, (draw.uniform(-3, 3) + draw.normal(0, 0.3, 12)).round(2).tolist()) for i in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1])]
    df = spark.createDataFrame(rows + [(300, None), (None, rows[0][1]), (302, [float("nan")] * 12)], "i long, x array<double>").repartition(3)
    found = warping.nearest_series(df, "i", "x", F.col("i") % 10 == 0, 3, reach).collect()
    expected = []
    for q, x in rows:
        if q % 10 == 0:
            best = sorted((warp(np.array(x), np.array(y), reach), i) for i, y in rows if i != q)[:3]
            expected += [(q, n, i, round(d, 6)) for n, (d, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank, r.id, round(r.distance, 6)) for r in found) == sorted(expected)
    # Bounds spare most comparisons of series at different levels.
    assert sum({r.query_id: r.compared for r in found}.values()) < 0.6 * len({r.query_id for r in found}) * (len(rows) - 1)


def test_bounds_never_exceed_distances():
    draw = np.random.default_rng(9)
    a, b = draw.normal(0, 1, (40, 9)), draw.normal(0, 1, (40, 9))
    for reach in (None, 0, 1, 3):
        exact = warping.warped(a, b, reach)
        assert np.allclose(exact, [warp(x, y, reach) for x, y in zip(a, b)])
        low, high = warping.ends(*warping.envelope(b, reach), b)
        assert (np.diagonal(warping.bound(a, low, high)) <= exact + 1e-9).all()


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "i long, x array<double>")
    assert [tuple(r) for r in warping.nearest_series(df, "i", "x", F.col("i") == 0, 3).collect()] == [(0, 1, 1, 1.0, 1)]
    assert warping.nearest_series(df.limit(0), "i", "x", F.lit(True), 3).collect() == []


def test_first_candidates_spare_comparisons(spark):
    """Of many series of one level, few are exactly compared: those of the least bounds come first and limit the rest."""
    draw = np.random.default_rng(6)
    courses = draw.permuted(np.tile(np.linspace(-1, 1, 8), (12, 1)), axis=1)
    x = courses[draw.integers(0, 12, 1200)] + draw.normal(0, 0.15, (1200, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x - x.mean(1, keepdims=True))], "i int, x array<double>")
    found = warping.nearest_series(df, "i", "x", F.col("i") % 30 == 0, 3, 1).collect()
    assert len(found) == 120 and sum(r.compared for r in found if r.rank == 1) < 3000


def test_pairs_are_never_rows(spark, tmp_path):
    """Series of one level, all of whose blocks must be looked at: a row is sent to each chunk of queries and a query to each part, but no pair with its series."""
    draw = np.random.default_rng(8)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(draw.uniform(0, 1, (3000, 20)))], "i int, x array<double>").repartition(4)
    store = spark._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()).iterator()
        total = 0
        while stages.hasNext():
            total += stages.next().shuffleWriteBytes()
        return total

    before = shuffled()
    found = warping.nearest_series(df, "i", "x", F.col("i") % 3 == 0, 3, 2).collect()
    assert len(found) == 3000
    # Rows once to be put in order, once to meet queries; queries once to each of eight parts, and room for as much again.
    assert shuffled() - before < 2 * (2 * 3000 + 8 * 1000) * 20 * 8


@pytest.mark.parametrize("reach", [None, 0, 2])
def test_whole_numbers_lose_no_pair(reach):
    draw = np.random.default_rng(4)
    for scale, shift, n, far in ((1.0, 0.0, 20, False), (1e-9, 5.0, 9, False), (1e6, -1e9, 6, False), (1.0, 0.0, 70, False), (1.0, 0.0, 1, True), (1.0, 0.0, 20, True)):
        q, c = (draw.normal(0, 1, (m, n)).round(1) * scale + shift for m in (30, 200))
        c[:10] = q[:10]
        c[11, -1] = -1e200
        if far:
            q[0, 0] = 1e200
        d = warping.warped(np.repeat(q, len(c), 0), np.tile(c, (len(q), 1)), reach).reshape(len(q), -1)
        most = np.sort(d, 1)[:, 5]
        most[3], most[4] = 0.0, np.inf
        found = np.zeros(d.shape, bool)
        found[warping.near(q.T, c.T.copy(), most, reach)] = True
        assert (found | (d > most[:, None])).all()
        # One limit far above the others spoils the steps of the queries beside it.
        assert far or found[5:].mean() < 0.5
