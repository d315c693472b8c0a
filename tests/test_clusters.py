"""Medoids against brute force and planted shapes."""

import itertools

import numpy as np

from narrata.operators import clusters


def test_warps():
    a = np.random.default_rng(1).normal(size=(7, 9))
    assert np.array_equal(clusters.warps(a, a[:4]), [clusters.warp(x, a[:4]) for x in a])


def test_rare_shape(spark):
    """A shape of 8 among 2,008 series has its own medoid."""
    draw = np.random.default_rng(2)
    shapes = {0: np.linspace(0, 1, 10), 1: np.linspace(1, 0, 10), 2: np.tile([0.0, 4.0], 5)}
    kinds = [0] * 1500 + [1] * 500 + [2] * 8
    rows = [(i, (shapes[kind] + draw.normal(0, 0.02, 10)).tolist()) for i, kind in enumerate(kinds)]
    found = {r.doc_id: r.cluster for r in clusters.k_medoids(spark.createDataFrame(rows, "doc_id long, x array<double>"), "doc_id", "x", 3).collect()}
    assert len(found) == len(rows) and {(kinds[i], kinds[c]) for i, c in found.items()} == {(0, 0), (1, 1), (2, 2)}


def test_cost(spark):
    """Near the best of all choices of medoids."""
    x = np.random.default_rng(3).normal(size=(120, 6))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "doc_id long, x array<double>")
    out = clusters.k_medoids(df, "doc_id", "x", 2).collect()
    d = clusters.warps(x, x)
    best = min(d[:, list(p)].min(1).sum() for p in itertools.combinations(range(120), 2))
    own = d[:, sorted({r.cluster for r in out})].min(1)
    assert all(abs(r.distance - own[r.doc_id]) < 1e-9 for r in out)
    print("cost", sum(r.distance for r in out), "best", best)
    assert sum(r.distance for r in out) <= 1.05 * best


def test_prototypes_in_blocks(spark):
    """Series of several lengths against the prototypes, as one by one; none for an empty series."""
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=n).tolist()) for i, n in enumerate([5, 9, 0, 5, 1, 9, 5])]
    curves = {7: draw.normal(size=5).tolist(), 3: draw.normal(size=5).tolist()}
    found = {(r.doc_id, r.prototype): r.distance for r in clusters.to_prototypes(spark.createDataFrame(rows, "doc_id long, x array<double>").coalesce(1), "doc_id", "x", curves).collect()}
    assert len(found) == 14
    for i, x in rows:
        want = clusters.warp(np.array(x), np.array(list(curves.values()))) if x else [np.inf] * 2
        assert [found[i, k] for k in curves] == list(want)


def test_features_are_worked_out_once(spark):
    """However many folds, fits and judgements: each row's features are made by one pass."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, i % 2, "a" if i % 3 else "b", float(i % 7)) for i in range(60)], "doc_id long, y int, g string, v double").mapInArrow(counted, "doc_id long, y int, g string, v double")
    clusters.classify(rows, ["v"], "y", "doc_id", "logistic", 2).collect()
    assert seen.value == 60
    clusters.transfer(rows, ["v"], "y", "g", "a", "b", "logistic").collect()
    assert seen.value == 120
