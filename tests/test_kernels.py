"""Steps by whole Arrow batches against the column functions of their names."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from narrata.functions import kernels as K
from narrata.functions import peaks as P
from narrata.functions import series as S
from narrata.operators import detectors
from narrata.plans import comparisons, geometry, queries

DATA = "/root/testdata/sf0.001"


def cases():
    draw = np.random.default_rng(17)
    noise = [draw.normal(size=n).tolist() for n in (1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 19, 20, 21, 39, 100, 101, 240)]
    steps = [np.round(draw.normal(size=n)).tolist() for n in (9, 30, 120)]
    return [*noise, *steps, [0.5] * 8, [0.25] * 50, [], [0.0, 1.0, 1.0, 0.0, 2.0, 2.0, 2.0, 0.0]]


@pytest.mark.parametrize(
    "kernel, column",
    [
        (lambda x: K.gaussian(x, 3.0), lambda x: S.gaussian(x, 3.0)),
        (K.savitzky_golay, S.savitzky_golay),
        (K.local_divergence, detectors.local_divergence),
        (K.local_entropy, detectors.local_entropy),
        (lambda x: K.peaks(x, np.maximum(K.lengths(x) // 10, 1), 0.05), lambda x: P.peaks(x, F.greatest((F.size(x) / 10).cast("int"), F.lit(1)), 0.05)),
        (lambda x: K.peaks(x, 3), lambda x: P.peaks(x, 3)),
        (lambda x: K.valleys(x, 2, 0.4), lambda x: P.peaks(F.transform(x, lambda v: -v), 2, 0.4)),
    ],
)
def test_like_column_functions(spark, kernel, column):
    lists = cases()
    rows = [(i, x) for i, x in enumerate(lists) if x]
    want = dict(spark.createDataFrame(rows, "i int, x array<double>").select("i", column(F.col("x"))).collect())
    found = kernel(pa.array([None, *lists, None], pa.list_(pa.float64()))).to_pylist()
    assert found[0] is found[-1] is None and found[1 + lists.index([])] == []
    for i, _ in rows:
        assert np.allclose(found[i + 1], want[i], rtol=0, atol=1e-12)


def test_a_slice_of_a_batch():
    lists = pa.array(cases(), pa.list_(pa.float64()))
    assert K.gaussian(lists[5:9], 2.0).to_pylist() == K.gaussian(lists, 2.0).to_pylist()[5:9]


@pytest.mark.parametrize("query", [queries.structure_detectors, queries.four_acts, queries.icc_classes, queries.unified_ranking, comparisons.shape_preservation])
def test_neighbours_are_not_walked_in_lambdas(spark, query):
    """Smoothing and peaks come from batches: the plan has no column walk of the mirrored series."""
    plan = query(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and "pmod" not in plan


def test_curvature_smooths_in_batches(spark):
    plan = geometry.curvature(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "pmod" not in plan


def test_rounded_like_spark(spark):
    draw = np.random.default_rng(23)
    x = np.concatenate([draw.normal(size=2000), draw.integers(-4000, 4000, 4000) / 2048, draw.integers(-(10**10), 10**10, 4000) / 1e10 + 5e-11, [0.0, -0.0, -1e-12, 4.9999999995e-10, 5e-10, 1e-300, 2.5, 123456789.0123456785, 1e12 + 1 / 3, -4e15 / 3, 1e200]])
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x.tolist()], "x double").select(F.round("x", 9)).collect()]
    found = K.rounded(x, 9).tolist()
    assert [repr(v) for v in found] == [repr(v) for v in want]


def columns_of(x, prominence):
    """The features as column functions."""
    v = F.transform(S.savitzky_golay(S.minmax(S.resample(x, 100), 0.5, 1e-8)), lambda y: F.round(y, 9))
    return S.let(v, lambda v: S.lets(lambda down, up, low: F.array(
        F.size(up).cast("double"), F.size(low).cast("double"), S.at(v, F.lit(99)) - S.at(v, F.lit(0)), S.deviation(S.differences(v)), S.mirror_symmetry(v), S.determination(v, 1e-8),
        F.coalesce(P.tallest(v, up), S.argmax(v)) / 100.0, F.coalesce(P.tallest(down, low), S.argmin(v)) / 100.0,
    ), lambda: F.transform(v, lambda y: -y), lambda down: P.peaks(v, 10, prominence), lambda down, up: P.peaks(down, 10, prominence)))


def test_features_like_column_functions(spark):
    lists = cases()
    rows = [(i, x) for i, x in enumerate(lists) if x]
    x = F.col("x")
    df = spark.createDataFrame(rows, "i int, x array<double>").select("i", columns_of(x, 0.08), columns_of(S.compound(x), 0.05))
    want = {r[0]: (list(r[1]), list(r[2])) for r in df.collect()}
    array = pa.array([None, *lists, None], pa.list_(pa.float64()))
    for k, found in enumerate((K.shape_features(array, 0.08), K.shape_features(K.compound(array), 0.05))):
        found = [c.to_pylist() for c in found]
        assert all(c[0] is c[-1] is c[1 + lists.index([])] is None for c in found)
        # To the last digit: sums are taken in the same order.
        for i, _ in rows:
            assert [c[i + 1] for c in found] == want[i][k], i
    assert [len(c) for c in K.shape_features(array[:0], 0.08)] == [0] * len(K.FEATURES)


@pytest.mark.parametrize("query, most", [(queries.icc_thresholds, 2), (queries.icc_classes, 2)])
def test_features_are_worked_out_once(spark, query, most):
    """One pass for the windows and one for all features; no series is walked in lambdas."""
    plan = query(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == most and "array_append" not in plan and "aggregate(" not in plan
