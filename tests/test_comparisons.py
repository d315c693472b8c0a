"""Metrics, peaks, sides, ways and roles on hand-made values; long series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.functions import series as S
from narrata.operators import comparisons as C


def test_slope_and_determination_of_a_long_series(spark):
    n = 60_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * 0.5 + F.pmod(i, F.lit(7))).alias("x"))
    row = df.select(S.slope(F.col("x")).alias("b"), S.determination(F.col("x")).alias("r2")).first()
    x = np.arange(n) * 0.5 + np.arange(n) % 7
    assert row.b == pytest.approx(np.polyfit(np.arange(n), x, 1)[0])
    assert row.r2 == pytest.approx(np.corrcoef(np.arange(n), x)[0, 1] ** 2)


def test_entropy_metrics(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 5.0, 9.0]), (2, [3.0]), (3, []), (4, None)], "id long, x array<double>")
    got = {r.id: r for r in C.entropy_metrics(df, "x").withColumn("structure", C.entropy_structure()).collect()}
    assert sorted(got) == [1, 2]
    r = got[1]
    assert (r.n, r.mean, r.highest, r.lowest, r.change, r.cliff, r.resolution) == (4, 4.25, 9.0, 1.0, 8.0, 4.75, 0.0)
    assert r.variance == pytest.approx(3.112475**2, abs=1e-5) and r.slope == pytest.approx(2.7)
    assert (r.q1, r.q2, r.q3, r.q4, r.highest_at, r.lowest_at, r.tail) == (1.0, 2.0, 5.0, 9.0, 0.75, 0.0, 9.0)
    assert r.spike == 3.5 and r.structure == "tragedy"
    assert got[2].q1 is None and got[2].q4 == 3.0 and got[2].structure == "slice_of_life"


@pytest.mark.parametrize(
    ("x", "structure"),
    [([1.0, 1.0, 3.0, 1.0], "kishotenketsu"), ([9.0, 9.0, 9.0, 12.0, 9.5], "mystery"), ([5.0, 3.0, 1.0, 3.0, 4.0], "man_in_hole"), ([5.0, 5.0, 5.0, 5.0], "slice_of_life"), ([9.0, 1.0, 1.0, 1.0], "unclassified")],
)
def test_structures(spark, x, structure):
    df = C.entropy_metrics(spark.createDataFrame([(1, x)], "id long, x array<double>"), "x")
    assert df.select(C.entropy_structure().alias("s")).first().s == structure


def test_peaks(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0, 2.0, 2.0, 0.0, 3.0, 0.0], [0.0, 0.0, 1.0, 0.0, 0.0]), ([1.0], [1.0])], "x array<double>, y array<double>")
    p, q = C.peak_places(F.col("x")), C.peak_places(F.col("y"))
    got = df.select(p.alias("p"), q.alias("q"), C.peak_alignment(p, q, 10).alias("a")).collect()
    assert (got[0].p, got[0].q) == ([1, 6], [2]) and got[0].a == pytest.approx(1 - 2.5 / 10)
    assert got[1].a == 0.0


def test_presence(spark):
    df = spark.createDataFrame([(1, [2, 0, 1], [0, 4, 1]), (2, [0], [0])], "id long, a array<int>, b array<int>")
    got = sorted((r.id, r.win_idx, r.a, r.b, r.share) for r in C.presence(df, "a", "b").collect())
    assert got == [(1, 0, 0.5, 0.0, 1.0), (1, 1, 0.0, 1.0, 0.0), (1, 2, 0.25, 0.25, 0.5), (2, 0, 0.0, 0.0, 0.0)]


def test_way(spark):
    df = spark.createDataFrame([(1, 0, 3.0, 4.0), (1, 1, -3.0, -4.0), (1, 2, 0.0, 2.0)], "doc_id long, idx int, d_a double, d_b double")
    assert tuple(C.way(df, ["a", "b"]).first()) == (1, 12.0, 5.0, 2.0)


def test_roles(spark):
    rows = [(1, i, "Ann") for i in range(10)] + [(1, i, "Bob") for i in (0, 2, 4, 8)] + [(1, 3, "Cy"), (1, 4, "Cy"), (1, 5, "Dee")]
    found = spark.createDataFrame(rows, "doc_id long, sent int, name string")
    got = {r.name: (r.mentions, r.place, r.role) for r in C.roles(found, spark.createDataFrame([(1, 9)], "doc_id long, last int")).collect()}
    assert got == {"Ann": (10, 1, "protagonist"), "Bob": (4, 2, "major"), "Cy": (2, 3, "supporting"), "Dee": (1, 4, "minor")}
