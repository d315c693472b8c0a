"""Tails against exact fractions, closed forms and integrals, and the report of tests."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from narrata.functions import tails
from narrata.operators import validation


def exact_fisher(a, b, c, d):
    row, column, n = a + b, a + c, a + b + c + d
    ways = {k: math.comb(column, k) * math.comb(n - column, row - k) for k in range(max(0, row + column - n), min(row, column) + 1)}
    return float(Fraction(sum(w for w in ways.values() if w <= ways[a]), sum(ways.values())))


def test_fisher(spark):
    draw = random.Random(1)
    tables = [(0, 5, 5, 0), (1, 0, 0, 1), (3, 0, 0, 0), (8, 2, 1, 5), (200, 3, 900, 1)] + [tuple(draw.randrange(30) for _ in range(4)) for _ in range(40)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long").withColumn("p", tails.fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    for r in df.collect():
        assert r.p == pytest.approx(exact_fisher(r.a, r.b, r.c, r.d), rel=1e-6)


def integral(f, low, high, n=20000):
    h = (high - low) / n
    return h / 3 * (f(low) + f(high) + sum((4 if i % 2 else 2) * f(low + i * h) for i in range(1, n)))


def test_chi_squared_and_normal(spark):
    cases = [(x, k) for x in (0.001, 0.5, 3.84, 20.0, 150.0) for k in (1, 2, 3, 7, 40)]
    rows = spark.createDataFrame(cases, "x double, k int").select("*", tails.p_chi_squared(F.col("x"), F.col("k")).alias("p"), tails.p_normal(F.sqrt("x")).alias("z")).collect()
    for r in rows:
        assert r.z == pytest.approx(math.erfc(math.sqrt(r.x / 2)), rel=1e-9, abs=1e-14)
        if r.k == 1:
            expected = r.z
        elif r.k % 2 == 0:
            expected = math.exp(-r.x / 2) * sum((r.x / 2) ** i / math.factorial(i) for i in range(r.k // 2))
        else:
            # Two more degrees of freedom add a term.
            expected = r.z + sum((r.x / 2) ** (j / 2) * math.exp(-r.x / 2) / math.gamma(j / 2 + 1) for j in range(1, r.k, 2))
        assert r.p == pytest.approx(expected, rel=1e-6, abs=1e-8)


def test_student(spark):
    cases = [(t, d) for t in (0.0, 0.3, 2.0, -5.0, 40.0) for d in (1.0, 2.0, 7.5, 300.0)]
    for r in spark.createDataFrame(cases, "t double, d double").withColumn("p", tails.p_student(F.col("t"), F.col("d"))).collect():
        t = abs(r.t)
        if r.d == 1:
            expected = 1 - 2 / math.pi * math.atan(t)
        elif r.d == 2:
            expected = 1 - t / math.sqrt(2 + t * t)
        else:
            scale = math.exp(math.lgamma((r.d + 1) / 2) - math.lgamma(r.d / 2)) / math.sqrt(r.d * math.pi)
            expected = 1 - 2 * integral(lambda v, d=r.d: scale * (1 + v * v / d) ** (-(d + 1) / 2), 0.0, t)
        assert r.p == pytest.approx(expected, rel=1e-6, abs=1e-9)


def test_report(spark):
    rows = [(i % 2 == 0, "x" if i % 4 else "y", float(i % 2) + i / 100, None if i == 3 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "first boolean, label string, m double, same double")
    found = {(r.test, r.metric): r for r in validation.report(df, F.col("first"), "label", ["m", "same"]).collect()}
    assert set(found) == {("chi_squared", "label"), ("mann_whitney", "m"), ("mann_whitney", "same")}
    assert found["mann_whitney", "m"].significant and found["mann_whitney", "same"].p == 1.0 and not found["mann_whitney", "same"].significant
    assert found["mann_whitney", "same"].n2 == 29
    # Of all comparisons of the two groups.
    a, b = [r[2] for r in rows if r[0]], [r[2] for r in rows if not r[0]]
    assert found["mann_whitney", "m"].statistic == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    welch = validation.metric(df, F.col("first"), "m", parametric=True).first()
    assert welch.test == "welch" and welch.p < 1e-10 and welch.band == "large"


def test_report_of_few(spark):
    df = spark.createDataFrame([(True, "x", 1.0), (None, "y", 2.0), (False, None, None)], "first boolean, label string, m double")
    rows = validation.report(df, F.col("first"), "label", ["m"]).collect()
    assert [(r.p, r.significant, r.note is not None) for r in rows] == [(1.0, False, True)] * 2
    small = spark.createDataFrame([(True, "x")] * 4 + [(False, "y")] * 3 + [(False, "x")], "first boolean, label string")
    r = validation.labels(small, F.col("first"), "label").first()
    assert (r.test, r.p) == ("fisher", round(exact_fisher(4, 0, 1, 3), 6))
