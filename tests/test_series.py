"""Series, window and statistics functions against numpy and hand-made values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.functions import peaks as P
from narrata.functions import series as S
from narrata.functions import text as X
from narrata.operators import functors, statistics, windows

CASES = [[1.0, 2.0, 5.0, 9.0], [3.0] * 6, [0.5], np.random.default_rng(3).normal(size=37).tolist()]


def value(spark, x, f, kind="array<double>"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(f(F.col("x")).alias("v")).first().v


@pytest.mark.parametrize("x", CASES, ids=len)
def test_scaling(spark, x):
    a = np.array(x)
    spread = a.max() - a.min()
    assert np.allclose(value(spark, x, S.minmax), (a - a.min()) / spread if spread else 0 * a)
    assert np.allclose(value(spark, x, S.mean), a.mean()) and np.allclose(value(spark, x, S.variance), a.var())
    off = np.cumsum(a - a.mean())
    assert np.allclose(value(spark, x, S.compound), off / max(abs(off.min()), abs(off.max()), 1.0))


@pytest.mark.parametrize("x", [c for c in CASES if len(c) >= 6], ids=len)
def test_smoothing(spark, x):
    a = np.array(x)
    assert np.allclose(value(spark, x, lambda c: S.moving_average(c, 5)), np.convolve(a, np.ones(5) / 5, mode="same"))
    reach = 8
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / 2.0) ** 2)
    mirrored = np.pad(a, reach, mode="symmetric")
    assert np.allclose(value(spark, x, lambda c: S.gaussian(c, 2.0)), np.convolve(mirrored, kernel / kernel.sum(), mode="valid"))


def test_resample(spark):
    for x in (CASES[0], CASES[3]):
        want = np.interp(np.linspace(0, len(x) - 1, 20), np.arange(len(x)), x)
        assert np.allclose(value(spark, x, lambda c: S.resample(c, 20)), want)


def test_cubic_series_stay(spark):
    x = [0.01 * i**3 - 0.2 * i * i + i for i in range(25)]
    assert np.allclose(value(spark, x, S.savitzky_golay), x)
    assert value(spark, x[:5], S.savitzky_golay) == x[:5]


def test_peaks(spark):
    assert value(spark, [0.0, 1.0, 1.0, 0.0, 2.0, 0.0], P.maxima) == [1, 4]
    assert value(spark, [0.0, 0.0], P.maxima) == []
    assert value(spark, [0.0, 3.0, 0.0, 2.0, 0.0], lambda c: P.peaks(c, 3)) == [1]
    assert value(spark, [0.0, 3.0, 2.5, 2.8, 0.0], lambda c: P.peaks(c, 1, 1.0)) == [1]


def test_entropy(spark):
    assert abs(value(spark, ["a", "a", "b", "c"], S.entropy, "array<string>") - 1.5) < 1e-12
    assert value(spark, [], S.entropy, "array<string>") == 0 and value(spark, ["a", "a"], S.normal_entropy, "array<string>") == 0


def test_word_windows(spark):
    found = value(spark, "a b c d e f g h i", lambda c: windows.word_windows(X.words(c), 4, 2), "string")
    assert found == [list("abcd"), list("cdef"), list("efgh"), list("ghi")]
    assert value(spark, "a", lambda c: windows.word_windows(X.words(c), 4, 2), "string") == [["a"]]
    assert value(spark, None, lambda c: windows.word_windows(X.words(c), 4, 2), "string") == [[]]


def test_mann_whitney(spark):
    draw = random.Random(4)
    rows = [(draw.random() < 0.4, float(draw.randint(0, 9))) for _ in range(80)]
    a, b = ([v for g, v in rows if g is side] for side in (True, False))
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    out = statistics.mann_whitney(spark.createDataFrame(rows, "g boolean, v double"), F.col("g"), "v").first()
    assert (out.n1, out.n2, out.u) == (len(a), len(b), u) and abs(out.auc - u / len(a) / len(b)) < 1e-6


def test_agreement(spark):
    df = spark.createDataFrame([(i % 3, "xyz"[i % 3], i) for i in range(12)], "a int, b string, v int")
    assert statistics.adjusted_rand(df, "a", "b").first().ari == 1.0
    assert abs(statistics.spearman(df.withColumn("w", F.col("v") * F.col("v")), "v", "w").first().rho - 1.0) < 1e-9


def test_variance_at_a_bound_is_that_of_sql(spark):
    """Lengths of sentences whose variance is exactly 20: the last digit of running means decides, as in SQL."""
    import duckdb

    draw, rows = random.Random(5), []
    while len(rows) < 60:
        x = [draw.randrange(1, 20) for _ in range(draw.randrange(2, 9))]
        if len(x) * sum(v * v for v in x) - sum(x) ** 2 == 20 * len(x) ** 2:
            rows.append([float(v) for v in x])
    engine = duckdb.connect()
    expected = [engine.execute("SELECT list_var_pop(?::DOUBLE[])", [x]).fetchall()[0][0] for x in rows]
    assert any(v != 20 for v in expected)
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x array<double>")
    assert [r.v for r in df.select("i", S.running_variance(F.col("x")).alias("v")).orderBy("i").collect()] == expected
    words = [" ".join(" ".join(["and"] * int(n)) + "." for n in x).split(" ") for x in rows]
    arousal = functors.arousal(F.col("w"))
    scores = spark.createDataFrame(list(enumerate(words)), "i int, w array<string>").select("i", arousal.alias("v")).orderBy("i").collect()
    assert [r.v > 0.5 for r in scores] == [sum(x) / len(x) < 10 and v > 20 for x, v in zip(rows, expected, strict=True)]
