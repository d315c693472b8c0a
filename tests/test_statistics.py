"""Resampling, ranks and strata on repeated, null and outlying rows."""

import random

from pyspark.sql import functions as F

from narrata.operators import corpus, graphs, statistics
from narrata.workspace import Workspace


def test_bootstrap(spark):
    rows = [(i, float(1 + i % 2)) for i in range(100)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, v double")
    mean = statistics.bootstrap(df, "id", "v", 400).first()
    # The standard error of the mean of 50 ones and 50 twos is 0.05.
    assert mean.point == 1.5 and 1.36 < mean.low < 1.44 and 1.56 < mean.high < 1.64
    median, std = (statistics.bootstrap(df, "id", "v", 50, statistic=s).first() for s in ("median", "std"))
    assert 1 <= median.low <= median.high <= 2 and abs(std.point - 0.5) < 1e-9 and std.low < 0.5 + 1e-9
    gap = statistics.bootstrap(df, "id", "v", 200, first=F.col("id") % 2 == 0).first()
    assert gap.point == gap.low == gap.high == -1.0
    assert statistics.bootstrap(df.limit(0), "id", "v", 10).first().point is None


def test_permutation(spark):
    same = spark.createDataFrame([(i, 3.0, i < 20) for i in range(50)] + [(99, None, True)], "id long, v double, g boolean")
    assert statistics.permutation_test(same, "id", F.col("g"), "v", 100).first().p_value == 1.0
    apart = spark.createDataFrame([(i, float(i % 5 + 10 * (i < 25)), i < 25) for i in range(50)], "id long, v double, g boolean")
    found = statistics.permutation_test(apart, "id", F.col("g"), "v", 100).first()
    assert abs(found.p_value - 1 / 101) < 1e-9 and abs(found.difference - 10) < 1e-9


def test_ranks(spark):
    draw = random.Random(2)
    values = [round(draw.random(), 2) for _ in range(300)] + [1e12, None, -1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    some = sorted(v for v in values if v is not None)
    for r in statistics.average_ranks(Workspace(spark, "t"), df, "v").collect():
        assert (r.before, r.n, r["rank"]) == (some.index(r.value), some.count(r.value), some.index(r.value) + (some.count(r.value) + 1) / 2)


def test_strata(spark):
    df = spark.createDataFrame([(i, None if i < 50 else f"s{i % 7}") for i in range(200)], "id long, s string")
    found = corpus.stratified_sample(df, "id", "s", 40).collect()
    assert len(found) == len({r.id for r in found}) == 40 and 9 <= sum(r.s is None for r in found) <= 12
    many = spark.createDataFrame([(i, i) for i in range(150)], "id long, s long")
    assert corpus.stratified_sample(many, "id", "s", 100).count() == 100
    assert corpus.stratified_sample(many, "id", "s", 500).count() == 150


def test_mentions_in_reach(spark):
    rows = [(1, "Anna met Bertram. " + "x" * 30 + " Carl saw Anna"), (2, ""), (3, None)]
    found = graphs.near_names(spark.createDataFrame(rows, "doc_id long, text string"), r"\b\p{Lu}\p{Ll}{2,}\b", 30).collect()
    assert {(r.doc_id, r.n1, r.n2): r.n for r in found} == {(1, "Anna", "Bertram"): 1, (1, "Anna", "Carl"): 1}
