"""Corpus operators and their queries against brute force."""

import itertools

from pyspark.sql import functions as F

from narrata.operators import corpus
from narrata.plans import queries, registry
from narrata.workspace import Workspace

assert queries


def test_translation_pairs(spark, tmp_path):
    rows = [(i, f"one two three {'four ' * (i % 7)}five", f"s{i % 3}") for i in [*range(990, 1011), 1999, 2000, 5003, 7100, 9007]] + [(i, "a b c", "sparse") for i in (1, 1500, 2500, 9999)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r.doc_id, r.other) for r in registry.QUERIES["translation_pairs"](spark, str(tmp_path)).collect()]
    of = {s: sorted(i for i, _, t in rows if t == s) for _, _, s in rows}
    assert sorted(found) == sorted(p for ids in of.values() for p in itertools.pairwise(ids))


def test_neighbours(spark):
    """More ranges than rows of a group, a group in all ranges, and rows without a group."""
    rows = [(i, "big", float(i)) for i in range(0, 4000, 3)] + [(i, f"g{i % 5}", float(i)) for i in range(40)] + [(i, None, float(i)) for i in (5, 1, 9)] + [(7, "single", 7.0)]
    df = spark.createDataFrame(rows, "i long, g string, v double").repartition(5, F.hash("i"))
    found = sorted((str(r.g), r.i, r.v, r.other, r.u) for r in corpus.neighbours(Workspace(spark, "test"), df, "g", "i", "v").collect())
    of = {s: sorted(i for i, t, _ in rows if t == s) for _, s, _ in rows}
    assert found == sorted((str(s), a, float(a), b, float(b)) for s, ids in of.items() for a, b in itertools.pairwise(ids))
