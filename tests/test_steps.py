"""Ordered steps against all assignments and hand values."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from narrata.operators import steps as C


def test_assignments_against_all(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.integers(-5, 6, (draw.integers(1, 6), 3)).astype(float).tolist()) for i in range(40)]
    found = C.assigned(spark.createDataFrame(rows, "doc_id int, windows array<array<double>>").withColumn("best", C.ordered_score(F.col("windows"))), "windows").collect()
    for r in found:
        w = r.windows
        most = max(sum(w[i][s] for i, s in enumerate(path)) for path in itertools.combinations_with_replacement(range(3), len(w)))
        assert r.best == most and r.assigned == sorted(r.assigned) and sum(w[i][s] for i, s in enumerate(r.assigned)) == most


def test_scores(spark):
    hot = lambda s: [float(s == k) for k in range(4)]
    rows = [(1, i, hot(s)) for i, s in enumerate([0, 0, 1, 2, 3, 0])] + [(2, 0, hot(2))] + [(3, 5, hot(3)), (3, 1, hot(1)), (3, 2, None), (3, 3, [1.0])]
    df = spark.createDataFrame(rows, "doc_id int, at int, v array<double>")
    found = {r.doc_id: r for r in C.scores(C.likeness(df, "doc_id", "at", "v", [hot(s) for s in range(4)]), "windows", 4, (0, 3)).collect()}
    # The last move goes from the last step to the first, which counts.
    assert found[1].steps == [0, 0, 1, 2, 3, 0] and found[1].order_score == 1.0 and found[1].completeness == 1.0
    # Outer windows are 0 (before 0.9) and none behind 5.1: of 0 0 1 2 3 0 the first, third and fourth belong.
    assert abs(found[1].position_score - 3 / 6) < 1e-12 and abs(found[1].ordered_score - 5 / 6) < 1e-12
    assert (found[2].order_score, found[2].completeness) == (0.0, 0.25)
    # In the order of places; rows without a fitting vector are left out.
    assert found[3].steps == [1, 3] and found[3].order_score == 0.0
