"""Shifts of belief by plain counting, and twists by the stated rules."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.operators import beliefs as C


def brute(words, parts, smoothing=0.1):
    each, vocabulary = len(words) // parts, sorted(set(words))
    cut = [words[k * each : (k + 1) * each if k < parts - 1 else len(words)] for k in range(parts)]
    p = []
    for segment in cut:
        c = Counter(segment)
        p.append([(c[w] + smoothing) / (len(segment) + smoothing * len(vocabulary)) for w in vocabulary])
    kl = [None] + [sum(a * math.log2(a / b) for a, b in zip(p[k], p[k - 1])) for k in range(1, parts)]
    return kl, [-sum(a * math.log2(a) for a in row) for row in p]


def test_beliefs(spark, monkeypatch):
    monkeypatch.setattr(C, "CELLS", 64)
    draw = random.Random(3)
    texts = [[draw.choice("abcdefghijklmnop") * draw.randrange(1, 3) for _ in range(n)] for n in (1, 4, 50, 237)] + [[], None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t array<string>")
    found = C.beliefs(df, F.col("t"), 5).orderBy("doc_id", "state").collect()
    assert {r.doc_id for r in found} == {0, 1, 2, 3}
    for i in range(4):
        kl, entropy = brute(texts[i], 5)
        mine = [r for r in found if r.doc_id == i]
        assert mine[0].kl is None and [r.kl for r in mine[1:]] == pytest.approx(kl[1:], abs=1e-9) and [r.entropy for r in mine] == pytest.approx(entropy, abs=1e-9)


def test_twists(spark):
    draw = np.random.default_rng(2)
    rows, expected = [], []
    for d in range(12):
        kl = draw.uniform(0.4, 0.6, 19)
        kl[draw.integers(1, 19)] = 2.0
        entropy = 5 - 0.05 * (d % 3) * np.arange(20) + draw.normal(0, 0.01, 20)
        rows += [(d, s, s / 19, None if s == 0 else float(kl[s - 1]), float(entropy[s])) for s in range(20)]
        for s in range(1, 20):
            if kl[s - 1] > kl.mean() + 2 * kl.std():
                before = [k for k in range(20) if s / 19 - 0.2 <= k / 19 < s / 19]
                slope = np.polyfit(np.arange(len(before)), entropy[before], 1)[0] if len(before) > 1 else 0
                expected.append((d, s, (kl[s - 1] - kl.mean()) / kl.std(), max(0.0, min(1.0, -10 * slope))))
    rows += [(99, 0, 0.0, None, 1.0), (99, 1, 1.0, 9.0, 1.0)]
    found = sorted((r.doc_id, r.state, r.z, r.foreshadowing) for r in C.twists(spark.createDataFrame(rows, "doc_id int, state int, position double, kl double, entropy double")).collect())
    assert len(found) == len(expected) >= 12
    for a, b in zip(found, expected):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-6)
