"""The training sample of language identification and the bound of its tree."""

import numpy as np
from pyspark.sql import functions as F

from narrata.llm import languages


def test_sample(spark):
    """A language of few long texts has a sample, and none has more than the bound."""
    rows = [(i, f"{i} " + "äé" * 50_000, "long") for i in range(20)] + [(100 + i, f"text {i} of many", "many") for i in range(3000)] + [(9000, "all of it", "small"), (9001, "", "empty"), (9002, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {}
    for r in languages.sample(df, "doc_id", "text", "lang", 1000).collect():
        found.setdefault(r.lang, []).append(r.text)
    assert sorted(found) == ["long", "many", "small"] and found["small"] == ["all of it"]
    sizes = {k: sum(len(t.encode()) for t in v) for k, v in found.items()}
    assert len(found["long"]) == 1 and 998 <= sizes["long"] <= 1000 and sizes["many"] == 1000
    whole = {t for _, t, _ in rows if t}
    assert any(t.startswith(found["long"][0]) for t in whole) and sum(t not in whole for t in found["many"]) <= 1


def test_many_contexts(spark, monkeypatch):
    """Too many contexts: the rarest ones go, and there is a result."""
    rows = [(i, f"the cat and the dog {i * 7919}", "en") for i in range(60)] + [(100 + i, f"le chat et le chien {i * 7907}", "fr") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    full = languages.learn(df, "doc_id", "text", "lang")
    nodes = sum(len(c) - 1 for c in full.cost[1:]) + 1
    for name, most in (("MOST_NODES", 120), ("MOST_CELLS", 240)):
        with monkeypatch.context() as m:
            m.setattr(languages, name, most)
            trees = languages.learn(df, "doc_id", "text", "lang")
            assert 60 < sum(len(c) - 1 for c in trees.cost[1:]) + 1 <= 120 < nodes
            assert np.isfinite(trees.bits([b"the chat", b"\xff zz"])).all()
            judged = languages.predict(df, "text", trees).where(F.col("lang") != F.col("lang_pred"))
            assert judged.count() == 0
