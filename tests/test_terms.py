"""Large lexicons against brute force, with 50,000 terms."""

import random

import pytest
from pyspark.sql import functions as F

from narrata.operators import terms as C


@pytest.fixture(scope="module")
def lexicon():
    draw = random.Random(6)
    found = {"".join(draw.choice("abcdeあ漢é") for _ in range(draw.randrange(2, 9))): draw.randrange(-5, 6) for _ in range(90_000)}
    assert len(found) >= 50_000
    return found


def leftmost_longest(text, terms):
    out, i = [], 0
    while i < len(text):
        n = next((n for n in range(8, 0, -1) if text[i : i + n] in terms and i + n <= len(text)), 0)
        if n:
            out.append((i, i + n, float(terms[text[i : i + n]])))
        i += n or 1
    return out


def test_terms_anywhere(spark, lexicon):
    draw = random.Random(8)
    texts = ["".join(draw.choice("abcdeあ漢é x") for _ in range(draw.randrange(300))) for _ in range(80)] + ["", None, "zzz"]
    shared = C.shared(spark.createDataFrame([*lexicon.items(), (None, 1), ("", 2)], "term string, value int"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    for r in C.found(df, "text", shared).collect():
        assert [(f.start, f.stop, f.value) for f in r.found] == leftmost_longest(texts[r.doc_id] or "", lexicon)


def test_beginnings_of_words(spark, lexicon):
    draw = random.Random(9)
    lists = [["".join(draw.choice("abcdeあ漢é") for _ in range(draw.randrange(1, 12))) for _ in range(draw.randrange(40))] for _ in range(50)] + [None]
    shared = C.shared(spark.createDataFrame(list(lexicon.items()), "term string, value int"))
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id int, w array<string>").repartition(3)
    for r in C.word_values(df, F.col("w"), shared).collect():
        expected = [next((float(lexicon[w[:n]]) for n in range(len(w), 0, -1) if w[:n] in lexicon), None) for w in lists[r.doc_id] or []]
        assert r["values"] == expected


def test_scores_and_bounds(spark, monkeypatch):
    shared = C.shared(spark.createDataFrame([("good", 4), ("bad", -2), ("good", 3)], "term string, value int"))
    df = spark.createDataFrame([(1, "good bad not good"), (2, "nothing")], "doc_id int, text string")
    both = C.found(df, "text", shared).join(df, "doc_id").select("doc_id", C.compound(C.negated(F.col("found"), F.col("text"), (" not",))).alias("s")).collect()
    assert {r.doc_id: round(r.s, 9) for r in both} == {1: round((4 + 2 + 4) / 3 / 5, 9), 2: 0.0}
    monkeypatch.setattr(C, "MOST_TERMS", 1)
    with pytest.raises(ValueError):
        C.shared(spark.createDataFrame([("a", 1), ("b", 1)], "term string, value int"))
    assert C.shared(spark.createDataFrame([], "term string, value int")).value == {}


def test_negations_are_told_where_the_text_is(spark):
    """A long text's terms are turned as by brute force; the plan has no join or shuffle, whose text would be walked for each term."""
    from narrata.plans import terms as plans

    draw = random.Random(3)
    texts = ["".join(draw.choice(("good", "bad", " not", " no", "é", " ")) for _ in range(n)) for n in (60_000, 50, 1, 0)] + [None]
    terms = {"good": 4.0, "bad": -2.0, "goodbad": 1.0}
    shared = C.shared(spark.createDataFrame(list(terms.items()), "term string, value double"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in C.found(df, "text", shared, negations=(" not", " no ")).collect():
        expected = leftmost_longest(texts[r.doc_id] or "", terms)
        assert [(f.start, f.stop, f.value) for f in r.found] == [(a, b, -v if texts[r.doc_id].startswith((" not", " no "), b) else v) for a, b, v in expected]
    plan = plans.term_compound(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
