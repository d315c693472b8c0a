"""Graph operators and their queries against brute force."""

import collections
import itertools
import re

import pytest

from narrata.operators import graphs
from narrata.plans import queries, registry

assert queries

TEXTS = [
    "Anna met Bob and Anna. Eva, McDonald and Élodie saw Übermensch; Al Xy BOB xAnna Anna_2 Anna2 Zoé.",
    "Anna \u0001Bob " + "x" * 1190 + " Carla " + "y " * 300 + "Anna Bob Carla Dora " * 40,
    "Müller" + " " * 1194 + "Maier " + " " * 1193 + "Marta",
    "",
    None,
]


def brute(text, reach):
    """Python's own letters: capitals and small ones of these texts."""
    places = [(m.group(), m.start()) for m in re.finditer(r"\b[A-ZÉÜ][a-zéü]{2,}\b", text or "")]
    return collections.Counter(tuple(sorted((a, b))) for (a, p), (b, q) in itertools.combinations(places, 2) if a != b and abs(p - q) < reach)


@pytest.mark.parametrize("step", [graphs.STEP_PAIRS, 7])
def test_mentions_in_reach(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(graphs, "STEP_PAIRS", step)
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.n1, r.n2): r.n for r in registry.QUERIES["mentions_in_reach"](spark, str(tmp_path)).collect()}
    assert found == {(i, *pair): n for i, text in enumerate(TEXTS) for pair, n in brute(text, 1200).items()}
    assert (2, "Maier", "Müller") not in found and found[0, "Anna", "Bob"] == 2
