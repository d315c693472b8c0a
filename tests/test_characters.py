"""Names, aliases and characters of hand-made texts, and against brute force."""

import collections
import random
import re

from narrata.operators import characters as C

TEXT = (
    "Elizabeth Bennet smiled. \"Well,\" said Elizabeth. Mr. Darcy bowed to Miss Bennet and Elizabeth Bennet. Darcy said nothing. "
    "Then Jane Bennet asked Elizabeth about Mr. Darcy. Fitzwilliam Darcy replied. The Lizard ran. Elizabeth laughed."
)


def test_mentions_of_each_rule(spark):
    found = C.mentions(spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {1}
    for r in found:
        assert TEXT[r.place :].startswith(r.name) and r.size == len(TEXT)
    seen = collections.Counter((r.name, r.rule) for r in found)
    assert seen["Elizabeth", "word"] == 5 and seen["Darcy", "word"] == 4 and ("The", "word") not in seen
    # The first pair begins the text, the others follow a space.
    assert seen["Elizabeth Bennet", "pair"] == 1 and seen["Fitzwilliam Darcy", "pair"] == 1 and ("Jane Bennet", "pair") not in seen
    assert seen["Darcy", "title"] == 2 and seen["Bennet", "title"] == 1 and {r.title for r in found if r.name == "Darcy" and r.rule == "title"} == {"mr"}
    assert seen["Elizabeth", "speech"] == 2 and seen["Darcy", "speech"] == 2


def related(leader, name):
    """The rule as it is stated: contained, or the first word of a longer leader, or the last word of two longer names."""
    a, b = leader.split(" "), name.split(" ")
    return leader in name or name in leader or (len(a) > 1 and (a[0] == b[0] or (len(b) > 1 and a[-1] == b[-1])))


def test_leaders_against_all_comparisons():
    draw = random.Random(4)
    parts = ["Ann", "Anna", "Annabel", "Bell", "Bella", "Carr", "Carrington", "Dee", "Eve"]
    for _ in range(300):
        names = list({draw.choice(parts) if draw.random() < 0.5 else f"{draw.choice(parts)} {draw.choice(parts)}" for _ in range(draw.randrange(12))})
        order, expected = [], []
        for name in names:
            expected.append(next((x for x in order if related(x, name)), name))
            if expected[-1] == name:
                order.append(name)
        assert C.leaders(names) == expected


def test_characters_and_ties(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "no one here")], "doc_id long, text string")
    found = C.mentions(docs)
    names = C.counted(found, 2)
    resolved = C.aliases(names)
    to = {r.alias: r.character for r in resolved.collect()}
    assert to["Darcy"] == "Darcy" and to["Elizabeth"] == "Elizabeth" and set(to.values()) >= {"Elizabeth", "Darcy"}
    people = {r.character: r for r in C.characters(found, names, resolved, 2).collect()}
    assert len(people) == 2 and people["Darcy"].title == "mr" and people["Darcy"].place == 1 and people["Darcy"].mentions == 8
    # The first one covers half of the text, which is less than a protagonist does.
    assert people["Darcy"].role == "major" and people["Elizabeth"].role == "major" and people["Elizabeth"].first == 0.0 and people["Darcy"].speech == 2
    ties = {(r.n1, r.n2): r.n for r in C.ties(found, resolved, 60).collect()}
    brute = collections.Counter()
    told = [(to[r.name], r.place) for r in found.collect() if r.name in to]
    for i, (a, p) in enumerate(told):
        for b, q in told[i + 1 :]:
            if a != b and abs(p - q) < 60:
                brute[min(a, b), max(a, b)] += 1
    assert ties == dict(brute)


def test_long_runs_of_names_take_no_stack(spark):
    text = "Anna Bell " * 5_000
    row = C.counted(C.mentions(spark.createDataFrame([(1, text)], "doc_id long, text string")), 3).where("name = 'Anna'").first()
    assert (row.n, row.first, row.last) == (5_000, 0, len(text) - 10)


def test_orbits(spark):
    docs = spark.createDataFrame([(1, "Anna met Boris. Anna fought Boris. " + "x " * 40 + "Anna slept. Boris fought.")], "doc_id long, text string")
    found = C.mentions(docs, (), (), ())
    met = C.scenes(found, C.aliases(C.counted(found, 2)), 40)
    brute = collections.Counter()
    for r in found.where("rule = 'word'").collect():
        for k in (r.place // 20 - 1, r.place // 20):
            if k >= 0:
                brute[k, r.name] += 1
    assert {(r.scene, r.character): r.m for r in met.collect()} == dict(brute)
    people = {r.character: r for r in C.orbits(met, docs, {"conflict": r"\bfought\b"}, 40).collect()}
    weight = sum((brute[k, "Anna"] * brute[k, "Boris"]) ** 0.5 for k in {k for k, _ in brute})
    assert [(s.name, s.weight) for s in people["Anna"].satellites] == [("Boris", round(weight, 4))]
    assert people["Anna"].scenes == sorted(k for k, n in brute if n == "Anna") and people["Anna"].total == sum(m for (k, n), m in brute.items() if n == "Anna")
    text = docs.first().text
    assert [(e.kind, e.n) for e in people["Boris"].events] == [("conflict", sum(text[20 * k : 20 * k + 40].count("fought") for k, n in brute if n == "Boris"))]


def test_mentions_by_brute_force_without_a_shuffle(spark):
    """Texts of hard edges, against a walk over their words; no text or run of it is shuffled."""
    draw = random.Random(8)
    words = ["Ann", "Émile", "Øre", "the", "The", "was", "X", "Xy", "X1", "Ab_c", "ΑΒ", "Ελένη", "z", "𝒳y", "mR"]
    texts = ["".join(draw.choice(words) + draw.choice((" ", " ", "\n", ". ", ".", ".\t", "\u00a0", "  ", ", ", "\0")) for _ in range(draw.randrange(60))) for _ in range(120)]
    word, blank = re.compile(r"\w+"), re.compile(r"[ \t\n\r]+")
    name = lambda w: w.isalpha() and w[0].isupper() and w[1:].islower()
    expected = collections.Counter()
    for d, t in enumerate(texts):
        found = list(word.finditer(t))
        at = lambda i: found[i][0] if 0 <= i < len(found) else ""  # noqa: E731, B023
        gap = lambda i: t[found[i - 1].end() : found[i].start()] if 0 < i < len(found) else ""  # noqa: E731, B023
        joined = lambda i: bool(name(at(i)) and name(at(i - 1)) and blank.fullmatch(gap(i)))  # noqa: E731, B023
        spot = 0
        for i, m in enumerate(found):
            spot = spot + 1 if joined(i) else 0
            if not name(m[0]):
                continue
            stop, more, pair, place = m[0] == "The", joined(i + 1), f"{m[0]} {at(i + 1)}", m.start()
            if len(m[0]) >= 3 and not stop:
                expected[d, m[0], place, "word", None] += 1
            if more and spot % 2 == 0 and not stop and at(i + 1) != "The" and place > 0 and t[place - 1] not in ".!?\n":
                expected[d, pair, place, "pair", None] += 1
            if at(i - 1).lower() in ("the", "mr") and blank.fullmatch(gap(i).removeprefix(".")):
                expected[d, pair if more else m[0], place, "title", at(i - 1).lower()] += 1
            expected[d, m[0], place, "speech", None] += (not stop and at(i - 1) == "was" and blank.fullmatch(gap(i)) is not None) + (not stop and at(i + 1) == "was" and blank.fullmatch(gap(i + 1)) is not None)
    got = C.mentions(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), ("the", "mr"), ("was",), ("the",))
    assert collections.Counter((r.doc_id, r.name, r.place, r.rule, r.title) for r in got.collect()) == +expected and expected.total() > 500
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
