"""Personal data, hard negatives and phrases against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.llm import negatives, personal, phrases

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in match.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text) if valid(k, m[0])]


def words_of(text, i, j):
    """Two words before and one after, as the operator tells them."""

    def told(w):
        if re.search("[0-9@]", w):
            return "#"
        punct = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""
        return re.sub(rf"^{punct}(?=.)|(?<=.){punct}$", "", w.lower())

    left, right = [told(w) for w in text[max(0, i - 64) : i].split()], [told(w) for w in text[j : j + 64].split()]
    return (left[-2] if len(left) > 1 else "^"), (left[-1] if left else "^"), (right[0] if right else "$")


def brute_personal(texts, rounds=10):
    """Spans of texts in which no two identifiers stand next to each other."""
    edges, places = collections.defaultdict(set), []
    for n, text in enumerate(texts):
        base = base_spans(text)
        items = [(k, i, j) for k, i, j in base]
        for m in re.finditer(r"(?<!\S)[\"'(\[<{]*([^\s0-9@]*[0-9@]\S*)", text):
            core = re.sub("[^0-9A-Za-z]+$", "", m[1])
            i, j = m.start(1), m.start(1) + len(core)
            if len(core) > 3 and all(b <= i or a >= j for _, a, b in base):
                items.append((None, i, j))
                places.append((n, i, j, core.lower()))
        for kind, i, j in items:
            l2, l1, r1 = words_of(text, i, j)
            for pattern in {f"{l2} {l1} _", f"{l1} _", f"{l1} _ {r1}"}:
                edges[pattern].add((text[i:j].lower(), kind))
    known = {}
    for _ in range(rounds):
        witness = collections.defaultdict(lambda: collections.defaultdict(list))
        for found in edges.values():
            names = {x for x, _ in found}
            for kind in KINDS:
                scores = [1.0 for _, k in found if k == kind] + [known[x][1] for x, k in found if k is None and x in known and known[x][0] == kind]
                confidence = sum(scores) / (len(names) + 2)
                if len(scores) >= 3 and confidence >= 0.8:
                    for x, k in found:
                        if k is None:
                            witness[x][kind].append(confidence)
        new = {}
        for x, kinds in witness.items():
            score, kind = max((1 - math.prod(1 - c for c in cs), k) for k, cs in kinds.items())
            if score >= 0.8 and x not in known:
                new[x] = (kind, score)
        if not new:
            break
        known |= new
    added = [(n, known[x][0], i, j) for n, i, j, x in places if x in known]
    order = list(KINDS)
    return [sorted([*base_spans(t), *((k, i, j) for m, k, i, j in added if m == n)], key=lambda s: (order.index(s[0]), s[1])) for n, t in enumerate(texts)], known


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"Please write to user{i}@mail.example.com today" for i in range(100)]
    texts += [f"Please write to nick{i}(at)home today" for i in range(14)]
    texts += [f"Somebody may ping nick{i}(at)home anytime" for i in range(14)] + ["Somebody may ping late9(at)home, anytime", "all about (late9(at)home) here", "Version 4.0.1 of room12 is out", "no data at all"]
    expected, known = brute_personal(texts)
    assert {"nick3(at)home", "late9(at)home"} <= known.keys() and "room12" not in known
    found = personal.find(spark.createDataFrame(list(enumerate(texts)), "n long, text string").repartition(5), "text").collect()
    assert len(found) == len(texts)
    for r in found:
        assert [(s.kind, s.start, s.stop) for s in r.spans] == expected[r.n], r.text
        assert [(s.kind, s.start, s.stop) for s in r.base] == base_spans(texts[r.n])
        assert r.n_added == len(r.spans) - len(r.base)


ODD = [
    "a@b.c%d@e.f x.@y@z.com", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.01 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111-2 411111111111111", "+1 (401) 555-0199+44 20 7946 0958 +1 2", "é漢字😀 mail😀a@b.co 漢 +49 (30) 901820",
    "a" * 200_000 + "@", "a@b" + ".c" * 50_000, "9 " * 50_000, "1." * 50_000, "+1" + " " * 100_000, "", None, "@ 1 + . -", "--x@-.-", "..@a.b.", "1-2-3-4-5-6-7-8-9-0-1-2-3",
]


def test_base_spans_of_odd_texts(spark):
    rows = [(i, t, "own") for i, t in enumerate(ODD)] + [(0, ODD[0], "again"), (None, ODD[1], None)]
    found = personal.find(spark.createDataFrame(rows, "doc_id long, text string, n_email string"), "text").collect()
    assert sorted(found[0].asDict()) == sorted(["doc_id", "text", *personal.OUTPUTS])
    assert len(found) == len(rows)
    for r in found:
        assert [(s.kind, s.start, s.stop) for s in r.base] == base_spans(r.text or ""), (r.text or "")[:60]
    none = personal.find(spark.createDataFrame([], "doc_id long, text string"), "text", ["doc_id"])
    assert none.columns == ["doc_id", *personal.OUTPUTS] and none.collect() == []


def test_personal_data_stays_in_the_engine(spark):
    found = personal.find(spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string"), "text")
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().toString())
    assert personal.written(F.col("spans")) is not None and found.select(personal.written(F.col("spans"))).first()[0] == "email:0:6"


def brute_negatives(rows, positives=2, hard=2, low=50, high=95):
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and i is not None]
    out, seen = [], set()
    for a, lab, v in sorted(good, key=lambda r: (r[0], r[1], r[2])):
        if a % 5 or a in seen:
            continue
        seen.add(a)
        others = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in good if i != a and len(w) == len(v))
        own = [(-s, i) for s, i, m in others if m == lab][:positives]
        for rank, (score, p) in enumerate(own, 1):
            fit = [(-s, i) for s, i, m in others if m != lab and low * score <= 100 * -s <= high * score][:hard]
            out += [(a, p, n, i, score, s, rank) for n, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def unit(draw, n):
    v = [draw.gauss(0, 1) for _ in range(n)]
    return [x / math.hypot(*v) for x in v]


@pytest.mark.parametrize("ring,group", [(1024, 512), (7, 3)])
def test_hard_negatives(spark, ring, group):
    draw = random.Random(5)
    rows = [(i, [c + 0.3 * x for c, x in zip([1.0 if j == i % 4 else 0.0 for j in range(6)], unit(draw, 6))], i % 3) for i in range(160)]
    rows += [(200 + i, unit(draw, 4), i % 2) for i in range(20)]
    rows += [(300, None, 1), (305, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (310, [float("nan")] * 6, 1), (315, [float("inf")] * 6, 2), (320, [1.0] * 6, None), (None, [1.0] * 6, 1), (325, [], 1)]
    # Ties, a repeated row, an id with two vectors, zeros, and all negative.
    rows += [(400, [0.5] * 6, 0), (401, [0.5] * 6, 0), (402, [0.5] * 6, 1), (402, [0.5] * 6, 1), (405, [0.1] * 6, 0), (405, [0.9] * 6, 2), (410, [0.0] * 6, 1), (415, [-1.0] * 6, 7)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label int").repartition(4)
    found = negatives.mine(df, "vec_id", "v", F.col("label"), F.col("vec_id") % 5 == 0, 2, 2, ring=ring, group=group)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"]
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows)


def test_hard_negatives_of_large_components_and_none(spark):
    rows = [(i, [float(10**30 + i * 10**15), float(i % 7) * 1e29], i % 2) for i in range(30)]
    found = negatives.mine(spark.createDataFrame(rows, "id long, v array<double>, label int"), "id", "v", F.col("label"), F.col("id") % 5 == 0, 2, 2).collect()
    top = 2**63 - 1
    clip = lambda s: max(-top - 1, min(top, s))
    assert sorted(tuple(r) for r in found) == sorted((*x[:4], clip(x[4]), clip(x[5]), x[6]) for x in brute_negatives(rows))
    none = negatives.mine(spark.createDataFrame([], "id long, v array<float>, label int"), "id", "v", F.col("label"), F.lit(True), 2, 2)
    assert none.collect() == []


def test_bounds_spare_far_cells(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(i, [(10.0 if j == i % 8 else 0.0) + 0.1 * draw.gauss(0, 1) for j in range(8)], i % 8) for i in range(400)]
    met = []
    plain = negatives._local
    monkeypatch.setattr(negatives, "_local", lambda pairs, k, largest, window: (met.append(pairs.count()), plain(pairs, k, largest, window))[1])
    negatives.mine(spark.createDataFrame(rows, "id long, v array<double>, label int"), "id", "v", F.col("label"), F.col("id") % 5 == 0, 2, 2, ring=8, group=10).collect()
    assert met[0] < 0.6 * (400 / 8) * (80 / 10)


def brute_phrases(rows, longest=5, least=3, most=20):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang, low = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        kept = {p: a for p, a in found.items() if not any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())}
        best = []
        for p, a in kept.items():
            score, k = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, n, p.decode(), -a, left, right, totals[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(best)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("words", [1 << 22, 40])
def test_phrases(spark, words):
    draw = random.Random(3)
    vocabulary = ["The", "of", "état", "naïve", "x-y", "ÉCOLE", "and", "new", "york", "city", "漢字"]
    rows = [(" ".join(draw.choice(vocabulary) + draw.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(draw.randrange(40))), draw.choice(["en", "fr", None, "und"])) for _ in range(120)]
    rows += [("new york city hall", "en")] * 6 + [("one two three four five six seven", "de")] * 4 + [(None, "en"), ("", None), (" . , ", "fr"), ("alone", "es"), ("a a a a a a a a", "it"), ("word " * 5000, "pt")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    found = phrases.collocations(df.withColumn("phrase", F.lit(1)), "text", "lang", 5, 3, 100, 20, words=words)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(rows)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string"), "text", "lang", 5, 3).collect() == []
    with pytest.raises(ValueError):
        phrases.collocations(spark.createDataFrame([], "text string, lang string"), "text", "lang", 5, 3, share=90)


def test_scores_are_exact(spark):
    a, n, left, right = 9_999_999_999_999_937, 99_999_999_999_999_997, 10_000_000_019, 99_999_999_977
    row = spark.createDataFrame([(a // 10**6, n, left, right)], "a long, n long, l long, r long")
    assert row.select(phrases.score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).first()[0] == 1000 * (a // 10**6) * n // (left * right)


def test_digest_of_spans(spark):
    row = personal.find(spark.createDataFrame([(1, "x 10.0.0.1 a@b.co")], "doc_id long, text string"), "text").select(F.sha2(personal.written(F.col("base")), 256)).first()[0]
    assert row == hashlib.sha256(b"email:11:17,ip:2:10").hexdigest()


def test_phrases_do_not_shuffle_texts(spark):
    runs = spark.createDataFrame([], "lang string, key binary, ids binary")
    nothing = spark.sparkContext.broadcast({})
    plan = phrases.stepped(runs, 2, nothing, nothing, 1 << 10)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Sort" not in plan


def test_runs_are_cut_at_pieces():
    ids = np.array([1, 2, -1, 3, -1, 4, 5, 6, 7, 8, 9, -1, 2, -1], np.int32)
    parts = [p.tolist() for p in phrases.cut(ids, 5)]
    assert parts == [[1, 2, -1, 3, -1], [4, 5, 6, 7, 8, 9, -1], [2, -1]]
