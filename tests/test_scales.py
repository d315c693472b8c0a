"""Segments at four scales by plain Python, and what their shapes say."""

import re

import numpy as np
from pyspark.sql import functions as F

from narrata.functions import series as S
from narrata.operators import detectors, scales

BODY = "It was so. " * 30
MARKED = "Preface.\n" + "".join(f"\nChapter {i}\n{BODY}\n\n{BODY}\n" for i in range(1, 4)) + "\nChapter 4\nshort"
BROKEN = "".join(f"{BODY}\n\n\n" for _ in range(4)) + BODY
RULES = scales.Rules(least=200, least_paragraph=50, sections=3)


def brute(text):
    """(level, start, stop) by the same rules in plain Python."""
    out = [("work", 0, len(text))]

    def marked(patterns, marks):
        for p in patterns:
            at = [m.start() for m in re.finditer(p, text)]
            if len(at) >= marks:
                return [(a, b) for a, b in zip(at, [*at[1:], len(text)]) if b - a >= RULES.least]
        return None

    chapters = marked(scales.CHAPTERS, 2)
    if chapters is None:
        n = len(text) // 6
        chapters = [x for i in range(6) if (x := (i * n, len(text) if i == 5 else (i + 1) * n))[1] > x[0]]
    paragraphs, at = [], 0
    for m in [*re.finditer(RULES.paragraph, text), None]:
        part = text[at : m.start() if m else len(text)]
        start = at + len(part) - len(part.lstrip())
        if len(part.strip()) >= RULES.least_paragraph:
            paragraphs.append((start, start + len(part.strip())))
        at = m.end() if m else at
    sections = marked(scales.BREAKS, 3)
    if sections is None:
        each = len(paragraphs) // RULES.sections
        sections = paragraphs if len(paragraphs) <= RULES.sections else [(paragraphs[i * each][0], (paragraphs[-1] if i == RULES.sections - 1 else paragraphs[(i + 1) * each - 1])[1]) for i in range(RULES.sections)]
    return out + [("chapter", *x) for x in chapters] + [("section", *x) for x in sections] + [("paragraph", *x) for x in paragraphs]


def test_segments(spark):
    texts = [MARKED, BROKEN, "第一章\n" + "あ" * 300 + "。\n　" + "い" * 300 + "\n第二章\n" + "う" * 300, "short text", "x" * 700, "  \n\n  ", ""]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string")
    found = scales.segments(df, RULES).collect()
    for i, t in enumerate(texts):
        mine = [r for r in found if r.doc_id == i]
        assert [(r.level, r.start, r.stop) for r in mine] == brute(t)
        assert all(r.body == t[r.start : r.stop] for r in mine)
        for level in scales.LEVELS:
            assert [r.idx for r in mine if r.level == level] == list(range(sum(r.level == level for r in mine)))
    assert [(r.level, r.stop) for r in found if r.doc_id == 99] == [("work", 0)]


def test_parents_hold_the_beginnings(spark):
    rows = scales.nested(scales.segments(spark.createDataFrame([(1, MARKED), (2, BROKEN)], "doc_id long, text string"), RULES)).collect()
    above = dict(zip(scales.LEVELS[1:], scales.LEVELS[:-1]))
    assert {r.parent for r in rows if r.level == "chapter"} == {0}
    for r in rows:
        if r.level != "work":
            holders = [p.idx for p in rows if p.doc_id == r.doc_id and p.level == above[r.level] and p.start <= r.start < p.stop]
            assert r.parent == (max(holders) if holders else None)


def shape(v):
    v, n = np.array(v, float), len(v)
    if n < 4:
        return "unknown"
    q = n // 4
    q1, q2, q3, q4 = v[:q].mean(), v[q : 2 * q].mean(), v[2 * q : 3 * q].mean(), v[3 * q :].mean()
    end, mid = v[-n // 4 :].mean(), v[q : 3 * n // 4].mean()
    low, high = mid < (q1 + end) / 2 * 0.9, mid > (q1 + end) / 2 * 1.1
    if end > q1 * 1.1 and not low and not high:
        return "rags_to_riches"
    if end < q1 * 0.9 and not low and not high:
        return "tragedy"
    if low or high:
        return "man_in_hole" if low else "icarus"
    if q4 > q2 and (q1 < q2 or q3 < q4):
        return "cinderella"
    return "oedipus" if q2 > q4 and (q1 > q2 or q3 > q4) else "other"


def test_shapes(spark):
    draw = np.random.default_rng(1)
    series = [[1.0, 2.0, 3.0], [1, 2, 3, 4.0], [4, 3, 2, 1.0], [3, 1, 1, 3.0], [1, 3, 3, 1.0], [2.0] * 9, [1, 1.04, 1, 1.05]] + [draw.uniform(0.8, 1.2, draw.integers(4, 30)).round(3).tolist() for _ in range(60)]
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(series)], "i int, x array<double>").select("i", scales.scale_shape(F.col("x")).alias("s")).collect()
    assert {r.i: r.s for r in rows} == {i: shape(x) for i, x in enumerate(series)}


def test_consistency(spark):
    def row(level, idx, shape, parent=None, doc=1, size=600):
        return (doc, level, idx, idx * size, (idx + 1) * size, parent, shape)

    rows = [row("work", 0, "a")] + [row("chapter", i, s, 0) for i, s in enumerate("aab")] + [row("section", i, s, 0) for i, s in enumerate("bbaa")] + [row("section", 4, "c", 0, size=10)]
    rows += [row("work", 0, "a", doc=2), row("chapter", 0, "b", 0, 2)]
    found = {r.doc_id: r for r in scales.consistency(spark.createDataFrame(rows, "doc_id int, level string, idx int, start long, stop long, parent int, shape string")).collect()}
    # Sections are two of b and two of a: the first comes first; the short one is not asked.
    assert (found[1].work, found[1].chapter, found[1].section, found[1].consistency) == ("a", "a", "b", 0.5)
    assert abs(found[1].agreeing - 4 / 7) < 1e-9
    assert (found[2].chapter, found[2].section, found[2].consistency, found[2].agreeing) == (None, None, 0.0, 0.0)


def test_nested_acts_are_those_of_the_chapters_alone(spark):
    draw = np.random.default_rng(3)
    bodies = [" ".join(map(str, draw.uniform(0, 1, 60).round(3))) for _ in range(40)]
    series = lambda body: F.transform(F.split(body, " "), lambda v: v.cast("double"))
    rows = [(1, "work", 0, 0, 40_000, " ")] + [(1, "chapter", i, 1000 * i, 1000 * i + (10 if i == 5 else 900), b) for i, b in enumerate(bodies)]
    found = scales.nested_acts(spark.createDataFrame(rows, "doc_id int, level string, idx int, start long, stop long, body string"), series, 500).collect()
    alone = detectors.with_detectors(spark.createDataFrame(list(enumerate(bodies)), "i int, body string").select("i", series(F.col("body")).alias("x")), "x", ("four_act",)).collect()
    assert {(r.idx, r.pattern) for r in found} == {(r.i, r.four_act.pattern) for r in alone if "kishotenketsu" in r.four_act.pattern and r.i != 5}
    assert all(abs(r.position - (1000 * r.idx + 450) / 40_000) < 1e-12 for r in found)


def test_running_sums(spark):
    lists = [[], [1.0], [float(i % 7) for i in range(1000)]]
    rows = spark.createDataFrame([(x,) for x in lists], "x array<double>").select("x", S.running(F.col("x")).alias("s")).collect()
    assert all(list(r.s) == np.cumsum(r.x).tolist() for r in rows)
