"""A text at four scales: the work, its chapters, its sections, its paragraphs.

Segments are an interval table (level, idx, start, stop) in characters of the
text, made in the text's row by marks where it has some, and else by length or
by runs of paragraphs. A segment's parent is the segment of the level above in
which it begins: that is told by a window over a document's segments in the
order of their beginnings, not by a join. Each segment has a series of its own,
whose shape is compared across scales.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import series as S
from narrata.operators import detectors
from narrata.workspace import Workspace

LEVELS = ("work", "chapter", "section", "paragraph")
# Marks of chapters and breaks between scenes, tried in this order.
CHAPTERS = (
    r"(?:^|\n)(?:Chapter|CHAPTER)\s+(?:\d+|[IVXLC]+|[A-Z][a-z]*)", r"(?:^|\n)(?:Part|PART)\s+(?:\d+|[IVXLC]+|[A-Z][a-z]*)", r"(?:^|\n)(?:Book|BOOK)\s+(?:\d+|[IVXLC]+|[A-Z][a-z]*)",
    r"(?:^|\n)第[一二三四五六七八九十百千\d]+[章回話編節部]", r"(?:^|\n)[一二三四五六七八九十]+[\s　、]", r"(?:^|\n)【[^】]+】", r"(?:^|\n)(?:\d+\.|\(\d+\)|\[\d+\])\s+",
)
BREAKS = (r"\n\s*\*\s*\*\s*\*\s*\n", r"\n\s*[*#-]{3,}\s*\n", r"\n\n\n+", r"(?:^|\n)　　[＊＃—]{3,}")
PARAGRAPH = r"\n\n+|(?<=。)\n(?=　)"
#: White space of any script.
_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


@dataclass(frozen=True)
class Rules:
    """Marks and sizes: the fewest marks that count, the least characters of a marked segment and of a paragraph, and how many parts there are without marks."""

    chapters: tuple[str, ...] = CHAPTERS
    breaks: tuple[str, ...] = BREAKS
    paragraph: str = PARAGRAPH
    chapter_marks: int = 2
    break_marks: int = 3
    least: int = 1000
    least_paragraph: int = 50
    parts: int = 6
    sections: int = 12


def _span(start: Column, stop: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))


def _cut(text: Column, pattern: str) -> tuple[Column, Column]:
    """What lies between the matches, and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _marked(text: Column, pattern: str, marks: int, least: int) -> Column:
    """Segments from each match to the next; null with too few matches."""
    gaps, found = _cut(text, pattern)

    def spans(sums: Column) -> Column:
        # sums[i]: end of match i.
        starts = F.transform(found, lambda m, i: F.get(sums, i) - F.length(m))
        return S.let(starts, lambda s: F.filter(F.transform(s, lambda a, i: _span(a, F.coalesce(F.get(s, i + 1), F.length(text).cast("double")))), lambda x: x["stop"] - x["start"] >= least))

    ends = S.running(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("double")))
    return F.when(F.size(found) >= marks, S.let(ends, spans))


def _paragraphs(text: Column, pattern: str, least: int) -> Column:
    """Parts between separators, without white space around them, that are long enough."""
    parts, seps = _cut(text, pattern)
    lengths = F.zip_with(parts, seps, lambda p, s: (F.length(p) + F.coalesce(F.length(s), F.lit(0))).cast("double"))

    def spans(sums: Column) -> Column:
        whole = F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.coalesce(F.get(sums, i - 1), F.lit(0.0)).alias("a")))
        bare = F.transform(whole, lambda x: S.let(F.length(x["p"]) - F.length(F.ltrim(x["p"], F.lit(_WHITE))), lambda skip: _span(x["a"] + skip, x["a"] + skip + F.length(F.btrim(x["p"], F.lit(_WHITE))))))
        return F.filter(bare, lambda x: x["stop"] - x["start"] >= least)

    return S.let(S.running(lengths), spans)


def _equal(text: Column, parts: int) -> Column:
    each = F.floor(F.length(text) / parts)
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: _span(i * each, F.when(i == parts - 1, F.length(text)).otherwise((i + 1) * each))), lambda x: x["stop"] > x["start"])


def _runs(paragraphs: Column, sections: int) -> Column:
    """So many sections of as many paragraphs each, the last with the rest; few paragraphs are a section each."""
    each = F.floor(F.size(paragraphs) / sections).cast("int")
    last = lambda i: F.when(i == sections - 1, F.size(paragraphs)).otherwise((i + 1) * each) - 1
    grouped = F.transform(F.sequence(F.lit(0), F.lit(sections - 1)), lambda i: _span(F.get(paragraphs, i * each)["start"], F.get(paragraphs, last(i))["stop"]))
    return F.when(F.size(paragraphs) <= sections, paragraphs).otherwise(grouped)


def segments(docs: DataFrame, rules: Rules = Rules(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, level, idx, start, stop, body) of each document at each scale; a null text is an empty work."""
    t = F.col("_t")

    def levels(body: Column) -> Column:
        chapters = F.coalesce(*(_marked(body, p, rules.chapter_marks, rules.least) for p in rules.chapters), _equal(body, rules.parts))
        marked = F.coalesce(*(_marked(body, p, rules.break_marks, rules.least) for p in rules.breaks), F.lit(None))
        each = lambda name, spans: F.transform(spans, lambda x, i: F.struct(F.lit(name).alias("level"), i.alias("idx"), x["start"].alias("start"), x["stop"].alias("stop")))
        of_text = lambda paragraphs: F.concat(each("work", F.array(_span(F.lit(0), F.length(body)))), each("chapter", chapters), each("section", F.coalesce(marked, _runs(paragraphs, rules.sections))), each("paragraph", paragraphs))
        return S.let(_paragraphs(body, rules.paragraph, rules.least_paragraph), of_text)

    whole = docs.select(id, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    exploded = whole.select(id, "_t", F.explode(levels(t)).alias("s"))
    return exploded.select(id, "s.*", F.substring(t, F.col("s.start").cast("int") + 1, (F.col("s.stop") - F.col("s.start")).cast("int")).alias("body"))


def nested(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Add ``parent``: the idx of the segment of the level above in which a segment begins; null for a work, and where there is none."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    before = Window.partitionBy(id).orderBy("start", "_rank", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = found.withColumn("_rank", rank)
    parent = F.lit(None).cast("int")
    for upper, lower in zip(LEVELS[:-1], LEVELS[1:], strict=True):
        above = F.last(F.when(F.col("level") == upper, F.struct("idx", "stop")), ignorenulls=True).over(before)
        parent = F.when((F.col("level") == lower) & (above["stop"] > F.col("start")), above["idx"]).otherwise(parent)
    return rows.withColumn("parent", parent).drop("_rank")


@S.bound
def scale_shape(x: Column, digits: int = 6) -> Column:
    """Six shapes from the means of the first, the middle and the last values; ``unknown`` for fewer than four values."""
    n = F.size(x)
    q = F.floor(n / 4).cast("int")
    mean = lambda start, stop: F.round(S.mean(F.slice(x, start + 1, F.greatest(stop - start, F.lit(1)))), digits)

    def told(q1: Column, q2: Column, q3: Column, q4: Column, end: Column, mid: Column) -> Column:
        half = F.round((q1 + end) / 2, digits)
        up, down, low, high = end > 1.1 * q1, end < 0.9 * q1, mid < 0.9 * half, mid > 1.1 * half
        return (
            F.when(up & ~low & ~high, "rags_to_riches").when(down & ~low & ~high, "tragedy").when(low, "man_in_hole").when(high, "icarus")
            .when((q4 > q2) & ((q1 < q2) | (q3 < q4)), "cinderella").when((q2 > q4) & ((q1 > q2) | (q3 > q4)), "oedipus").otherwise("other")
        )

    steps = [lambda *_: mean(F.lit(0), q), lambda *_: mean(q, 2 * q), lambda *_: mean(2 * q, 3 * q), lambda *_: mean(3 * q, n), lambda *_: mean(n - F.ceil(n / 4).cast("int"), n), lambda *_: mean(q, F.floor(3 * n / 4).cast("int"))]
    return F.when(n < 4, "unknown").otherwise(S.lets(told, *steps))


def consistency(found: DataFrame, chapters: int = 3, sections: int = 4, least_section: int = 500, id: str = "doc_id") -> DataFrame:
    """(id, n_chapters, n_sections, work, chapter, section, consistency, agreeing) of segments (level, idx, start, stop, parent, shape).

    The shape of a level is the one that most of its segments have, of equal ones the one that comes first. It is null
    with too few segments; short sections are not asked. Consistency is the share of neighbouring levels of one shape
    (0 with one level), ``agreeing`` the share of chapters and sections that have their parent's.
    """
    of = lambda level: F.col("level") == level
    asked = ~of("section") | (F.col("stop") - F.col("start") >= least_section)
    shapes = found.where(asked & (F.col("level") != "paragraph")).groupBy(id, "level", "shape").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    top = shapes.groupBy(id, "level").agg(F.max(F.struct("n", (-F.col("first")).alias("first"), "shape"))["shape"].alias("shape"))
    sizes = found.groupBy(id).agg(*(F.count_if(of(level)).alias(f"n_{level}s") for level in ("chapter", "section")))
    wide = top.groupBy(id).agg(*(F.max(F.when(of(level), F.col("shape"))).alias(level) for level in LEVELS[:3])).join(sizes, id)
    enough = wide.withColumns({"chapter": F.when(F.col("n_chapters") >= chapters, F.col("chapter")), "section": F.when(F.col("n_sections") >= sections, F.col("section"))})
    present = F.filter(F.array("work", "chapter", "section"), lambda s: s.isNotNull())
    same = S.let(present, lambda p: F.when(F.size(p) > 1, S.total(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: (F.get(p, i) == F.get(p, i - 1)).cast("double"))) / (F.size(p) - 1)).otherwise(0.0))
    above = found.where(F.col("level").isin("work", "chapter")).select(id, F.when(of("work"), "chapter").otherwise("section").alias("level"), F.col("idx").alias("parent"), F.col("shape").alias("_above"))
    agree = found.where(F.col("parent").isNotNull() & F.col("level").isin("chapter", "section") & asked).join(above, [id, "level", "parent"]).groupBy(id).agg(F.avg((F.col("shape") == F.col("_above")).cast("double")).alias("agreeing"))
    return enough.withColumn("consistency", same).join(agree, id, "left").select(id, "n_chapters", "n_sections", "work", "chapter", "section", "consistency", "agreeing")


def nested_acts(found: DataFrame, series: Callable[[Column], Column], least: int = 3000, id: str = "doc_id", ws: Workspace | None = None) -> DataFrame:
    """(id, idx, pattern, score, turn, position) of chapters of ``least`` characters that hold a whole four-act structure.

    ``series`` makes a chapter's series of its ``body``; ``position`` is the chapter's middle in the work.
    """
    ws = ws or Workspace(found.sparkSession, "acts")
    works = found.where("level = 'work'").select(id, F.col("stop").alias("_size"))
    # Both are written: a filter would be pushed below the detector, with all that it computes.
    chapters = ws.save(found.where((F.col("level") == "chapter") & (F.col("stop") - F.col("start") >= least)).select(id, "idx", "start", "stop", series(F.col("body")).alias("x")), "chapters")
    judged = ws.save(detectors.with_detectors(chapters, "x", ("four_act",)).drop("x"), "judged").where(F.contains("four_act.pattern", F.lit("kishotenketsu")))
    return judged.join(works, id).select(id, "idx", "four_act.pattern", "four_act.score", "four_act.turn", ((F.col("start") + F.col("stop")) / 2 / F.col("_size")).alias("position"))
