"""Registered queries of texts at four scales.

The marks are ones that the test tables have.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.functions import text as X
from narrata.operators import functors
from narrata.operators import scales as C
from narrata.operators.windows import word_windows
from narrata.plans import oracle as O
from narrata.plans import queries as Q
from narrata.plans.registry import query
from narrata.workspace import Workspace

RULES = C.Rules((r"(?:^|\n)(?:The|La|Die|Les) ", r"(?:^|\n)(?:Of|And|De|Und) "), (r"\n[A-Z][a-z]+\.",), r"\n+", least=200, least_paragraph=20, sections=5)
LEAST_SECTION, LEAST_ACTS = 200, 500


def _ends_sql(name: str, source: str, pattern: str) -> str:
    """CTE name(doc_id, t, m, e): matches, and where each ends."""
    return rf"""{name}_g AS (SELECT doc_id, t, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m FROM {source}),
    {name} AS (SELECT doc_id, t, g, m, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda v: length(v))) + list_sum(list_transform(m[1:i], lambda v: length(v)))) AS e FROM {name}_g)"""


def _marked_sql(name: str, source: str, pattern: str, marks: int) -> str:
    """CTEs that end in name(doc_id, start, stop) of documents with enough matches, and name_no(doc_id, t), the others."""
    return rf"""{_ends_sql(f"{name}_e", source, pattern)},
    {name} AS (SELECT doc_id, a AS start, b AS stop FROM (SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: e[i] - length(m[i]))) AS a, unnest(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i < len(m) THEN e[i + 1] - length(m[i + 1]) ELSE length(t) END)) AS b FROM {name}_e WHERE len(m) >= {marks}) WHERE b - a >= {RULES.least}),
    {name}_no AS (SELECT doc_id, t FROM {name}_e WHERE len(m) < {marks})"""


_C1, _C2 = RULES.chapters
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
#: CTEs that end in seg(doc_id, level, idx, start, stop, body).
_SEGMENTS_SQL = rf"""
    tx AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_marked_sql("ca", "tx", _C1, 2)}, {_marked_sql("cb", "ca_no", _C2, 2)},
    ce AS (SELECT doc_id, i * (length(t) // 6) AS start, CASE WHEN i = 5 THEN length(t) ELSE (i + 1) * (length(t) // 6) END AS stop FROM cb_no, range(6) r(i)),
    {_marked_sql("sa", "tx", RULES.breaks[0], 3)}, {_ends_sql("pe", "tx", RULES.paragraph)},
    pp AS (SELECT doc_id, unnest(g) AS p, unnest(list_transform(range(len(g)), lambda i: CASE WHEN i = 0 THEN 0 ELSE e[i] END)) AS a FROM pe),
    pa AS (SELECT doc_id, a + length(p) - length(ltrim(p, {_BLANK})) AS start, a + length(p) - length(ltrim(p, {_BLANK})) + length(trim(p, {_BLANK})) AS stop FROM pp WHERE length(trim(p, {_BLANK})) >= {RULES.least_paragraph}),
    pn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM pa),
    sb AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM (SELECT doc_id, start, stop, CASE WHEN n <= 5 THEN i ELSE least(i // (n // 5), 4) END AS k FROM pn WHERE doc_id IN (SELECT doc_id FROM sa_no)) GROUP BY doc_id, k),
    lv AS (SELECT doc_id, 'work' AS level, 0 AS start, length(t) AS stop FROM tx UNION ALL SELECT doc_id, 'chapter', start, stop FROM (FROM ca UNION ALL FROM cb UNION ALL SELECT * FROM ce WHERE stop > start) UNION ALL SELECT doc_id, 'section', start, stop FROM (FROM sa UNION ALL FROM sb) UNION ALL SELECT doc_id, 'paragraph', start, stop FROM pa),
    seg AS (SELECT doc_id, level, row_number() OVER (PARTITION BY doc_id, level ORDER BY start) - 1 AS idx, start, stop, substring(t, CAST(start AS INT) + 1, CAST(stop - start AS INT)) AS body FROM lv JOIN tx USING (doc_id)),
    par AS (SELECT c.doc_id, c.level, c.idx, p.idx AS parent FROM seg c JOIN seg p ON p.doc_id = c.doc_id AND p.level = CASE c.level WHEN 'chapter' THEN 'work' WHEN 'section' THEN 'chapter' WHEN 'paragraph' THEN 'section' END AND p.start <= c.start
      QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.level, c.idx ORDER BY p.start DESC, p.idx DESC) = 1 AND p.stop > c.start),
    nst AS (SELECT seg.*, parent FROM seg LEFT JOIN par USING (doc_id, level, idx))"""


def _segments(spark, sf_dir):
    return C.nested(C.segments(Q._docs(spark, sf_dir), RULES))


@query(f"WITH {_SEGMENTS_SQL} SELECT doc_id, level, idx, start, stop, parent, md5(body) AS digest FROM nst")
def nested_segments(spark, sf_dir):
    """Works, chapters, sections and paragraphs as intervals, each with the one that it begins in."""
    return _segments(spark, sf_dir).withColumn("digest", F.md5("body")).drop("body")


_W = O.windows(*Q.NARROW).replace("doc_id", "sid").replace("FROM documents", "FROM bod")
#: CTEs that end in shp(doc_id, level, idx, start, stop, parent, shape).
_SHAPES_SQL = rf"""{_SEGMENTS_SQL}, num AS (SELECT *, row_number() OVER () AS sid FROM nst WHERE level <> 'paragraph'), bod AS (SELECT sid, body AS text FROM num), {_W}, {O.LEXICAL.replace("doc_id", "sid")},
    ser AS (SELECT sid, list(round(value, 6) ORDER BY win_idx) AS x FROM le GROUP BY sid),
    qs AS (SELECT sid, len(x) AS n, round(list_avg(x[1 : len(x) // 4]), 6) AS q1, round(list_avg(x[len(x) // 4 + 1 : 2 * (len(x) // 4)]), 6) AS q2, round(list_avg(x[2 * (len(x) // 4) + 1 : 3 * (len(x) // 4)]), 6) AS q3, round(list_avg(x[3 * (len(x) // 4) + 1 :]), 6) AS q4, round(list_avg(x[len(x) - (len(x) + 3) // 4 + 1 :]), 6) AS en, round(list_avg(x[len(x) // 4 + 1 : 3 * len(x) // 4]), 6) AS mid FROM ser),
    sh AS (SELECT sid, CASE WHEN n < 4 THEN 'unknown' WHEN en > 1.1 * q1 AND NOT mid < 0.9 * h AND NOT mid > 1.1 * h THEN 'rags_to_riches' WHEN en < 0.9 * q1 AND NOT mid < 0.9 * h AND NOT mid > 1.1 * h THEN 'tragedy' WHEN mid < 0.9 * h THEN 'man_in_hole' WHEN mid > 1.1 * h THEN 'icarus'
      WHEN q4 > q2 AND (q1 < q2 OR q3 < q4) THEN 'cinderella' WHEN q2 > q4 AND (q1 > q2 OR q3 > q4) THEN 'oedipus' ELSE 'other' END AS shape FROM (SELECT *, round((q1 + en) / 2, 6) AS h FROM qs)),
    shp AS (SELECT num.*, shape FROM num JOIN sh USING (sid))"""


def _series(body):
    return F.transform(word_windows(X.words(body), *Q.NARROW), lambda w: F.round(functors.lexical_entropy(w), 6))


@query(rf"""WITH {_SHAPES_SQL}, ask AS (SELECT * FROM shp WHERE level <> 'section' OR stop - start >= {LEAST_SECTION}),
    dom AS (SELECT doc_id, level, shape FROM (SELECT doc_id, level, shape, count(*) AS n, min(idx) AS first FROM ask GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, level ORDER BY n DESC, first) = 1),
    cnt AS (SELECT doc_id, count(*) FILTER (level = 'chapter') AS n_chapters, count(*) FILTER (level = 'section') AS n_sections FROM nst GROUP BY doc_id),
    wd AS (SELECT doc_id, n_chapters, n_sections, max(shape) FILTER (level = 'work') AS work, max(shape) FILTER (level = 'chapter' AND n_chapters >= 3) AS chapter, max(shape) FILTER (level = 'section' AND n_sections >= 4) AS section FROM dom JOIN cnt USING (doc_id) GROUP BY ALL),
    ag AS (SELECT c.doc_id, round(avg(CASE WHEN c.shape = p.shape THEN 1 ELSE 0 END), 6) AS agreeing FROM ask c JOIN shp p ON p.doc_id = c.doc_id AND p.idx = c.parent AND ((c.level = 'chapter' AND p.level = 'work') OR (c.level = 'section' AND p.level = 'chapter')) GROUP BY c.doc_id)
    SELECT doc_id, n_chapters, n_sections, work, chapter, section, agreeing, CASE WHEN chapter IS NULL AND section IS NULL THEN 0.0 WHEN chapter IS NULL THEN CAST(work = section AS INT) WHEN section IS NULL THEN CAST(work = chapter AS INT) ELSE (CAST(work = chapter AS INT) + CAST(chapter = section AS INT)) / 2 END AS consistency FROM wd LEFT JOIN ag USING (doc_id)""")
def nested_scales(spark, sf_dir):
    """The shape of each document at three scales, and how far they agree."""
    found = _segments(spark, sf_dir).where("level <> 'paragraph'").withColumn("shape", C.scale_shape(_series(F.col("body")))).drop("body")
    saved = Workspace(spark, "scales").save(found, "shapes")
    return C.consistency(saved, least_section=LEAST_SECTION).withColumn("agreeing", F.round("agreeing", 6))


@query()
def nested_acts(spark, sf_dir):
    """Chapters that hold a whole four-act structure of their own."""
    return C.nested_acts(C.segments(Q._docs(spark, sf_dir), RULES), _series, LEAST_ACTS)
