"""Registered queries of names, aliases and characters.

Titles and verbs are words that the test tables have: general ones would find
nothing there and prove nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.operators import characters as C
from narrata.plans import queries as Q
from narrata.plans.registry import query
from narrata.workspace import Workspace

TITLES, VERBS = ("the", "la", "der", "les", "el"), ("was", "is", "est", "und", "que")
STOPWORDS = ("the", "of", "and", "to", "in", "la", "de", "les", "der", "die", "und")
LEAST, MOST = 3, 30

_WS = r"[ \t\n\r]+"
#: CTEs that end in mentions(doc_id, size, name, place, rule, title), from the tokens of a text and what is between them.
_MENTIONS_SQL = rf"""
    tk AS (SELECT doc_id, length(t) AS size, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') AS w, string_split_regex(t, '[\p{{L}}\p{{N}}_]+') AS g FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
    te AS (SELECT doc_id, size, generate_subscripts(w, 1) AS i, unnest(w) AS w, unnest(g[1 : len(w)]) AS g FROM tk),
    tp AS (SELECT *, CAST(sum(length(g) + length(w)) OVER o - length(w) AS BIGINT) AS place, lag(w) OVER o AS pw, lead(w) OVER o AS nw, lead(g) OVER o AS ng, regexp_full_match(w, '\p{{Lu}}\p{{Ll}}+') AS cap FROM te WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    tq AS (SELECT *, cap AND coalesce(lag(cap) OVER o, false) AND regexp_full_match(g, '{_WS}') AS joined FROM tp WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    tr AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER o AS run, coalesce(lead(joined) OVER o, false) AS more FROM tq WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    tz AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) - 1 AS spot, w || ' ' || nw AS pair, lower(w) IN {STOPWORDS} AS stop, lower(nw) IN {STOPWORDS} AS nstop FROM tr),
    mentions AS (
      SELECT doc_id, size, w AS name, place, 'word' AS rule, NULL AS title FROM tz WHERE cap AND length(w) >= 3 AND NOT stop
      UNION ALL SELECT doc_id, size, pair, place, 'pair', NULL FROM tz WHERE cap AND more AND spot % 2 = 0 AND NOT stop AND NOT nstop AND place > 0 AND right(g, 1) NOT IN ('.', '!', '?', chr(10))
      UNION ALL SELECT doc_id, size, CASE WHEN more THEN pair ELSE w END, place, 'title', lower(pw) FROM tz WHERE cap AND lower(pw) IN {TITLES} AND regexp_full_match(g, '\.?{_WS}')
      UNION ALL SELECT doc_id, size, w, place, 'speech', NULL FROM tz WHERE cap AND NOT stop AND pw IN {VERBS} AND regexp_full_match(g, '{_WS}')
      UNION ALL SELECT doc_id, size, w, place, 'speech', NULL FROM tz WHERE cap AND NOT stop AND nw IN {VERBS} AND regexp_full_match(ng, '{_WS}'))"""

_RELATED = "contains(od.x, l) OR contains(l, od.x) OR (contains(l, ' ') AND (split_part(l, ' ', 1) = split_part(od.x, ' ', 1) OR (contains(od.x, ' ') AND split_part(l, ' ', 2) = split_part(od.x, ' ', 2))))"
#: CTEs that end in al(doc_id, place, leaders, alias, character): names in the order of their counts, each compared with all leaders before it.
_ALIASES_SQL = f"""{_MENTIONS_SQL},
    nm AS (SELECT doc_id, name, count(*) AS n, min(place) AS first, max(place) AS last, count(*) FILTER (rule = 'speech') AS speech FROM mentions GROUP BY ALL HAVING count(*) >= {LEAST}),
    od AS (SELECT doc_id, name AS x, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name) AS place FROM nm),
    al(doc_id, place, leaders, alias, character) AS (
      SELECT doc_id, place, [x], x, x FROM od WHERE place = 1
      UNION ALL SELECT doc_id, place, CASE WHEN c IS NULL THEN list_append(leaders, x) ELSE leaders END, x, coalesce(c, x)
      FROM (SELECT od.*, al.leaders, list_filter(al.leaders, lambda l: {_RELATED})[1] AS c FROM al JOIN od ON od.doc_id = al.doc_id AND od.place = al.place + 1))"""


def _found(spark, sf_dir, ws):
    found = ws.save(C.mentions(Q._docs(spark, sf_dir), TITLES, VERBS, STOPWORDS), "mentions")
    names = ws.save(C.counted(found, LEAST), "names")
    return found, names, ws.save(C.aliases(names), "aliases")


@query(f"WITH RECURSIVE {_ALIASES_SQL} SELECT doc_id, alias, character FROM al")
def character_aliases(spark, sf_dir):
    """Names of each document and the character that each is an alias of."""
    return C.aliases(C.counted(C.mentions(Q._docs(spark, sf_dir), TITLES, VERBS, STOPWORDS), LEAST))


@query(f"""WITH RECURSIVE {_ALIASES_SQL},
    sm AS (SELECT al.doc_id, character, sum(n) AS mentions, array_to_string(list_sort(list(alias)), '|') AS aliases, min(first) AS first, max(last) AS last, sum(speech) AS speech FROM al JOIN nm ON nm.doc_id = al.doc_id AND nm.name = al.alias GROUP BY ALL),
    tt AS (SELECT doc_id, character, title, count(*) AS n FROM mentions JOIN al USING (doc_id) WHERE alias = name AND title IS NOT NULL GROUP BY doc_id, character, title QUALIFY row_number() OVER (PARTITION BY doc_id, character ORDER BY n DESC, title) = 1),
    pl AS (SELECT sm.*, first / size AS f, last / size AS l, row_number() OVER (PARTITION BY sm.doc_id ORDER BY mentions DESC, character) AS place, mentions / max(mentions) OVER (PARTITION BY sm.doc_id) AS ratio FROM sm JOIN tk USING (doc_id))
    SELECT doc_id, character, place, mentions, aliases, round(f, 6) AS first, round(l, 6) AS last, speech, title, CASE WHEN place = 1 AND l - f > 0.7 THEN 'protagonist' WHEN ratio > 0.3 AND l - f > 0.5 THEN 'major' WHEN ratio > 0.1 THEN 'supporting' ELSE 'minor' END AS role
    FROM pl LEFT JOIN tt USING (doc_id, character) WHERE place <= {MOST}""")
def extracted_characters(spark, sf_dir):
    """Characters with mentions, aliases, reach, speech, title and role."""
    found, names, resolved = _found(spark, sf_dir, Workspace(spark, "characters"))
    told = C.characters(found, names, resolved, MOST)
    return told.withColumns({"aliases": F.array_join("aliases", "|"), "first": F.round("first", 6), "last": F.round("last", 6)})


@query(f"""WITH RECURSIVE {_ALIASES_SQL}, m AS (SELECT doc_id, place, character FROM (SELECT doc_id, name AS alias, place FROM mentions) JOIN (SELECT doc_id, alias, character FROM al) USING (doc_id, alias))
    SELECT a.doc_id, least(a.character, b.character) AS n1, greatest(a.character, b.character) AS n2, count(*) // 2 AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.character <> b.character AND abs(a.place - b.place) < 300 GROUP BY ALL""")
def character_ties(spark, sf_dir):
    """How often two characters are mentioned within 300 characters of text."""
    found, _, resolved = _found(spark, sf_dir, Workspace(spark, "characters"))
    return C.ties(found, resolved, 300)


#: Characters of a scene, and what happens in it.
SCENE, EVENTS = 400, {"conflict": r"(?:^| )to the(?: |$)", "death": r"(?:^| )of the(?: |$)"}


def _shown(rows: str, item: str, order: str) -> str:
    return f"string_agg({item}, ',' ORDER BY {order}) AS {rows}"


@query(f"""WITH RECURSIVE {_ALIASES_SQL}, mc AS (SELECT doc_id, character, place // {SCENE // 2} AS k FROM (SELECT doc_id, name AS alias, place FROM mentions) JOIN (SELECT doc_id, alias, character FROM al) USING (doc_id, alias)),
    sc AS (SELECT doc_id, k - s AS scene, character, count(*) AS m FROM mc, (SELECT unnest([0, 1]) AS s) WHERE k >= s GROUP BY ALL),
    sw AS (SELECT a.doc_id, a.character, b.character AS other, round(sum(sqrt(a.m * b.m)) + 1e-9, 4) AS weight FROM sc a JOIN sc b ON a.doc_id = b.doc_id AND a.scene = b.scene AND a.character <> b.character GROUP BY ALL), sa AS (SELECT doc_id, character, {_shown("satellites", "other", "weight DESC, other")}, round(sum(weight), 3) AS pull FROM sw GROUP BY ALL),
    tw AS (SELECT doc_id, k AS scene, lower(substring(text, CAST(k * {SCENE // 2} + 1 AS INT), {SCENE})) AS w FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // {SCENE // 2} + 1)) AS k FROM documents WHERE length(text) > 0)),
    ev AS (SELECT doc_id, scene, {", ".join(f"len(regexp_extract_all(w, '{p}')) AS {k}" for k, p in EVENTS.items())} FROM tw), es AS (SELECT doc_id, character, {", ".join(f"sum({k}) AS {k}" for k in EVENTS)} FROM sc JOIN ev USING (doc_id, scene) GROUP BY ALL),
    ow AS (SELECT doc_id, character, CAST(sum(m) AS BIGINT) AS total, {_shown("scenes", "scene", "scene")} FROM sc GROUP BY ALL)
    SELECT doc_id, character, total, scenes, coalesce(satellites, '') AS satellites, coalesce(pull, 0) AS pull, {", ".join(f"CAST(coalesce({k}, 0) AS BIGINT) AS {k}" for k in EVENTS)} FROM ow LEFT JOIN sa USING (doc_id, character) LEFT JOIN es USING (doc_id, character)""")
def character_orbits(spark, sf_dir):
    """Each character's scenes, those met there, how strongly they pull, and what happens."""
    docs = Q._docs(spark, sf_dir)
    ws = Workspace(spark, "orbits")
    found, _, resolved = _found(spark, sf_dir, ws)
    told = C.orbits(ws.save(C.scenes(found, resolved, SCENE), "scenes"), docs, EVENTS, SCENE)
    names = F.coalesce(F.array_join(F.transform("satellites", lambda s: s["name"]), ","), F.lit(""))
    pull = F.coalesce(F.round(F.aggregate("satellites", F.lit(0.0), lambda a, s: a + s["weight"]), 3), F.lit(0.0))
    happened = {k: F.coalesce(F.get(F.transform(F.filter("events", lambda e: e["kind"] == k), lambda e: e["n"]), F.lit(0)), F.lit(0)).alias(k) for k in EVENTS}  # noqa: B023
    return told.select("doc_id", "character", "total", F.array_join(F.transform("scenes", lambda s: s.cast("string")), ",").alias("scenes"), names.alias("satellites"), pull.alias("pull"), *happened.values())
