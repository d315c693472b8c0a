"""SQL (DuckDB dialect) of the numbered queries that SQL can express on small tables, by plain joins over all pairs."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


NEAR = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS g FROM d),
    e AS (SELECT doc_id, unnest(g) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.g) + len(y.g) - c)),
    m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(doc_id, o) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, m.b FROM r JOIN m ON r.o = m.a),
    c AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
    SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
    """

REPEATS = f"""
    WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
    v AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
    f AS (SELECT g, min(doc_id) AS first FROM v GROUP BY g),
    h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM v JOIN f USING (g) WHERE doc_id > first),
    e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM d),
    k AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS kept FROM e ANTI JOIN h USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """

_RULES = [("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("block", "com", "/en/"), ("allow", "net", "/de/"), ("block", "org", "/es/")]


def _rule(host: str, path: str, value: int) -> str:
    """The longest rule that fits, or its verdict."""
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(v, h + p)[value]}'" for v, h, p in _RULES) + " END"


def _parts(url: str) -> str:
    rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) END"
    return f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path"


#: Links are absolute canonical ones here.
URLS = rf"""
    WITH RECURSIVE p AS (SELECT page_id, url, html, {_parts("url")} FROM pages),
    e AS (SELECT url AS a, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS b FROM p WHERE html IS NOT NULL AND url IS NOT NULL),
    m AS (SELECT a, b FROM e WHERE contains(b, '://') UNION SELECT b, a FROM e WHERE contains(b, '://')),
    n AS (SELECT DISTINCT a AS url FROM m), r(url, o) AS (SELECT url, url FROM n UNION SELECT r.url, m.b FROM r JOIN m ON r.o = m.a), o AS (SELECT url, o, {_parts("o")} FROM r),
    b AS (SELECT DISTINCT url FROM o WHERE {_rule("host", "path", 0)} = 'block')
    SELECT page_id, host, path, {_rule("host", "path", 1)} AS rule, coalesce({_rule("host", "path", 0)}, CASE WHEN b.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN b ON p.url = b.url
    """

#: Sequences that are rarer than 100 are neither candidates nor parts of one.
PHRASES = rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
    p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
    t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
    g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k))),
    f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
    o AS (SELECT DISTINCT lang, j AS k, array_to_string(w[s : s + j - 1], ' ') AS phrase, a FROM f, (SELECT unnest([2, 3, 4]) AS j), (SELECT unnest([1, 2, 3, 4]) AS s) WHERE j < k AND s <= k - j + 1),
    c AS (SELECT * FROM f ANTI JOIN o USING (lang, k, phrase, a) WHERE k > 1),
    x AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, t.n, CAST(1000 * CAST(c.a AS HUGEINT) * t.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score, m
      FROM (SELECT *, unnest(range(1, k)) AS m FROM c) c JOIN t USING (lang)
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : m], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[m + 1 : c.k], ' ')),
    b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, m) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
    """

NEGATIVES = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank FROM s WHERE same QUALIFY positive_rank <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score, CAST(positive_rank AS INT) AS positive_rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3
    """
