"""Pieces of SQL that the oracle queries share, in DuckDB's dialect."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda w: w <> '')"
TOKENS = r"regexp_extract_all(lower(array_to_string(w, ' ')), '[\p{L}\p{N}_]+')"
LETTERS = r"regexp_extract_all(lower(array_to_string(w, ' ')), '\p{L}+')"


def windows(size: int, overlap: int) -> str:
    """CTEs that end in win(doc_id, win_idx, n_windows, w)."""
    return f"""ws AS (SELECT doc_id, {WORDS} AS w FROM documents),
    wr AS (SELECT doc_id, w, list_filter(list_transform(range(0, greatest(len(w), 1), {size - overlap}), lambda i: w[i + 1 : i + {size}]), lambda x: len(x) >= {size // 2}) AS r FROM ws),
    wl AS (SELECT doc_id, CASE WHEN len(r) > 0 THEN r ELSE [w] END AS r FROM wr),
    win AS (SELECT doc_id, unnest(r) AS w, generate_subscripts(r, 1) - 1 AS win_idx, len(r) AS n_windows FROM wl)"""


def entropies(items: str, name: str) -> str:
    """CTE name(doc_id, win_idx, n, k, h): entropy of the windows' items; windows without any have none."""
    return f"""{name}_i AS (SELECT doc_id, win_idx, unnest({items}) AS x FROM win),
    {name}_c AS (SELECT doc_id, win_idx, x, count(*) AS c FROM {name}_i GROUP BY ALL),
    {name} AS (SELECT doc_id, win_idx, sum(c) AS n, count(*) AS k, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM {name}_c GROUP BY ALL)"""


#: CTEs on top of windows() that end in le(doc_id, win_idx, n_windows, value): normalized lexical entropy.
LEXICAL = entropies(LETTERS, "ent") + """,
    le AS (SELECT w.doc_id, w.win_idx, w.n_windows, CASE WHEN e.k > 1 THEN e.h / log2(e.k) ELSE 0.0 END AS value FROM win w LEFT JOIN ent e USING (doc_id, win_idx))"""


def resampled(x: str, n: str) -> str:
    """n points of the line through list x."""
    p = f"(i * (len({x}) - 1) / greatest({n} - 1, 1)::DOUBLE)"
    return f"list_transform(range({n}), lambda i: {x}[floor({p})::INT + 1] + ({p} - floor({p})) * ({x}[least(floor({p})::INT + 1, len({x}) - 1) + 1] - {x}[floor({p})::INT + 1]))"


def value_at(x: str, p: str) -> str:
    """The line through list x at place p of 0 to 1."""
    q = f"({p} * (len({x}) - 1))"
    return f"({x}[floor({q})::INT + 1] + ({q} - floor({q})) * ({x}[least(floor({q})::INT + 1, len({x}) - 1) + 1] - {x}[floor({q})::INT + 1]))"


def variance(x: str) -> str:
    return f"(list_sum(list_transform({x}, lambda y: (y - list_avg({x})) * (y - list_avg({x})))) / len({x}))"


def correlation(x: str, y: str) -> str:
    """Of two lists of one length; 0 if one is constant."""
    a, b = (f"(z[{k}] - list_avg({v}))" for k, v in ((1, x), (2, y)))
    both = f"list_zip({x}, {y})"
    size = " * ".join(f"list_sum(list_transform({v}, lambda u: (u - list_avg({v})) * (u - list_avg({v}))))" for v in (x, y))
    return f"(CASE WHEN sqrt({size}) > 1e-12 THEN list_sum(list_transform({both}, lambda z: {a} * {b})) / sqrt({size}) ELSE 0.0 END)"


def slope(x: str) -> str:
    return f"(CASE WHEN len({x}) > 1 THEN list_sum(list_transform(range(len({x})), lambda i: (i - (len({x}) - 1) / 2) * ({x}[i + 1] - list_avg({x})))) / (len({x}) * (len({x}) * len({x}) - 1) / 12.0) ELSE 0.0 END)"


def peaks(source: str, x: str, out: str, gap: str, prominence: float | None = None) -> str:
    """CTEs that end in ``out``: the source's columns and ``out``, the places (from 1) of peaks of list x."""
    low = f"coalesce(list_max(list_filter(range(1, i), lambda j: {x}[j] > {x}[i])), 0)"
    high = f"coalesce(list_min(list_filter(range(i + 1, len({x}) + 1), lambda j: {x}[j] > {x}[i])), len({x}) + 1)"
    kept = f"list_sort(list_filter(k, lambda i: {x}[i] - greatest(list_min({x}[{low} + 1 : i]), list_min({x}[i : {high} - 1])) >= {prominence}))" if prominence is not None else "list_sort(k)"
    return f"""{out}_a AS (SELECT *, list_filter(range(1, len({x}) + 1), lambda i: i = 1 OR {x}[i] <> {x}[i - 1]) AS s FROM {source}),
    {out}_b AS (SELECT * EXCLUDE (s), list_transform(list_filter(range(2, len(s)), lambda k: {x}[s[k]] > {x}[s[k - 1]] AND {x}[s[k]] > {x}[s[k + 1]]), lambda k: (s[k] + s[k + 1] - 1) // 2) AS t FROM {out}_a),
    {out}_c AS (SELECT * EXCLUDE (t), list_transform(list_reverse_sort(list_transform(t, lambda i: {{'v': {x}[i], 'i': i}})), lambda q: [q.i]) AS o FROM {out}_b),
    {out}_d AS (SELECT * EXCLUDE (o), CASE WHEN len(o) = 0 THEN []::BIGINT[] ELSE list_reduce(o, lambda a, b: CASE WHEN len(list_filter(a, lambda j: abs(j - b[1]) < {gap})) > 0 THEN a ELSE list_concat(a, b) END) END AS k FROM {out}_c),
    {out} AS (SELECT * EXCLUDE (k), {kept} AS {out} FROM {out}_d)"""


def tallest(x: str, places: str) -> str:
    """The place of the largest value, of equal ones the first; null for none."""
    return f"(-(list_max(list_transform({places}, lambda i: {{'v': {x}[i], 'i': -i}}))).i)"


def argmax(x: str) -> str:
    return f"list_position({x}, list_max({x}))"


def argmin(x: str) -> str:
    return f"list_position({x}, list_min({x}))"
