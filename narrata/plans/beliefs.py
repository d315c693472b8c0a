"""Registered queries of shifts of belief over a text's whole vocabulary, and of twists."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.functions import text as X
from narrata.operators import beliefs as C
from narrata.plans import queries as Q
from narrata.plans.registry import query

PARTS, SIGMAS = 20, 2.0

#: CTEs that end in bl(doc_id, state, kl, entropy).
_BELIEFS_SQL = rf"""tt AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t FROM documents), tw AS (SELECT doc_id, least(CASE WHEN len(t) >= {PARTS} THEN (i - 1) // (len(t) // {PARTS}) ELSE {PARTS - 1} END, {PARTS - 1}) AS state, w FROM (SELECT doc_id, t, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM tt)),
    vc AS (SELECT DISTINCT doc_id, w FROM tw), ct AS (SELECT doc_id, state, w, count(*) AS c FROM tw GROUP BY ALL), sh AS (SELECT v.doc_id, k.state, v.w, coalesce(c, 0) + 0.1::DOUBLE AS c FROM vc v CROSS JOIN (SELECT unnest(range({PARTS})) AS state) k LEFT JOIN ct ON ct.doc_id = v.doc_id AND ct.state = k.state AND ct.w = v.w),
    pr AS (SELECT doc_id, state, w, c / sum(c) OVER (PARTITION BY doc_id, state) AS p FROM sh), pv AS (SELECT *, lag(p) OVER (PARTITION BY doc_id, w ORDER BY state) AS q FROM pr),
    bl AS (SELECT doc_id, state, sum(p * log2(p / q)) AS kl, -sum(p * log2(p)) AS entropy FROM pv GROUP BY ALL)"""


@query(f"WITH {_BELIEFS_SQL} SELECT doc_id, state, round(state / {PARTS - 1}, 6) AS position, round(kl, 6) + 0.0 AS kl, round(entropy, 6) + 0.0 AS entropy FROM bl")
def belief_states(spark, sf_dir):
    """Divergence and entropy of each twentieth of a text, over all its words."""
    found = C.beliefs(Q._docs(spark, sf_dir), X.tokens(F.col("text")), PARTS)
    return found.select("doc_id", "state", F.round("position", 6).alias("position"), (F.round("kl", 6) + 0.0).alias("kl"), (F.round("entropy", 6) + 0.0).alias("entropy"))


@query(f"""WITH {_BELIEFS_SQL}, st AS (SELECT *, round(avg(kl) OVER d, 9) AS m, round(stddev_pop(kl) OVER d, 9) AS s, count(kl) OVER d AS n, count(*) OVER b AS c, regr_slope(entropy, state) OVER b AS slope FROM bl WINDOW d AS (PARTITION BY doc_id), b AS (PARTITION BY doc_id ORDER BY state ROWS BETWEEN {(PARTS - 1) // 5} PRECEDING AND 1 PRECEDING))
    SELECT doc_id, state, round(state / {PARTS - 1}, 6) AS position, round(kl, 5) AS kl, round((kl - m) / s, 5) AS z, round(CASE WHEN c > 1 THEN greatest(0, least(1, -10 * slope)) ELSE 0 END, 5) + 0.0 AS foreshadowing FROM st WHERE n >= 3 AND round(kl, 9) > m + {SIGMAS} * s""")
def plot_twists(spark, sf_dir):
    """Twists of each text, how far they stand out, and whether they are foreshadowed."""
    found = C.twists(C.beliefs(Q._docs(spark, sf_dir), X.tokens(F.col("text")), PARTS), PARTS, SIGMAS)
    return found.select("doc_id", "state", F.round("position", 6).alias("position"), F.round("kl", 5).alias("kl"), F.round("z", 5).alias("z"), (F.round("foreshadowing", 5) + 0.0).alias("foreshadowing"))
