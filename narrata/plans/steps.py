"""The registered query of ordered steps: runs of embeddings against the centres of their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.operators import steps as C
from narrata.plans.registry import query, table

#: Vectors of a run, steps, and those that belong to the outer parts.
RUN, STEPS, ORDERED = 20, 8, (0, 1, 6, 7)


@query(f"""WITH RECURSIVE v AS (SELECT vec_id // {RUN} AS id, vec_id AS place, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    c AS (SELECT label, i, round(avg(x)) AS x FROM (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v WHERE label < {STEPS}) GROUP BY ALL), st AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY label),
    s AS (SELECT id, place, list(list_inner_product(e, c) ORDER BY st.label) AS s FROM v, st GROUP BY ALL), w AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY id) AS n, list_position(s, list_max(s)) - 1 AS step FROM s),
    m AS (SELECT *, lead(step) OVER (PARTITION BY id ORDER BY i) AS nxt, i < (n // 2) * 0.3 OR i > (n // 2) * 1.7 AS outr FROM w),
    g AS (SELECT id, n, string_agg(step, ',' ORDER BY i) AS steps, CASE WHEN n > 1 THEN count(*) FILTER (nxt IS NOT NULL AND (nxt - step + {STEPS}) % {STEPS} IN (0, 1)) / (n - 1) ELSE 0 END AS order_score, count(DISTINCT step) / {STEPS} AS completeness, count(*) FILTER ((step IN {ORDERED}) = outr) / n AS position_score FROM m GROUP BY id, n),
    b(id, i, best) AS (SELECT id, i, s FROM w WHERE i = 0 UNION ALL SELECT w.id, w.i, list_transform(range(1, {STEPS} + 1), lambda k: list_max(best[1:k]) + w.s[k]) FROM b JOIN w ON w.id = b.id AND w.i = b.i + 1)
    SELECT g.id AS run, n AS windows, steps, round(order_score, 6) AS order_score, completeness, round(position_score, 6) AS position_score, round((order_score + completeness + position_score) / 3, 6) AS total, round(list_max(best) / n, 4) AS ordered_score FROM g JOIN b ON b.id = g.id AND b.i = g.n - 1""")
def step_scores(spark, sf_dir):
    """How runs of embeddings follow the centres of eight labels in turn."""
    vectors = table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null").select((F.col("vec_id") / RUN).cast("long").alias("run"), "vec_id", "label", F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("v"))
    means = vectors.where(F.col("label") < STEPS).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x")).alias("x"))
    # One vector for each step.
    centres = [[x.x for x in r.c] for r in means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).orderBy("label").limit(STEPS).collect()]
    found = C.scores(C.likeness(vectors, "run", "vec_id", "v", centres), "windows", len(centres), ORDERED)
    rounded = {c: F.round(c, 6) for c in ("order_score", "position_score", "total")}
    return found.withColumns(rounded).select("run", F.size("windows").cast("long").alias("windows"), F.array_join(F.transform("steps", lambda s: s.cast("string")), ",").alias("steps"), "order_score", "completeness", "position_score", "total", F.round("ordered_score", 4).alias("ordered_score"))
