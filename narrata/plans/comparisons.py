"""Registered queries that compare series: metrics, tables of functors, shapes before and after summing, peaks, sides, roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.functions import kernels as K
from narrata.functions import series as S
from narrata.functions import text as X
from narrata.operators import comparisons as C
from narrata.operators import corpus, detectors, functors, graphs
from narrata.operators.windows import series
from narrata.plans import narrative
from narrata.plans import oracle as O
from narrata.plans import queries as Q
from narrata.plans.registry import SQL, query
from narrata.workspace import Workspace

#: The rules for entropies of 0 to 1.
SCALED = {"spike": 0.02, "high": 0.95, "drop": 0.05, "rise": 0.001, "even": 0.998}
LEFT, RIGHT = ("the", "la", "der"), ("and", "et", "und")


@query(f"""WITH {Q.W20}, {Q._ARRAY_SQL}, x AS (SELECT doc_id, list_transform(x, lambda v: round(v, 9)) AS x, len(x) AS n FROM ar),
    m AS (SELECT doc_id, n, list_avg(x) AS mean, {O.variance("x")} AS variance, list_max(x) AS highest, list_min(x) AS lowest, {O.slope("x")} AS slope, x[1] AS first, x[n] AS last, list_avg(x[1 : n // 4]) AS q1, list_avg(x[n // 4 + 1 : n // 2]) AS q2, list_avg(x[n // 2 + 1 : 3 * n // 4]) AS q3, list_avg(x[3 * n // 4 + 1 :]) AS q4,
      ({O.argmax("x")} - 1) / n AS highest_at, ({O.argmin("x")} - 1) / n AS lowest_at, list_avg(x[n - (n + 9) // 10 + 1 :]) AS tail FROM x),
    k AS (SELECT *, 1 / (1 + variance) AS uniformity, last - first AS change, last - mean AS cliff, q3 - (q1 + q2) / 2 AS spike, highest - last AS resolution FROM m)
    SELECT doc_id, n, round(mean, 5) AS mean, round(variance, 5) AS variance, highest, lowest, round(slope, 5) + 0.0 AS slope, first, last, round(q1, 5) AS q1, round(q2, 5) AS q2, round(q3, 5) AS q3, round(q4, 5) AS q4, round(highest_at, 6) AS highest_at, round(lowest_at, 6) AS lowest_at, round(tail, 5) AS tail, round(uniformity, 5) AS uniformity,
      round(cliff, 5) + 0.0 AS cliff, round(spike, 5) + 0.0 AS spike, CASE WHEN round(spike, 6) > 0.02 AND round(q4 - q3, 6) < 0 THEN 'kishotenketsu' WHEN round(mean, 6) > 0.95 AND round(resolution, 6) > 0.05 THEN 'mystery' WHEN round(slope, 6) > 0.001 AND change > 0 THEN 'tragedy' WHEN lowest_at > 0.3 AND lowest_at < 0.7 AND last > lowest THEN 'man_in_hole' WHEN round(uniformity, 6) > 0.998 THEN 'slice_of_life' ELSE 'unclassified' END AS structure FROM k""")
def entropy_metrics(spark, sf_dir):
    """Summary metrics of each document's lexical entropy, and the structure that they suggest."""
    found = C.entropy_metrics(Q._entropy(spark, sf_dir, Q.NARROW), "lexical_entropy").withColumn("structure", C.entropy_structure(**SCALED))
    rounded = {c: F.round(c, 5) for c in ("mean", "variance", "q1", "q2", "q3", "q4", "tail", "uniformity")} | {c: F.round(c, 5) + 0.0 for c in ("slope", "cliff", "spike")} | {c: F.round(c, 6) for c in ("highest_at", "lowest_at")}
    return found.withColumns(rounded).drop("change", "resolution")


_FUNCTORS = {"entropy": functors.lexical_entropy, "sentiment": narrative._sentiment, "arousal": lambda w: functors.arousal(w, Q.AROUSAL), "epistemic": lambda w: functors.epistemic(w, Q.EPISTEMIC), "pacing": lambda w: functors.pacing(w, Q.ACTION), "presence": functors.character_presence, "voice": lambda w: functors.narrative_voice(w, Q.VOICE)}
_SOURCES = {"entropy": "lexical_entropy", "sentiment": "sentiment_scores", "arousal": "arousal_scores", "epistemic": "epistemic_scores", "pacing": "pacing_scores", "presence": "character_presence", "voice": "narrative_voice"}
_PAIRS = [("sentiment", "entropy"), ("sentiment", "arousal"), ("sentiment", "epistemic"), ("arousal", "entropy"), ("pacing", "arousal"), ("sentiment", "pacing")]


@query("WITH " + ", ".join(f"z_{k} AS (SELECT doc_id, list(value ORDER BY win_idx) AS {k} FROM ({SQL[name]}) GROUP BY doc_id)" for k, name in _SOURCES.items())
    + ", al AS (SELECT * FROM z_entropy" + "".join(f" JOIN z_{k} USING (doc_id)" for k in list(_SOURCES)[1:]) + ") SELECT doc_id, "
    + ", ".join(f"round(list_avg({k}) + 1e-9, 5) + 0.0 AS {k}_mean, round(sqrt({O.variance(k)}) + 1e-9, 5) AS {k}_std" for k in _SOURCES) + ", " + ", ".join(f"round({O.correlation(a, b)}, 4) + 0.0 AS {a}_{b}" for a, b in _PAIRS)
    + f", round(0.5 * list_avg(entropy) + 0.5 * sqrt({O.variance('arousal')}) + 1e-9, 5) AS complexity, CASE WHEN round(list_avg(arousal), 6) > 0.6 THEN 'High' WHEN round(list_avg(arousal), 6) > 0.4 THEN 'Medium' ELSE 'Low' END AS tension FROM al")
def functor_table(spark, sf_dir):
    """Seven functors of each document side by side: means, deviations, six correlations, complexity and tension."""
    scored = series(Q._wide(spark, sf_dir), _FUNCTORS).drop("windows")
    scored = scored.select("doc_id", *(F.transform(k, lambda v: F.round(v, 6)).alias(k) for k in _FUNCTORS))
    single = {f"{k}_mean": F.round(S.mean(F.col(k)) + 1e-9, 5) + 0.0 for k in _FUNCTORS} | {f"{k}_std": F.round(S.deviation(F.col(k)) + 1e-9, 5) for k in _FUNCTORS}
    pairs = {f"{a}_{b}": F.round(S.correlation(F.col(a), F.col(b)), 4) + 0.0 for a, b in _PAIRS}
    level = F.round(S.mean(F.col("arousal")), 6)
    more = {"complexity": F.round(0.5 * S.mean(F.col("entropy")) + 0.5 * S.deviation(F.col("arousal")) + 1e-9, 5), "tension": F.when(level > 0.6, "High").when(level > 0.4, "Medium").otherwise("Low")}
    return scored.select("doc_id", *(c.alias(k) for k, c in (single | pairs | more).items()))


_SUMMED = Q._ARRAY_SQL.replace("ar AS (", "a0 AS (") + """, a1 AS (SELECT doc_id, list_transform(x, lambda y: y - list_avg(x)) AS c FROM a0), a2 AS (SELECT doc_id, list_transform(range(1, len(c) + 1), lambda i: list_sum(c[1:i])) AS c FROM a1),
    ar AS (SELECT doc_id, list_transform(c, lambda y: y / greatest(abs(list_min(c)), abs(list_max(c)), 1.0)) AS x FROM a2)"""


@query(f"""WITH a AS ({SQL["six_shapes"]}), b AS ({SQL["six_shapes"].replace(Q._ARRAY_SQL, _SUMMED)}) SELECT doc_id, a.shape, b.shape AS summed_shape, a.shape = b.shape AS preserved FROM a JOIN b USING (doc_id)""")
def shape_preservation(spark, sf_dir):
    """The shape of each document's series and of its running sum."""
    v = F.col("lexical_entropy")
    step = detectors.Steps(Q._entropy(spark, sf_dir))
    own, summed = step.batch(["array<double>"] * 2, lambda x, y: [K.gaussian(x, 3.0), K.gaussian(y, 3.0)], v, S.compound(v))
    docs = step.df.select("doc_id", detectors.six_shapes(own, None)["shape"].alias("shape"), detectors.six_shapes(summed, None)["shape"].alias("summed_shape"))
    return docs.withColumn("preserved", F.col("shape") == F.col("summed_shape"))


_BOTH = "count(*) >= 3 AND stddev_pop(circle) > 1e-7 AND stddev_pop(hole) > 1e-7"


@query(f"""WITH {Q.W20}, {Q._ARRAY_SQL}, {Q._DETECTORS_SQL}, sr AS ({SQL["six_shapes"].replace(Q.W50, Q.W20).rsplit("SELECT doc_id, shape, r + 0.0 AS score", 1)[0]} SELECT doc_id, max(shape) FILTER (k = 1) AS shape, max(r) FILTER (shape = 'man_in_hole') AS hole FROM k GROUP BY doc_id),
    jn AS (SELECT shape, hole, round(sc, 6) AS circle FROM c4 JOIN sr USING (doc_id) WHERE n >= 10)
    SELECT coalesce(shape, 'all') AS shape, count(*) AS n, round(avg(circle), 5) AS mean_circle, CASE WHEN {_BOTH} THEN round(corr(circle, hole), 4) ELSE 0.0 END + 0.0 AS r FROM jn GROUP BY ROLLUP (shape)""")
def circle_by_shape(spark, sf_dir):
    """Mean story-circle score of each shape's documents, and its correlation with likeness to a man in a hole; ``all`` for all documents."""
    x = F.col("lexical_entropy")
    docs = Q._entropy(spark, sf_dir, Q.NARROW)
    smooth = S.resample(S.minmax(S.gaussian(x, 3.0)), 100)
    curve = F.array(*(F.lit(float(v)) for v in detectors.six_curves()["man_in_hole"]))
    judged = detectors.with_detectors(docs, "lexical_entropy", ("circle",)).where(F.size(x) >= 10)
    rows = judged.select(detectors.six_shapes(x)["shape"].alias("shape"), F.round(S.correlation(smooth, curve), 6).alias("hole"), F.col("circle.score").alias("circle"))
    return rows.rollup("shape").agg(F.count("*").alias("n"), F.round(F.avg("circle"), 5).alias("mean_circle"), (F.expr(f"CASE WHEN {_BOTH} THEN round(try_divide(covar_pop(circle, hole), stddev_pop(circle) * stddev_pop(hole)), 4) ELSE 0D END") + 0.0).alias("r")).withColumn("shape", F.coalesce("shape", F.lit("all")))


_PEAKS = "list_filter(range(1, 99), lambda i: {0}[i + 1] > {0}[i] AND {0}[i + 1] > {0}[i + 2])"


@query(f"""WITH {Q.W20}, {Q._ARRAY_SQL}, rs AS (SELECT doc_id, list_transform({O.resampled("x", "100")}, lambda y: round(y, 9)) AS v FROM ar),
    pr AS (SELECT doc_id, v AS p, lead(doc_id) OVER o AS other, lead(v) OVER o AS q FROM rs JOIN documents USING (doc_id) WINDOW o AS (PARTITION BY source ORDER BY doc_id)), ok AS (SELECT *, {_PEAKS.format("p")} AS pp, {_PEAKS.format("q")} AS qp FROM pr WHERE q IS NOT NULL)
    SELECT doc_id, other, round({O.correlation("p", "q")}, 4) + 0.0 AS r, round(list_avg(list_transform(list_zip(p, q), lambda z: abs(z[1] - z[2]))), 5) AS mean_gap, len(pp) AS peaks, len(qp) AS other_peaks,
      round(CASE WHEN len(pp) > 0 AND len(qp) > 0 THEN 1 - list_avg(list_transform(pp, lambda i: list_min(list_transform(qp, lambda j: abs(i - j))))) / 100 ELSE 0.0 END, 6) AS alignment FROM ok""")
def peak_alignment(spark, sf_dir):
    """Neighbours of a source: correlation, mean gap, and how near the peaks of one are to the other's."""
    v = F.transform(S.resample(F.col("lexical_entropy"), 100), lambda y: F.round(y, 9))
    docs = Q._entropy(spark, sf_dir, Q.NARROW, "source").select("doc_id", "source", v.alias("v"))
    pairs = corpus.neighbours(Workspace(spark, "peak-alignment"), docs, "source", "doc_id", "v").withColumns({"p": C.peak_places(F.col("v")), "q": C.peak_places(F.col("u"))})
    gap = S.mean(F.zip_with("v", "u", lambda a, b: F.abs(a - b)))
    return pairs.select("doc_id", "other", (F.round(S.correlation(F.col("v"), F.col("u")), 4) + 0.0).alias("r"), F.round(gap, 5).alias("mean_gap"), F.size("p").alias("peaks"), F.size("q").alias("other_peaks"), F.round(C.peak_alignment(F.col("p"), F.col("q"), 100), 6).alias("alignment"))


def _count_sql(terms: tuple[str, ...]) -> str:
    return f"len(list_filter({O.TOKENS}, lambda t: t IN {terms}))"


@query(f"""WITH {Q.W50}, c AS (SELECT doc_id, win_idx, {_count_sql(LEFT)} AS l, {_count_sql(RIGHT)} AS r FROM win), m AS (SELECT *, greatest(max(l) OVER (PARTITION BY doc_id), max(r) OVER (PARTITION BY doc_id), 1) AS m FROM c)
    SELECT doc_id, win_idx, round(l / m, 6) AS one, round(r / m, 6) AS two, round(l / greatest(l + r, 1), 6) AS share FROM m""")
def two_sides(spark, sf_dir):
    """Which of two sets of names each window speaks of."""
    count = lambda terms: F.transform("windows", lambda w: F.size(F.filter(X.tokens(functors.body(w)), lambda t: t.isin(*terms))))
    rows = C.presence(Q._wide(spark, sf_dir).select("doc_id", count(LEFT).alias("one"), count(RIGHT).alias("two")), "one", "two")
    return rows.select("doc_id", "win_idx", *(F.round(c, 6).alias(c) for c in ("one", "two", "share")))


@query(f"""WITH {Q._ARROWS_SQL}, s AS (SELECT doc_id, idx, sqrt(d_a * d_a + d_b * d_b) AS step, sum(d_a) OVER o AS a, sum(d_b) OVER o AS b FROM ar WINDOW o AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING))
    SELECT doc_id, round(sum(step) + 1e-9, 5) AS steps, round(max(sqrt(a * a + b * b)) + 1e-9, 5) AS far, round(arg_max(sqrt(a * a + b * b), idx) + 1e-9, 5) AS ends FROM s GROUP BY doc_id""")
def state_distances(spark, sf_dir):
    """How far each document's states are from each other: the whole way, the farthest from the first, and first to last."""
    found = C.way(Q._arrows(spark, sf_dir), ["a", "b"])
    return found.select("doc_id", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("steps", "far", "ends")))


@query(f"""WITH {Q._EDGES_SQL}, c AS (SELECT doc_id, name, count(*) AS mentions, max(i) - min(i) AS reach FROM n GROUP BY ALL), l AS (SELECT doc_id, max(i) - 1 AS last FROM s GROUP BY doc_id),
    p AS (SELECT doc_id, name, mentions, reach / greatest(last, 1) AS coverage, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, name) AS place, mentions / max(mentions) OVER (PARTITION BY doc_id) AS ratio FROM c JOIN l USING (doc_id))
    SELECT doc_id, name, mentions, round(coverage, 6) AS coverage, place, CASE WHEN place = 1 AND coverage > 0.7 THEN 'protagonist' WHEN ratio > 0.3 AND coverage > 0.5 THEN 'major' WHEN ratio > 0.1 THEN 'supporting' ELSE 'minor' END AS role FROM p""")
def character_roles(spark, sf_dir):
    """The role of each name in its document, by mentions and by how much of the document they cover."""
    docs = Q._docs(spark, sf_dir)
    last = docs.select("doc_id", (F.size(X.sentences(F.col("text"))) - 1).alias("last"))
    return C.roles(graphs.sentence_names(docs, functors.names(F.col("sentence"))), last).withColumn("coverage", F.round("coverage", 6))
