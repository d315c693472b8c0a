"""More registered queries: sentiment, pace, events, scenes, profiles, and the laws of a document's states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import lexicon as L
from narrata.functions import series as S
from narrata.functions import text as X
from narrata.operators import coded, corpus, detectors, functors, graphs
from narrata.operators.windows import long_form, series, windowed
from narrata.plans import oracle as O
from narrata.plans import queries as Q
from narrata.plans.registry import query

#: Words of the tables, so that every rule is met.
VALENCE = {"the": -1.2, "and": 1.9, "of": 0.6, "la": 1.1, "und": -0.8, "et": 2.0}
NEGATIONS, BOOSTERS = ("to", "de"), {"in": 0.293, "der": -0.293}

_VALUE = "CASE " + " ".join(f"WHEN {{0}} = '{w}' THEN {v}::DOUBLE" for w, v in VALENCE.items()) + " ELSE 0.0::DOUBLE END"
_PUSH = "CASE " + " ".join(f"WHEN {{0}} = '{w}' THEN {v}::DOUBLE" for w, v in BOOSTERS.items()) + " ELSE 0.0::DOUBLE END"
_SENTIMENT = f"""se_t AS (SELECT doc_id, win_idx, {O.TOKENS} AS t FROM win), se_i AS (SELECT doc_id, win_idx, t, unnest(range(1, len(t) + 1)) AS i FROM se_t), se_v AS (SELECT doc_id, win_idx, {_VALUE.format("t[i]")} AS v, {_PUSH.format("t[i - 1]")} AS p, len(list_filter(t[greatest(i - 3, 1) : i - 1], lambda w: w IN ('to', 'de'))) > 0 AS no FROM se_i),
    se_s AS (SELECT doc_id, win_idx, sum(CASE WHEN v = 0 THEN 0.0 WHEN no THEN -0.74 * (v + sign(v) * p) ELSE v + sign(v) * p END) AS s FROM se_v GROUP BY ALL), sent AS (SELECT w.doc_id, w.win_idx, w.n_windows, coalesce(s, 0.0) / sqrt(coalesce(s, 0.0) * coalesce(s, 0.0) + 15) AS value FROM win w LEFT JOIN se_s USING (doc_id, win_idx))"""


def _sentiment(w):
    return functors.sentiment(w, VALENCE, NEGATIONS, BOOSTERS)


def _each(spark, sf_dir) -> DataFrame:
    return Q._each_window(Q._wide(spark, sf_dir))


@query(f"WITH {Q.W50}, {_SENTIMENT} SELECT doc_id, win_idx, round(value, 6) + 0.0 AS value FROM sent")
def sentiment_scores(spark, sf_dir):
    return _each(spark, sf_dir).select("doc_id", "win_idx", (F.round(_sentiment(F.col("words")), 6) + 0.0).alias("value"))


_LENGTHS = "list_transform(list_filter(list_transform(string_split_regex(b, '[.!?]+'), lambda s: trim(s)), lambda s: s <> ''), lambda s: len(string_split(s, ' '))::DOUBLE)"
_BODY = "bo AS (SELECT doc_id, win_idx, w, array_to_string(w, ' ') AS b FROM win)"


@query(rf"""WITH {Q.W50}, {_BODY}, pc AS (SELECT doc_id, win_idx, w, b, {_LENGTHS} AS n, regexp_extract_all(lower(b), '[\p{{L}}\p{{N}}_]+') AS t, coalesce(list_sum(list_transform(regexp_extract_all(b, '["“][^"”]*["”]'), lambda s: length(s))), 0) AS said FROM bo)
    SELECT doc_id, win_idx, round(greatest(0.0, least(1.0, 0.35 * least(1.0, CASE WHEN length(b) > 0 THEN 2 * said / length(b) ELSE 0.0 END) + 0.30 * CASE WHEN len(n) > 0 THEN greatest(0.0, least(1.0, (30 - list_avg(n)) / 25)) ELSE 0.5 END
      + 0.15 * least(1.0, 33 * len(list_filter(t, lambda x: x IN ('what', 'he'))) / greatest(len(t), 1)))), 6) AS value, round(CASE WHEN length(b) > 0 THEN said / length(b) ELSE 0.0 END, 6) AS dialogue FROM pc""")
def pacing_scores(spark, sf_dir):
    w = F.col("words")
    return _each(spark, sf_dir).select("doc_id", "win_idx", F.round(functors.pacing(w, Q.ACTION), 6).alias("value"), F.round(functors.dialogue_density(w), 6).alias("dialogue"))


@query(f"""WITH {Q.W50}, {_BODY}, st AS (SELECT doc_id, win_idx, {_LENGTHS} AS n, unnest(CASE WHEN len(regexp_extract_all(b, '[.,!?;:]')) > 0 THEN regexp_extract_all(b, '[.,!?;:]') ELSE [NULL] END) AS m FROM bo),
    c AS (SELECT doc_id, win_idx, any_value(n) AS n, m, count(m) AS c FROM st GROUP BY doc_id, win_idx, m), h AS (SELECT doc_id, win_idx, any_value(n) AS n, CASE WHEN sum(c) > 0 THEN log2(sum(c)) - sum(c * log2(greatest(c, 1))) / sum(c) ELSE 0.0 END AS h FROM c GROUP BY ALL)
    SELECT doc_id, win_idx, round(0.6 * CASE WHEN len(n) > 1 AND list_avg(n) > 0 THEN least(1.0, list_stddev_pop(n) / list_avg(n) / 1.5) ELSE 0.0 END + 0.4 * h / 2.584962500721156, 6) + 0.0 AS value FROM h""")
def structural_entropy(spark, sf_dir):
    return _each(spark, sf_dir).select("doc_id", "win_idx", (F.round(functors.structural_entropy(F.col("words")), 6) + 0.0).alias("value"))


@query(rf"""WITH s AS (SELECT doc_id, lower(unnest(string_split_regex(text, '[.!?]+'))) AS s FROM documents), k AS (SELECT doc_id, s, 'death' AS kind, len(regexp_extract_all(s, '(?:^| )of the(?: |$)')) AS n FROM s UNION ALL SELECT doc_id, s, 'conflict', len(regexp_extract_all(s, '(?:^| )to the(?: |$)')) FROM s)
    SELECT doc_id, kind, count(*) AS events, round(sum(least(2.0, 1 + 0.2 * n)::DOUBLE * CASE kind WHEN 'death' THEN 1.5 ELSE 1.2 END::DOUBLE), 4) AS intensity FROM k WHERE n > 0 GROUP BY ALL""")
def narrative_events(spark, sf_dir):
    """Sentences of each document with events of each kind, and their summed intensity."""
    return corpus.events(Q._docs(spark, sf_dir), Q.EVENTS).groupBy("doc_id", "kind").agg(F.count("*").alias("events"), F.round(F.sum("intensity"), 4).alias("intensity"))


@query(rf"""WITH {Q.W50}, t AS (SELECT doc_id, win_idx, w, lower(array_to_string(w, ' ')) AS b FROM win), n AS (SELECT doc_id, win_idx, len(w) AS w, len(regexp_extract_all(b, '(?:^| )of the(?: |$)')) AS d, len(regexp_extract_all(b, '(?:^| )to the(?: |$)')) AS c FROM t)
    SELECT doc_id, win_idx, round(least(1.0, (CASE WHEN d > 0 THEN least(2.0, 1 + 0.2 * d) * 1.5 ELSE 0 END + CASE WHEN c > 0 THEN least(2.0, 1 + 0.2 * c) * 1.2 ELSE 0 END) / greatest(w, 1) * 100 / 4), 6) AS value FROM n""")
def event_scores(spark, sf_dir):
    return _each(spark, sf_dir).select("doc_id", "win_idx", F.round(functors.event_intensity(F.col("words"), Q.EVENTS), 6).alias("value"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(text, '\n[ \t]*(\*[ \t]*){3,}\n|\n[ \t]*-{3,}[ \t]*\n|\n[ \t]*#{1,3}[ \t]*\n|\n{4,}'), lambda x: trim(x) <> '') AS s FROM documents), n AS (SELECT doc_id, list_transform(s, lambda x: len(list_filter(string_split_regex(x, '[ \t\n\r]+'), lambda w: w <> ''))::DOUBLE) AS n FROM s)
    SELECT doc_id, len(n) AS scenes, round(list_avg(n), 4) AS mean_words, round(list_stddev_pop(n), 4) AS std_words, list_max(n)::BIGINT AS most_words FROM n WHERE len(n) > 0""")
def scene_statistics(spark, sf_dir):
    n = F.transform(X.scene_breaks(F.col("text")), lambda s: F.size(X.words(s)).cast("double"))
    docs = Q._docs(spark, sf_dir).select("doc_id", n.alias("n")).where(F.size("n") > 0)
    return docs.select("doc_id", F.size("n").alias("scenes"), F.round(S.mean(F.col("n")), 4).alias("mean_words"), F.round(S.deviation(F.col("n")), 4).alias("std_words"), F.array_max("n").cast("long").alias("most_words"))


@query(f"""WITH {Q.W50}, t AS (SELECT doc_id, win_idx, unnest({O.TOKENS}) AS x FROM win), c AS (SELECT doc_id, win_idx, x, count(*) AS n FROM t GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id, win_idx) AS p FROM c),
    m AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.win_idx, b.win_idx + 1) AS win_idx, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM p a FULL JOIN p b ON a.doc_id = b.doc_id AND a.win_idx = b.win_idx + 1 AND a.x = b.x),
    j AS (SELECT doc_id, win_idx, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2 AS v FROM m GROUP BY ALL)
    SELECT w.doc_id, w.win_idx, round(CASE WHEN w.win_idx = 0 THEN 0.0 ELSE coalesce(v, 0.0) END + 1e-9, 5) AS value FROM win w LEFT JOIN j USING (doc_id, win_idx)""")
def jsd_windows(spark, sf_dir):
    """Jensen-Shannon divergence in nats of each window's words from those of the one before."""
    return Q._scored(spark, sf_dir, coded.divergence).withColumn("value", F.round(F.col("value") + 1e-9, 5))


@query(f"""WITH {Q.W50}, {O.LEXICAL}, {_SENTIMENT}, {Q._EPISTEMIC_SQL.split(", t AS", 1)[1].join(["t AS", ""])}, al AS (SELECT doc_id, 'lexical_entropy' AS functor, value FROM le UNION ALL SELECT doc_id, 'sentiment', value FROM sent UNION ALL SELECT doc_id, 'epistemic', value FROM ep)
    SELECT doc_id, functor, count(*) AS n, round(avg(value), 5) + 0.0 AS mean, round(stddev_pop(value), 5) AS std, round(max(value) - min(value), 5) AS range FROM al GROUP BY ALL""")
def functor_profiles(spark, sf_dir):
    """Several functors of each document, from one pass over its windows."""
    more = {"sentiment": _sentiment, "epistemic": lambda w: functors.epistemic(w, Q.EPISTEMIC)}
    names = ["lexical_entropy", *more]
    docs = coded.window_series(Q._docs(spark, sf_dir).select("doc_id", F.col("text").alias("body"), "text"), "lexical_entropy", coded.normal_entropy, *Q.WIDE)
    scored = series(windowed(docs, *Q.WIDE, text="body").drop("body"), more).select("doc_id", *names)
    each = scored.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("functor"), F.col(k).alias("v")) for k in names))).alias("s")).select("doc_id", "s.*")
    v = F.col("v")
    return each.select("doc_id", "functor", F.size(v).alias("n"), (F.round(S.mean(v), 5) + 0.0).alias("mean"), F.round(S.deviation(v), 5).alias("std"), F.round(F.array_max(v) - F.array_min(v), 5).alias("range"))


@query(f"""WITH {O.windows(*Q.NARROW)}, {Q._ARRAY_SQL}, {Q._DETECTORS_SQL}, lb AS (SELECT doc_id, 'aristotle' AS model, CASE WHEN n >= 10 THEN sa END AS score FROM c4 UNION ALL SELECT doc_id, 'freytag', CASE WHEN n >= 10 THEN sf END FROM c4 UNION ALL SELECT doc_id, 'campbell', CASE WHEN n >= 10 THEN sh END FROM c4 UNION ALL SELECT doc_id, 'circle', CASE WHEN n >= 10 THEN sc END FROM c4)
    SELECT lang, model, count(*) AS n, count(score) AS judged, round(avg(round(score, 6)), 5) AS mean_score, count(*) FILTER (round(score, 6) > 0.5) AS passed FROM lb JOIN documents USING (doc_id) GROUP BY ALL""")
def detector_summary(spark, sf_dir):
    """How each detector judges each language's documents."""
    names = tuple(detectors.ON_SMOOTH)
    docs = detectors.with_detectors(Q._entropy(spark, sf_dir, Q.NARROW, "lang"), "lexical_entropy", names)
    return detectors.summary(docs, ["lang"], names).drop("patterns")


_LAWS = f"""{Q._ARROWS_SQL}, l AS (SELECT doc_id, idx, d_a AS x, lead(d_a) OVER o AS y, lead(d_a, 2) OVER o AS z FROM ar WINDOW o AS (PARTITION BY doc_id ORDER BY idx))"""


@query(f"""WITH {_LAWS} SELECT doc_id, count(*) AS arrows, count(z) AS triples, coalesce(bool_and(abs((x + y) + z - (x + (y + z))) < 1e-9), true) AS associative, bool_and(x + 0.0 = x) AS identity FROM l GROUP BY doc_id""")
def category_laws(spark, sf_dir):
    """Whether a document's transitions compose associatively, and unchanged with the identity."""
    return graphs.laws(Q._arrows(spark, sf_dir), ["a"])


@query(f"""WITH {Q._ARROWS_SQL}, sm AS (SELECT doc_id, idx, type, intensity, sum(d_a) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s FROM ar), tp AS (SELECT doc_id, min(idx) AS last FROM (SELECT *, max(round(s, 6)) OVER (PARTITION BY doc_id) AS m FROM sm) WHERE round(s, 6) = m GROUP BY doc_id)
    SELECT doc_id, last + 1 AS length, round(arg_max(s, idx), 6) + 0.0 AS d_a, max(intensity) AS intensity FROM sm JOIN tp USING (doc_id) WHERE idx <= last GROUP BY doc_id, last""")
def paths_to_the_top(spark, sf_dir):
    """The composed transition of each document from its first state to the one with the largest feature."""
    return graphs.path_to_top(Q._arrows(spark, sf_dir), "a")


@query(f"""WITH {O.windows(*Q.NARROW)}, {O.LEXICAL}, q AS (SELECT doc_id, win_idx, value, n_windows AS n, least(win_idx // greatest(n_windows // 3, 1), 2) AS part FROM le), p AS (SELECT doc_id, part, list(value ORDER BY win_idx) AS x FROM q GROUP BY ALL UNION ALL SELECT doc_id, -1, list(value ORDER BY win_idx) FROM q GROUP BY doc_id),
    m AS (SELECT doc_id, part, len(x) AS n, round(list_avg(x[1 : len(x) // 4]), 6) AS a, round(list_avg(x[len(x) // 4 + 1 : 2 * (len(x) // 4)]), 6) AS b, round(list_avg(x[2 * (len(x) // 4) + 1 : 3 * (len(x) // 4)]), 6) AS c, round(list_avg(x[len(x) - (len(x) + 3) // 4 + 1 :]), 6) AS d FROM p), f AS (SELECT *, round((b + c) / 2, 6) AS m, round((a + d) / 2, 6) AS e FROM m),
    s AS (SELECT doc_id, part, CASE WHEN n < 4 THEN 'insufficient_data' WHEN d > 1.1 * a AND NOT m < 0.9 * e AND NOT m > 1.1 * e THEN 'rags_to_riches' WHEN d < 0.9 * a AND NOT m < 0.9 * e AND NOT m > 1.1 * e THEN 'tragedy' WHEN m < 0.9 * e THEN 'man_in_hole' WHEN m > 1.1 * e AND NOT d > 1.1 * a THEN 'icarus' WHEN m > 1.1 * e THEN 'cinderella' WHEN d < 0.9 * a THEN 'oedipus' ELSE 'other' END AS shape FROM f)
    SELECT w.doc_id, w.shape AS work, count(*) AS parts, round(avg((w.shape = s.shape)::INT), 6) AS consistency FROM s JOIN s w ON s.doc_id = w.doc_id AND w.part = -1 AND s.part >= 0 GROUP BY ALL""")
def multiscale_shapes(spark, sf_dir):
    """The shape of each document's series, and how many of its three parts have the same."""
    docs = Q._entropy(spark, sf_dir, Q.NARROW)
    x = F.col("lexical_entropy")
    each = F.greatest((F.size(x) / 3).cast("int"), F.lit(1))
    parts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.slice(x, k * each + 1, F.when(k == 2, F.size(x)).otherwise(each))), lambda p: F.size(p) > 0)
    shaped = docs.select("doc_id", detectors.quarter_shape(x).alias("work"), parts.alias("_parts")).withColumn("_shapes", F.transform("_parts", lambda p: detectors.quarter_shape(p)))
    same = F.size(F.filter("_shapes", lambda s: s == F.col("work"))) / F.size("_shapes")
    return shaped.select("doc_id", "work", F.size("_shapes").alias("parts"), F.round(same, 6).alias("consistency"))
