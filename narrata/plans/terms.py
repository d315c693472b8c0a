"""Registered queries of large lexicons, which are made of the tables' own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.functions import text as X
from narrata.operators import terms as C
from narrata.plans import queries as Q
from narrata.plans.registry import query, table

#: Least and most letters of a term, and negations.
SHORTEST, LONGEST, NEGATIONS = 3, 6, (" the", " la", " der")

_LEXICON_SQL = rf"""lx AS (SELECT term, CAST('0x' || substr(md5(term), 1, 2) AS INT) % 11 - 5 AS value FROM (SELECT DISTINCT left(w, {LONGEST}) AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM benchmark) WHERE length(w) >= {SHORTEST}))"""


def _lexicon(spark, sf_dir):
    """Beginnings of the words of ``benchmark``, with a value of -5 to 5 each."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(X.matches(F.lower("text"), r"\p{L}+")).alias("w")).where(F.length("w") >= SHORTEST)
    named = words.select(F.left("w", F.lit(LONGEST)).alias("term")).distinct()
    return C.shared(named.withColumn("value", F.conv(F.left(F.md5("term"), F.lit(2)), 16, 10).cast("int") % 11 - 5))


@query(rf"""WITH {_LEXICON_SQL}, w AS (SELECT doc_id, row_number() OVER () AS i, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM documents)), x AS (SELECT DISTINCT w FROM w), m AS (SELECT w, arg_max(value, length(term)) AS value FROM (SELECT w, unnest(list_transform(range(1, least(length(w), {LONGEST}) + 1), lambda n: left(w, n))) AS term FROM x) JOIN lx USING (term) GROUP BY w),
    s AS (SELECT doc_id, count(*) AS n_words, count(value) AS n_terms, sum(greatest(coalesce(value, 0), 0)) AS p, sum(greatest(-coalesce(value, 0), 0)) AS n FROM w LEFT JOIN m USING (w) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_terms, 0) AS n_terms, round(coalesce((p - n) / n_words * 100 / ((p + n) / n_words * 100 + 15), 0), 6) + 0.0 AS score FROM documents LEFT JOIN s USING (doc_id)""")
def term_sentiment(spark, sf_dir):
    """Sentiment of each document by the longest terms that begin its words."""
    docs = C.word_values(Q._docs(spark, sf_dir), X.matches(F.lower("text"), r"\p{L}+"), _lexicon(spark, sf_dir))
    v = F.col("values")
    return docs.select("doc_id", F.size(v).cast("long").alias("n_words"), F.size(F.filter(v, lambda x: x.isNotNull())).cast("long").alias("n_terms"), (F.round(C.balance(v), 6) + 0.0).alias("score"))


@query()
def term_compound(spark, sf_dir):
    """The same without words: leftmost-longest terms anywhere, turned by what follows."""
    docs = Q._docs(spark, sf_dir).select("doc_id", F.lower("text").alias("text"))
    turned = C.found(docs, "text", _lexicon(spark, sf_dir), negations=NEGATIONS)
    return turned.select("doc_id", F.size("found").alias("n_terms"), F.round(C.compound(F.col("found.value")), 6).alias("score"))
