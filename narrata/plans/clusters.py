"""Registered queries of clusters and of nearest series."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.functions import series as S
from narrata.operators import density, hierarchy, warping
from narrata.plans import queries as Q
from narrata.plans.registry import query, table
from narrata.workspace import Workspace

#: Distance and least number of rows of density clusters of whole vectors of 256ths.
EPS, LEAST = 290, 3
#: Points of a series, clusters, neighbours and reach of a warping.
POINTS, CLUSTERS, NEIGHBOURS, REACH = 20, 6, 3, 2


@query(f"""WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    n AS (SELECT a.id AS a, b.id AS b, CAST(list_inner_product(a.e, a.e) + list_inner_product(b.e, b.e) - 2 * list_inner_product(a.e, b.e) AS BIGINT) AS d FROM v a JOIN v b ON list_inner_product(a.e, a.e) + list_inner_product(b.e, b.e) - 2 * list_inner_product(a.e, b.e) <= {EPS * EPS}),
    c AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= {LEAST}), l AS (SELECT a, b FROM n WHERE a IN (FROM c) AND b IN (FROM c)),
    r(id, o) AS (SELECT id, id FROM c UNION SELECT r.id, l.b FROM r JOIN l ON r.o = l.a), k AS (SELECT id, min(o) AS cluster FROM r GROUP BY id),
    e AS (SELECT n.a AS id, k.cluster FROM n JOIN k ON n.b = k.id WHERE n.a NOT IN (FROM c) QUALIFY row_number() OVER (PARTITION BY n.a ORDER BY d, n.b) = 1)
    SELECT v.id AS vec_id, coalesce(k.cluster, e.cluster) AS cluster, k.id IS NOT NULL AS core FROM v LEFT JOIN k ON k.id = v.id LEFT JOIN e ON e.id = v.id""")
def density_clusters(spark, sf_dir):
    """Density clusters of embeddings, whose components are 256ths, so that distances are exact."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("v"))
    return density.dbscan(vectors, "vec_id", "v", EPS, LEAST).withColumnRenamed("id", "vec_id")


def _points(spark, sf_dir, *more):
    """Each document's series, written once: a filter on it would work it out again."""
    docs = Q._entropy(spark, sf_dir, Q.NARROW, *more)
    return Workspace(spark, "points").save(docs.select("doc_id", *more, F.transform(S.resample(F.col("lexical_entropy"), POINTS), lambda v: F.round(v, 6)).alias("x")), "points")


@query()
def ward_clusters(spark, sf_dir):
    """Clusters of the documents' series by Ward's criterion."""
    return hierarchy.ward(_points(spark, sf_dir), "doc_id", "x", CLUSTERS)[0]


@query()
def ward_merges(spark, sf_dir):
    """The merges of Ward's hierarchy and their heights."""
    return hierarchy.ward(_points(spark, sf_dir), "doc_id", "x", CLUSTERS)[1].withColumn("height", F.round("height", 6))


@query()
def nearest_series(spark, sf_dir):
    """The nearest other series of each hundredth document, under warping."""
    found = warping.nearest_series(_points(spark, sf_dir), "doc_id", "x", F.col("doc_id") % 100 == 0, NEIGHBOURS, REACH)
    return found.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("distance", 6).alias("distance"), "compared")
