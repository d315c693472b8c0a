"""The registered report of tests between two groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.operators import validation as V
from narrata.plans import queries as Q
from narrata.plans.registry import query
from narrata.workspace import Workspace

#: Deviations that part three bands, and one that few documents have.
BANDS, RARE = (0.008, 0.012), 0.2

#: Two-sided tail of the normal distribution, by Simpson's rule.
_NORMAL = "greatest(1 - 2 * abs({z}) / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow({z} * i / 2000, 2) / 2))), 0)"
_FACTORIAL = "lgamma(({n}) + 1)"


def _hypergeometric(k: str) -> str:
    f = lambda n: _FACTORIAL.format(n=n)
    return f"exp({f('a + b')} + {f('c + d')} + {f('a + c')} + {f('b + d')} - {f('a + b + c + d')} - {f(k)} - {f(f'a + b - {k}')} - {f(f'a + c - {k}')} - {f(f'd - a + {k}')})"


_METRIC_SQL = """{m}_r AS (SELECT first, rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0 AS r FROM gr),
    {m}_a AS (SELECT count(*) FILTER (first)::DOUBLE AS n1, count(*) FILTER (NOT first)::DOUBLE AS n2, sum(r) FILTER (first) AS s FROM {m}_r), {m}_t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM gr GROUP BY {m})),
    {m}_u AS (SELECT n1, n2, s - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS e FROM {m}_a, {m}_t), {m}_z AS (SELECT *, greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0) / e AS z, 2 * u / (n1 * n2) - 1 AS delta FROM {m}_u)"""


@query(f"""WITH {Q._MEANS_SQL}, gr AS (SELECT lang = 'en' AS first, mean, std, CASE WHEN std < {BANDS[0]} THEN 'low' WHEN std < {BANDS[1]} THEN 'middle' ELSE 'high' END AS band, std > {RARE} AS rare FROM md), {_METRIC_SQL.format(m="mean")}, {_METRIC_SQL.format(m="std")},
    k AS (SELECT band, count(*) FILTER (first) AS x, count(*) FILTER (NOT first) AS y FROM gr GROUP BY band), n AS (SELECT sum(x)::DOUBLE AS n1, sum(y)::DOUBLE AS n2 FROM k), ex AS (SELECT n1, n2, unnest([x, y]) AS o, unnest([(x + y) * n1 / (n1 + n2), (x + y) * n2 / (n1 + n2)]) AS e FROM k, n), ch AS (SELECT n1, n2, sum((o - e) * (o - e) / e) AS x, sqrt(sum((o - e) * (o - e) / e) / (n1 + n2)) AS v, min(e) AS least FROM ex GROUP BY n1, n2),
    ft AS (SELECT count(*) FILTER (first AND NOT rare) AS a, count(*) FILTER (first AND rare) AS b, count(*) FILTER (NOT first AND NOT rare) AS c, count(*) FILTER (NOT first AND rare) AS d FROM gr), fk AS (SELECT *, unnest(range(greatest(a - d, 0), least(a + b, a + c) + 1)) AS k FROM ft), fp AS (SELECT a, b, c, d, {_hypergeometric("k")} AS q, {_hypergeometric("a")} AS p FROM fk),
    fx AS (SELECT a, b, c, d, sum(q) FILTER (q <= p * (1 + 1e-7)) AS exact, (a + b + c + d)::DOUBLE AS n FROM fp GROUP BY a, b, c, d),
    fy AS (SELECT *, least((a + b) * (a + c), (a + b) * (b + d), (c + d) * (a + c), (c + d) * (b + d)) / n AS e, n * pow(greatest(abs(a * d - b * c) - n / 2, 0), 2) / ((a + b)::DOUBLE * (c + d) * (a + c) * (b + d)) AS x FROM fx),
    al AS (SELECT 'chi_squared' AS test, 'band' AS metric, n1, n2, x AS statistic, exp(-x / 2) AS p, v AS effect, CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.3 THEN 'small' WHEN v < 0.5 THEN 'medium' ELSE 'large' END AS band, CASE WHEN least < 5 THEN 'few are expected in a cell' END AS note FROM ch
      UNION ALL SELECT CASE WHEN e < 5 THEN 'fisher' ELSE 'chi_squared' END, 'rare', a + b, c + d, CASE WHEN e >= 5 THEN x WHEN b * c <> 0 THEN a * d / (b * c) END, CASE WHEN e < 5 THEN least(exact, 1) ELSE {_NORMAL.format(z="sqrt(x)")} END, CASE WHEN e >= 5 THEN sqrt(x / (a + b + c + d)) END,
        CASE WHEN e >= 5 THEN CASE WHEN sqrt(x / (a + b + c + d)) < 0.1 THEN 'negligible' WHEN sqrt(x / (a + b + c + d)) < 0.3 THEN 'small' WHEN sqrt(x / (a + b + c + d)) < 0.5 THEN 'medium' ELSE 'large' END END, NULL FROM fy
      {"".join(f"UNION ALL SELECT 'mann_whitney', '{m}', n1, n2, u, {_NORMAL.format(z='z')}, delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END, NULL FROM {m}_z " for m in ("mean", "std"))})
    SELECT test, metric, n1::BIGINT AS n1, n2::BIGINT AS n2, round(statistic, 4) AS statistic, round(p, 5) + 0.0 AS p, round(effect, 5) AS effect, band, note, p < 0.05 AS significant FROM al""")
def validation_report(spark, sf_dir):
    """Whether the entropy of English documents differs from that of others: labels by exact tests, metrics by ranks."""
    std = F.col("std")
    docs = Q._means(spark, sf_dir).withColumns({"band": F.when(std < BANDS[0], "low").when(std < BANDS[1], "middle").otherwise("high"), "rare": std > RARE})
    # Each test reads the rows anew.
    docs = Workspace(spark, "validation").save(docs, "rows")
    first = F.col("lang") == "en"
    found = V.report(docs, first, "band", ["mean", "std"]).unionByName(V.labels(docs, first, "rare").withColumn("significant", F.col("p") < 0.05))
    return found.withColumns({"statistic": F.round("statistic", 4), "p": F.round("p", 5) + 0.0, "effect": F.round("effect", 5)})
