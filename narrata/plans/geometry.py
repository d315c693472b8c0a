"""Registered queries of geometric features."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.functions import kernels as K
from narrata.operators import detectors
from narrata.operators import geometry as G
from narrata.plans import oracle as O
from narrata.plans import queries as Q
from narrata.plans.registry import query
from narrata.workspace import Workspace


def _round(columns: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"{e} AS {k}" if k == "n_peaks" else f"round({e} + 1e-9, {digits}) + 0.0 AS {k}" for k, e in columns.items())


def _moment(x: str, k: int) -> str:
    return f"(CASE WHEN sqrt({O.variance(x)}) > 1e-12 THEN list_avg(list_transform({x}, lambda y: pow((y - list_avg({x})) / sqrt({O.variance(x)}), {k}))) ELSE 0.0 END)"


def _forward(x: str) -> str:
    return f"list_transform(range(len({x})), lambda i: CASE WHEN len({x}) < 5 THEN 0.0 ELSE ({x}[least(i, len({x}) - 2) + 2] - {x}[least(i, len({x}) - 2) + 1]) * (len({x}) - 1) END)"


def _central(x: str) -> str:
    return f"list_transform(range(len({x})), lambda i: CASE WHEN len({x}) < 2 THEN 0.0 ELSE ({x}[least(i + 1, len({x}) - 1) + 1] - {x}[greatest(i - 1, 0) + 1]) * (len({x}) - 1) / (least(i + 1, len({x}) - 1) - greatest(i - 1, 0)) END)"


def _bend(first: str, second: str) -> str:
    return f"list_transform(list_zip({first}, {second}), lambda z: abs(z[2]) / pow(1 + z[1] * z[1], 1.5))"


def _area(y: str) -> str:
    return f"(CASE WHEN len({y}) > 1 THEN (list_sum({y}) - ({y}[1] + {y}[len({y})]) / 2) / (len({y}) - 1) ELSE 0.0 END)"


_SERIES_SQL = f"{Q.W20}, {Q._ARRAY_SQL.replace('ar AS (', 'a9 AS (')}, ar AS (SELECT doc_id, list_transform(x, lambda v: round(v, 6)) AS x FROM a9 WHERE len(x) >= 4)"


def _long(spark, sf_dir):
    """Series of four values and more; they are written first, since a filter on them would work them out again."""
    docs = Q._entropy(spark, sf_dir, Q.NARROW).select("doc_id", F.transform("lexical_entropy", lambda v: F.round(v, 6)).alias("x"))
    return Workspace(spark, "series").save(docs, "series").where(F.size("x") >= 4)


_TENTH = "greatest(len(x) // 10, 1)"
_GEOMETRIC = {
    "mean": "list_avg(x)", "deviation": f"sqrt({O.variance('x')})", "highest": "list_max(x)", "lowest": "list_min(x)",
    "mean_curvature": "list_avg(c)", "max_curvature": "list_max(c)", "curvature_variance": O.variance("c"), "total_curvature": _area("c"), "arc_length": _area("list_transform(d, lambda s: sqrt(1 + s * s))"),
    "mean_derivative": "list_avg(r)", "max_derivative": "list_max(list_transform(r, lambda v: abs(v)))", "derivative_variance": O.variance("r"),
    "n_peaks": "len(pk)", "skewness": _moment("x", 3), "kurtosis": f"{_moment('x', 4)} - 3",
    "entropy_initial": f"list_avg(x[1 : {_TENTH}])", "entropy_final": f"list_avg(x[len(x) - {_TENTH} + 1 :])", "entropy_change": f"list_avg(x[len(x) - {_TENTH} + 1 :]) - list_avg(x[1 : {_TENTH}])",
    "late": "len(list_filter(pk, lambda i: (i - 1) / (len(x) - 1) > 0.6)) / greatest(len(pk), 1)",
}
_SHAPES = {
    "geodesic_tragedy": "greatest(1 - (mean_curvature - 52) / 20, 0) * CASE WHEN entropy_change < -0.05 THEN 1 WHEN entropy_change < 0 THEN 0.3 ELSE 0.1 END * CASE WHEN skewness < -0.5 THEN 1 WHEN skewness < 0 THEN 0.5 ELSE 0.2 END",
    "high_curvature_mystery": "0.6 * greatest((mean_curvature - 64) / 8, 0) + 0.4 * least(1, n_peaks / 13)",
    "random_walk_comedy": "0.4 * least(1, cv / 0.25) + 0.3 * least(1, n_peaks / 11) + 0.3 * CASE WHEN abs(entropy_change) < 0.1 THEN 1 ELSE 0.5 END",
    "compression_progress": "CASE WHEN entropy_change < -0.05 THEN 0.7 * least(1, abs(entropy_change) / 0.3) + 0.3 * greatest(1 - cv / 0.3, 0) ELSE 0.1 END",
    "discontinuous_twist": "0.6 * late + 0.4 * least(1, max_curvature / 1000)",
}


@query(f"""WITH {_SERIES_SQL}, {Q._gaussian_sql(2.0, "ar", "gs")}, sm AS (SELECT doc_id, ar.x, CASE WHEN len(ar.x) < 5 THEN ar.x ELSE gs.x END AS gv FROM ar JOIN gs USING (doc_id)),
    d1 AS (SELECT *, {_forward("gv")} AS d, {_forward("x")} AS r, list_transform(gv, lambda v: round(v, 12)) AS z FROM sm), d2 AS (SELECT *, {_forward("d")} AS b, 0.5 * sqrt({O.variance("z")}) AS least FROM d1), d3 AS (SELECT *, {_bend("d", "b")} AS c FROM d2), {O.peaks("d3", "z", "pk", "1", "least")},
    f AS (SELECT doc_id, {_round(_GEOMETRIC)} FROM pk), v AS (SELECT *, CASE WHEN mean > 0 THEN deviation / mean ELSE 0 END AS cv FROM f), w AS (SELECT *, {", ".join(f"({e})::DOUBLE AS {k}" for k, e in _SHAPES.items())} FROM v)
    SELECT doc_id, {", ".join(_GEOMETRIC)}, {", ".join(f"round({k} / ({' + '.join(_SHAPES)}), 6) AS {k}" for k in _SHAPES)} FROM w""")
def curvature(spark, sf_dir):
    """Geometric features of each document's series, and five kinds of movement."""
    step = detectors.Steps(_long(spark, sf_dir))
    (smoothed,) = step.batch(["array<double>"], lambda x: [K.gaussian(x, 2.0)], F.col("x"))
    return step.df.select("doc_id", G.geometric_features(F.col("x"), 6, smoothed).alias("f")).select("doc_id", "f.*", G.information_shape(F.col("f")).alias("k")).select("*", "k.*").drop("k")


_Q = "len(x) // 4"
_VECTOR = {
    "mean": "list_avg(x)", "deviation": f"sqrt({O.variance('x')})", "lowest": "list_min(x)", "highest": "list_max(x)",
    "mean_curvature": "list_avg(c)", "max_curvature": "list_max(c)", "std_curvature": f"sqrt({O.variance('c')})", "n_peaks": "len(pk)", "skewness": _moment("x", 3), "kurtosis": f"{_moment('x', 4)} - 3",
    "entropy_change": f"list_avg(x[len(x) - {_Q} + 1 :]) - list_avg(x[1 : {_Q}])", "arc_length": "list_sum(list_transform(range(1, len(x)), lambda i: sqrt(pow(x[i + 1] - x[i], 2) + pow(1 / (len(x) - 1), 2))))",
    "q1": f"list_avg(x[1 : {_Q}])", "q2": f"list_avg(x[{_Q} + 1 : 2 * ({_Q})])", "q3": f"list_avg(x[2 * ({_Q}) + 1 : 3 * ({_Q})])", "q4": f"list_avg(x[3 * ({_Q}) + 1 :])",
    "mean_velocity": "list_avg(d)", "std_velocity": f"sqrt({O.variance('d')})",
}


@query(f"""WITH {_SERIES_SQL}, d1 AS (SELECT *, {_central("x")} AS d, 0.5 * sqrt({O.variance("x")}) AS least FROM ar), d2 AS (SELECT *, {_central("d")} AS b FROM d1), d3 AS (SELECT *, {_bend("d", "b")} AS c FROM d2), {O.peaks("d3", "x", "pk", "1", "least")}, f AS (SELECT doc_id, {_round(_VECTOR)} FROM pk)
    SELECT *, CASE WHEN entropy_change > 0.1 AND skewness > 0.3 THEN 'rags_to_riches' WHEN entropy_change < -0.1 AND skewness < -0.3 THEN 'tragedy' WHEN (q2 + q3) / 2 < 0.9 * ((q1 + q4) / 2) THEN 'man_in_hole' WHEN (q2 + q3) / 2 > 1.1 * ((q1 + q4) / 2) THEN 'icarus'
      WHEN n_peaks >= 3 AND q4 > q2 THEN 'cinderella' WHEN n_peaks >= 3 AND q2 > q4 THEN 'oedipus' WHEN mean > 0 AND deviation / mean > 0.25 THEN 'random_walk' ELSE 'other' END AS shape FROM f""")
def shape_vectors(spark, sf_dir):
    """The features that classifiers take, and the shape that they tell."""
    return _long(spark, sf_dir).select("doc_id", G.shape_vector(F.col("x"), 6).alias("f")).select("doc_id", "f.*", G.feature_label(F.col("f")).alias("shape"))
