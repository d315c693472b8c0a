"""Geometric features and the shapes that they tell, against the formulas in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.operators import geometry as G


def forward(v):
    if len(v) < 5:
        return np.zeros(len(v))
    d = np.diff(v) * (len(v) - 1)
    return np.append(d, d[-1])


def peaks(v):
    """Places above both neighbours (no plateaus here) that stand out by half a deviation."""
    out = []
    for i in range(1, len(v) - 1):
        if v[i] > v[i - 1] and v[i] > v[i + 1]:
            left = max([j for j in range(i) if v[j] > v[i]], default=-1)
            right = min([j for j in range(i + 1, len(v)) if v[j] > v[i]], default=len(v))
            if v[i] - max(v[left + 1 : i + 1].min(), v[i:right].min()) >= 0.5 * v.std():
                out.append(i)
    return out


def smooth(v, sigma=2.0):
    if len(v) < 5:
        return v
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(v, radius, mode="symmetric"), kernel / kernel.sum(), mode="valid")


def trapezoid(y):
    return (y.sum() - (y[0] + y[-1]) / 2) / (len(y) - 1)


def features(v):
    s = smooth(v)
    d, r = forward(s), forward(v)
    c = np.abs(forward(d)) / (1 + d**2) ** 1.5
    at, w = peaks(s), max(1, len(v) // 10)
    z = (v - v.mean()) / v.std()
    return {
        "mean": v.mean(), "deviation": v.std(), "highest": v.max(), "lowest": v.min(), "mean_curvature": c.mean(), "max_curvature": c.max(), "curvature_variance": c.var(), "total_curvature": trapezoid(c),
        "arc_length": trapezoid(np.sqrt(1 + d**2)), "mean_derivative": r.mean(), "max_derivative": np.abs(r).max(), "derivative_variance": r.var(), "n_peaks": len(at), "skewness": (z**3).mean(), "kurtosis": (z**4).mean() - 3,
        "entropy_initial": v[:w].mean(), "entropy_final": v[-w:].mean(), "entropy_change": v[-w:].mean() - v[:w].mean(), "late": sum(i / (len(v) - 1) > 0.6 for i in at) / max(1, len(at)),
    }


def shapes(f):
    cv = f["deviation"] / f["mean"] if f["mean"] > 0 else 0
    fall = f["entropy_change"]
    raw = [
        max(0, 1 - (f["mean_curvature"] - 52) / 20) * (1 if fall < -0.05 else 0.3 if fall < 0 else 0.1) * (1 if f["skewness"] < -0.5 else 0.5 if f["skewness"] < 0 else 0.2),
        max(0, (f["mean_curvature"] - 64) / 8) * 0.6 + min(1, f["n_peaks"] / 13) * 0.4,
        min(1, cv / 0.25) * 0.4 + min(1, f["n_peaks"] / 11) * 0.3 + (1 if abs(fall) < 0.1 else 0.5) * 0.3,
        min(1, abs(fall) / 0.3) * 0.7 + max(0, 1 - cv / 0.3) * 0.3 if fall < -0.05 else 0.1,
        f["late"] * 0.6 + min(1, f["max_curvature"] / 1000) * 0.4,
    ]
    return [x / sum(raw) for x in raw]


@pytest.fixture(scope="module")
def series():
    draw = np.random.default_rng(11)
    walks = [draw.normal(0, s, n).cumsum() + 5 for n in (5, 9, 23, 60) for s in (0.05, 0.5, 3.0)]
    return [w.round(4) for w in [*walks, np.linspace(1, 0, 20) + draw.normal(0, 0.001, 20), np.linspace(0.2, 0.9, 30) + draw.normal(0, 0.2, 30)]]


def test_geometric_features(spark, series):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(series)], "i int, x array<double>")
    for r in df.select("i", G.geometric_features(F.col("x"), 9).alias("f")).select("i", "f.*", G.information_shape(F.col("f")).alias("k")).collect():
        own = features(series[r.i])
        assert {k: r[k] for k in own} == pytest.approx(own, rel=1e-6, abs=1e-7)
        assert list(r.k) == pytest.approx(shapes(own), abs=2e-6)


def test_a_falling_series_is_a_geodesic_tragedy(spark):
    x = [1 - (i / 39) ** 2 for i in range(40)]
    f = spark.createDataFrame([(x,)], "x array<double>").select(G.geometric_features(F.col("x")).alias("f"))
    kinds = f.select(G.information_shape(F.col("f")).alias("k")).first().k.asDict()
    # Hand values: curvature far under 52, a fall over 0.3, negative skewness above -0.5.
    assert f.first().f.entropy_change < -0.3 and max(kinds, key=kinds.get) == "geodesic_tragedy" and abs(sum(kinds.values()) - 1) < 1e-5


def test_shape_vectors(spark, series):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(series)], "i int, x array<double>")
    for r in df.select("i", G.shape_vector(F.col("x"), 9).alias("f")).select("i", "f.*").collect():
        v = series[r.i]
        at = np.linspace(0, 1, len(v))
        speed = np.gradient(v, at)
        c = np.abs(np.gradient(speed, at)) / (1 + speed**2) ** 1.5
        q = len(v) // 4
        own = {
            "mean_curvature": c.mean(), "max_curvature": c.max(), "std_curvature": c.std(), "n_peaks": len(peaks(v)), "entropy_change": v[-q:].mean() - v[:q].mean(), "arc_length": np.sqrt(np.diff(v) ** 2 + np.diff(at) ** 2).sum(),
            "q1": v[:q].mean(), "q2": v[q : 2 * q].mean(), "q3": v[2 * q : 3 * q].mean(), "q4": v[3 * q :].mean(), "mean_velocity": speed.mean(), "std_velocity": speed.std(),
        }
        assert {k: r[k] for k in own} == pytest.approx(own, rel=1e-6, abs=1e-7)


def test_labels(spark):
    plain = {"entropy_change": 0.0, "skewness": 0.0, "q1": 1.0, "q2": 1.0, "q3": 1.0, "q4": 1.0, "n_peaks": 0, "mean": 1.0, "deviation": 0.1}
    cases = {
        "rags_to_riches": {"entropy_change": 0.2, "skewness": 0.4}, "tragedy": {"entropy_change": -0.2, "skewness": -0.4}, "man_in_hole": {"q2": 0.5, "q3": 0.5}, "icarus": {"q2": 1.5, "q3": 1.5},
        "cinderella": {"n_peaks": 3, "q4": 1.1}, "oedipus": {"n_peaks": 3, "q2": 1.05}, "random_walk": {"deviation": 0.3}, "other": {},
    }
    rows = [(name, {**plain, **more}) for name, more in cases.items()]
    df = spark.createDataFrame([(n, *(float(v) for v in f.values())) for n, f in rows], "name string, " + ", ".join(f"{k} double" for k in plain))
    assert all(r.name == r.label for r in df.select("name", G.feature_label(F.struct(*plain)).alias("label")).collect())
