"""Features of a series over normal time, and the shapes that they tell of.

Two sets of features: one from a smoothed series with forward differences and
the first and last tenths, one from the series as it is with central
differences and quarters. Each is a struct column of one row's array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions import peaks as P
from narrata.functions import series as S

# Quartiles of curvature and peaks over a corpus of works.
LOW, MEDIAN, HIGH, SHARP, SOME_PEAKS, MANY_PEAKS = 52.0, 64.0, 72.0, 1000.0, 11, 13
KINDS = ("geodesic_tragedy", "high_curvature_mystery", "random_walk_comedy", "compression_progress", "discontinuous_twist")


def _struct(digits: int, **columns: Column) -> Column:
    """Rounded; what lies in the middle goes up, whatever the order of its sum."""
    return F.struct(*((F.round(c + 1e-9, digits) + 0.0 if k != "n_peaks" else c).alias(k) for k, c in columns.items()))


@S.bound
def forward(x: Column) -> Column:
    """Differences to the next value over the step of normal time, the last one again; 0 for fewer than five values."""
    last = F.size(x) - 1
    each = lambda j: (S.at(x, j + 1) - S.at(x, j)) * last
    return F.transform(x, lambda v, i: F.when(last < 4, 0.0).otherwise(each(F.least(i, last - 1))))


def area(y: Column) -> Column:
    """Of the trapezoids under a series over normal time."""
    return S.let(y, lambda v: F.when(F.size(v) > 1, (S.total(v) - (S.at(v, F.lit(0)) + S.at(v, F.size(v) - 1)) / 2) / (F.size(v) - 1)).otherwise(0.0))


def bend(first: Column, second: Column) -> Column:
    return F.zip_with(second, first, lambda b, s: F.abs(b) / F.pow(1 + s * s, F.lit(1.5)))


def _peaks(x: Column) -> Column:
    return S.let(0.5 * S.deviation(x), lambda least: P.peaks(x, 1, least))


@S.bound
def geometric_features(x: Column, digits: int = 4, smoothed: Column | None = None) -> Column:
    """Eighteen features and ``late``, the share of peaks behind 0.6; ``smoothed`` is the series smoothed by two, where it is known."""
    n = F.size(x)
    tenth = F.greatest((n / 10).cast("int"), F.lit(1))

    def told(smooth: Column, slope: Column, curve: Column, raw: Column, at: Column) -> Column:
        early, late = S.mean(F.slice(x, 1, tenth)), S.mean(F.slice(x, n - tenth + 1, tenth))
        return _struct(
            digits,
            mean=S.mean(x), deviation=S.deviation(x), highest=F.array_max(x), lowest=F.array_min(x),
            mean_curvature=S.mean(curve), max_curvature=F.array_max(curve), curvature_variance=S.variance(curve), total_curvature=area(curve),
            arc_length=area(F.transform(slope, lambda s: F.sqrt(1 + s * s))),
            mean_derivative=S.mean(raw), max_derivative=F.array_max(F.transform(raw, F.abs)), derivative_variance=S.variance(raw),
            n_peaks=F.size(at), skewness=F.when(n < 4, 0.0).otherwise(S.moment(x, 3)), kurtosis=F.when(n < 4, 0.0).otherwise(S.moment(x, 4) - 3),
            entropy_initial=early, entropy_final=late, entropy_change=late - early,
            late=F.size(F.filter(at, lambda i: i / (n - 1) > 0.6)) / F.greatest(F.size(at), F.lit(1)),
        )

    return S.lets(
        told,
        lambda: F.when(n < 5, x).otherwise(S.gaussian(x, 2.0) if smoothed is None else smoothed), lambda smooth: forward(smooth), lambda smooth, slope: bend(slope, forward(slope)),
        lambda *_: forward(x), lambda smooth, *_: _peaks(F.transform(smooth, lambda v: F.round(v, 12))),
    )


@S.bound
def information_shape(f: Column, digits: int = 6) -> Column:
    """Shares of five kinds of movement, from :func:`geometric_features`."""
    one = F.lit(1.0)
    cv = F.when(f["mean"] > 0, f["deviation"] / f["mean"]).otherwise(0.0)
    change, peaks = f["entropy_change"], f["n_peaks"]
    not_under = lambda c: F.greatest(c, F.lit(0.0))
    raw = [
        not_under(1 - (f["mean_curvature"] - LOW) / (HIGH - LOW)) * F.when(change < -0.05, 1.0).when(change < 0, 0.3).otherwise(0.1) * F.when(f["skewness"] < -0.5, 1.0).when(f["skewness"] < 0, 0.5).otherwise(0.2),
        0.6 * not_under((f["mean_curvature"] - MEDIAN) / (HIGH - MEDIAN)) + 0.4 * F.least(one, peaks / MANY_PEAKS),
        0.4 * F.least(one, cv / 0.25) + 0.3 * F.least(one, peaks / SOME_PEAKS) + 0.3 * F.when(F.abs(change) < 0.1, 1.0).otherwise(0.5),
        F.when(change < -0.05, 0.7 * F.least(one, F.abs(change) / 0.3) + 0.3 * not_under(1 - cv / 0.3)).otherwise(0.1),
        0.6 * f["late"] + 0.4 * F.least(one, f["max_curvature"] / SHARP),
    ]
    return S.let(F.array(*raw), lambda r: S.let(S.total(r), lambda t: F.struct(*(F.round(F.when(t > 0, S.at(r, F.lit(i)) / t).otherwise(0.0), digits).alias(k) for i, k in enumerate(KINDS)))))


@S.bound
def shape_vector(x: Column, digits: int = 4) -> Column:
    """Eighteen features for classifiers; quarters are 0 for fewer than four values."""
    n = F.size(x)
    step = 1 / F.greatest(n - 1, F.lit(1)).cast("double")
    q = (n / 4).cast("int")
    of = lambda start, size: F.when(q > 0, S.mean(F.slice(x, start + 1, F.greatest(size, F.lit(1))))).otherwise(0.0)

    def told(speed: Column, curve: Column, at: Column) -> Column:
        each = lambda f, y: F.when(n > 2, f(y)).otherwise(0.0)
        return _struct(
            digits,
            mean=S.mean(x), deviation=S.deviation(x), lowest=F.array_min(x), highest=F.array_max(x),
            mean_curvature=each(S.mean, curve), max_curvature=each(F.array_max, curve), std_curvature=each(S.deviation, curve),
            n_peaks=F.size(at), skewness=S.moment(x, 3), kurtosis=S.moment(x, 4) - 3,
            entropy_change=of(n - q, q) - of(F.lit(0), q),
            arc_length=S.total(F.transform(S.differences(x), lambda d: F.sqrt(d * d + step * step))),
            q1=of(F.lit(0), q), q2=of(q, q), q3=of(2 * q, q), q4=of(3 * q, n - 3 * q),
            mean_velocity=each(S.mean, speed), std_velocity=each(S.deviation, speed),
        )

    return S.lets(told, lambda: S.gradient(x, step), lambda speed: bend(speed, S.gradient(speed, step)), lambda *_: _peaks(x))


@S.bound
def feature_label(f: Column) -> Column:
    """One of eight shapes, from :func:`shape_vector`: the first rule that holds."""
    middle, ends = (f["q2"] + f["q3"]) / 2, (f["q1"] + f["q4"]) / 2
    return (
        F.when((f["entropy_change"] > 0.1) & (f["skewness"] > 0.3), "rags_to_riches").when((f["entropy_change"] < -0.1) & (f["skewness"] < -0.3), "tragedy")
        .when(middle < 0.9 * ends, "man_in_hole").when(middle > 1.1 * ends, "icarus").when((f["n_peaks"] >= 3) & (f["q4"] > f["q2"]), "cinderella").when((f["n_peaks"] >= 3) & (f["q2"] > f["q4"]), "oedipus")
        .when(F.when(f["mean"] > 0, f["deviation"] / f["mean"]).otherwise(0.0) > 0.25, "random_walk").otherwise("other")
    )
