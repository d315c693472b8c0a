"""Numeric series as array columns.

A document's series is one array, so smoothing, resampling and features need
no shuffle. Kernels with fixed weights are literals of the plan.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often, and inside whatever lambda, f uses it."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def lets(f: Callable[..., Column], *steps: Callable[..., Column]) -> Column:
    """f of values that are computed once, each from the ones before."""

    def bind(done: list[Column]) -> Column:
        if len(done) == len(steps):
            return f(*done)
        return let(steps[len(done)](*done), lambda v: bind([*done, v]))

    return bind([])


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """A function whose first argument is computed once."""

    @functools.wraps(f)
    def once(x: Column, *args, **kwargs) -> Column:
        return let(x, lambda v: f(v, *args, **kwargs))

    return once


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


@bound
def running(x: Column, block: int = 64) -> Column:
    """Sums of the first values, the next one added each time; sums of blocks keep the cost far from the square of the length."""
    n = F.size(x)
    part = lambda b: total(F.slice(x, b * block + 1, F.least(F.lit(block), n - b * block)))

    def sums(parts: Column) -> Column:
        return let(F.transform(parts, lambda _, b: total(F.slice(parts, 1, b))), lambda heads: F.transform(x, lambda _, i: F.get(heads, F.floor(i / block).cast("int")) + total(F.slice(x, F.floor(i / block).cast("int") * block + 1, i % block + 1))))

    return F.when(n > 0, let(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), part), sums)).otherwise(x)


@bound
def mean(x: Column) -> Column:
    """Null for no values."""
    return F.when(F.size(x) > 0, total(x) / F.size(x))


@bound
def variance(x: Column) -> Column:
    """Of the population."""
    return F.when(F.size(x) > 0, let(mean(x), lambda m: total(F.transform(x, lambda v: (v - m) * (v - m)))) / F.size(x))


def running_variance(x: Column) -> Column:
    """Of the population, by one pass of running means (Welford's), as SQL engines take it: where a variance is compared with a bound, the last digit decides. Null for no values."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(a: Column, v: Column) -> Column:
        n = a["n"] + 1
        moved = lambda m: F.struct(n.alias("n"), m.alias("m"), (a["s"] + (v - m) * (v - a["m"])).alias("s"))
        return let(a["m"] + (v - a["m"]) / n, moved)

    return F.aggregate(x, start, step, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))


def deviation(x: Column) -> Column:
    return F.sqrt(variance(x))


def at(x: Column, i: Column) -> Column:
    """From 0; null outside."""
    return F.get(x, i)


def indexed(x: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.transform(x, f)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


@bound
def minmax(x: Column, flat: float = 0.0, least: float = 0.0) -> Column:
    """Scaled to 0..1; ``flat`` for series whose range is not over ``least``."""

    def scaled(low: Column, high: Column) -> Column:
        return F.when(high - low > least, F.transform(x, lambda v: (v - low) / (high - low))).otherwise(F.transform(x, lambda v: F.lit(flat)))

    return lets(scaled, lambda: F.array_min(x), lambda low: F.array_max(x))


@bound
def zscore(x: Column) -> Column:

    def scaled(m: Column, s: Column) -> Column:
        return F.when(s > 0, F.transform(x, lambda v: (v - m) / s)).otherwise(F.transform(x, lambda v: F.lit(0.0)))

    return lets(scaled, lambda: mean(x), lambda m: deviation(x))


@bound
def moving_average(x: Column, k: int = 5) -> Column:
    """Sums of k values around each, zeros beyond the ends, over k."""
    half = k // 2
    return F.transform(x, lambda v, i: total(F.slice(x, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, F.size(x) - 1) - F.greatest(i - half, F.lit(0)) + 1)) / k)


@bound
def resample(x: Column, n: int | Column) -> Column:
    """n points of the line through the values, ends included."""
    last = F.size(x) - 1
    n = F.lit(n) if isinstance(n, int) else n

    def point(i: Column) -> Column:
        p = i * last / F.greatest(n - 1, F.lit(1)).cast("double")
        low = F.floor(p).cast("int")
        return at(x, low) + (p - low) * (at(x, F.least(low + 1, last)) - at(x, low))

    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point))


def gaussian_weights(sigma: float) -> list[float]:
    """Up to four sigma on either side; their sum is one."""
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(weights) for w in weights]


@bound
def gaussian(x: Column, sigma: float) -> Column:
    """Gaussian smoothing cut at four sigma; the series is mirrored at its ends, end values included."""
    weights = gaussian_weights(sigma)
    radius, n = len(weights) // 2, F.size(x)
    kernel = F.array(*(F.lit(w) for w in weights))

    def mirrored(i: Column) -> Column:
        p = F.pmod(i, 2 * n)
        return at(x, F.when(p < n, p).otherwise(2 * n - 1 - p))

    ks = F.sequence(F.lit(0), F.lit(2 * radius))
    return F.transform(x, lambda v, i: F.aggregate(ks, F.lit(0.0), lambda a, k: a + F.get(kernel, k) * mirrored(i + k - radius)))


def savgol_weights(window: int, order: int) -> list[list[float]]:
    """Row p: weights that give the value at place p of the least-squares polynomial through ``window`` points."""
    half = window // 2
    ts = [(i - half) / half for i in range(window)]
    size = order + 1
    normal = [[sum(t ** (i + j) for t in ts) for j in range(size)] for i in range(size)]
    inverse = [row[:] + [float(i == j) for j in range(size)] for i, row in enumerate(normal)]
    for c in range(size):
        pivot = max(range(c, size), key=lambda r: abs(inverse[r][c]))
        inverse[c], inverse[pivot] = inverse[pivot], inverse[c]
        inverse[c] = [v / inverse[c][c] for v in inverse[c]]
        for r in range(size):
            if r != c:
                inverse[r] = [v - inverse[r][c] * u for v, u in zip(inverse[r], inverse[c], strict=True)]
    inverse = [row[size:] for row in inverse]
    return [[sum(p**i * inverse[i][j] * t**j for i in range(size) for j in range(size)) for t in ts] for p in ts]


@bound
def savitzky_golay(x: Column, window: int = 11, order: int = 3) -> Column:
    """Local least-squares cubic; the end pieces come from the first and the last window. Shorter series stay as they are."""
    half, n = window // 2, F.size(x)
    rows = F.array(*(F.array(*(F.lit(w) for w in row)) for row in savgol_weights(window, order)))

    def value(i: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(i - half, n - window))
        weights = F.get(rows, i - start)
        return F.aggregate(F.sequence(F.lit(0), F.lit(window - 1)), F.lit(0.0), lambda a, k: a + F.get(weights, k) * at(x, start + k))

    return F.when(n < window, x).otherwise(F.transform(x, lambda v, i: value(i)))


@bound
def compound(x: Column) -> Column:
    """Running sum of the centred series over its largest size, 1 at least."""

    def running(m: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<double>"), lambda a, v: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)) + v - m))

    def most(m: Column, sums: Column) -> Column:
        return F.greatest(F.abs(F.array_min(sums)), F.abs(F.array_max(sums)), F.lit(1.0))

    return lets(lambda m, sums, top: F.transform(sums, lambda v: v / top), lambda: mean(x), running, most)


@bound
def differences(x: Column) -> Column:
    return F.when(F.size(x) > 1, F.transform(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda v, i: v - at(x, i))).otherwise(F.array().cast("array<double>"))


@bound
def gradient(x: Column, step: Column) -> Column:
    """Central differences; one-sided at the ends."""
    last = F.size(x) - 1
    return F.when(last < 1, F.transform(x, lambda v: F.lit(0.0))).otherwise(
        F.transform(x, lambda v, i: (at(x, F.least(i + 1, last)) - at(x, F.greatest(i - 1, F.lit(0)))) / (step * (F.least(i + 1, last) - F.greatest(i - 1, F.lit(0)))))
    )


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of two series of one length; 0 if one is constant."""

    def centred(z: Column) -> Column:
        return let(z, lambda v: let(mean(v), lambda m: F.transform(v, lambda a: a - m)))

    def ratio(a: Column, b: Column, size: Column) -> Column:
        return F.when(size > 1e-12, dot(a, b) / size).otherwise(0.0)

    return lets(ratio, lambda: centred(x), lambda a: centred(y), lambda a, b: F.sqrt(dot(a, a) * dot(b, b)))


@bound
def slope(x: Column) -> Column:
    """Least-squares slope by index; 0 for fewer than two values."""
    n = F.size(x)
    mid, many = (n - 1) / 2, n.cast("double")
    spread = many * (many * many - 1) / F.lit(12.0)
    sums = let(mean(x), lambda m: F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda a, i: a + (i - mid) * (at(x, i) - m)))
    return F.when(n > 1, sums / spread).otherwise(0.0)


@bound
def determination(x: Column, trace: float = 0.0) -> Column:
    """R squared of the least-squares line, ``trace`` added to the sum of squares; 0 for constant series."""
    n = F.size(x).cast("double")
    return lets(lambda b, v: F.when(v > 0, F.greatest(F.lit(0.0), 1 - (v - b * b * (n * n - 1) / F.lit(12.0)) * n / (v * n + trace))).otherwise(0.0), lambda: slope(x), lambda b: variance(x))


@bound
def autocorrelation(x: Column) -> Column:
    n = F.size(x)
    return F.when(n > 2, correlation(F.slice(x, 1, F.greatest(n - 1, F.lit(0))), F.slice(x, 2, F.greatest(n - 1, F.lit(0))))).otherwise(0.0)


@bound
def mirror_symmetry(x: Column) -> Column:
    """Size of the correlation of the first half with the mirrored second half of as many values."""
    half = (F.size(x) / 2).cast("int")
    return F.when(half > 1, F.abs(correlation(F.slice(x, 1, half), F.reverse(F.slice(x, half + 1, half))))).otherwise(0.0)


@bound
def moment(x: Column, k: int) -> Column:
    """Standardised central moment of the population; 0 for constant series."""
    return lets(lambda m, s: F.when(s > 1e-12, total(F.transform(x, lambda v: F.pow((v - m) / s, F.lit(k)))) / F.size(x)).otherwise(0.0), lambda: mean(x), lambda m: deviation(x))


@bound
def sign_changes(x: Column) -> Column:
    return let(F.filter(F.transform(differences(x), F.signum), lambda v: v != 0), lambda steps: F.size(F.filter(differences(steps), lambda v: v != 0)))


@bound
def local_maxima(x: Column, least: float = float("-inf")) -> Column:
    """Places of values above both neighbours and ``least``."""
    last = F.size(x) - 1
    return F.when(
        last >= 2,
        F.filter(F.sequence(F.lit(1), F.greatest(last - 1, F.lit(1))), lambda i: (at(x, i) > at(x, i - 1)) & (at(x, i) > at(x, i + 1)) & (at(x, i) > least)),
    ).otherwise(F.array().cast("array<int>"))


def quarters(x: Column) -> list[Column]:
    """Means of four parts: three of floor(n/4) values and the rest."""
    q = (F.size(x) / 4).cast("int")
    parts = [F.slice(x, q * k + 1, q) for k in range(3)] + [F.slice(x, q * 3 + 1, F.size(x))]
    return [mean(p) for p in parts]


@bound
def first_part(x: Column, k: int) -> Column:
    """floor(n/k) values from the start."""
    return F.slice(x, 1, (F.size(x) / k).cast("int"))


@bound
def last_part(x: Column, k: int) -> Column:
    """ceil(n/k) values at the end."""
    n = F.ceil(F.size(x) / k).cast("int")
    return F.slice(x, F.size(x) - n + 1, n)


@bound
def argmax(x: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


@bound
def argmin(x: Column) -> Column:
    return (F.array_position(x, F.array_min(x)) - 1).cast("int")


def best_lag(x: Column, y: Column, reach: int = 10) -> Column:
    """(lag, r) with the largest correlation of x and the shifted y, of those equal in nine digits the smallest lag."""
    n = F.size(x)

    def part(lag: Column) -> Column:
        kept = F.greatest(n - F.abs(lag), F.lit(0))
        a = F.slice(x, F.greatest(-lag, F.lit(0)) + 1, kept)
        b = F.slice(y, F.greatest(lag, F.lit(0)) + 1, kept)
        return F.struct(F.when(kept > 2, F.round(correlation(a, b), 9)).otherwise(-2.0).alias("r"), (-lag).alias("order"), lag.alias("lag"))

    return F.array_max(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), part))


def counts(items: Column) -> Column:
    """How often each distinct item occurs: sorted once, then cut where neighbours differ."""

    def ends(ordered: Column) -> Column:
        n = F.size(ordered)
        return F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == n) | (at(ordered, i) != at(ordered, i - 1)))

    def sizes(ordered: Column, cuts: Column) -> Column:
        return F.when(F.size(ordered) > 0, F.transform(cuts, lambda e, k: e - F.coalesce(F.when(k > 0, at(cuts, k - 1)), F.lit(0)))).otherwise(F.array().cast("array<int>"))

    return lets(sizes, lambda: F.sort_array(items), ends)


@bound
def entropy(items: Column, base: float = 2.0) -> Column:
    """Shannon entropy of the items' shares; 0 for none."""
    n = F.size(items)
    inner = F.aggregate(counts(items), F.lit(0.0), lambda a, c: a + c * F.log(base, c.cast("double")))
    return F.when(n > 0, F.log(base, n.cast("double")) - inner / n).otherwise(0.0)


@bound
def normal_entropy(items: Column) -> Column:
    """Entropy over that of equal shares; 0 for fewer than two distinct items."""
    distinct = F.size(F.array_distinct(items))
    return F.when(distinct > 1, entropy(items) / F.log2(F.greatest(distinct, F.lit(2)).cast("double"))).otherwise(0.0)
