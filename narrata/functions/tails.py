"""Tails of distributions as columns, so that a report of tests is one DataFrame.

The incomplete gamma and beta functions are sums of fixed length in the row's
own expression: no function of Python runs, and every engine that can add gets
the same digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions import series as S

#: Terms of series and steps of continued fractions.
TERMS = 300


@S.bound
def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series eight places up, and down again by the product between."""
    up = x.cast("double") + 8
    series = (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * F.pow(up, F.lit(3))) + 1 / (1260 * F.pow(up, F.lit(5))) - 1 / (1680 * F.pow(up, F.lit(7)))
    between = F.lit(1.0)
    for i in range(8):
        between = between * (x + float(i))
    return series - F.log(between)


def log_factorial(n: Column) -> Column:
    return log_gamma(n + 1.0)


def upper_gamma(a: Column, x: Column, terms: int = TERMS) -> Column:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction from there on."""

    def told(a: Column, x: Column) -> Column:
        scale = F.exp(-x + a * F.log(x) - log_gamma(a))
        start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))

        def add(s: Column, k: Column) -> Column:
            return S.let(s["term"] * x / (a + k), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")))

        lower = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, add, lambda s: s["sum"])
        # From the innermost step outwards.
        inner = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, k: k * (k - a) / (x + 2 * k + 1 - a - f))
        return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(1 - scale * lower, F.lit(0.0))).otherwise(F.least(scale / (x + 1 - a - inner), F.lit(1.0)))

    return S.lets(told, lambda: a.cast("double"), lambda _: x.cast("double"))


def _beta_fraction(a: Column, b: Column, x: Column, terms: int) -> Column:
    """The continued fraction of the incomplete beta function, from the innermost step outwards."""

    def step(f: Column, m: Column) -> Column:
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return even / (1 + odd / (1 + f))

    inner = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(0.0), step)
    return 1 / (1 - (a + b) * x / (a + 1) / (1 + inner))


def lower_beta(a: Column, b: Column, x: Column, terms: int = TERMS) -> Column:
    """Regularised incomplete beta function."""

    def told(a: Column, b: Column, x: Column) -> Column:
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
        near = x < (a + 1) / (a + b + 2)
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(near, front * _beta_fraction(a, b, x, terms) / a).otherwise(1 - front * _beta_fraction(b, a, 1 - x, terms) / b)

    return S.lets(told, lambda: a.cast("double"), lambda *_: b.cast("double"), lambda *_: x.cast("double"))


def p_chi_squared(chi2: Column, dof: Column) -> Column:
    """Upper tail; 1 without degrees of freedom."""
    return F.when(dof > 0, upper_gamma(dof / 2, chi2 / 2)).otherwise(1.0)


def p_normal(z: Column) -> Column:
    """Two-sided."""
    return upper_gamma(F.lit(0.5), z * z / 2)


def p_student(t: Column, dof: Column) -> Column:
    """Two-sided, of Student's t; degrees of freedom need not be whole."""
    return lower_beta(dof / 2, F.lit(0.5), dof / (dof + t * t))


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Fisher's exact two-sided p of a two by two table: the tables with its margins that are no likelier than it is."""

    def told(row: Column, column: Column, n: Column, own: Column) -> Column:
        f = log_factorial
        whole = f(row) + f(n - row) + f(column) + f(n - column) - f(n)
        of = lambda k: F.exp(whole - f(k) - f(row - k) - f(column - k) - f(n - row - column + k))
        low, high = F.greatest(row + column - n, F.lit(0).cast("long")), F.least(row, column)
        return S.let(of(own), lambda p: F.least(F.aggregate(F.sequence(low, high), F.lit(0.0), lambda s, k: S.let(of(k), lambda q: s + F.when(q <= p * (1 + 1e-7), q).otherwise(0.0))), F.lit(1.0)))

    return S.lets(told, lambda: (a + b).cast("long"), lambda *_: (a + c).cast("long"), lambda *_: (a + b + c + d).cast("long"), lambda *_: a.cast("long"))
