"""Peaks of a series, with height, distance and prominence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions import series as S

_NONE = "array<int>"


@S.bound
def maxima(x: Column) -> Column:
    """Middles of all runs of equal values with lower ones on both sides."""
    n = F.size(x)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | (S.at(x, i) != S.at(x, i - 1)))

    def tops(first: Column) -> Column:
        inner = F.sequence(F.lit(1), F.greatest(F.size(first) - 2, F.lit(1)))
        high = F.filter(inner, lambda k: (k < F.size(first) - 1) & (S.at(x, S.at(first, k)) > S.at(x, S.at(first, k - 1))) & (S.at(x, S.at(first, k)) > S.at(x, S.at(first, k + 1))))
        return F.transform(high, lambda k: ((S.at(first, k) + S.at(first, k + 1) - 1) / 2).cast("int"))

    return F.when(n > 2, S.let(starts, tops)).otherwise(F.array().cast(_NONE))


def prominence(x: Column, i: Column) -> Column:
    """Height over the higher of the lowest values towards a higher one, or an end, on either side."""
    n = F.size(x)
    left = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), i), lambda j: S.at(x, j) > S.at(x, i))), F.lit(-1))
    right = F.coalesce(F.array_min(F.filter(F.sequence(i, n - 1), lambda j: S.at(x, j) > S.at(x, i))), n)
    low = F.greatest(F.array_min(F.slice(x, left + 2, i - left)), F.array_min(F.slice(x, i + 1, right - i)))
    return S.at(x, i) - low


@S.bound
def peaks(x: Column, distance: Column | int = 1, least_prominence: float = 0.0, least_height: float = float("-inf")) -> Column:
    """Places of peaks; of peaks closer than ``distance`` the higher one stays, of equal ones the later."""
    gap = F.lit(distance) if isinstance(distance, int) else distance
    def spaced(high: Column) -> Column:
        order = F.transform(F.reverse(F.array_sort(F.transform(high, lambda i: F.struct(S.at(x, i).alias("v"), i.alias("i"))))), lambda s: s.getField("i"))
        return F.aggregate(order, F.array().cast(_NONE), lambda a, i: F.when(F.exists(a, lambda j: F.abs(i - j) < gap), a).otherwise(F.array_append(a, i)))

    kept = S.let(F.filter(maxima(x), lambda i: S.at(x, i) >= least_height), spaced)
    return F.array_sort(F.filter(kept, lambda i: prominence(x, i) >= least_prominence))


def tallest(x: Column, places: Column) -> Column:
    """The place with the largest value, of equal ones the first; null for none."""
    return -F.array_max(F.transform(places, lambda i: F.struct(S.at(x, i).alias("v"), (-i).alias("i")))).getField("i")
