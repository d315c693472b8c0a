"""Structures in a series: features of shape, and rules over them.

Every detector is an expression over one array column and gives a struct, so
any number of them run in one pass over the documents, without a shuffle.
What looks at many neighbours of each value (smoothing, peaks, local entropy
and divergence) is added by whole Arrow batches before.
Series that are too short get ``insufficient_data``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.functions import kernels as K
from narrata.functions import peaks as P
from narrata.functions import series as S

SHORT = "insufficient_data"
#: Values of a series that detectors ask for.
LEAST = 10
#: Outputs of detectors that are names.
NAMES = ("resolution", "turn_type")


def _position(i: Column, n: Column) -> Column:
    return i / F.greatest(n - 1, F.lit(1))


def _prepared(smooth: Column) -> Column:
    """Scaled to 0..1; values are told apart to nine digits."""
    return F.transform(S.minmax(smooth, 0.5, 1e-8), lambda v: F.round(v, 9))


def _gap(x: pa.Array) -> np.ndarray:
    return np.maximum(K.lengths(x) // 10, 1)


def _mean_of(scores: list[Column], optional: Column, has: Column) -> Column:
    """Mean of the scores, with one more where there is one."""
    whole = sum(scores, F.lit(0.0))
    return F.when(has, (whole + optional) / (len(scores) + 1)).otherwise(whole / len(scores))


def _fixed(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _interpolated(x: Column, p: Column) -> Column:
    at = p * (F.size(x) - 1)
    low = F.floor(at).cast("int")
    return S.at(x, low) + (at - low) * (S.at(x, F.least(low + 1, F.size(x) - 1)) - S.at(x, low))


def _label(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.when(*rules[0])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise(otherwise)


def _guard(x: Column, least: int, label: Column) -> Column:
    return F.when(F.size(x) < least, SHORT).otherwise(label)


class Steps:
    """A table to which values are added as columns: each is computed once, however often later ones use it."""

    def __init__(self, df: DataFrame):
        self.df, self._names = df, []

    def __call__(self, value: Column) -> Column:
        name = f"_step{len(self._names)}"
        self._names.append(name)
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def batch(self, kinds: list[str], make: Callable[..., list[pa.Array]], *inputs: Column) -> list[Column]:
        """Columns of these kinds that ``make`` makes of the inputs, whole Arrow batches at once."""
        before = len(self._names)
        for value in inputs:
            self(value)
        read = self._names[before:]
        names = [f"_step{len(self._names) + i}" for i in range(len(kinds))]
        self._names += names
        others = [f for f in self.df.schema.fields if f.name not in read]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                made = make(*(rows.column(name) for name in read))
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in others), *made], names=[*(f.name for f in others), *names])

        schema = T.StructType([*others, *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in zip(names, kinds, strict=True))])
        self.df = self.df.mapInArrow(run, schema)
        return [F.col(name) for name in names]

    def done(self, out: dict[str, Column]) -> DataFrame:
        """The table with results in place of the steps."""
        return self.df.withColumns(out).drop(*self._names)


#: Columns that a detector reads, by name.
Parts = dict[str, Column]
Detector = Callable[[Steps, Parts], Column]


def _conform(step: Steps, n: Column, score: Column, rules: Callable[[Column], list[tuple[Column, str]]], otherwise: str, **more: Column) -> Column:
    """Struct of pattern, score and more; short series have a pattern only. Numbers are rounded, names are not."""
    long, s = n >= LEAST, step(score)
    pattern = F.when(~long, SHORT).otherwise(_label(rules(s), otherwise))
    return F.struct(pattern.alias("pattern"), F.when(long, F.round(s, 6)).alias("score"), *(F.when(long, c if k in NAMES else F.round(c, 6)).alias(k) for k, c in more.items()))


def aristotle(step: Steps, of: Parts) -> Column:
    """Three acts between the two steepest places, with the turning points and the unity of action."""
    v = of["v"]
    n = F.greatest(F.size(v), F.lit(1))
    quarter = (n / 4).cast("int")
    d, steep = of["d"], of["steep"]
    ranked = F.reverse(F.sort_array(F.transform(of["steepest"], lambda i: F.struct(S.at(steep, i).alias("g"), i.alias("i")))))
    two = step(F.sort_array(F.transform(F.slice(ranked, 1, 2), lambda s: _position(s.getField("i"), n))))
    a1 = F.when(F.size(two) == 2, F.when(S.at(two, F.lit(0)) < 0.15, 0.25).otherwise(S.at(two, F.lit(0)))).otherwise(0.25)
    a2 = F.when(F.size(two) == 2, F.when(S.at(two, F.lit(1)) < 0.5, 0.75).otherwise(S.at(two, F.lit(1)))).otherwise(0.75)
    cuts = step(F.array(a1, a2))
    wide = S.at(cuts, F.lit(1)) - S.at(cuts, F.lit(0)) >= 0.3
    a1, a2 = step(F.when(wide, S.at(cuts, F.lit(0))).otherwise(0.25)), step(F.when(wide, S.at(cuts, F.lit(1))).otherwise(0.75))
    i1, i2 = (a1 * (n - 1)).cast("int"), (a2 * (n - 1)).cast("int")
    one, mid, last = step(F.slice(v, 1, F.greatest(i1, F.lit(1)))), step(F.slice(v, i1 + 1, F.greatest(i2 - i1, F.lit(1)))), step(F.slice(v, F.greatest(i2, F.lit(0)) + 1, n))
    m1, m2, m3 = step(S.mean(one)), S.mean(mid), step(S.mean(last))
    rises, climax = step(S.differences(mid)), step(_position(S.argmax(v), n))
    score = (
        1 - F.abs(a2 - a1 - 0.5)
        + F.when(m2 > m1, 0.8).otherwise(0.3)
        + F.when((climax > 0.6) & (climax < 0.85), 1.0).when((climax > 0.5) & (climax < 0.9), 0.7).otherwise(0.3)
        + F.when(S.slope(last) < -1e-12, 0.9).otherwise(0.5)
        + F.when(S.variance(one) < S.variance(mid), 0.8).otherwise(0.5)
    ) / 5
    arcs = F.greatest(F.size(of["tops"]), F.lit(1))
    upward = F.when(F.size(rises) > 0, F.size(F.filter(rises, lambda y: y > 0)) / F.greatest(F.size(rises), F.lit(1))).otherwise(0.5)
    calm = F.when(F.size(last) > 1, 1 - F.least(F.lit(1.0), 2 * (F.array_max(last) - F.array_min(last)))).otherwise(0.5)
    unity = S.clip(0.4 * F.greatest(F.lit(0.0), 1 - (arcs - 1) * 0.2) + 0.3 * upward + 0.3 * calm)
    inciting = _position(S.argmax(F.slice(d, 1, quarter)), n)
    crisis = _position(quarter + S.argmax(F.slice(steep, quarter + 1, (3 * n / 4).cast("int") - quarter)), n)
    rules = lambda s: [(s > 0.7, "classic_three_act"), (s > 0.5, "modified_three_act"), (m1 > m3, "tragic"), (m1 < m3, "comedic")]
    return _conform(step, n, score, rules, "non_conforming", act1_end=a1, act2_end=a2, inciting=inciting, crisis=crisis, climax=climax, unity=unity)


#: The pyramid at nine even places.
PYRAMID = [0.3, 0.5, 0.7, 0.9, 1.0, 0.85, 0.6, 0.4, 0.35]


def freytag(step: Steps, of: Parts) -> Column:
    """A rise to a peak near the middle and a fall like it."""
    v = of["v"]
    n = F.greatest(F.size(v), F.lit(1))
    found = of["high"]
    central = F.filter(found, lambda i: F.abs(i - (n / 2).cast("int")) < (n / 4).cast("int"))
    top = step(F.coalesce(P.tallest(v, central), P.tallest(v, found), S.argmax(v)))
    c = step(_position(top, n))
    rise, fall = step(F.slice(v, 1, top + 1)), step(F.slice(v, top + 1, n))
    k = step(F.least(F.size(rise), F.size(fall), F.lit(50)))
    alike = (S.correlation(S.resample(rise, k), S.resample(F.reverse(fall), k)) + 1) / 2
    symmetry = step(F.when(k > 1, alike).otherwise(0.5))
    even = step(S.resample(v, 9))
    first, high, end = S.at(v, F.lit(0)), S.at(v, top), S.at(v, n - 1)
    up, down, off = step(high - first), step(high - end), F.abs(c - 0.5)
    count = step(F.size(of["highest"]))
    scores = [
        F.when(off < 0.1, 1.0).when(off < 0.2, 0.7).otherwise(0.4),
        F.when(up > 0, F.least(F.lit(1.0), 0.5 + up)).otherwise(0.2),
        F.when(down > 0, F.least(F.lit(1.0), 0.5 + down)).otherwise(0.2),
        symmetry,
        F.when(count <= 1, 1.0).when(count <= 3, 0.6).otherwise(0.3),
    ]
    score = _mean_of(scores, F.greatest(F.lit(0.0), S.correlation(even, _fixed(PYRAMID))), F.array_max(even) > F.array_min(even))
    rules = lambda s: [(s > 0.7, "classic_pyramid"), (s > 0.5, "modified_pyramid"), (c < 0.3, "early_climax"), (c > 0.7, "late_climax"), (symmetry < 0.4, "asymmetric")]
    turn = end - first
    return _conform(step, n, score, rules, "non_conforming", climax=c, height=up, symmetry=symmetry, resolution=F.when(turn < -0.15, "tragic").when(turn > 0.15, "comic").otherwise("neutral"))


#: Places of twelve stages, and their level.
STAGES12 = [0.0, 0.08, 0.12, 0.17, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 1.0]
HERO = [0.50, 0.55, 0.45, 0.60, 0.55, 0.45, 0.35, 0.20, 0.50, 0.60, 0.80, 0.70]


def campbell(step: Steps, of: Parts) -> Column:
    """Twelve stages around an ordeal, the low point of the middle."""
    v = of["v"]
    n = F.greatest(F.size(v), F.lit(1))
    low, high = (0.3 * n).cast("int"), (0.8 * n).cast("int")
    ordeal = step(low + S.argmin(F.slice(v, low + 1, F.greatest(high - low, F.lit(1)))))
    p = step(_position(ordeal, n))
    places = [p / 0.55 * e if k < 8 else p + (e - 0.55) * ((1 - p) / 0.45) for k, e in enumerate(STAGES12)]
    found = step(F.transform(F.array(*(S.clip(q) for q in places)), lambda q: F.round(_interpolated(v, q), 9)))
    even = step(S.resample(v, 12))
    s = [S.at(found, F.lit(k)) for k in range(12)]
    yes = lambda c, no: F.when(c, 1.0).otherwise(no)
    depth, change = step(1 - S.at(v, ordeal)), step(s[11] - s[0])
    departure = step(0.3 * yes(s[2] < s[1], 0.3) + 0.3 * yes(s[3] > s[2], 0.3) + 0.4 * F.least(F.lit(1.0), 10 * S.variance(F.slice(found, 1, 5))))
    initiation = step(0.3 * yes(s[7] < s[5], 0.2) + 0.4 * yes(s[8] > s[7], 0.2) + 0.3 * yes(s[7] == F.array_min(found), 0.5))
    back = step(0.3 * yes(s[10] > s[9], 0.3) + 0.3 * yes(s[11] > 0.5, 0.3) + 0.4 * S.clip(change + 0.5))
    scores = [
        F.when((p > 0.4) & (p < 0.7), 1.0).when((p > 0.3) & (p < 0.8), 0.6).otherwise(0.3),
        F.when(depth > 0.5, 1.0).when(depth > 0.3, 0.7).otherwise(0.4),
        F.when(change > 0.1, 1.0).when(change > -0.1, 0.7).otherwise(0.5),
        departure, initiation, back,
    ]
    score = _mean_of(scores, F.greatest(F.lit(0.0), S.correlation(even, _fixed(HERO))), F.array_max(even) > F.array_min(even))
    rules = lambda t: [((t > 0.7) & (depth > 0.4), "classic_hero_journey"), (t > 0.55, "modified_journey"), (depth < 0.2, "flat_journey"), (change < -0.2, "tragic_journey"), (back < 0.3, "incomplete_journey")]
    rise = ordeal + S.argmax(F.slice(v, ordeal + 1, n))
    return _conform(step, n, score, rules, "non_conforming", ordeal=p, depth=depth, resurrection=_position(rise, n), transformation=change, departure=departure, initiation=initiation, homecoming=back)


#: The level of eight stages.
CIRCLE = [0.8, 0.75, 0.5, 0.3, 0.2, 0.35, 0.6, 0.85]


def circle(step: Steps, of: Parts) -> Column:
    """Eight stages down into a valley and up again; without a valley between 0.2 and 0.8 they are even."""
    v = of["v"]
    n = F.greatest(F.size(v), F.lit(1))
    down = step(F.transform(v, lambda y: -y))
    # Null without a valley.
    p = step(_position(P.tallest(down, of["valleys"]), n))
    s4, s6 = F.greatest(F.lit(0.15), p - 0.1), F.least(F.lit(0.85), p + 0.1)
    turned = F.array(F.lit(0.0), 0.3 * s4, 0.7 * s4, s4, p, s6, s6 + (1 - s6) * 0.5, F.lit(1.0))
    places = step(F.when((p > 0.2) & (p < 0.8), turned).otherwise(_fixed([k / 7 for k in range(8)])))
    found = step(F.transform(places, lambda q: F.round(_interpolated(v, q), 9)))
    r = step(S.correlation(found, _fixed(CIRCLE)))
    s = [S.at(found, F.lit(k)) for k in range(8)]
    lowest = step(F.least(*s[3:6]))
    fall, climb = s[0] > lowest + 0.1, s[7] > lowest + 0.1
    valley = lowest < (s[0] + s[1] + s[2] + s[3]) / 4 - 0.1
    yes = lambda c, w: F.when(c, w).otherwise(0.0)
    score = S.clip(0.4 * F.greatest(F.lit(0.0), r) + yes(fall, 0.3) + yes(climb, 0.3) + yes(valley, 0.2) + yes(s[2] < s[1], 0.1) + yes(s[6] > s[5], 0.1))
    rules = lambda t: [((t > 0.7) & fall & climb, "full_circle"), (fall & ~climb, "truncated_descent"), (~fall & climb, "ascent_only"), (r < -0.3, "inverted"), (t > 0.4, "partial_circle")]
    return _conform(step, n, score, rules, "non_conforming", descent=S.at(places, F.lit(2)), valley=F.coalesce(p, S.at(places, F.lit(4))), ascent=S.at(places, F.lit(6)))


def _counts(x: Column, low: Column, high: Column, bins: Column) -> Column:
    """How many values each of equal bins between low and high has, the last one with its upper end; all in the middle one if low is high."""
    place = F.transform(x, lambda v: F.when(high > low, F.least(F.floor((v - low) / (high - low) * bins), bins - 1)).otherwise(F.floor(bins / 2)).cast("int"))
    return S.let(place, lambda at: F.transform(F.sequence(F.lit(0), bins - 1), lambda b: F.size(F.filter(at, lambda p: p == b))))


def divergence(p: Column, q: Column, base: float = 2.0) -> Column:
    """Kullback-Leibler divergence of two lists of shares."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: a * F.log(base, a / b)), F.lit(0.0), lambda s, v: s + v)


@S.bound
def local_divergence(x: Column, states: int = 20, bins: int = 14) -> Column:
    """Symmetric divergence in nats between neighbouring windows that overlap by half, drawn out to the length of the series."""
    n = F.size(x)
    w = F.greatest(F.lit(5), (n / states).cast("int"))
    step = (w / 2).cast("int")

    def shares(part: Column, low: Column, high: Column) -> Column:
        # Densities over the bins' width, with a trace in each.
        raw = F.transform(_counts(part, low, high, F.lit(bins)), lambda c: c / w + 1e-10 * (high - low) / bins)
        return S.let(raw, lambda r: S.let(S.total(r), lambda t: F.transform(r, lambda v: v / t)))

    def between(now: Column, then: Column) -> Column:
        low, high = F.least(F.array_min(now), F.array_min(then)), F.greatest(F.array_max(now), F.array_max(then))
        both = lambda lo, hi: S.lets(lambda p, q: (divergence(p, q, math.e) + divergence(q, p, math.e)) / 2, lambda: shares(now, lo, hi), lambda p: shares(then, lo, hi))
        return S.lets(lambda lo, hi: F.when(hi > lo, both(lo, hi)).otherwise(0.0), lambda: low, lambda lo: high)

    starts = F.sequence(F.lit(0), F.greatest(n - w - 1, F.lit(0)), step)
    steps = F.transform(starts, lambda i: S.lets(between, lambda: F.slice(x, i + 1, w), lambda now: F.slice(x, F.greatest(F.least(i + step, n - w), F.lit(0)) + 1, w)))
    return S.let(steps, lambda s: F.when((n > w) & (F.size(s) > 1), F.transform(x, lambda v, i: _interpolated(s, _position(i, n)))).otherwise(F.transform(x, lambda v: F.lit(0.0))))


@S.bound
def local_entropy(x: Column, window: int = 20) -> Column:
    """Entropy in nats of the values around each, in at most ten bins; 0 for fewer than three values."""
    n, half = F.size(x), window // 2

    def one(part: Column) -> Column:
        bins = F.least(F.lit(10), (F.size(part) / 2).cast("int") + 1)
        h = lambda c: -F.aggregate(c, F.lit(0.0), lambda a, k: a + F.when(k > 0, k / F.size(part) * F.log(k / F.size(part))).otherwise(0.0))
        return F.when(F.size(part) < 3, 0.0).otherwise(h(_counts(part, F.array_min(part), F.array_max(part), bins)))

    start = lambda i: F.greatest(i - half, F.lit(0))
    return F.transform(x, lambda v, i: S.let(F.slice(x, start(i) + 1, F.least(i + half, n) - start(i)), one))


@S.bound
def percentile(x: Column, q: float) -> Column:
    """By linear interpolation between ordered values."""
    return _interpolated(F.sort_array(x), F.lit(q))


def _around(x: Column, i: Column, reach: int = 5) -> Column:
    """Mean of the values from ``reach`` before up to ``reach`` after."""
    low = F.greatest(i - reach, F.lit(0))
    return S.mean(F.slice(x, low + 1, F.least(i + reach, F.size(x)) - low))


def _region(x: Column) -> tuple[Column, Column, Callable[[Column], Column]]:
    """Where a turn may be: from, up to, and the part of a series between."""
    n = F.greatest(F.size(x), F.lit(1))
    low, high = (0.4 * n).cast("int"), (0.8 * n).cast("int")
    return low, high, lambda a: F.slice(a, low + 1, F.greatest(high - low, F.lit(1)))


def four_act(step: Steps, of: Parts) -> Column:
    """A turn without conflict in the second half, from the series as it is."""
    x, kl, entropy, bend = (of[k] for k in ("x", "kl", "entropy", "bend"))
    n = F.greatest(F.size(x), F.lit(1))
    low, high, part = _region(x)

    def spikes(own: Column, places: Column, top: Column) -> Column:
        """Places in the region with a peak at ``top`` or more."""
        found = F.transform(places, lambda i: i + low)
        return F.when(high - low > 3, F.filter(found, lambda i: S.at(own, i) >= top)).otherwise(F.array().cast("array<int>"))

    def candidates(own: Column, places: Column, top: Column, other: Column, other_top: Column, weight: float, order: int, name: str) -> Column:
        place = lambda i: F.greatest(F.lit(0.2), 1 - 2 * F.abs(i / n - 0.6))
        score = lambda i: S.at(own, i) * place(i) * (1 + F.least(F.lit(1.0), _around(other, i) / (other_top + 1e-8))) * weight
        return F.transform(spikes(own, places, top), lambda i: F.struct(F.round(score(i), 9).alias("s"), F.lit(-order).alias("o"), (-i).alias("i"), S.at(own, i).alias("strength"), F.lit(name).alias("type")))

    most = F.array_max(part(kl))
    shift = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("o"), (-(low + S.argmax(part(kl)))).alias("i"), most.alias("strength"), F.lit("perspective_shift").alias("type"))
    none = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("o"), (-(0.65 * n).cast("int")).alias("i"), F.lit(0.0).alias("strength"), F.lit("none").alias("type"))
    kl_top, bend_top = step(percentile(kl, 0.75)), step(percentile(bend, 0.85))
    found = step(F.concat(candidates(kl, of["kl_tops"], kl_top, bend, bend_top, 1.0, 0, "kl_spike"), candidates(bend, of["bend_tops"], bend_top, kl, kl_top, 0.5, 1, "curvature_anomaly")))
    best = step(F.when(F.size(found) > 0, F.array_max(found)).when(most > 0.25, shift).otherwise(none))
    ten, strength, kind = step(-best["i"]), best["strength"], best["type"]
    end = F.least(ten, (0.6 * n).cast("int"))
    before = step(F.slice(bend, 1, F.greatest(end, F.lit(1))))
    mean, whole = step(S.mean(before)), step(S.mean(bend))
    even = 0.6 * F.greatest(F.lit(0.0), F.when(whole > 0, 1 - mean / (whole + 1e-8)).otherwise(0.5)) + 0.4 / (1 + S.deviation(before) / (mean + 1e-8))
    start = ten + (0.1 * n).cast("int")
    now, then = step(_around(entropy, ten)), S.mean(F.slice(entropy, start + 1, n))
    smooth = step(F.when(end < 5, 0.5).otherwise(S.clip(even)))
    compressed = step(F.when(start >= n - 5, 0.0).otherwise(F.when(now > 0, S.clip((now - then) / now, -1.0)).otherwise(0.0)))
    pos = step(ten / n)
    ratio = step(S.mean(F.slice(bend, 1, F.greatest(ten, F.lit(1)))) / (S.mean(F.slice(bend, ten + 1, n)) + 1e-8))
    place = F.when(pos.between(0.55, 0.72), 1.0).when(pos.between(0.50, 0.75), 0.8).when(pos.between(0.40, 0.55), 0.5).otherwise(0.3)
    turn = F.when(kind == "none", 0.1).otherwise(F.least(F.lit(1.0), strength / 12) * place * F.when(kind == "kl_spike", 1.0).when(kind == "perspective_shift", 0.8).otherwise(0.6))
    calm = F.when(compressed > 0.15, F.least(F.lit(1.0), 3 * compressed)).when(compressed > 0.05, 2 * compressed).when(compressed > 0, compressed).otherwise(0.05)
    growth = F.when((ratio > 0) & (ratio < 0.9), 1.2).when(ratio > 1.2, 0.7).otherwise(1.0)
    ki, sho, turned, calmed = step(S.clip(0.8 * smooth * growth)), step(S.clip(0.7 * smooth * growth)), step(turn), step(calm)
    first = 0.15 * ki + 0.15 * sho + 0.35 * turned + 0.35 * calmed
    belief = kind.isin("kl_spike", "perspective_shift")
    rules = lambda s: [
        ((first > 0.45) & (smooth > 0.35) & belief & pos.between(0.55, 0.75) & (compressed > 0.08), "classic_kishotenketsu"),
        ((first > 0.40) & belief & pos.between(0.50, 0.75) & (compressed > 0.03), "modern_kishotenketsu"),
        ((kind != "none") & pos.between(0.55, 0.78) & (compressed > 0.01), "subtle_kishotenketsu"),
        ((pos < 0.50) | (compressed <= 0) | ((kind == "curvature_anomaly") & (compressed < 0.02)), "western_conflict"),
        ((kind == "none") & (smooth > 0.45), "zuihitsu"),
    ]
    return _conform(step, n, 0.2 * ki + 0.2 * sho + 0.35 * turned + 0.25 * calmed, rules, "hybrid", turn=pos, turn_type=kind, strength=strength, smoothness=smooth, compression=compressed)


def six_curves(n: int = 100) -> dict[str, list[float]]:
    """The canonical curves: two lines, two parabolas and two sines of a half period's shift."""
    xs = [i / (n - 1) for i in range(n)]
    wave = [math.sin(2 * math.pi * t - math.pi / 2) for t in xs]
    return {"rags_to_riches": xs, "tragedy": [1 - t for t in xs], "man_in_hole": [4 * (t - 0.5) ** 2 for t in xs], "icarus": [1 - 4 * (t - 0.5) ** 2 for t in xs], "cinderella": [0.5 + 0.5 * w for w in wave], "oedipus": [0.5 - 0.5 * w for w in wave]}


def six_shapes(x: Column, sigma: float | None = 3.0) -> Column:
    """The canonical curve with the largest correlation, of equal ones the first."""

    def ranked(v: Column) -> Column:
        scores = [F.struct(F.round(S.correlation(v, _fixed(c)), 6).alias("r"), F.lit(-i).alias("o"), F.lit(k).alias("shape")) for i, (k, c) in enumerate(six_curves().items())]
        return F.reverse(F.array_sort(F.array(*scores)))

    def told(all_: Column) -> Column:
        best, second = S.at(all_, F.lit(0)), S.at(all_, F.lit(1))
        note = F.when(best["r"] > 0.8, "strong").when(best["r"] > 0.5, "moderate").otherwise("weak")
        return F.struct(best["shape"].alias("shape"), best["r"].alias("score"), note.alias("note"), (best["r"] - second["r"] < 0.1).alias("ambiguous"))

    return S.let(S.let(S.resample(S.minmax(S.gaussian(x, sigma) if sigma else x), 100), ranked), told)


def shape_features(step: Steps, x: Column, prominence: float) -> Parts:
    """Features of a resampled, scaled and smoothed series."""
    return dict(zip(K.FEATURES, step.batch(list(K.FEATURES.values()), lambda x: K.shape_features(x, prominence), x), strict=True))


#: Least prominence of a peak of a series, and of a compound series.
PROMINENT, COMPOUND_PROMINENT = 0.08, 0.05


def icc(step: Steps, x: Column, features: Parts | None = None) -> Column:
    """Five classes by net change, peaks, volatility, symmetry and trend; 0 if no class fits in all.

    Classes 1 and 2 fit better than the others where more than one fits in all.
    """
    f = features or shape_features(step, x, PROMINENT)
    net, n, vol, sym, r2 = (f[k] for k in ("net", "up", "volatility", "symmetry", "r2"))
    calm, lively = vol <= 0.07, (n >= 4) & (vol >= 0.05)
    k = F.when(net.between(0.15, 1) & (n <= 3) & calm, 1).when(net.between(-1, -0.15) & (n <= 4) & calm, 2).when(net.between(-0.2, 0.2) & lively & (sym >= 0.3), 3).when(net.between(0.15, 1) & lively & (r2 >= 0.15), 4).when(net.between(-1, -0.15) & lively & (r2 >= 0.15), 5).otherwise(0)
    return F.struct(k.alias("icc"), F.round(net, 6).alias("net"), n.alias("peaks"), F.round(vol, 6).alias("volatility"), F.round(sym, 6).alias("symmetry"), F.round(r2, 6).alias("r2"))


def compound_icc(step: Steps, x: Column, features: Parts | None = None) -> Column:
    """Seven classes of a compound series by a cascade of rules."""
    f = features or shape_features(step, x, COMPOUND_PROMINENT)
    net, sym, r2, n, m, top, low = (f[k] for k in ("net", "symmetry", "r2", "up", "down", "top", "low"))
    yes = lambda c, w: F.when(c, w).otherwise(0.0)
    inside = lambda c, a, b: (c > a) & (c < b)
    size = F.abs(net)
    coherence = step(yes(r2 > 0.5, 0.3) + yes(sym > 0.7, 0.3) + yes(size > 0.4, 0.2) + yes(inside(top, 0.15, 0.85) | inside(low, 0.15, 0.85), 0.1) + yes((n <= 6) & (m <= 6), 0.1))
    k = (
        F.when((coherence < 0.25) & (sym < 0.8), 0).when((net > 0.4) & (r2 > 0.5), 1).when((net < -0.4) & (r2 > 0.5), 2)
        .when((size < 0.25) & inside(top, 0.2, 0.8) & (sym > 0.25) & n.between(1, 4), 3).when((size < 0.25) & inside(low, 0.2, 0.8) & (sym > 0.25) & m.between(1, 4), 4)
        .when((sym > 0.9) & (n >= 1) & inside(top, 0.3, 0.7) & (net > -0.2), 5).when((sym > 0.9) & (m >= 1) & inside(low, 0.3, 0.7) & (net < 0.2), 6)
        .when((net > 0.25) & (r2 > 0.3), 1).when((net < -0.25) & (r2 > 0.3), 2).otherwise(0)
    )
    return F.struct(k.alias("cicc"), F.round(coherence, 6).alias("coherence"), F.round(net, 6).alias("net"))


def with_icc(df: DataFrame, series: str, compound: bool = True) -> DataFrame:
    """Add the classes of a series (icc) and of its compound series (cicc)."""
    step = Steps(df)
    x = F.col(f"`{series}`")

    def both(x: pa.Array) -> list[pa.Array]:
        return K.shape_features(x, PROMINENT) + (K.shape_features(K.compound(x), COMPOUND_PROMINENT) if compound else [])

    made = step.batch(list(K.FEATURES.values()) * (1 + compound), both, x)
    own, other = (dict(zip(K.FEATURES, made[i:], strict=False)) for i in (0, len(K.FEATURES)))
    return step.done({"icc": icc(step, x, own)} | ({"cicc": compound_icc(step, x, other)} if compound else {}))


@S.bound
def epistemic_pattern(x: Column) -> Column:
    """How certainty moves over a text; needs four windows."""
    m, s = S.mean(x), S.deviation(x)
    slope = S.mean(S.last_part(x, 4)) - S.mean(S.first_part(x, 4))
    m, s, slope = F.round(m, 6), F.round(s, 6), F.round(slope, 6)
    name = _label([((m > 0.65) & (s < 0.15), "exposition"), ((m < 0.35) & (s < 0.15), "ambiguity"), ((slope > 0.2) & (s < 0.2), "progressive_discovery"), (slope > 0.25, "mystery_resolution"), (slope < -0.25, "reverse_mystery"), (s > 0.2, "suspense")], "mixed")
    return _guard(x, 4, name)


@S.bound
def character_arc(x: Column, dominance: Column, distinct: Column) -> Column:
    half = (F.size(x) / 2).cast("int")
    change = F.round(S.mean(F.slice(x, half + 1, F.size(x))) - S.mean(F.slice(x, 1, half)), 6)
    return _guard(x, 4, _label([(dominance > 0.5, "protagonist"), ((distinct > 5) & (dominance < 0.3), "ensemble"), (F.round(S.variance(x), 6) > 0.05, "rotating_focus"), (change < -0.1, "convergent"), (change > 0.1, "divergent")], "stable"))


@S.bound
def view_shift(views: Column, x: Column) -> Column:
    """How the point of view (array of names) shifts; ``x`` is the distance."""
    n = F.size(views)
    shifts = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & (S.at(views, i) != S.at(views, i - 1))))
    rate = shifts / F.greatest(n - 1, F.lit(1))
    drift = F.abs(F.round(S.mean(S.last_part(x, 4)) - S.mean(S.first_part(x, 4)), 6))
    return _label([((shifts == 0) & (S.at(views, F.lit(0)) == "first"), "stable_first"), (shifts == 0, "stable_third"), (rate > 0.3, "shifting"), ((rate > 0.1) & (F.round(S.variance(x), 6) > 0.1), "frame_narrative"), (drift > 0.2, "evolving")], "stable")


@S.bound
def quarter_shape(x: Column, digits: int = 6) -> Column:
    """A shape from the means of four quarters, the last one of ceil(n/4) values."""
    q = F.transform(F.array(S.mean(S.first_part(x, 4)), S.mean(F.slice(x, (F.size(x) / 4).cast("int") + 1, (F.size(x) / 4).cast("int"))), S.mean(F.slice(x, 2 * (F.size(x) / 4).cast("int") + 1, (F.size(x) / 4).cast("int"))), S.mean(S.last_part(x, 4))), lambda v: F.round(v, digits))
    a, b, c, d = (S.at(q, F.lit(i)) for i in range(4))
    mid, ends = F.round((b + c) / 2, digits), F.round((a + d) / 2, digits)
    up, down, low, high = d > 1.1 * a, d < 0.9 * a, mid < 0.9 * ends, mid > 1.1 * ends
    return _guard(x, 4, _label([(up & ~low & ~high, "rags_to_riches"), (down & ~low & ~high, "tragedy"), (low, "man_in_hole"), (high & ~up, "icarus"), (high & up, "cinderella"), (down, "oedipus")], "other"))


@S.bound
def arc(x: Column) -> Column:
    """Rise and fall of the means of start, middle and end."""
    third = F.greatest((F.size(x) / 4).cast("int"), F.lit(1))
    a, m, d = (F.round(S.mean(p), 6) for p in (F.slice(x, 1, third), F.slice(x, third + 1, F.size(x) - 2 * third), F.slice(x, F.size(x) - third + 1, third)))
    return _guard(x, 4, _label([((m > a) & (m > d), "Rise-Fall"), ((m < a) & (m < d), "Fall-Rise"), ((a < d) & (m < d), "Rising"), ((a > d) & (m >= d), "Falling")], "Stable"))


@S.bound
def plot_states(x: Column) -> Column:
    """Tension smoothed as 0.7 of the new and 0.3 of the last value, and the state that it, its last three values and the place tell."""
    n = F.size(x)

    def state(smooth: Column, t: Column, i: Column) -> Column:
        p = _position(i, n)
        a, b = S.at(smooth, i - 2), S.at(smooth, i - 1)
        return F.when(t > 0.8, "climax").when((t > 0.6) & (p < 0.7), "rising").when(t > 0.6, "falling").when((t < 0.3) & (p < 0.2), "equilibrium").when(t < 0.3, "resolution").when((a < b) & (b < t), "rising").when((a > b) & (b > t), "falling").otherwise("equilibrium")

    smooth = F.aggregate(x, F.array().cast("array<double>"), lambda a, v: F.array_append(a, S.clip(F.coalesce(0.7 * v + 0.3 * F.get(a, F.size(a) - 1), v))))
    return S.let(smooth, lambda s: F.struct(s.alias("tension"), F.transform(s, lambda t, i: state(s, t, i)).alias("states")))


def plot_structure(states: Column) -> Column:
    """The kind of plot that a list of states makes."""
    first, last = S.first_part(states, 4), S.last_part(states, 4)
    calm, peak, solved = F.array_contains(first, "equilibrium"), F.array_contains(states, "climax"), F.array_contains(last, "resolution")
    return F.when(F.size(states) < 4, "too_short").otherwise(_label([(calm & peak & solved, "classic_arc"), (calm & peak, "tragic_arc"), (~calm & peak, "in_medias_res"), (~peak, "episodic")], "episodic"))


#: Detectors of a smooth series between 0 and 1, and those of the series as it is.
ON_SMOOTH: dict[str, Detector] = {"aristotle": aristotle, "freytag": freytag, "campbell": campbell, "circle": circle}
ON_RAW: dict[str, Detector] = {"six_shapes": lambda step, of: step(six_shapes(of["smooth"], None)), "four_act": four_act}
DETECTORS = (*ON_SMOOTH, *ON_RAW)


def _parts(step: Steps, x: Column, smooth: bool, acts: bool) -> Parts:
    """What detectors read: of the smooth series, and of the four acts."""
    wide, floats, places = K.gaussian, "array<double>", "array<int>"
    of: Parts = {"x": x}

    def first(x: pa.Array) -> list[pa.Array]:
        return [wide(x, 3.0)] * smooth + ([wide(x, 2.0), K.local_divergence(x), K.local_entropy(x)] if acts else [])

    names = ["smooth"] * smooth + ["soft", "kl", "entropy"] * acts
    of.update(zip(names, step.batch([floats] * len(names), first, x), strict=True))
    read = []
    if smooth:
        of["v"] = step(_prepared(of["smooth"]))
        of["d"] = step(S.gradient(of["v"], F.lit(1.0)))
        of["steep"] = step(F.transform(of["d"], F.abs))
        read += [of["v"], of["steep"]]
    if acts:
        nine = lambda a: F.transform(a, lambda v: F.round(v, 9))
        of["kl"], slope = step(nine(of["kl"])), step(S.gradient(of["soft"], F.lit(1.0)))
        of["bend"] = step(nine(F.zip_with(S.gradient(slope, F.lit(1.0)), slope, lambda b, s: F.abs(b) / F.pow(1 + s * s, F.lit(1.5)))))
        low, high, part = _region(x)
        read += [part(of["kl"]), part(of["bend"]), F.greatest(((high - low) / 5).cast("int"), F.lit(1))]

    def second(*read: pa.Array) -> list[pa.Array]:
        out = []
        if smooth:
            v, steep = read[:2]
            gap = _gap(v)
            out += [K.peaks(steep, gap, 0.01), K.peaks(v, gap), K.peaks(v, gap, 0.05), K.peaks(v, gap, 0.1), K.valleys(v, gap)]
        if acts:
            kl, bend, gap = read[-3:]
            gap = gap.fill_null(1).to_numpy(zero_copy_only=False)
            out += [K.peaks(kl, gap), K.peaks(bend, gap)]
        return out

    names = ["steepest", "tops", "high", "highest", "valleys"] * smooth + ["kl_tops", "bend_tops"] * acts
    if names:
        of.update(zip(names, step.batch([places] * len(names), second, *read), strict=True))
    return of


def with_detectors(df: DataFrame, series: str, names: tuple[str, ...] = DETECTORS) -> DataFrame:
    """Add a struct column for each detector, all in one pass over the rows and without a shuffle."""
    step = Steps(df)
    of = _parts(step, F.col(f"`{series}`"), bool(set(names) & {*ON_SMOOTH, "six_shapes"}), "four_act" in names)
    return step.done({name: (ON_SMOOTH | ON_RAW)[name](step, of) for name in names})


def pattern_of(name: str) -> Column:
    """What a detector's column says about a document, as a name."""
    return F.col(f"{name}.{'shape' if name == 'six_shapes' else 'pattern'}")


def ranked(names: tuple[str, ...] = DETECTORS) -> Column:
    """The detectors' columns as structs (score, model, pattern), best first; short series have score 0."""
    each = [F.struct(F.coalesce(F.col(f"{name}.score"), F.lit(0.0)).alias("score"), F.lit(name).alias("model"), pattern_of(name).alias("pattern")) for name in names]
    return F.reverse(F.sort_array(F.array(*each)))


def summary(df: DataFrame, by: list[str], names: tuple[str, ...] = DETECTORS) -> DataFrame:
    """(by..., model, n, judged, mean_score, passed, patterns): how the detectors' columns judge each group's documents."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("model"), F.col(f"{k}.score").alias("score"), pattern_of(k).alias("pattern")) for k in names))).alias("s")
    rows = df.select(*by, each).select(*by, "s.*")
    counts = rows.groupBy(*by, "model", "pattern").agg(F.count("*").alias("n"), F.count("score").alias("judged"), F.sum("score").alias("sum"), F.count_if(F.col("score") > 0.5).alias("passed"))
    shares = F.map_from_entries(F.sort_array(F.collect_list(F.struct("pattern", "n"))))
    return counts.groupBy(*by, "model").agg(F.sum("n").alias("n"), F.sum("judged").alias("judged"), F.round(F.sum("sum") / F.nullif(F.sum("judged"), F.lit(0)), 5).alias("mean_score"), F.sum("passed").alias("passed"), shares.alias("patterns"))
