"""Detectors against the same rules in numpy, on canonical curves, noise, flat and short series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.operators import detectors


def smooth(x, sigma):
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    n, period = len(x), np.concatenate([x, x[::-1]])
    return np.array([(w / w.sum() * period[(np.arange(i - r, i + r + 1)) % (2 * n)]).sum() for i in range(n)])


def prepared(x):
    v = smooth(x, 3.0)
    return np.round((v - v.min()) / (v.max() - v.min()) if v.max() - v.min() > 1e-8 else np.full(len(v), 0.5), 9)


def find_peaks(x, distance=1, prominence=None, height=-math.inf):
    x = np.asarray(x, float)
    tops, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            tops.append((i + j) // 2)
        i = j + 1
    tops = [i for i in tops if x[i] >= height]
    kept = []
    for i in sorted(tops, key=lambda i: (-x[i], -i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)

    def prominent(i):
        left = max((j for j in range(i) if x[j] > x[i]), default=-1)
        right = min((j for j in range(i, len(x)) if x[j] > x[i]), default=len(x))
        return x[i] - max(x[left + 1 : i + 1].min(), x[i:right].min())

    return sorted(i for i in kept if prominence is None or prominent(i) >= prominence)


def corr(a, b):
    return float(np.corrcoef(a, b)[0, 1]) if np.ptp(a) > 0 and np.ptp(b) > 0 else math.nan


def even(v, n):
    return np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(v)), v)


def label(rules, otherwise):
    return next((name for fits, name in rules if fits), otherwise)


def aristotle(x):
    v = prepared(x)
    n, d = len(v), np.gradient(v)
    steep = find_peaks(abs(d), n // 10, 0.01)
    a1, a2 = 0.25, 0.75
    if len(steep) >= 2:
        a1, a2 = (i / (n - 1) for i in sorted(sorted(steep, key=lambda i: (-abs(d[i]), -i))[:2]))
        a1, a2 = 0.25 if a1 < 0.15 else a1, 0.75 if a2 < 0.5 else a2
        if a2 - a1 < 0.3:
            a1, a2 = 0.25, 0.75
    i1, i2 = int(a1 * (n - 1)), int(a2 * (n - 1))
    one, mid, last = v[:i1], v[i1:i2], v[i2:]
    climax = np.argmax(v) / (n - 1)
    scores = [1 - abs(a2 - a1 - 0.5), 0.8 if mid.mean() > one.mean() else 0.3, 1.0 if 0.6 < climax < 0.85 else 0.7 if 0.5 < climax < 0.9 else 0.3, 0.9 if np.polyfit(range(len(last)), last, 1)[0] < -1e-12 else 0.5, 0.8 if one.var() < mid.var() else 0.5]
    score = np.mean(scores)
    steps = np.diff(mid)
    unity = 0.4 * max(0, 1 - (max(1, len(find_peaks(v, n // 10))) - 1) * 0.2) + 0.3 * ((steps > 0).sum() / len(steps) if len(steps) else 0.5) + 0.3 * (1 - min(1, 2 * np.ptp(last)))
    q = n // 4
    name = label([(score > 0.7, "classic_three_act"), (score > 0.5, "modified_three_act"), (one.mean() > last.mean(), "tragic"), (one.mean() < last.mean(), "comedic")], "non_conforming")
    return name, score, a1, a2, np.argmax(d[:q]) / (n - 1), (q + np.argmax(abs(d[q : 3 * n // 4]))) / (n - 1), climax, min(1, max(0, unity))


def freytag(x):
    v = prepared(x)
    n = len(v)
    found = find_peaks(v, n // 10, 0.05)
    middle = [i for i in found if abs(i - n // 2) < n // 4]
    best = lambda some: max(some, key=lambda i: (v[i], -i))
    top = best(middle) if middle else best(found) if found else int(np.argmax(v))
    c = top / (n - 1)
    rise, fall = v[: top + 1], v[top:]
    symmetry = 0.5
    if len(rise) > 1 and len(fall) > 1:
        k = min(len(rise), len(fall), 50)
        r = corr(even(rise, k), even(fall[::-1], k))
        symmetry = 0.5 if math.isnan(r) else (r + 1) / 2
    up, down, off = v[top] - v[0], v[top] - v[-1], abs(c - 0.5)
    count = len(find_peaks(v, n // 10, 0.1))
    scores = [1.0 if off < 0.1 else 0.7 if off < 0.2 else 0.4, min(1, 0.5 + up) if up > 0 else 0.2, min(1, 0.5 + down) if down > 0 else 0.2, symmetry, 1.0 if count <= 1 else 0.6 if count <= 3 else 0.3]
    r = corr(even(v, 9), [0.3, 0.5, 0.7, 0.9, 1.0, 0.85, 0.6, 0.4, 0.35])
    score = np.mean(scores + ([] if math.isnan(r) else [max(0, r)]))
    turn = v[-1] - v[0]
    name = label([(score > 0.7, "classic_pyramid"), (score > 0.5, "modified_pyramid"), (c < 0.3, "early_climax"), (c > 0.7, "late_climax"), (symmetry < 0.4, "asymmetric")], "non_conforming")
    return name, score, c, up, symmetry, "tragic" if turn < -0.15 else "comic" if turn > 0.15 else "neutral"


PLACES = [0.0, 0.08, 0.12, 0.17, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 1.0]


def campbell(x):
    v = prepared(x)
    n = len(v)
    low = int(0.3 * n)
    at = low + int(np.argmin(v[low : int(0.8 * n)]))
    p = at / (n - 1)
    places = [min(1, max(0, e * p / 0.55 if k < 8 else p + (e - 0.55) * (1 - p) / 0.45)) for k, e in enumerate(PLACES)]
    s = np.round(np.interp(places, np.linspace(0, 1, n), v), 9)
    depth, change = 1 - v[at], s[11] - s[0]
    departure = 0.3 * (1 if s[2] < s[1] else 0.3) + 0.3 * (1 if s[3] > s[2] else 0.3) + 0.4 * min(1, 10 * s[:5].var())
    initiation = 0.3 * (1 if s[7] < s[5] else 0.2) + 0.4 * (1 if s[8] > s[7] else 0.2) + 0.3 * (1 if s[7] == s.min() else 0.5)
    back = 0.3 * (1 if s[10] > s[9] else 0.3) + 0.3 * (1 if s[11] > 0.5 else 0.3) + 0.4 * max(0, min(1, change + 0.5))
    scores = [1.0 if 0.4 < p < 0.7 else 0.6 if 0.3 < p < 0.8 else 0.3, 1.0 if depth > 0.5 else 0.7 if depth > 0.3 else 0.4, 1.0 if change > 0.1 else 0.7 if change > -0.1 else 0.5, departure, initiation, back]
    r = corr(even(v, 12), [0.50, 0.55, 0.45, 0.60, 0.55, 0.45, 0.35, 0.20, 0.50, 0.60, 0.80, 0.70])
    score = np.mean(scores + ([] if math.isnan(r) else [max(0, r)]))
    name = label([(score > 0.7 and depth > 0.4, "classic_hero_journey"), (score > 0.55, "modified_journey"), (depth < 0.2, "flat_journey"), (change < -0.2, "tragic_journey"), (back < 0.3, "incomplete_journey")], "non_conforming")
    return name, score, p, depth, (at + np.argmax(v[at:])) / (n - 1), change, departure, initiation, back


def circle(x):
    v = prepared(x)
    n = len(v)
    valleys = find_peaks(-v, n // 10)
    places, p = [k / 7 for k in range(8)], None
    if valleys:
        p = min(valleys, key=lambda i: (v[i], i)) / (n - 1)
        if 0.2 < p < 0.8:
            a, b = max(0.15, p - 0.1), min(0.85, p + 0.1)
            places = [0.0, 0.3 * a, 0.7 * a, a, p, b, b + (1 - b) * 0.5, 1.0]
    s = np.round(np.interp(places, np.linspace(0, 1, n), v), 9)
    r = corr(s, [0.8, 0.75, 0.5, 0.3, 0.2, 0.35, 0.6, 0.85])
    r = 0.0 if math.isnan(r) else r
    low = s[3:6].min()
    down, up = s[0] > low + 0.1, s[7] > low + 0.1
    score = min(1, 0.4 * max(0, r) + 0.3 * down + 0.3 * up + 0.2 * (low < s[:4].mean() - 0.1) + 0.1 * (s[2] < s[1]) + 0.1 * (s[6] > s[5]))
    name = label([(score > 0.7 and down and up, "full_circle"), (down and not up, "truncated_descent"), (not down and up, "ascent_only"), (r < -0.3, "inverted"), (score > 0.4, "partial_circle")], "non_conforming")
    return name, score, places[2], p if p is not None else places[4], places[6]


def four_act(x):
    n = len(x)
    slope = np.gradient(smooth(x, 2.0))
    bend = np.round(abs(np.gradient(slope)) / (1 + slope**2) ** 1.5, 9)
    w, steps = max(5, n // 20), []
    for i in range(0, n - w, w // 2):
        now, j = x[i : i + w], min(i + w // 2, n - w)
        then = x[j : j + w]
        low, high = min(now.min(), then.min()), max(now.max(), then.max())
        if high == low:
            steps.append(0.0)
            continue
        p, q = (np.histogram(y, bins=np.linspace(low, high, 15), density=True)[0] + 1e-10 for y in (now, then))
        p, q = p / p.sum(), q / q.sum()
        steps.append(((p * np.log(p / q)).sum() + (q * np.log(q / p)).sum()) / 2)
    kl = np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(steps)), steps) if len(steps) > 1 else np.zeros(n)
    kl = np.round(kl, 9)
    ent = np.zeros(n)
    for i in range(n):
        part = x[max(0, i - 10) : min(n, i + 10)]
        if len(part) >= 3:
            c = np.histogram(part, bins=min(10, len(part) // 2 + 1))[0]
            c = c[c > 0] / len(part)
            ent[i] = -(c * np.log(c)).sum()
    low, high = int(0.4 * n), int(0.8 * n)
    tops = np.percentile(kl, 75), np.percentile(bend, 85)
    found = []
    for own, top, other, other_top, weight, kind in ((kl, tops[0], bend, tops[1], 1.0, "kl_spike"), (bend, tops[1], kl, tops[0], 0.5, "curvature_anomaly")):
        if high - low > 3:
            for i in find_peaks(own[low:high], max(1, (high - low) // 5)):
                i += low
                if own[i] >= top:
                    near = other[max(0, i - 5) : min(n, i + 5)].mean()
                    found.append((round(own[i] * max(0.2, 1 - 2 * abs(i / n - 0.6)) * (1 + min(1, near / (other_top + 1e-8))) * weight, 9), i, own[i], kind))
    if found:
        _, ten, strength, kind = max(found, key=lambda c: c[0])
    elif kl[low:high].max() > 0.25:
        ten, kind = low + int(np.argmax(kl[low:high])), "perspective_shift"
        strength = kl[ten]
    else:
        ten, strength, kind = int(0.65 * n), 0.0, "none"
    end = min(ten, int(0.6 * n))
    ki = bend[:end]
    calm = 0.5 if end < 5 else min(1, max(0, 0.6 * max(0, 1 - ki.mean() / (bend.mean() + 1e-8) if bend.mean() > 0 else 0.5) + 0.4 / (1 + ki.std() / (ki.mean() + 1e-8))))
    start, packed = ten + int(0.1 * n), 0.0
    if start < n - 5:
        now = ent[max(0, ten - 5) : min(n, ten + 5)].mean()
        packed = max(-1, min(1, (now - ent[start:].mean()) / now)) if now > 0 else 0.0
    pos = ten / n
    place = 1.0 if 0.55 <= pos <= 0.72 else 0.8 if 0.5 <= pos <= 0.75 else 0.5 if 0.4 <= pos <= 0.55 else 0.3
    turn = 0.1 if kind == "none" else min(1, strength / 12) * place * {"kl_spike": 1.0, "perspective_shift": 0.8}.get(kind, 0.6)
    rest = min(1, 3 * packed) if packed > 0.15 else 2 * packed if packed > 0.05 else packed if packed > 0 else 0.05
    a, b = bend[:ten].mean(), bend[ten:].mean()
    ratio = a / (b + 1e-8)
    grown = 1.0 if not (a > 0 and b > 0) else 1.2 if ratio < 0.9 else 0.7 if ratio > 1.2 else 1.0
    k, s = min(1, 0.8 * calm * grown), min(1, 0.7 * calm * grown)
    first, belief = 0.15 * k + 0.15 * s + 0.35 * turn + 0.35 * rest, kind in ("kl_spike", "perspective_shift")
    name = label([(first > 0.45 and calm > 0.35 and belief and 0.55 <= pos <= 0.75 and packed > 0.08, "classic_kishotenketsu"), (first > 0.4 and belief and 0.5 <= pos <= 0.75 and packed > 0.03, "modern_kishotenketsu"), (kind != "none" and 0.55 <= pos <= 0.78 and packed > 0.01, "subtle_kishotenketsu"), (pos < 0.5 or packed <= 0 or (kind == "curvature_anomaly" and packed < 0.02), "western_conflict"), (kind == "none" and calm > 0.45, "zuihitsu")], "hybrid")
    return name, 0.2 * k + 0.2 * s + 0.35 * turn + 0.25 * rest, pos, kind, strength, calm, packed


ALL = {"aristotle": aristotle, "freytag": freytag, "campbell": campbell, "circle": circle, "four_act": four_act}


def curves():
    draw = random.Random(1)
    out = [list(map(float, c)) for c in detectors.six_curves(40).values()]
    for n in (10, 11, 17, 40, 90, 230):
        out.append([draw.random() for _ in range(n)])
        walk = [0.0]
        for _ in range(n - 1):
            walk.append(walk[-1] + draw.gauss(0, 1))
        out += [walk, [math.sin(i / n * 9) + draw.random() / 5 for i in range(n)]]
    return out


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*curves(), [1.0] * 30, [1.0, 2.0], [], *([1.0] * k for k in range(1, 10))])], "id int, x array<double>")
    return {r.id: r for r in detectors.with_detectors(df, "x").collect()}


@pytest.mark.parametrize("name", sorted(ALL))
def test_like_numpy(found, name):
    for i, x in enumerate(curves()):
        got, want = list(found[i][name]), ALL[name](np.array(x))
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g == w if isinstance(w, str) else abs(g - w) < 2e-6, (i, name, got, want)


@pytest.mark.parametrize("name", sorted(ALL))
def test_short_and_flat(found, name):
    n = len(curves())
    assert found[n][name].score is not None and 0 <= found[n][name].score <= 1
    assert found[n + 1][name].pattern == found[n + 2][name].pattern == detectors.SHORT and found[n + 1][name].score is None


def test_line(spark):
    """A straight line is its own mirror image up to the sign: symmetry 1, coherent."""
    df = spark.createDataFrame([(0, [i / 99 for i in range(100)]), (1, [1 - i / 99 for i in range(100)]), (2, [0.5] * 60), (3, [math.sin(math.pi * i / 99) for i in range(100)])], "id int, x array<double>")
    step = detectors.Steps(df)
    x = F.col("x")
    rows = step.done({"a": detectors.icc(step, x), "c": detectors.compound_icc(step, x)}).orderBy("id").collect()
    assert [r.a.icc for r in rows[:2]] == [1, 2] and [r.c.cicc for r in rows] == [1, 2, 0, 3]
    assert abs(rows[0].a.symmetry - 1) < 1e-6 and abs(rows[0].a.r2 - 1) < 1e-6 and abs(rows[0].c.coherence - 0.9) < 0.11
