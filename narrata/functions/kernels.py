"""Steps on series that look at many neighbours of each value, for a whole Arrow batch at once.

They give what the column functions of their names give, in the same order of
sums, in a small part of their time. :meth:`narrata.operators.detectors.Steps.batch`
adds them to a table. Values are finite.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from narrata.functions import series as S

#: Values whose neighbours are laid out at once.
AT_ONCE = 1 << 16


def _parts(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all series, and how many each has (null: none)."""
    sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return x.flatten().to_numpy(zero_copy_only=False).astype(float), sizes


def _lists(values: np.ndarray, sizes: np.ndarray, like: pa.Array, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    mask = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind, from_pandas=True), mask=mask)


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each value: its series' first place and size, and its own place in the series."""
    first, n = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
    return first, n, np.arange(len(n)) - first


def smooth(x: np.ndarray, sizes: np.ndarray, sigma: float) -> np.ndarray:
    weights = S.gaussian_weights(sigma)
    first, n, i = _places(sizes)
    out = np.zeros(len(x))
    for k, w in enumerate(weights):
        p = (i + (k - len(weights) // 2)) % (2 * n)
        out += w * x[first + np.where(p < n, p, 2 * n - 1 - p)]
    return out


def local_cubic(x: np.ndarray, sizes: np.ndarray, window: int = 11, order: int = 3) -> np.ndarray:
    weights = np.array(S.savgol_weights(window, order))
    first, n, i = _places(sizes)
    long = n >= window
    first, n, i = first[long], n[long], i[long]
    start = np.maximum(0, np.minimum(i - window // 2, n - window))
    sums = np.zeros(len(i))
    for k in range(window):
        sums += weights[i - start, k] * x[first + start + k]
    out = x.copy()
    out[long] = sums
    return out


def nearby_entropy(x: np.ndarray, sizes: np.ndarray, window: int = 20) -> np.ndarray:
    first, n, i = _places(sizes)
    low, high = np.maximum(i - window // 2, 0), np.minimum(i + window // 2, n)
    out = np.zeros(len(x))
    for s in range(0, len(x), AT_ONCE):
        at = slice(s, s + AT_ONCE)
        size = (high - low)[at]
        inside = np.arange(window)[None] < size[:, None]
        part = x[np.where(inside, (first + low)[at, None] + np.arange(window)[None], (first + low)[at, None])]
        bins = np.minimum(10, size // 2 + 1)
        least, most = part.min(1), part.max(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            place = np.minimum(np.floor((part - least[:, None]) / (most - least)[:, None] * bins[:, None]), bins[:, None] - 1)
        place = np.where((most > least)[:, None], place, (bins // 2)[:, None]).astype(np.int64)
        rows = np.repeat(np.arange(len(size)), size)
        counts = np.bincount(rows * 10 + place[inside], minlength=len(size) * 10).reshape(-1, 10)
        h = np.zeros(len(size))
        for k in counts.T:
            share = k / size
            h += np.where(k > 0, share * np.log(np.where(k > 0, share, 1.0)), 0.0)
        out[at] = np.where(size < 3, 0.0, -h)
    return out


def nearby_divergence(x: np.ndarray, sizes: np.ndarray, states: int = 20, bins: int = 14) -> np.ndarray:
    w = np.maximum(5, sizes // states)
    step = w // 2
    many = np.where(sizes > w, np.maximum(sizes - w - 1, 0) // step + 1, 0)
    many = np.where(many > 1, many, 0)
    doc = np.repeat(np.arange(len(sizes)), many)
    start = (np.arange(len(doc)) - (np.cumsum(many) - many)[doc]) * step[doc]
    heads = np.cumsum(sizes) - sizes
    width = w[doc]
    firsts = [heads[doc] + start, heads[doc] + np.maximum(np.minimum(start + step[doc], sizes[doc] - width), 0)]
    row = np.repeat(np.arange(len(doc)), width)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
    parts = [x[f[row] + inner] for f in firsts]
    cuts = np.cumsum(width) - width
    ends = lambda f: f(*(f.reduceat(p, cuts) for p in parts)) if len(doc) else np.zeros(0)
    low, high = ends(np.minimum), ends(np.maximum)
    shares = []
    with np.errstate(invalid="ignore", divide="ignore"):
        for p in parts:
            place = np.minimum(np.floor((p - low[row]) / (high - low)[row] * bins), bins - 1)
            place = np.where((high > low)[row], place, 0).astype(np.int64)
            raw = np.bincount(row * bins + place, minlength=len(doc) * bins).reshape(-1, bins) / width[:, None] + (1e-10 * (high - low) / bins)[:, None]
            shares.append(raw / functools.reduce(np.add, raw.T, np.zeros(len(doc)))[:, None])
        kl = [functools.reduce(np.add, (a * np.log(a / b)).T, np.zeros(len(doc))) for a, b in (shares, shares[::-1])]
        each = np.where(high > low, (kl[0] + kl[1]) / 2, 0.0)
    first, n, i = _places(sizes)
    known = np.repeat(many, sizes)
    at = i / np.maximum(n - 1, 1) * (known - 1)
    base = np.repeat(np.cumsum(many) - many, sizes)
    out = np.zeros(len(x))
    f = known > 0
    if f.any():
        below = np.floor(at[f]).astype(np.int64)
        a = each[base[f] + below]
        out[f] = a + (at[f] - below) * (each[base[f] + np.minimum(below + 1, known[f] - 1)] - a)
    return out


def tops(x: np.ndarray, sizes: np.ndarray, gaps: np.ndarray, least: float) -> tuple[list[int], np.ndarray]:
    """Places of all series' peaks, in order, and how many each has."""
    first, _, i = _places(sizes)
    run = np.flatnonzero((i == 0) | (x != np.roll(x, 1)))
    owner = np.repeat(np.arange(len(sizes)), sizes)[run]
    value = x[run]
    inner = np.zeros(len(run), bool)
    if len(run) > 2:
        inner[1:-1] = (owner[:-2] == owner[1:-1]) & (owner[2:] == owner[1:-1]) & (value[1:-1] > value[:-2]) & (value[1:-1] > value[2:])
    k = np.flatnonzero(inner)
    # The middle of a run by its places in the series, not in the batch.
    head, owner = first[run[k]], owner[k]
    place = head + (run[k] + run[np.minimum(k + 1, len(run) - 1)] - 2 * head - 1) // 2
    values, order = x.tolist(), np.lexsort((-place, -x[place], owner)).tolist()
    place, owner, heads = place.tolist(), owner.tolist(), (np.cumsum(sizes) - sizes).tolist()
    found: list[list[int]] = [[] for _ in heads]
    taken: dict[int, bytearray] = {}
    for o in order:
        d, p = owner[o], place[o]
        j, gap = p - heads[d], int(gaps[d])
        near = taken.setdefault(d, bytearray(int(sizes[d])))
        if not near[j]:
            start, stop = max(j - gap + 1, 0), min(j + gap, len(near))
            near[start:stop] = b"\1" * (stop - start)
            if least <= 0 or _stands_out(values, p, heads[d], heads[d] + len(near), least):
                found[d].append(j)
    return [j for f in found for j in sorted(f)], np.array([len(f) for f in found], dtype=np.int64)


def _stands_out(x: list[float], p: int, head: int, end: int, least: float) -> bool:
    """Whether the height over the higher of the lowest values towards a higher one, or an end, is at least ``least``."""
    top, lows = x[p], []
    for way in (range(p - 1, head - 1, -1), range(p + 1, end)):
        low = top
        for j in way:
            v = x[j]
            if v > top:
                break
            if v < low:
                low = v
        lows.append(low)
    return top - max(lows) >= least


def _floats(kernel: Callable[..., np.ndarray], x: pa.Array, *options) -> pa.Array:
    values, sizes = _parts(x)
    return _lists(kernel(values, sizes, *options), sizes, x, pa.float64())


def gaussian(x: pa.Array, sigma: float) -> pa.Array:
    return _floats(smooth, x, sigma)


def savitzky_golay(x: pa.Array, window: int = 11, order: int = 3) -> pa.Array:
    return _floats(local_cubic, x, window, order)


def local_entropy(x: pa.Array, window: int = 20) -> pa.Array:
    return _floats(nearby_entropy, x, window)


def local_divergence(x: pa.Array, states: int = 20, bins: int = 14) -> pa.Array:
    return _floats(nearby_divergence, x, states, bins)


def peaks(x: pa.Array, distance: int | np.ndarray = 1, least_prominence: float = 0.0) -> pa.Array:
    """With a distance for all series, or one for each."""
    values, sizes = _parts(x)
    found, many = tops(values, sizes, np.broadcast_to(distance, len(sizes)), least_prominence)
    return _lists(np.array(found, np.int64), many, x, pa.int32())


def valleys(x: pa.Array, distance: int | np.ndarray = 1, least_prominence: float = 0.0) -> pa.Array:
    """Peaks of the series upside down."""
    values, sizes = _parts(x)
    found, many = tops(-values, sizes, np.broadcast_to(distance, len(sizes)), least_prominence)
    return _lists(np.array(found, np.int64), many, x, pa.int32())


def lengths(x: pa.Array) -> np.ndarray:
    return _parts(x)[1]


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: of the shortest decimal form, halves away from zero."""
    scale = 10.0**digits
    size = np.abs(x) * scale
    low = np.floor(size)
    out = np.copysign((low + (size - low >= 0.5)) / scale, x) + 0.0
    # Near a half, and for numbers that the product has no room for, the decimal form decides.
    near = np.flatnonzero((np.abs(size - low - 0.5) < 1e-6 + size * 2.0**-50) | (size > 2.0**49))
    unit = Decimal(1).scaleb(-digits)
    out[near] = [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) + 0.0 if abs(v) < 1e15 else v for v in x[near].tolist()]
    return out


def compound(x: pa.Array) -> pa.Array:
    """Running sum of the centred series over its largest size, 1 at least."""
    values, sizes = _parts(x)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mean = np.bincount(owner, values, len(sizes)) / np.maximum(sizes, 1)
    # The value and the mean's opposite in turn: sums are those of one step after the other.
    turns = np.column_stack([values, -mean[owner]]).ravel()
    ends = np.cumsum(sizes)
    out = np.empty(len(values))
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        if b > a:
            sums = np.cumsum(turns[2 * a : 2 * b])[1::2]
            out[a:b] = sums / max(abs(sums.min()), abs(sums.max()), 1.0)
    return _lists(out, sizes, x, pa.float64())


def _total(rows: np.ndarray) -> np.ndarray:
    """Sums of columns, one row after the other."""
    return functools.reduce(np.add, rows, np.zeros(rows.shape[1]))


def _variance(rows: np.ndarray) -> np.ndarray:
    m = _total(rows) / len(rows)
    return _total((rows - m) * (rows - m)) / len(rows)


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson's r of columns; 0 if one is constant."""
    a, b = (z - _total(z) / len(z) for z in (a, b))
    size = np.sqrt(_total(a * a) * _total(b * b))
    return np.divide(_total(a * b), size, out=np.zeros(len(size)), where=size > 1e-12)


def _trend(v: np.ndarray, trace: float) -> np.ndarray:
    """R squared of the least-squares lines of columns."""
    n = float(len(v))
    m, spread = _total(v) / n, n * (n * n - 1) / 12.0
    b = _total((np.arange(len(v)) - (n - 1) / 2)[:, None] * (v - m)) / spread
    of = _variance(v)
    return np.where(of > 0, np.maximum(0.0, 1 - (of - b * b * (n * n - 1) / 12.0) * n / (of * n + trace)), 0.0)


def _tallest(values: np.ndarray, places: list[int], many: np.ndarray, points: int) -> np.ndarray:
    """The place of each series' largest value among its places, of equal ones the first; of all values where there are no places."""
    out = values.reshape(-1, points).argmax(1)
    owner, place = np.repeat(np.arange(len(many)), many), np.array(places, np.int64)
    order = np.lexsort((place, -values[owner * points + place], owner))
    heads = order[np.searchsorted(owner, np.flatnonzero(many))]
    out[many > 0] = place[heads]
    return out


#: Names and kinds of what :func:`shape_features` gives.
FEATURES = {"up": "int", "down": "int", "net": "double", "volatility": "double", "symmetry": "double", "r2": "double", "top": "double", "low": "double"}


def shape_features(x: pa.Array, prominence: float, points: int = 100, gap: int = 10) -> list[pa.Array]:
    """Features of resampled, scaled and smoothed series, by name as in :data:`FEATURES`; null without values."""
    values, sizes = _parts(x)
    some = np.flatnonzero(sizes)
    first, last = (np.cumsum(sizes) - sizes)[some], sizes[some] - 1
    p = np.arange(points)[:, None] * last / (points - 1.0)
    low = np.floor(p).astype(np.int64)
    below = values[first + low]
    even = below + (p - low) * (values[first + np.minimum(low + 1, last)] - below)
    least = even.min(0, initial=np.inf)
    width = even.max(0, initial=-np.inf) - least
    wide = width > 1e-8
    scaled = np.where(wide, (even - least) / np.where(wide, width, 1.0), 0.5)
    each = np.full(len(some), points, np.int64)
    flat = rounded(local_cubic(scaled.T.ravel(), each), 9)
    v, gaps = flat.reshape(-1, points).T, np.full(len(some), gap)
    tops_, valleys_ = tops(flat, each, gaps, prominence), tops(-flat, each, gaps, prominence)
    half = points // 2
    found = [
        tops_[1], valleys_[1], v[-1] - v[0], np.sqrt(_variance(v[1:] - v[:-1])), np.abs(_likeness(v[:half], v[half : 2 * half][::-1])), _trend(v, 1e-8),
        _tallest(flat, *tops_, points) / 100.0, _tallest(-flat, *valleys_, points) / 100.0,
    ]
    out = []
    for made, kind in zip(found, FEATURES.values(), strict=True):
        whole = np.zeros(len(sizes), made.dtype)
        whole[some] = made
        out.append(pa.array(whole, pa.int32() if kind == "int" else pa.float64(), mask=sizes == 0))
    return out
