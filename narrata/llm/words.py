"""Words and word sequences of many texts as 64-bit fingerprints, vectorised.

A word is a longest run of bytes other than the space and 0x09 to 0x0D. Its
fingerprint is the sum of a mixed number for each byte and its place in the
word (tabulation hashing), so that no algebra of the bytes makes different
words equal. A second one, independent of the first,
makes 128 bits. Fingerprints of sequences come from prefix sums of a polynomial
over those of the words, so their cost does not depend on the length. They
depend on the bytes alone: they are equal in every task, on every machine.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text bytes that are worked on at once (a longer text is worked on alone).
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

# Odd multipliers and seeds, and the finisher of the published splitmix64 generator.
_COUNT, _WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SEEDS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd number modulo 2**64, and of its inverse, as far as they have been needed."""

    def __init__(self, base: int):
        self._bases = [base, pow(base, -1, 1 << 64)]
        self._found = [np.ones(1, U), np.ones(1, U)]

    def __call__(self, n: int, inverse: bool = False) -> np.ndarray:
        while len(self._found[inverse]) < n:
            have = self._found[inverse]
            step = pow(self._bases[inverse], len(have), 1 << 64)
            self._found[inverse] = np.concatenate([have, have * U(step)])
        return self._found[inverse][:n]


_powers = _Powers(_WORD)


@functools.cache
def _table(seed: int) -> np.ndarray:
    """The mixed number of each of 64 places and each byte."""
    return mix(np.arange(64 << 8, dtype=U) * U(_COUNT) + U(seed))


def split(text: bytes, lower: bool = False) -> list[bytes]:
    """The words of a UTF-8 text; ``lower`` changes A to Z only."""
    return (text.lower() if lower else text).split()


class Words:
    """The words of a list of UTF-8 texts, their fingerprints, and where each text's words begin."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self._data, self._lower = b"\n".join(texts) + b"\n", lower
        raw = np.frombuffer(self._data, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self._starts, ends = edge[::2], edge[1::2]
        self._sizes = ends - self._starts
        at = np.flatnonzero(~space)
        self._bytes = (_LOWER[raw] if lower else raw)[at]
        self._places = at - np.repeat(self._starts, self._sizes)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        #: Index of the first word of each text, and the number of words at the end.
        self.first = np.searchsorted(self._starts, begins)

    def _fingerprints(self, seed: int) -> np.ndarray:
        if not len(self._sizes):
            return np.zeros(0, U)
        terms = _table(seed)[(self._places & 63) << 8 | self._bytes]
        far = np.flatnonzero(self._places >= 64)
        if len(far):
            terms[far] = mix(terms[far] + (self._places[far] >> 6).astype(U) * U(_COUNT))
        sums = np.add.reduceat(terms, np.cumsum(self._sizes) - self._sizes)
        return mix(sums + self._sizes.astype(U) * U(_COUNT))

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return self._fingerprints(SEEDS[0])

    @functools.cached_property
    def seconds(self) -> np.ndarray:
        """Fingerprints that are independent of the first ones."""
        return self._fingerprints(SEEDS[1])

    @functools.cached_property
    def items(self) -> list[bytes]:
        """The words of all texts, in turn."""
        return split(self._data, self._lower)

    def of(self, i: int) -> list[bytes]:
        """The words of one text."""
        return self.items[self.first[i] : self.first[i + 1]]

    def sequences(self, k: int | np.ndarray, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the k words from each of ``at`` on."""
        return sequences(self.hashes, k, at)


def sequences(self, k: int | np.ndarray, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the k words from each of ``at`` on."""
        return sequences(self.hashes, k, at)


def sequences(hashes: np.ndarray, k: int | np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * _powers(len(hashes)), out=sums[1:])
    return mix((sums[at + k] - sums[at]) * _powers(max(len(hashes), 1), True)[np.minimum(at, max(len(hashes) - 1, 0))] + np.asarray(k).astype(U) * U(_COUNT))


def shingle_set(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    """The distinct k-word shingles themselves; fewer words are one shingle, no words none."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(k)), strict=False))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the k-word shingles of each text in turn, and where each text's begin; a text with fewer words is one shingle, one without words none."""
    counts = np.diff(words.first)
    some = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(some)])
    text = np.repeat(np.arange(len(some)), some)
    at = words.first[:-1][text] + np.arange(begins[-1]) - begins[:-1][text]
    return words.sequences(np.minimum(k, counts)[text], at), begins


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with about ``limit`` text bytes, and their texts (null: empty)."""
    sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(text)).to_pylist()], dtype=np.int64)
    at, n = 0, len(sizes)
    total = np.cumsum(sizes)
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        part = batch.slice(at, end - at)
        yield part, [t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()]
        at = end


class Permutations:
    """Universal hash functions: multiply, add, keep the upper 32 bits."""

    def __init__(self, count: int, seed: int = 1):
        draw = np.random.default_rng(seed).integers(0, 1 << 63, (2, count), dtype=np.uint64)
        self._factor, self._add = draw[0] << U(1) | U(1), draw[1]
        self.count = count

    def minima(self, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Row per text: the smallest image of its values under each function; all ones for a text without any."""
        out = np.full((len(begins) - 1, self.count), 0xFFFFFFFF, np.uint32)
        full = np.flatnonzero(np.diff(begins))
        step = 1 << 15
        if not len(full):
            return out
        for low in _runs(begins, full, step):
            part = values[begins[low[0]] : begins[low[-1] + 1]]
            cuts = begins[low] - begins[low[0]]
            for k in range(self.count):
                out[low, k] = np.minimum.reduceat(part * self._factor[k] + self._add[k], cuts) >> U(32)
        return out


def _runs(begins: np.ndarray, full: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Texts that have values, in runs of about ``step`` values."""
    group = begins[full] // step
    yield from np.split(full, np.flatnonzero(np.diff(group)) + 1)
