"""Byte-level BPE encoding and decoding.

The ``tokenizers`` library merges the bytes; Spark hands it Arrow batches. A
rank file (base64 token, rank) becomes a BPE model: every byte is shown as a
printable character, and every split of a token into two tokens is a merge
with the token's rank, so merges are picked as by ranks of byte strings.
Text is cut by the split pattern first and each distinct piece is merged once
per worker and kept in a bounded cache.

Defined results: null text counts as empty; empty text has no ids; repeated
rows are encoded one by one; ids of any length are whole, never cut; columns
that have the name of an output are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import models

from narrata.llm.rows import without

#: Pieces kept per worker; the cache starts anew beyond it.
CACHE_PIECES = 400_000
#: Rows per Arrow batch sent back.
ROWS_OUT = 512


def byte_chars() -> list[str]:
    """The printable character that stands for each byte.

    Bytes that Latin-1 prints stay as they are; the others, in order, take the
    code points from 256 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Ranks:
    """A rank file's vocabulary: encodes texts to ids, decodes ids to bytes."""

    def __init__(self, content: bytes, pattern: str):
        ranks = parse_ranks(content)
        chars = byte_chars()
        shown = {token: token.decode("latin-1").translate(dict(enumerate(chars))) for token in ranks}
        merges = [(shown[token[:i]], shown[token[i:]]) for token in sorted(ranks, key=ranks.get) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        self._model = models.BPE(vocab={shown[token]: rank for token, rank in ranks.items()}, merges=merges, ignore_merges=True)
        self._chars = dict(enumerate(chars))
        self._split = regex.compile(pattern)
        self._cache: dict[str, bytes] = {}
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def _merge(self, piece: str) -> bytes:
        shown = piece.encode("utf-8", "replace").decode("latin-1").translate(self._chars)
        return np.array([t.id for t in self._model.tokenize(shown)], dtype=np.int32).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        pieces = self._split.findall(text or "")
        try:
            joined = b"".join(map(self._cache.__getitem__, pieces))
        except KeyError:
            if len(self._cache) > CACHE_PIECES:
                self._cache = {}
            for piece in pieces:
                if piece not in self._cache:
                    self._cache[piece] = self._merge(piece)
            joined = b"".join(map(self._cache.__getitem__, pieces))
        return np.frombuffer(joined, dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """First code point and the one after the last of each token; a token that starts inside a character starts at it."""
        data = np.frombuffer(self.decode(ids), dtype=np.uint8)
        first = (data & 0xC0) != 0x80
        point = np.concatenate([[0], np.cumsum(first)])
        ends = np.cumsum([len(self.tokens[i]) for i in ids.tolist()], dtype=np.int64) if len(ids) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ids) else ends
        inside = (starts < len(data)) & ~first[np.minimum(starts, max(len(data) - 1, 0))] if len(data) else np.zeros(len(ids), bool)
        return np.stack([point[starts] - inside, point[ends]], axis=1) if len(ids) else np.zeros((0, 2), np.int64)


_held: dict[tuple[int, str], Ranks] = {}


def held(content: bytes, pattern: str) -> Ranks:
    """One vocabulary per worker."""
    key = (hash(content), pattern)
    if key not in _held:
        _held[key] = Ranks(content, pattern)
    return _held[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(df: DataFrame, text: str, ranks: str, pattern: str, out: str = "ids", offsets: str | None = None) -> DataFrame:
    """Add the ids of column ``text``: array<int> ``out``, and ``offsets`` (array of [start, end] code points) if named.

    The vocabulary's size is fixed by its file, so it is broadcast.
    """
    df = without(df, out, *([offsets] if offsets else []))
    content = df.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    extra = [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)]
    if offsets:
        extra.append(T.StructField(offsets, T.ArrayType(T.ArrayType(T.LongType())), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(content.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                found = [coder.encode(t) for t in batch.column(text).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))]
                if offsets:
                    lists.append(pa.array([coder.offsets(x).tolist() for x in found], type=pa.list_(pa.list_(pa.int64()))))
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, *(f.name for f in extra)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra]))


def decoder(df: DataFrame, ranks: str, pattern: str) -> Callable[[Column | str], Column]:
    """A function from a column of ids to the column of their bytes (binary); null ids give null."""
    content = df.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    @F.arrow_udf(T.BinaryType())
    def decode(ids: pa.Array) -> pa.Array:
        coder = held(content.value, pattern)
        flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        return pa.array([None if not ok else coder.decode(flat[a:b]) for a, b, ok in zip(ends[:-1], ends[1:], ids.is_valid().to_pylist(), strict=True)], type=pa.binary())

    return decode


def decode_parts(parts: list[bytes]) -> list[str]:
    """Text of consecutive runs of ids, from their bytes: a character that is split between runs goes to the run with its last byte."""
    out, rest = [], b""
    for i, part in enumerate(parts):
        data, last = rest + part, i == len(parts) - 1
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                wide = 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 1
                cut = len(data) - back if wide > back and not last else len(data)
                break
        out.append(data[:cut].decode("utf-8", "replace"))
        rest = data[cut:]
    return out
