"""Best-fit packing of token sequences: minimum bin slack.

Texts become ids, ids become pieces of at most ``capacity`` tokens, and pieces
go to bins. Only the number of pieces of each length matters for the choice of
bins, and there are at most ``capacity`` lengths: Spark counts them, and for
each bin a bitset subset-sum over the lengths that are left finds the fullest
combination with the longest one. The combination is removed as often as the
counts allow. Spark then ranks the pieces within their length, and a rank
tells the bin and the place in it.

Defined results: null text counts as empty; an empty text is the end token
alone; repeated rows are packed one by one; an empty table gives no bins;
columns that have the name of an output are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from narrata.llm.bpe import byte_chars
from narrata.llm.ranks import partitions, ranked
from narrata.llm.rows import nest, unnest, without
from narrata.workspace import Workspace

#: Word pieces kept per worker; the cache starts anew beyond it.
CACHE_PIECES = 250_000
ROWS_OUT = 256


class Words:
    """Ids of whole texts by a tokenizer file, with the pieces of plain Latin text merged once and kept.

    A piece is what the file's split pattern cuts out; its model merges each
    piece by itself, so ids of a text are those of its pieces in turn. Texts
    with other characters go through the tokenizer as they are.
    """

    #: Below this code point, lower case and NFC work on single characters (but for one, which is left out).
    LATIN = 0x17F

    def __init__(self, content: str):
        self._whole = Tokenizer.from_str(content)
        spec = json.loads(content)
        cuts = [p["pattern"]["Regex"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        plain = [chr(c) for c in range(0x21, self.LATIN) if not 0x7F <= c <= 0xA0 and c not in (0x130, 0xAD)]
        kind = lambda k: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == k)
        self._special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)")
        self._other = re.compile(f"[^ \n\t\r{re.escape(''.join(plain))}]")
        lower = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self._cut = re.compile(cuts[0].replace(r"[\p{L}]", f"[{kind('L')}]").replace(r"[\p{N}]", f"[{kind('N')}]").replace(r"\p{L}\p{N}", kind("L") + kind("N"))) if lower and len(cuts) == 1 else None
        self._chars = dict(enumerate(byte_chars()))
        self._cache: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self._cut is None or self._other.search(text) or self._special.search(text):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        pieces = self._cut.findall(text.lower())
        try:
            return b"".join(map(self._cache.__getitem__, pieces))
        except KeyError:
            if len(self._cache) > CACHE_PIECES:
                self._cache = {}
            cache, tokenize = self._cache, self._whole.model.tokenize
            for piece in pieces:
                if piece not in cache:
                    cache[piece] = np.array([t.id for t in tokenize(piece.encode().decode("latin-1").translate(self._chars))], dtype="<u4").tobytes()
            return b"".join(map(cache.__getitem__, pieces))


_held: dict[int, Words] = {}


def held(content: str) -> Words:
    key = hash(content)
    if key not in _held:
        _held[key] = Words(content)
    return _held[key]


def pieces(df: DataFrame, text: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece: the other columns, and piece, start, length and ids (binary, little-endian 32-bit).

    Each text's ids end with ``end_id``. Only sequences longer than
    ``capacity`` are cut, into pieces of that length and a last one.
    """
    df = without(df, "piece", "start", "length", "ids")
    with open(tokenizer, encoding="utf-8") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())
    kept = [f for f in df.schema.fields if f.name != text]
    extra = [T.StructField("piece", T.IntegerType(), False), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("ids", T.BinaryType(), False)]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(content.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                source, piece, start, length, ids = [], [], [], [], []
                for row, value in enumerate(batch.column(text).to_pylist()):
                    data = words.ids(value or "") + end
                    for k, a in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[a : a + 4 * capacity]
                        source.append(row)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        ids.append(part)
                rest = [batch.column(f.name).take(pa.array(source, pa.int32())) for f in kept]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=[f.name for f in [*kept, *extra]])

    return df.mapInArrow(run, T.StructType([*kept, *extra]))


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths, longest first, whose sum is the largest up to ``room``; each at most as often as it is there."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left and not reach >> room:
            take = min(step, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, []
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return sorted(chosen, reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first bin, per bin, first place in the bin).

    Each round uses up one length at least, or halves how often it can be
    combined, so there are few rounds: their number depends on the capacity
    and not on the number of pieces.
    """
    left, used, rows, bin_ = {k: n for k, n in counts.items() if n}, dict.fromkeys(counts, 0), [], 0
    while left:
        first = max(left)
        left[first] -= 1
        chosen = [first, *fullest(left, capacity - first)]
        left[first] += 1
        need = {x: chosen.count(x) for x in set(chosen)}
        times = min(left[x] // n for x, n in need.items())
        place = 0
        for x in sorted(need, reverse=True):
            rows.append((x, used[x], times * need[x], bin_, need[x], place))
            used[x] += times * need[x]
            left[x] -= times * need[x]
            place += x * need[x]
            if not left[x]:
                del left[x]
        bin_ += times
    return rows


def pack(df: DataFrame, capacity: int, order: list[str], ws: Workspace | None = None) -> DataFrame:
    """Add sequence_id and offset to pieces with a column ``length`` of 1 to ``capacity``; ``order`` settles which of equal lengths go where.

    Sequences hold at most ``capacity`` tokens and their places have no gaps.
    """
    ws = ws or Workspace(df.sparkSession, "pack")
    stored = ws.save(nest(df, F.col("length").cast("long").alias("length"), *(F.col(c).alias(f"order{i}") for i, c in enumerate(order))), "pieces")
    order = [f"order{i}" for i in range(len(order))]
    # One row for each length: no more than the capacity.
    counts = {r["length"]: r["count"] for r in stored.groupBy("length").count().collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    rows = sorted(plan(counts, capacity))
    ranks = ranked(ws, stored, ["length", *order], ["length"], partitions(df, sum(counts.values())), "_rank")
    table = df.sparkSession.sparkContext.broadcast(np.array(rows, dtype=np.int64).reshape(-1, 6))
    fields = [stored.schema["row"], T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        wide = int((t[:, 1] + t[:, 2]).max()) + 1 if len(t) else 1
        keys = t[:, 0] * wide + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            row = t[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            bins, nth = np.divmod(rank - row[:, 1], np.maximum(row[:, 4], 1))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(row[:, 3] + bins), pa.array(row[:, 5] + nth * length)], names=["row", "sequence_id", "offset"])

    return unnest(ranks.mapInArrow(run, T.StructType(fields)), df.columns, "sequence_id", "offset")
