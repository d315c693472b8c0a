"""Each registered query of the numbered operators on the smallest tables: with SQL row by row, the others by brute force."""

import base64
import collections
import glob
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from narrata.llm import fingerprints, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def engine():
    found = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return found


@pytest.fixture(scope="module")
def texts(engine):
    return {i: t or "" for i, t in engine.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()}


def run(spark, number):
    name = next(n for n in queries.QUERIES if n.startswith(f"op{number}_"))
    return queries.QUERIES[name](spark, DATA)


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_like_sql(spark, engine, name):
    df = queries.QUERIES[name](spark, DATA)
    other = engine.execute(queries.SQL[name])
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered([c[0] for c in other.description], other.fetchall())


def test_op2(spark, texts):
    rows = {r.doc_id: r for r in run(spark, 2).collect()}
    ids = list(texts)
    assert sorted(rows) == ids
    for i, j in zip(ids, [*ids[1:], ids[0]]):
        r, t = rows[i], texts[i]
        edit = fingerprints.edited(t, texts[j])
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        own, other, following = (fingerprints.signatures([x.encode()])[0] for x in (t, edit, texts[j]))
        assert r.fingerprint == fingerprints.shown(own) and r.near_edited == (own == other).mean() and r.near_next == (own == following).mean()


def test_op4(spark, engine):
    lang = dict(engine.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = run(spark, 4).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op6(spark, texts):
    rows = run(spark, 6).collect()
    size, slots, shard_of = collections.Counter(), collections.defaultdict(list), {}
    for r in rows:
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        assert shard_of.setdefault(t, r.shard) == r.shard
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in rows) == sorted(texts) and set(size) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Contiguous shards of least capacity: none above the even share by more than the largest group.
    groups = collections.Counter()
    for t in texts.values():
        groups[t] += len(t.encode()) + 1
    assert max(size.values()) <= sum(size.values()) / 8 + max(groups.values())


def test_op8(spark, texts):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    bins, seen = collections.defaultdict(list), collections.defaultdict(dict)
    for r in run(spark, 8).collect():
        bins[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
    total = 0
    for i, t in texts.items():
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        assert seen[i] == {k: (k * 2048, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(2048, len(ids), 2048)))}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1


def test_op9(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in run(spark, 9).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_op11(spark, texts):
    from test_new_operators import base_spans

    rows = run(spark, 11).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = base_spans(texts[r.doc_id])
        shown = [f"{k}:{i}:{j}" for k, i, j in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest() and set(shown) <= {*r.spans.split(","), ""}
