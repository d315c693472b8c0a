"""Each numbered operator against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from narrata.llm import bpe, components, fingerprints, languages, near, packing, sharding, substrings, topk, urls, warc
from narrata.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0d]+")
RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def corpus():
    draw = random.Random(7)
    vocabulary = ["the", "of", "and", "Été", "naïve", "don't", "x1", "42", "ß", "日本", "é", "🙂", "end.", "to"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    base, passage = text(120), text(60)
    near_copy = base.split()
    near_copy[10] = "changed"
    rows = [(0, base), (1, " ".join(near_copy)), (2, base), (3, None), (4, ""), (5, "  \n\t "), (6, "one"), (7, "ONE"), (8, text(40) + " " + passage), (9, passage + "\n" + text(30)), (10, "a " * 40), (11, "b " + "a " * 60), (12, text(3000)), (None, text(20)), (None, text(20)), (13, base), (13, base), (14, "three little words"), (15, "<|endoftext|> of é text gap")]
    return [(i, t, f"row{k}") for k, (i, t) in enumerate(rows)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, kept string")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, kept string")


def key(*values):
    return tuple((v is not None, v) for v in values)


def test_bpe(spark, docs, nothing):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode(docs.withColumn("ids", F.lit(1)), "text", RANKS, public_tokenizers.PATTERN, offsets="offsets")
    rows = coded.withColumn("back", bpe.decoder(docs, RANKS, public_tokenizers.PATTERN)("ids")).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = r.text or ""
        assert list(r.ids) == own.encode_ordinary(text) and bytes(r.back) == text.encode()
        assert not r.ids or (r.offsets[0][0], r.offsets[-1][1]) == (0, len(text))
    assert bpe.encode(nothing, "text", RANKS, public_tokenizers.PATTERN).count() == 0
    whole = "é🙂".encode()
    assert bpe.decode_parts([whole[:1], whole[1:3], whole[3:]]) == ["", "é", "🙂"] and bpe.decode_parts([b"\xc3"]) == ["�"]


def test_packing(spark, docs, nothing):
    own = Tokenizer.from_file(WORDS)
    cut = packing.pieces(docs.withColumn("offset", F.lit("x")), "text", WORDS, 64, 0)
    packed = packing.pack(cut, 64, ["doc_id", "kept", "piece"]).collect()
    ids = collections.defaultdict(dict)
    bins = collections.defaultdict(list)
    for r in packed:
        ids[r.kept][r.piece] = np.frombuffer(r.ids, "<u4").tolist()
        assert r.length == len(ids[r.kept][r.piece]) and r.start == 64 * r.piece
        bins[r.sequence_id].append((r.offset, r.length))
    for _, text, kept in ROWS:
        assert sum((ids[kept][k] for k in sorted(ids[kept])), []) == own.encode(text or "", add_special_tokens=False).ids + [0]
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in packed) // 64) + 1
    assert packing.pack(packing.pieces(nothing, "text", WORDS, 64, 0), 64, ["doc_id"]).count() == 0
    assert packing.fullest({5: 2, 3: 1, 7: 0}, 9) == [5, 3] and packing.fullest({}, 9) == []
    for seed in range(20):
        draw = random.Random(seed)
        counts = {draw.randint(1, 30): draw.randint(1, 50) for _ in range(8)}
        placed = packing.plan(counts, 30)
        assert {x: sum(r[2] for r in placed if r[0] == x) for x in counts} == counts


def brute_shards(rows, shards):
    first, size = {}, collections.Counter()
    for i, t, _ in rows:
        t = t or ""
        k = key(i)
        first[t] = min(first.get(t, k), k)
        size[t] += len(t.encode()) + 1
    sizes = [size[t] for t in sorted(size, key=lambda t: (first[t], hashlib.sha256(t.encode()).hexdigest()))]

    def fits(capacity):
        n, now = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if now + s > capacity:
                n, now = n + 1, 0
            now += s
        return n <= shards

    return next(c for c in range(1, sum(sizes) + 1) if fits(c))


def test_sharding(spark, docs, nothing):
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumn("slot", F.lit(9))
    out = sharding.shard(df, "doc_id", F.sha2(text, 256), F.octet_length(text) + 1, 4).collect()
    assert len(out) == len(ROWS)
    sizes, slots, of = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in out:
        sizes[r.shard] += len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
        of[r.text or ""].add(r.shard)
    assert max(sizes.values()) == brute_shards(ROWS, 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())
    assert sharding.shard(nothing, "doc_id", F.col("text"), F.lit(1), 4).count() == 0


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(500, i) for i in range(501, 530)] + [(None, 3), (4, None), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = components.components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {x: find(x) for x in root}
    assert components.components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls(spark):
    rules = [urls.Rule("block", "com", "/en/"), urls.Rule("allow", "example.com", "/en/7"), urls.Rule("block", "b.org", "/")]
    canonical = lambda u: f'<html><head><LINK href="{u}" rel="canonical"></head>'
    pages = [(10, "http://F.net/a/b?q", "<link rel=canonical href='../c/./d'>"), (11, "http://f.NET/c/d#top", canonical("http://x.com/en/z")), (12, "http://g.net", "<link rel='canonical' href='mailto:a@b.org'>"), (13, "http://h.net/#s", canonical("#t")), (1, "http://A.Example.COM/en/7?x", None), (2, "http://x.com/en/a#t", ""), (3, "http://c.net/p", canonical("http://d.net/q")), (4, "http://d.net/q", "<meta http-equiv=refresh content='0; url=http://b.org/z'>"), (5, None, "x"), (6, "no-scheme", None), (7, "http://notcom/en/", canonical("/rel")), (8, "http://e.net", canonical("http://x.example.com/en/70")), (9, "http://x.example.com/en/70", canonical("http://b.org/z")), (3, "http://c.net/p", None)]
    df = spark.createDataFrame(pages, "page_id int, url string, html string").withColumn("Host", F.lit(1))
    out = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.judge(df.drop("html"), "url", rules, urls.links(df, "url", "html")).collect()}
    assert out == {
        (10, "f.net", "/a/b"): (None, "block"), (11, "f.net", "/c/d"): (None, "block"), (12, "g.net", ""): (None, "allow"), (13, "h.net", "/"): (None, "allow"),
        (1, "a.example.com", "/en/7"): ("example.com/en/7", "allow"), (2, "x.com", "/en/a"): ("com/en/", "block"), (3, "c.net", "/p"): (None, "block"), (4, "d.net", "/q"): (None, "block"), (5, "", ""): (None, "allow"),
        (6, "", ""): (None, "allow"), (7, "notcom", "/en/"): (None, "allow"), (8, "e.net", ""): (None, "block"), (9, "x.example.com", "/en/70"): ("example.com/en/7", "allow"),
    }
    none = df.limit(0)
    assert urls.judge(none.drop("html"), "url", rules, urls.links(none, "url", "html")).count() == 0


def test_warc(spark):
    draw = random.Random(1)
    pages = [(1, "http://a/1", "same"), (2, "http://a/2\r\nX: y", "same"), (3, None, None), (4, "http://a/4", ""), (5, "u", "x" * 700_000), (None, "u", "same"), (6, "u", "é🙂"), (7, "u", "once"), (7, "u", "once")] + [(100 + i, "u", str(draw.random()) * 900) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    ws = Workspace(spark, "t")
    folder, index = warc.write(df, "page_id", "url", F.encode("html", "UTF-8"), 0, ws)
    rows = warc.read(folder, index).collect()
    largest = {}
    for i, _, h in pages:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    assert sorted(key(r.record) for r in rows) == sorted(key(i) for i, _, _ in pages)
    of = {(i, h or ""): None for i, _, h in pages}
    for r in rows:
        digests = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for i, h in of if i == r.record}
        h = digests[r.payload_digest]
        revisit = r.record is not None and largest[h] != r.record
        assert r.payload_bytes == len(h.encode()) and r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == (largest[h] if revisit else None) and (r.payload is None if revisit else bytes(r.payload) == h.encode())
    one = warc.read(folder, index.where("record = 6")).collect()
    assert len(one) == 1 and bytes(one[0].payload) == "é🙂".encode()
    folder, index = warc.write(df.limit(0), "page_id", "url", F.encode("html", "UTF-8"), 0, ws)
    assert warc.read(folder, index).count() == 0


def test_topk(spark):
    draw = np.random.default_rng(2)
    vectors = [(i, draw.normal(size=6).round(2).tolist()) for i in range(90)] + [(90 + i, [0.5] * 6) for i in range(40)] + [(200, None), (201, [float("nan")] * 6), (202, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (203, [float("inf")] * 6), (210, [3e5] * 6), (300, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    found = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 30 == 0, 5).collect()
    good = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in good:
        if q % 30 == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == want
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.lit(True), 5).count() == 0


@pytest.mark.parametrize("size", [1e7, 1e9, 1e30, 1e300])
def test_topk_large(spark, size):
    draw = np.random.default_rng(4)
    vectors = [(i, (draw.normal(size=5) * (size if i % 4 else 1.0)).tolist()) for i in range(60)] + [(60 + i, [size] * 5) for i in range(8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * x)) if abs(256 * x) < 2**53 else int(256 * x) for x in v] for i, v in vectors}
    want = set()
    for q in (i for i in whole if i % 10 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want |= {(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(scores[:5])}
    found = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 10 == 0, 5).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == want


def sets_of(rows, k):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for i, t, kept in rows:
        w = WORD.findall((t or "").translate(lower))
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset(), kept))
    return out


def brute_near(rows, k):
    root = {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, s) for i, s, _ in sets_of(rows, k) if s and i is not None]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


@pytest.mark.parametrize("k", [4, 5])
def test_near(spark, docs, nothing, k):
    want = brute_near(ROWS, k)
    out = near.near_duplicates(docs, "doc_id", "text", words=k).collect()
    assert sorted((key(r.id), r.n_shingles) for r in out) == sorted((key(i), len(s)) for i, s, _ in sets_of(ROWS, k))
    for r in out:
        assert r.component_id == (want[r.id] if r.id is not None else None) and r.kept == (r.id is None or r.id == want[r.id])
    assert near.near_duplicates(nothing, "doc_id", "text").count() == 0


#: Two words of 1,024 letters that are equal under any polynomial modulo 2**64 with an odd base.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
EUHT = THUE.translate(str.maketrans("ab", "ba"))


def test_near_edges(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words[:60])
    rows = [(1, base), (2, " ".join([THUE, *words[:3]])), (3, " ".join([EUHT, *words[:3]])), (9, " ".join(words[100:160])), (9, base + " end"), (11, " ".join(words[100:160]) + " last"), (9, base + " end")]
    # Likeness of exactly 0.8: 8 of 10 shingles; of less: 7 of 9.
    rows += [(20, " ".join(words[200:212])), (21, " ".join(words[201:213])), (30, " ".join(words[220:231])), (31, " ".join(words[221:232]))]
    rows += [(100 + i, " ".join(draw.sample(words, 12))) for i in range(20)]
    rows = [(i, t, "") for i, t in rows]
    out = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept string"), "doc_id", "text", words=4).collect()
    assert {r.id: r.component_id for r in out} == brute_near(rows, 4)
    assert {r.component_id for r in out if r.id in (2, 3)} == {2, 3} and {r.component_id for r in out if r.id == 11} == {1}


def test_collisions():
    draw = np.random.default_rng(0)
    left, right = draw.integers(0, 4, (40, 16)).astype(np.uint32), draw.integers(0, 4, (30, 16)).astype(np.uint32)
    for least in (1, 5, 9, 16):
        a, b = near.collisions(left, right, least)
        assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero((left[:, None] == right[None]).sum(2) >= least))))
    sets = [set(draw.integers(0, 50, n).tolist()) for n in (0, 5, 30, 40)]
    assert near.common(sets, sets[1:]).tolist() == [[len(a & b) for b in sets[1:]] for a in sets]


def test_near_large_group(spark):
    draw = random.Random(5)
    base = [f"w{draw.randint(0, 500)}" for _ in range(80)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(draw.randint(0, 6)):
            words[draw.randrange(80)] = f"z{draw.randint(0, 99)}"
        rows.append((i, " ".join(words), ""))
    want = brute_near(rows, 4)
    out = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept string"), "doc_id", "text", words=4).collect()
    assert {r.id: r.component_id for r in out} == want


def signature(text):
    """By the definition: the smallest image of the shingles under each function."""
    draw = np.random.default_rng(1).integers(0, 1 << 63, (2, fingerprints.PERMUTATIONS), dtype=np.uint64)
    w, full = text.encode().lower().split(), 1 << 64

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % full
        return x ^ (x >> 31)

    count = 0x9E3779B97F4A7C15
    hashes, k = [mixed((sum(mixed(((p << 8 | c) * count + 0xA24BAED4963EE407) % full) for p, c in enumerate(x)) + len(x) * count) % full) for x in w], min(5, len(w))
    values = []
    for i in range(len(w) - k + 1 if w else 0):
        values.append(mixed((sum(h * pow(0xD1342543DE82EF95, j, full) for j, h in enumerate(hashes[i : i + k])) + k * count) % full))
    return np.array([min((((v * (int(f) << 1 | 1) + int(a)) % full) >> 32 for v in values), default=0xFFFFFFFF) for f, a in draw.T.tolist()], np.uint32)


def test_fingerprints(spark, docs, nothing):
    out = fingerprints.compared(docs, "doc_id", "text").collect()
    order = sorted(ROWS, key=lambda r: (key(r[0]), r[1] or ""))
    texts = [t or "" for _, t, _ in order]
    edits = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, texts[1:] + texts[:1])]
    assert sorted((key(r.id), r.n_chars, r.edited_sha256) for r in out) == sorted((key(i), len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, _, _), t, e in zip(order, texts, edits))
    of = collections.defaultdict(set)
    for r in out:
        of[r.fingerprint].add(r.n_chars)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    five = {s for _, s, _ in sets_of(ROWS, 5)}
    assert len(of) == len(five)
    # The likeness of fingerprints is near that of the sets.
    named = sets_of([(k, t, "") for k, t in enumerate([*texts, *edits])], 5)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    by_text = {(r.n_chars, r.edited_sha256): r for r in out}
    for k, (t, e) in enumerate(zip(texts, edits)):
        r = by_text[len(t), hashlib.sha256(e.encode()).hexdigest()]
        assert abs(r.near_edited - jaccard(named[k][1], named[len(texts) + k][1])) < 0.2
        a, b = np.frombuffer(base64.b64decode(r.fingerprint), "<u4"), np.frombuffer(base64.b64decode(r.edited_fingerprint), "<u4")
        assert r.near_edited == (a == b).mean() and (a == signature(t)).all() and (b == signature(e)).all()
    assert fingerprints.compared(nothing, "doc_id", "text").count() == 0
    want = {i: c for i, c in brute_near(ROWS, 5).items()}
    found = fingerprints.near_duplicates(docs, "doc_id", "text").collect()
    assert {r.id: r.component_id for r in found if r.id is not None} == want


def brute_repeats(rows, window):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            w = WORD.findall(t or "")
            for j in range(len(w) - window + 1):
                g = tuple(w[j : j + window])
                first[g] = min(first.get(g, i), i)
    out = {}
    for i, t, kept in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[kept] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substrings_edges(spark):
    words = [f"w{i}" for i in range(90)]
    rows = [(1, " ".join([THUE, *words[:14]])), (2, " ".join([EUHT, *words[:14]])), (3, " ".join(words[30:60])), (4, " ".join(words[60:90])), (4, "new " + " ".join(words[30:50])), (4, "short"), (5, " ".join(words[60:75])), (3, " ".join(words[30:60]))]
    rows = [(i, t, str(k)) for k, (i, t) in enumerate(rows)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, name string"), "doc_id", "text", 13).collect()
    assert {r.name: (r.n_words, r.n_removed, r.kept) for r in out} == brute_repeats(rows, 13)


@pytest.mark.parametrize("window", [13, 50])
def test_substrings(spark, docs, nothing, window):
    renamed = docs.withColumnRenamed("kept", "name").withColumn("n_words", F.lit("x"))
    out = substrings.remove_repeats(renamed, "doc_id", "text", window).collect()
    assert {r.name: (r.n_words, r.n_removed, r.kept) for r in out} == brute_repeats(ROWS, window)
    assert substrings.remove_repeats(nothing, "doc_id", "text", window).count() == 0


def test_substrings_random(spark):
    draw = random.Random(11)
    rows = [(i, " ".join(draw.choice("ab" if i % 3 else "abc") for _ in range(draw.randint(5, 90))), str(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, name string")
    assert {r.name: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df, "doc_id", "text", 13).collect()} == brute_repeats(rows, 13)


def brute_bits(trained, text):
    """Code length by the definition, from counts in dictionaries."""
    counts = collections.defaultdict(collections.Counter)
    for t in trained:
        for o in range(languages.ORDER + 1):
            for i in range(o, len(t)):
                counts[t[i - o : i]][t[i]] += 1
    total = 0.0
    for i, b in enumerate(text):
        bits = 8.0
        for o in range(languages.ORDER + 1):
            seen = counts.get(text[i - o : i]) if i >= o else None
            if not seen:
                continue
            t, d = sum(seen.values()), len(seen)
            bits = -np.log2(seen[b] / (t + d)) if b in seen else -np.log2(d / (t + d)) + bits
        total += bits
    return total


def test_languages(spark, nothing):
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(6)] + [(10 + i, f"le chat et le chien été {i}", "fr") for i in range(6)] + [(20, None, "fr"), (21, "", None), (22, "12 34 !?", "en"), (23, "the dog", None), (24, "été", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    trees = languages.learn(df, "doc_id", "text", "lang")
    trained = {name: [t.encode() for _, t, l in rows if l == name and t is not None] for name in ("en", "fr")}
    for text in (b"the chat", b"\xff\x00zz", "été".encode(), b"x"):
        assert np.allclose(trees.bits([b"", text])[1], [brute_bits(trained[n], text) for n in ("en", "fr")])
    long = b"the chat et le dog " * 60_000
    assert np.allclose(trees.bits([long]), trees._bits([long], 0))
    out = {r.doc_id: (r.lang_pred, r.score) for r in languages.predict(df, "text", trees).collect()}
    assert out[20] == out[21] == out[22] == ("und", 0.0) and out[23][0] == "en" and out[24][0] == "fr" and out[3][0] == "en"
    none = languages.learn(nothing, "doc_id", "text", "kept")
    assert {r.lang_pred for r in languages.predict(df, "text", none).collect()} == {"und"}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t, _ in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    letters = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    stages = dict(corpus_pipeline.STAGES)
    a = stages["language"](spark, docs, str(tmp_path))
    assert a.columns == docs.columns and sorted(map(key, (r.doc_id for r in a.collect()))) == sorted(key(r[0]) for r in letters)
    b = stages["near_dedup"](spark, a, str(tmp_path))
    near_ = brute_near([(r[0], r[1], "") for r in letters], 5)
    left = {i for i, c in near_.items() if i == c}
    assert b.columns == docs.columns and sorted(key(r.doc_id) for r in b.collect()) == sorted([key(i) for i in left] + [key(None)] * 2)
    c = stages["substring_dedup"](spark, b, str(tmp_path)).collect()
    cut = brute_repeats([(r.doc_id, r.text, r.text) for r in b.collect()], corpus_pipeline.PASSAGE_WORDS)
    before = {r.doc_id: r.text for r in b.collect() if r.doc_id is not None}
    for r in c:
        if r.doc_id is not None:
            _, removed, kept = cut[before[r.doc_id]]
            assert r.text == (kept if removed else before[r.doc_id])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    own = Tokenizer.from_file(WORDS)
    want = {key(r.doc_id, zlib.crc32(np.array([*own.encode(r.text, add_special_tokens=False).ids, 0][:2048], "<u4").tobytes())) for r in c}
    assert {key(r.doc_id, r.ids_crc32) for r in packed if r.piece == 0} == want
