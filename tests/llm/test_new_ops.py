"""Spelling variants, fingerprints and periodic runs against brute force, over nulls, odd texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from respondex.llm import periodic_runs, simhash, spelling
from tests.llm.test_ops import ODD, docs, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def single_edit(a, b):
    """Whether one inserted, deleted or replaced character makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, ratio=2):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if x != w and single_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best is not None and counts[best] >= ratio * n else None, n, len(near))
    full = {}
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        full[w] = (form, root, n, k, None if form is None else counts[form])
    return full


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("tile", [3, 10_000])
def test_variants_equal_brute_force(spark, tile):
    r = random.Random(tile)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(1, 8))) for _ in range(400)} | {"\U0001f642" * 5, "x" * 300, "x" * 299 + "y", "x" * 299}
    counts = {w: r.choice([3, 3, 4, 6, 9, 12, 50]) for w in words}
    got = as_dict(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), tile=tile))
    assert got == brute_variants(counts)
    assert any(x[0] is not None and x[1] != x[0] for x in got.values()) and any(x[3] == 0 for x in got.values())


def test_buffers_end_between_groups(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BUFFER", 7)
    words = {a + b + c + d + "z" for a in "ab" for b in "ab" for c in "abc" for d in "abc"}
    counts = {w: 3 + i for i, w in enumerate(sorted(words))}
    assert as_dict(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), tile=5)) == brute_variants(counts)


def test_words_of_the_contract(spark, tmp_path):
    r = random.Random(4)
    texts = [*ODD, *[" ".join(r.choice(["Hello", "hello", "hellos", "École", "école", "ecole", "ÉCOLE", "straße", "×mal÷", "日本hallo語", "wörld_world", "abcd"]) for _ in range(300)) for _ in range(40)]]
    d = docs(spark, texts)
    counts = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{i}:{run}".encode())
            k = h % len(run)
            w = run[:k] + run[k + 1 :] if h % 97 == 0 else run
            counts[w] += len(w) >= 5
    want = {w: n for w, n in counts.items() if n >= 3}
    assert {x["word"]: x["n"] for x in spelling.word_counts(d, change=spelling.spoiled).collect()} == want
    d.write.parquet(str(tmp_path / "documents.parquet"))
    assert as_dict(spelling.op11(spark, str(tmp_path))) == brute_variants(want)
    assert spelling.variants(spelling.word_counts(empty(spark))).count() == 0
    assert spelling.spoiled(None, "hello") == "hello"


def brute_fingerprint(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, limit):
    """rows: (id, fingerprint); the least id reachable over fingerprints, for each row."""
    points = sorted({f for _, f in rows})
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= limit:
                parent[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted([(i, f, least.get(find(f))) for i, f in rows], key=repr)


@pytest.mark.parametrize(("leaf", "block"), [(8192, 16384), (1, 16384), (4, 5)])
def test_fingerprint_links_equal_brute_force(spark, leaf, block):
    r = random.Random(leaf)
    base = [" ".join(r.choice("abcdefghij") for _ in range(60)) for _ in range(12)]
    near = [re.sub(r"\b\w", lambda m: r.choice("xyz") if r.random() < 0.03 else m[0], r.choice(base)) for _ in range(80)]
    texts = [*ODD, *base, *near, *near[:5], *[" ".join(r.choice("ABCDE") for _ in range(r.randrange(0, 4))) for _ in range(40)]]
    d = docs(spark, texts).unionByName(docs(spark, texts[:3]))
    rows = [(i, brute_fingerprint(t)) for i, t in [*enumerate(texts), *enumerate(texts[:3])]]
    got = simhash.NearDuplicates(d, leaf=leaf, block=block).components().collect()
    assert sorted([(x["id"], x["fp"] % (1 << 64), x["component"]) for x in got], key=repr) == brute_components(rows, 3)


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 4])
def test_pairs_meet_in_a_shard_of_any_tree(limit):
    r = np.random.default_rng(limit)
    points = r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, limit + 1), replace=False)) for _ in points], np.uint64)
    both = np.concatenate([points, points ^ flips])
    of, shards, odd = [set() for _ in both], 0, simhash.odd(both)
    for n, (tree, sides) in enumerate(simhash.joins(points[:800], len(both), limit, leaf=50)):
        shards += tree.shards
        for side, parity in enumerate(sides):
            at = np.flatnonzero(odd == bool(parity))
            index, shard = tree.shards_of(both[at], side)
            for i, s in zip(at[index].tolist(), shard.tolist()):
                of[i].add((n, s))
    assert all(of) and all(of[i] & of[i + len(points)] for i in range(len(points)))
    assert shards > 20 and sum(map(len, of)) < 0.4 * shards * len(both)  # branches are pruned


def test_forest_connects_what_links_connect(monkeypatch):
    monkeypatch.setattr(simhash, "ROWS", 7)
    monkeypatch.setattr(simhash, "HELD", 20)
    r = np.random.default_rng(5)
    x = np.unique(r.integers(0, 1 << 12, 300, dtype=np.uint64))
    for a, b in ((x, None), (x[:120], x[120:])):
        src, dst = simhash.forest(a, b, 1)
        links = [(int(p), int(q)) for p in a for q in (a if b is None else b) if p != q and (int(p) ^ int(q)).bit_count() <= 1]
        assert len(src) <= len(x)
        roots = []
        for pairs in (links, list(zip(src.tolist(), dst.tolist()))):
            at = {int(p): int(p) for p in x}
            for _ in range(20):
                for p, q in pairs:
                    at[p] = at[q] = min(at[p], at[q])
            roots.append(at)
        assert roots[0] == roots[1]


def test_fingerprints_of_empty_tables_and_null_ids(spark):
    assert simhash.NearDuplicates(empty(spark)).components().count() == 0
    d = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (5, "a b c d"), (None, "other words here now")], "doc_id long, text string")
    got = sorted((str(x["id"]), str(x["component"])) for x in simhash.NearDuplicates(d).components().collect())
    assert got == sorted([("None", "5"), ("7", "5"), ("5", "5"), ("None", "None")])


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = "the quick brown fox " * 900
    want = brute_fingerprint(text)
    monkeypatch.setattr(simhash, "COUNTED", 100)
    assert simhash.fingerprint(text) % (1 << 64) == want


def brute_runs(w, least=12):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i) + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def random_words(r):
    w, n = [], r.randrange(0, 140)
    while len(w) < n:
        piece = [r.choice("abcdefgh"[: r.choice([1, 2, 4, 8])]) for _ in range(r.randrange(1, 18))]
        w += piece * r.choice([1, 1, 2, 3, 6])
    return [x.encode() for x in w]


@pytest.mark.parametrize("least", [2, 5, 7, 12, 20, 33])
def test_runs_equal_brute_force(least):
    r = random.Random(least)
    for _ in range(120):
        texts = [random_words(r) for _ in range(r.randrange(1, 5))]
        assert periodic_runs.runs_of(texts, least) == [brute_runs(t, least) for t in texts]


def test_appending_in_any_steps_gives_the_same_runs():
    r = random.Random(8)
    for _ in range(60):
        w = random_words(r)
        c, at = periodic_runs.Catchers(12), 0
        ids = np.array([x[0] for x in w], np.int64)
        while at < len(w):
            step = r.choice([1, 1, 2, 9, 40])
            c.extend(ids[at : at + step])
            at += step
            assert list(zip(*(x.tolist() for x in c.runs()))) == brute_runs(w[:at])


def contract_words(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_of_the_contract(spark, tmp_path):
    r = random.Random(2)
    texts = [*ODD, "Row row row " * 9, *[b" ".join(random_words(r)).decode() for _ in range(120)], *[" ".join(str(r.randrange(500)) for _ in range(r.randrange(90))) for _ in range(80)]]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in periodic_runs.op13(spark, str(tmp_path)).collect()}
    planted = 0
    for i, t in enumerate(texts):
        w = contract_words(i, t)
        planted += w != re.findall("[^\x20\x09-\x0d]+", t or "")
        runs = brute_runs(w)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        s, n, p = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        x = got[i]
        assert (x["n_runs"], x["start"], x["length"], x["period"]) == (len(runs), s, n, p) and x["exponent_milli"] == (None if n is None else 1000 * n // p)
        assert x["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert x["collapsed_sha256"] == hashlib.sha256(" ".join(y for k, y in enumerate(w) if k not in gone).encode()).hexdigest()
    assert planted > 5
    assert periodic_runs.scan(empty(spark)).count() == 0 and periodic_runs.planted(None, [b"a"]) == [b"a"]
    twice = docs(spark, texts[:20]).unionByName(docs(spark, texts[:20]))
    assert periodic_runs.scan(twice).count() == 40
