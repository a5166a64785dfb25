"""Operators against brute force and libraries, over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from respondex.llm import bpe, decontaminate, html_text, jaccard_join, language, licenses, quality, rules, token_counts, url_filter

ODD = [None, "", " ", "\n\t ", "x", "<|endoftext|>", "a<|endoftext|> b", "日本語 текст ß İ \U0001f642 e\u0301", "THE the The " * 700, "a" * 5000, "don't we'll  \r\n\x1c\x85 1234 ½", "twice", "twice"]


def docs(spark, texts=ODD, **more):
    """Documents with columns that clash with what operators add."""
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", 1, "x", 2.0, [1]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, id string, score double, ids array<int>")


def empty(spark):
    return docs(spark, ["x"]).where("false")


def test_bpe_equals_library(spark):
    tok = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tok.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in bpe.encoded(docs(spark), texts=True).collect()}
    size = {r["doc_id"]: r for r in token_counts.token_counts(docs(spark)).collect()}
    for i, text in enumerate(ODD):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want and got[i]["decoded"] == t.decode(want, skip_special_tokens=False)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert (size[i]["n_tokens"], size[i]["n_bytes"]) == (len(want), len((text or "").encode()))
    assert bpe.encoded(empty(spark)).count() == token_counts.token_counts(empty(spark)).count() == 0


def test_frequent_pretokens_are_measured(spark, monkeypatch):
    tok = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tok.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["the theandore ededshhe " * 40, "theandore ededshhe qqzzq " * 30, None, "", "<|endoftext|> theandore", *ODD]
    d = docs(spark, texts)
    e = bpe.Encoder(bpe.tokenizer_file())
    words = token_counts.frequent(d, e, size=5)
    seen = Counter(w for x in texts if x for w in e.words(x))
    assert words == sorted(seen, key=lambda w: (-seen[w], w.encode()))[:5]
    assert max(len(x) for x in e.encode_all(words)) > 1  # not only entries of the vocabulary
    for frequent, kept in ((3, 2), (token_counts.FREQUENT, token_counts.KEPT)):
        monkeypatch.setattr(token_counts, "KEPT", kept)
        monkeypatch.setattr(token_counts, "FREQUENT", frequent)
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(d).collect()}
        assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    sizes = token_counts.Sizes(e, {"the": 1})
    for w in ("theandore", "ededshhe", "qqzzq", "the"):
        monkeypatch.setattr(token_counts, "KEPT", 1)
        sizes.learn({w})
        assert sizes[w] == len(e.encode_all([w])[0]) and "the" in sizes and len(sizes) <= 2


def test_bpe_random_texts():
    tok = pytest.importorskip("tokenizers")
    import public_tokenizers

    t, e, r = tok.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.Encoder(bpe.tokenizer_file()), random.Random(3)
    pool = ["a", "aa", "e", "the", "  ", " ", "\n", "\x85", "\u3000", "é", "ß", "中", "\U0001f642", "<|endoftext|>", "'s", "'", "12", "½", "_", "--", "\u0301", "\x00", "World"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(1, 30))) for _ in range(2000)]
    assert e.encode_all(texts) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def small_vocabulary(tmp_path):
    signs = {v: k for k, v in bpe.byte_signs().items()}
    vocab = {signs[b]: b for b in range(256)}
    merges = [["a", "b"], ["ab", "a"], ["b", "a"], ["a", "a"], ["aa", "b"], ["ba", "ba"], ["ab", "ab"]]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}, "added_tokens": []}))
    return str(tmp_path / "t.json"), merges


def test_trie_states_equal_merging(tmp_path):
    path, merges = small_vocabulary(tmp_path)
    e, r = bpe.Encoder(bpe.tokenizer_file(path)), random.Random(1)
    rank = {tuple(m): i for i, m in enumerate(merges)}

    def merged(word):
        parts = list(word)
        while True:
            best = min((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank) if any(p in rank for p in zip(parts, parts[1:])) else None
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]

    for _ in range(400):
        w = "".join(r.choice("aab") for _ in range(r.randrange(1, 14)))
        assert [e.vocabulary.bytes[i].decode() for i in e.encode_all([w])[0]] == merged(w)


def brute_windows(texts, items, window, share):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    out = {}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for name, item in items:
            x = words(item)
            n = min(window, len(x))
            for k in range(len(x) - n + 1 if x else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == x[k : k + n]:
                        hit.update(range(j, j + n))
                        if name is not None:
                            found.add(str(name))
        out[i] = (len(w), len(hit), sorted(found), bool(hit) and share * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [1, 7, 100000])
def test_decontamination_equals_brute_force(spark, block):
    r = random.Random(block)
    items = [(i if i else None, " ".join(r.choice("abcd") for _ in range(r.randrange(0, 9)))) for i in range(8)] + [(50, None), (51, ""), (52, "B, c!"), (53, "B, c!")]
    texts = [*ODD, *[" ".join(r.choice(["a", "B", "c", "d", "z"]) for _ in range(r.randrange(0, 40))) for _ in range(25)]]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["items"], x["contaminated"]) for x in decontaminate.scan(docs(spark, texts), b, window=4, block_words=block).collect()}
    want = brute_windows(texts, items, 4, 20)
    assert got == want
    kept = decontaminate.without_contaminated(docs(spark, texts), b, window=4, block_words=block)
    assert kept.columns == docs(spark).columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in want.items() if not x[3]}


def test_decontamination_of_repeated_documents_in_many_passes(spark):
    items = [(i, f"a{i} b c d e f g{i}") for i in range(12)]
    texts = ["x a3 b c d y", "a3 b c d", "b c d e f", None]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, texts).unionByName(docs(spark, texts))
    got = sorted((x["doc_id"], x["n_words"], x["n_hit"], x["items"]) for x in decontaminate.scan(d, b, window=4, block_words=5).collect())
    want = brute_windows(texts, items, 4, 20)
    assert got == sorted((i, *want[i][:3]) for i in range(4) for _ in range(2))


def test_decontamination_of_a_repetitive_item():
    words = [b"a"] * 3000
    automaton = decontaminate.SuffixAutomaton([("x", words)], 13)
    spans, found = automaton.hits(words)
    assert spans == [(0, 3000)] and found == {"x"}


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs(spark), none).where("n_hit > 0").count() == 0 and decontaminate.scan(empty(spark), none).count() == 0


def brute_jaccard(rows, size, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
        sets.setdefault(i, []).append(s)
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for a, (i, s) in enumerate(flat):
        for j, t in flat[:a]:
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in parent}


@pytest.mark.parametrize(("size", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 66, 3)])
def test_jaccard_join_equals_brute_force(spark, size, percent, seed):
    r = random.Random(seed)
    texts = list(ODD)
    for i in range(220):
        if i % 3 == 0:
            texts.append(" ".join(str(r.randrange(500)) for _ in range(r.choice([1, 2, 4, 9, 12, 15, 22, 31, 48, 70, 150]))))
        else:
            w = (r.choice(texts) or "q").split()[:400]
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                k = r.randrange(len(w) + 1)
                w = r.choice([w[:k] + w[k + 1 :], [*w[:k], "zz", *w[k:]], [*w, "q"], w[1:]])
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    sets, want = brute_jaccard(rows, size, percent)
    got = jaccard_join.JaccardJoin(docs(spark, texts), size=size, percent=percent).components().collect()
    assert {x["cid"]: x["component"] for x in got} == want
    assert {x["cid"]: x["n"] for x in got} == {i: len(s[0]) for i, s in sets.items()}
    kept = jaccard_join.one_of_each(docs(spark, texts), size=size, percent=percent)
    assert {x["doc_id"] for x in kept.collect()} == {i for i, c in want.items() if i == c} and kept.columns == docs(spark).columns


def test_jaccard_lists_of_a_shared_passage_are_short(spark):
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(80))
    texts = [" ".join(f"u{r.randrange(10**6)}" for _ in range(120)) + " " + passage for _ in range(300)] + [passage + f" {i}" for i in range(5)]
    join = jaccard_join.JaccardJoin(docs(spark, texts), size=3, percent=80)
    keys = join.keys(join.docs, join.boundary([(200, 300)]))
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] <= 12


def test_sketches_never_show_too_many_differences():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(300):
        a = r.integers(0, 2**63, r.integers(1, 3000)).astype(np.uint64)
        b = np.concatenate([a[: r.integers(0, len(a) + 1)], r.integers(0, 2**63, r.integers(0, 900)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if len(b):
            d = jaccard_join.differing(jaccard_join.sketch(a), jaccard_join.sketch(b))
            assert d <= len(np.setxor1d(a, b)) and d == jaccard_join.differing(jaccard_join.sketch(b), jaccard_join.sketch(a))
    assert jaccard_join.differing(jaccard_join.sketch(a), jaccard_join.sketch(a)) == 0


def test_jaccard_join_of_shared_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "v w x y z"), (7, "v w x y z"), (5, "v w x y z"), (None, "a b c d e"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["cid"] or -1, x["component"] or -1) for x in jaccard_join.JaccardJoin(df).components().collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (5, 1), (7, 1), (9, 9)]
    kept = [r["doc_id"] for r in jaccard_join.one_of_each(df).collect()]
    assert sorted(x or -1 for x in kept) == [-1, 1, 9]
    assert jaccard_join.JaccardJoin(df.where("false")).components().count() == 0


def test_jaccard_join_of_a_chain_in_one_list(spark):
    base = [str(i) for i in range(120)]
    texts = [" ".join([*base[: 120 - k], *[f"n{j}" for j in range(k)]]) for k in range(0, 60, 2)]
    rows = list(enumerate(texts))
    _, want = brute_jaccard(rows, 1, 90)
    got = jaccard_join.JaccardJoin(docs(spark, texts), size=1, percent=90).components().collect()
    assert {x["cid"]: x["component"] for x in got} == want and len(set(want.values())) == 1


@pytest.mark.parametrize("block", [1, 100000])
def test_spans_beyond_limits_are_cut(spark, block):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "É!")], "item_id long, text string")
    far = " ".join(f"w{i}" for i in range(200))
    texts = [None, "", f"ß, {far} ONE (two) three-four Five six; end É {far}", f"{far} two three four five {far}", "É one", f"É {far}"]
    got = {r["doc_id"]: r["text"] for r in decontaminate.without_spans(docs(spark, texts), items, window=4, longest=5, block_words=block).collect()}
    assert got == {0: None, 1: "", 2: f"ß, {far} ; end É {far}", 3: texts[3], 4: " one", 5: texts[5]}
    assert decontaminate.without_spans(docs(spark, texts), items).columns == docs(spark).columns
    assert decontaminate.without_spans(docs(spark, texts), items.where("false")).count() == len(texts)


def labelled(spark):
    r = random.Random(8)
    rows = []
    for i in range(120):
        lang = ["aa", "bb", "ru"][i % 3]
        syl = {"aa": ["tho", "ing", "ea"], "bb": ["que", "elle", "ou"], "ru": ["при", "вет", "мир"]}[lang]
        rows.append((i, " ".join("".join(r.choice(syl) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 60))), lang))
    return spark.createDataFrame([*rows, (900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")


def test_language(spark):
    table = language.learn(labelled(spark), "doc_id", "text", "lang")
    texts = ["tho ing eaing", "quelle ou que", "привет мир", "tho ing ea " * 20 + "que elle ou " * 8, None, "123 !!", "", "漢字"]
    got = {r["doc_id"]: r for r in language.identify(docs(spark, texts), table).collect()}
    assert [got[i]["lang_pred"] for i in range(7)] == ["aa", "bb", "ru", "aa", "und", "und", "und"]
    assert got[7]["lang_pred"] in table["langs"] and all(0 <= r["score"] <= 1 for r in got.values())
    spans = got[3]["spans"]
    assert [(s["start"], s["end"], s["lang"]) for s in spans] == [(0, 60, "aa"), (60, 84, "bb")]
    kept = language.with_language(docs(spark, texts), table)
    assert kept.columns == docs(spark).columns and {0, 1, 2, 3} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id in (4, 5, 6)").count() == 0


def test_language_without_labels(spark):
    table = language.learn(labelled(spark).where("false"), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in language.identify(docs(spark), table).collect()} == {"und"}


def test_viterbi_equals_enumeration():
    import numpy as np

    r = np.random.default_rng(5)
    for _ in range(200):
        s = -r.exponential(2.0, (r.integers(1, 6), 3))
        best = max(np.ndindex(*[3] * len(s)), key=lambda path: sum(s[i, x] for i, x in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:])))
        value = lambda path: sum(s[i, x] for i, x in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        assert value(language.viterbi(s, 1.5)) == pytest.approx(value(best))


def test_viterbi_is_exact_on_many_draws():
    import numpy as np

    r = np.random.default_rng(9)
    paths = {n: np.array(list(np.ndindex(*[3] * n))) for n in range(1, 6)}
    for i in range(20_000):
        n, penalty = int(r.integers(1, 6)), float(r.choice([1.0, 3.0, 12.0]))
        s = -r.exponential(penalty * r.choice([0.3, 0.6, 1.0]), (n, 3)) * (r.random((n, 3)) < 0.8)
        p = paths[n]
        values = s[np.arange(n), p].sum(axis=1) - penalty * (np.diff(p, axis=1) != 0).sum(axis=1)
        got = language.viterbi(s, penalty)
        assert s[np.arange(n), got].sum() - penalty * np.count_nonzero(np.diff(got)) == pytest.approx(values.max()), i


def test_language_counts_do_not_depend_on_tasks(spark, monkeypatch):
    import numpy as np

    one = language.learn(labelled(spark).coalesce(1), "doc_id", "text", "lang")
    monkeypatch.setattr(language, "MAX_COUNTED", 10)
    many = language.learn(labelled(spark).repartition(7), "doc_id", "text", "lang")
    assert one["grams"] == many["grams"] and np.allclose(np.vstack(one["logp"]), np.vstack(many["logp"]))
    assert language.identify(empty(spark), one).count() == 0
    twice = docs(spark, ["tho ing", "tho ing"]).withColumn("doc_id", F.lit(1))
    assert [r["lang_pred"] for r in language.identify(twice, one).collect()] == ["aa", "aa"]


def test_viterbi_with_a_compromise_label():
    import numpy as np

    s = np.array([[0.0, -30.0, -10.0], [-30.0, 0.0, -10.0]])
    assert list(language.viterbi(s, 12.0)) == [0, 1]
    r = np.random.default_rng(8)
    for _ in range(300):
        s = -np.abs(r.choice([0, 10, 30], (r.integers(1, 6), 3), p=[0.3, 0.5, 0.2]) + r.random((1, 3)))
        value = lambda path: sum(s[i, x] for i, x in enumerate(path)) - 12.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        assert value(language.viterbi(s, 12.0)) == pytest.approx(max(map(value, np.ndindex(*[3] * len(s)))))


def test_small_language_keeps_its_rows_and_ngrams(spark, monkeypatch):
    r = random.Random(12)
    words = lambda signs, n: " ".join("".join(r.choice(signs) for _ in range(5)) for _ in range(n))
    rows = [(i, words("abcdefghij", 20), "big") for i in range(400)] + [(1000 + i, words("qrs", 6), "small") for i in range(8)]
    monkeypatch.setattr(language, "MAX_GRAMS", 60)
    table = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", max_rows=40)
    assert table["langs"] == ["big", "small"] and sum(set(g) <= set(" qrs") for g in table["grams"]) >= 30
    assert language.even_share([400, 8], 40) == 32 and language.even_share([5, 5], 40) == 5 and language.even_share([], 3) == 0


def test_quality(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeiou") + r.choice("bdlmnrst") for _ in range(r.randrange(1, 4)))
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        rows.append((i, " ".join(word() if good else word().upper() + "!!" for _ in range(r.randrange(20, 80)))))
        labels.append((i, int(good), "clash"))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 0, "again"), (5000, None, ""), (None, 1, "")], "doc_id long, quality int, text string")
    model = quality.learn(d.where("doc_id < 240"), y)
    got = {x["doc_id"]: x["score"] for x in quality.scores(d, model).collect()}
    assert sum((got[i] >= 0.7) == (i % 3 > 0) for i in range(240, 300)) >= 57
    odd = quality.scores(docs(spark), model).collect()
    assert len(odd) == len(ODD) and all(0 <= x["score"] <= 1 for x in odd)
    kept = quality.good(docs(spark), model)
    assert kept.columns == docs(spark).columns
    one = quality.learn(d, y.where("quality = 1"))
    assert {x["score"] for x in quality.scores(d, one).collect()} == {1.0}
    assert {x["score"] for x in quality.scores(d, quality.learn(empty(spark), y)).collect()} == {0.5}


def test_quality_calibration_and_features():
    import numpy as np

    r = np.random.default_rng(3)
    z = r.normal(0, 2, 6000)
    y = (r.random(6000) < 1 / (1 + np.exp(-z))).astype(float)
    temperature, offset = quality.calibration(2 * z + 3, y)
    assert temperature == pytest.approx(2, abs=0.25) and offset == pytest.approx(-3, abs=0.4)
    # the whole fit: classes of unequal share, scores of unseen rows are right on average in each tenth
    x = r.normal(0, 1, (8000, 6))
    chance = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] + 1.5)))
    y = (r.random(8000) < chance).astype(float)
    net = quality.fit(x[:5000], y[:5000], np.arange(5000) % 5 == 0)
    p = quality.probabilities(x[5000:], net)
    bins = np.minimum((p * 10).astype(int), 9)
    error = sum(abs(p[bins == b].mean() - y[5000:][bins == b].mean()) * np.mean(bins == b) for b in set(bins.tolist()))
    assert error < 0.05
    n1 = np.tanh(((x[:1] - net["mean"]) / net["std"]) @ net["p"][0] + net["p"][1])
    assert quality.probabilities(x[:1], net)[0] == pytest.approx(1 / (1 + np.exp(-((n1 @ net["p"][2] + net["p"][3])[0] + net["offset"]) / net["temperature"])))
    # pooled vectors by plain loops
    vectors, terms, text = r.normal(0, 1, (quality.BUCKETS, quality.DIM)), quality.Terms(), "The cat! the cat sat 12x a1b2c3d4e5f6g7"
    got = quality.pooled([text, None], terms, vectors)
    tokens = text.split()
    w = np.array([vectors[quality.bucket("w" + t.strip("!").lower())] for t in tokens])
    s = np.array([vectors[quality.bucket("s" + quality.shape(t))] for t in tokens])
    want = np.concatenate([w.mean(axis=0), w.std(axis=0), s.mean(axis=0), s.std(axis=0), [1, 0, np.log1p(7) / 10]])
    assert np.allclose(got[0], want) and not got[1].any()
    assert quality.shape("a1b2c3d4e5f6g7") != quality.shape("a1b2c3d4e5f6!!") and quality.shape("The!!") == "Ul!"


def test_quality_of_repeated_and_no_documents(spark):
    rows = [(i % 20, f"word{i % 20} and more", "x") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    y = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = quality.learn(d, y, max_rows=20)
    assert quality.scores(d, model).count() == 200 and quality.scores(d.where("false"), model).count() == 0 and quality.good(d.where("false"), model).count() == 0


def test_url_filter(spark):
    urls = ["http://A.Example.org/es/1", "https://example.org/en/12", "http://x.org", "http://x.org/", "http://b.com/de/x", "http://b.com/fr/", "http://bad.net/p?b=2&a=1&utm_source=q#f", "https://www.BAD.net:443/p/?a=1&b=2", "http://good.net/p", "http://notorg/", "http://myexample.org/es/", None, "", "nothing", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(99, urls[6])], "page_id long, url string").withColumn("rule", F.lit("clash"))
    listed = spark.createDataFrame([("http://bad.net/p?a=1&b=2",), (None,), ("nothing",)], "url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages, listed).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
    assert got[2] == ("x.org", "", None, "allow") and got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/de/", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6] == ("bad.net", "/p", None, "block") and got[7][2:] == (None, "block") and got[99][3] == "block" and got[8][3] == "allow" and got[9][2] is None
    assert got[10][2] == "org/" and got[11] == got[12] == got[13] == ("", "", None, "allow") and got[14] == ("b:", "//c/d", None, "allow")
    assert url_filter.judged(pages, listed.where("false")).where("listed").count() == 0 and url_filter.judged(pages.where("false"), listed).count() == 0


def test_bloom_passes_every_listed_url(spark):
    urls = spark.range(3000).select(F.concat(F.lit("http://h.net/"), "id").alias("url"))
    pages = urls.withColumn("page_id", F.monotonically_increasing_id()).unionByName(spark.range(3000).select(F.concat(F.lit("http://o.net/"), "id").alias("url"), (F.lit(10**6) + F.col("id")).alias("page_id")))
    got = url_filter.judged(pages, urls, [])
    assert got.where("verdict = 'block'").count() == 3000 and got.where("verdict = 'block' AND host <> 'h.net'").count() == 0


def test_bloom_blocks_pass_few_others(spark):
    listed = spark.range(4000).select(F.concat(F.lit("h.net/"), "id").alias("c"))
    blocks = -(-4000 * url_filter.BITS // url_filter.BLOCK)
    others = spark.range(40_000).select(F.concat(F.lit("o.net/x"), "id").alias("c"))
    probe = others.select(url_filter.block(F.col("c"), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(url_filter.masks(F.col("c")))]).join(url_filter.bloom(listed, blocks), "block")
    passed = probe.where(" AND ".join(f"(w{i} & m{i}) = m{i}" for i in range(4))).count()
    assert passed / 40_000 < 0.01


def test_url_filter_with_a_large_list(spark, monkeypatch):
    urls = [f"http://h{i % 7}.net/{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 2)] + [(9999, None)], "page_id long, url string")
    listed = spark.createDataFrame([(u,) for u in urls[::3]], "url string")
    got = []
    for n in (500_000, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", n)
        got.append({r["page_id"]: tuple(r)[1:] for r in url_filter.judged(pages, listed).collect()})
    assert got[0] == got[1] and {i for i, r in got[0].items() if r[3] == "block"} == {i for i in range(600) if i % 300 % 3 == 0}


def base_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(win)
    covered = {j for i, x in enumerate(win) if many[x] >= 2 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_rules(spark):
    r = random.Random(6)
    plain = [" ".join(r.choice(["the", "of", "and", "house", "water", "was", "in", "garden"]) + r.choice(["", "", ","]) for _ in range(90)) for _ in range(30)]
    texts = [*ODD, "a b c a b c x a b c", "l\nl\n\n \nl\nm", "# $ # |x|", *plain, " ".join(f"%%%{i}###" for i in range(80))]
    got = {x["doc_id"]: x for x in rules.judged(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == base_counts(t), t
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"])
        assert not (x["base_failed"] and x["kept"])
    assert not got[len(texts) - 1]["kept"] and not got[len(texts) - 1]["base_failed"]
    assert rules.judged(empty(spark)).count() == 0 and rules.judged(docs(spark), lang_col=None).count() == len(ODD)


def test_small_languages_have_references(spark, monkeypatch):
    texts = [("en", "the cat of the house and a dog ")] * 6 + [("fr", "le chat de la maison et un ami ")] * 2 + [(None, "the le x ")]
    df = spark.createDataFrame([(i, t * 10, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    got = []
    for n in (200, 1):
        monkeypatch.setattr(rules, "LANGUAGES", n)
        got.append({r["doc_id"]: (r["js_chars"], r["js_words"], r["kept"]) for r in rules.judged(df).collect()})
    assert got[0] == got[1] and got[0][6][1] == pytest.approx(0, abs=1e-6) and got[0][8][1] > 0


def test_js_distances_equal_python(spark):
    from math import log2, sqrt

    texts = ["the cat of the house and a dog " * 10, "The dog! Of 12 cats & the é house " * 9, "zz zz zz"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    classes = ["a-z", r"\x20\x09-\x0D", r"^\x00-\x7F", "A-Z", "0-9", r".,;:!?'\"()\-"]

    def chars(t):
        n = [len(re.findall(f"[{c}]", t)) for c in classes]
        return [*n, len(t) - sum(n)]

    words = [re.findall(r"[^\W\d_]+", t.lower()) for t in texts]
    total = Counter(w for ws in words for w in ws)
    top = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[: rules.COMMON]]
    n_all = sum(map(len, words))
    ref_c = [sum(x) / sum(map(len, texts)) for x in zip(*map(chars, texts))]
    ref_w = [total[w] / n_all for w in top]

    def js(p, q):
        part = lambda x, m: x * log2(x / m) if x > 0 else 0.0
        return sqrt(sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q)) / 2)

    for x in rules.judged(df).collect():
        t, w = texts[x["doc_id"]], words[x["doc_id"]]
        p = [w.count(v) / len(w) for v in top]
        assert x["js_chars"] == pytest.approx(js([c / len(t) for c in chars(t)], ref_c))
        assert x["js_words"] == pytest.approx(js([*p, max(0, 1 - sum(p))], [*ref_w, max(0, 1 - sum(ref_w))]), abs=1e-6)


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><header><p>Site name</p></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Big &amp; title</h1><p><b>First   line<br>goes on.<p>Second &lt;x&gt; line of the story, long enough to read.</p></article><div class='comments'><div class=comment><p>I like this a lot.</p></div></div><footer>&copy; me</footer></body>"
    pages = spark.createDataFrame([(0, "u", page, "clash"), (1, None, None, ""), (2, "u", "", ""), (3, "u", "<", ""), (4, "u", "<p>" * 3000 + "x", "")], "page_id long, url string, html string, text string")
    model = html_text.learn(pages)
    got = {r["page_id"]: r["text"] for r in html_text.extracted(pages, model).collect()}
    assert got[0] == "Big & title\n\nFirst line goes on.\n\nSecond <x> line of the story, long enough to read."
    assert got[1] == got[2] == "" and len(got) == 5
    wrong = 0
    for seed in range(9000, 9100):
        source, blocks = html_text.generated(seed)
        wrong += model.text(source).split("\n\n") != blocks
    assert wrong <= 5


HIDDEN = {
    "<p>We found <a title='the hidden cost' href='#'>LINKTEXT</a> and <em title='a hidden gem of the town'>THE OLD MILL</em> by the river.</p>": ["We found LINKTEXT and THE OLD MILL by the river."],
    "<p>Open <span style='display:none'><span>a</span>SECRET</span>and shut.</p>": ["Open and shut."],
    "<p>One <b data-x='display: none' alt=aria-hidden=true>two</b> <i hidden>no <b>deep</b> no</i>three <s aria-hidden=\"TRUE\">four</s><u aria-hidden=false>five</u>.</p>": ["One two three five."],
    "<p>Left <span hidden>gone <i>and gone</p><p>Right <span style='color:red; DISPLAY : none'>gone<p>Next.</p>": ["Left", "Right", "Next."],
    "<p>Raw <span hidden><script>var s = '</span>';</script>gone</span>stays <br hidden>here <img hidden>too.</p>": ["Raw stays here too."],
    "<p>Quoted <span title=\"a > b\" hidden>x <a title='</span>'>y</a> z</span>end.</p>": ["Quoted end."],
    "<p>To the end <span hidden>of the page": ["To the end"],
}


def test_hidden_text_of_pages():
    for source, blocks in HIDDEN.items():
        assert [t for t in html_text.Page(source).text if t] == blocks, source
    said = html_text.attributes(" Class='post body' data-class=ad hidden ID = x class=no href=/a?b=1/ title='id=\"y\"'")
    assert said == {"class": "post body", "data-class": "ad", "hidden": "", "id": "x", "href": "/a?b=1/", "title": 'id="y"'}
    assert html_text.hides({"style": "a:b;display:none"}) and not html_text.hides({"style": "x-display:none", "class": "hidden"})
    model = html_text.fitted([])
    # no page marks its article; what is content was written by hand
    paragraph = "It was a long walk along the river, and nobody had expected the rain to last until the evening."
    page = f"<body><div class=menu><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></div><div class=post><h1>A walk</h1><p>{paragraph}</p><p hidden>{paragraph} Not shown.</p><div aria-hidden='true'><p>{paragraph} Nor this.</p></div><p>Then the sun came out, and <a title='hidden path' href=#>the path</a> dried within an hour or so.</p></div><div class=footer>&copy; us</div></body>"
    assert model.text(page).split("\n\n") == ["A walk", paragraph, "Then the sun came out, and the path dried within an hour or so."]


def test_html_without_caps(spark):
    model = html_text.fitted([])
    long = '<article><h1>A title</h1><p>Before <img alt="' + "x" * 9000 + '"><img alt=' + "y" * 9000 + "> after it, as one would write.</p></article>"
    formula = "<article><p>The formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds in <svg><title>no</title><text>all</text></svg> cases.</p><p>See <object>the object</object> and <video><source src=v>the film</video>.</p></article>"
    texts = [model.text(x) for x in (long, formula)]
    assert texts[0].endswith("Before after it, as one would write.") and "xx" not in texts[0] and "yy" not in texts[0]
    assert "The formula x=2 holds in all cases." in texts[1] and "See the object and the film." in texts[1]
    quote = '<article><p>Some words <a title="no end>of a line</a> that goes on.</p></article>'
    assert [t for t in html_text.Page(quote).text if t] == ["Some words of a line that goes on."]
    many = "<article>" + "".join(f"<p>Sentence number {i} of a long page, which goes on.</p>" for i in range(4000)) + "</article>"
    assert model.text(many).count("Sentence number") == 4000
    pages = spark.createDataFrame([(1, "u", long, "clash", 2), (1, "u", long, "clash", 2)], "page_id long, url string, html string, text string, h int")
    assert [r["text"] for r in html_text.extracted(pages, model).collect()] == [texts[0]] * 2
    assert html_text.extracted(pages.where("false"), html_text.learn(pages.where("false"))).count() == 0


def article_text(source):
    """The article by a plain parser: its blocks, without what its own marks set apart."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.blocks, self.run = [], [], []

        def flush(self):
            text = " ".join("".join(self.run).split())
            self.blocks += [text] if text else []
            self.run = []

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "img", "input"):
                self.run.append(" ")
            elif tag not in html_text.INLINE:
                self.flush()
            if tag not in html_text.VOID:
                named = set(re.findall("[a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()))
                self.open.append((tag, tag in html_text.APART or bool(named & {"ad", "ads", "comment", "comments", "share", "sidebar"})))

        def handle_endtag(self, tag):
            if tag not in html_text.INLINE:
                self.flush()
            if tag in [t for t, _ in self.open]:
                while self.open.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if any(t == "article" for t, _ in self.open) and not any(a for _, a in self.open) and self.open[-1][0] not in ("script", "style"):
                self.run.append(data)

    p = P()
    p.feed(source or "")
    p.flush()
    return "\n\n".join(p.blocks)


def test_html_of_all_pages(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.op7(spark, "/root/testdata/sf0.001").collect()}
    want = {r["page_id"]: article_text(r["html"]) for r in pages.collect()}
    assert got.keys() == want.keys() and [i for i in want if got[i] != want[i]] == []


def test_marginals_equal_enumeration():
    from itertools import product
    from math import exp

    page = html_text.Page("<div class=post><p>One line here.</p><ul><li><a>x</a></li></ul></div><footer>f</footer>")
    model = html_text.fitted([])
    n = len(page.parent)
    feats = [[]] + [page.features(i) for i in range(1, n)]
    total, on = 0.0, [0.0] * n
    for y in product((0, 1), repeat=n):
        e = sum(model.odds.get(f, 0.0) * y[i] for i in range(1, n) for f in feats[i])
        e += sum(model.pair["e" if page.text[i] is None else "l"][y[page.parent[i]]][y[i]] for i in range(1, n))
        w = exp(e)
        total += w
        for i in range(n):
            on[i] += w * y[i]
    assert model.marginals(page) == pytest.approx([x / total for x in on], abs=1e-9)


def test_wrapped_headers_and_full_licenses(spark):
    import os
    import textwrap

    def wrapped(text, mark=""):
        return "\n".join(mark + x for x in textwrap.wrap(text, 70))

    mit, bsd = [wrapped(x) for x in licenses._MIT], [wrapped(x) for x in licenses._BSD]
    gpl = licenses._GPL.format("General Public License", 3)
    rows = {
        "MIT": ["x = 1\n" + wrapped(licenses._MIT[0], "# ") + "\nimport os\n", "Copyright (c) 2020 Some One\n\n" + "\n\n".join(mit), "Some prose\nof two lines\n" + mit[0] + "\nand more prose\nbelow"],
        "BSD-3-Clause": ["Copyright (c) 2020, Some One\n\n" + "\n\n".join(bsd)],
        "GPL-3.0": ["/*\n" + wrapped(gpl, " * ") + "\n */\nint x;"],
        "MPL-2.0": [wrapped(licenses._LONG["MPL-2.0"][0], "// ")],
    }
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("GPL-2.0", "GPL-2"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(f"/usr/share/common-licenses/{file}"):
            with open(f"/usr/share/common-licenses/{file}") as f:
                rows.setdefault(name, []).append(f.read())
    want = [(name, t) for name, ts in rows.items() for t in ts]
    plain = ["we need permission\nto go\nout to the garden", "the terms of the house\nare few and old"]
    df = spark.createDataFrame([(i, f"d{i}/LICENSE" if len(t) > 900 else f"d{i}/f.txt", t) for i, t in enumerate([t for _, t in want] + plain)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["own_license"] for r in licenses.scanned(df, "doc_id", "path", "text").collect()}
    assert [got[i] for i in range(len(want) + 2)] == [name for name, _ in want] + [None, None]


def test_full_texts_identifiers_and_shared_sentences(spark):
    full = {"MIT": licenses._MIT, "BSD-3-Clause": licenses._BSD, "BSD-2-Clause": licenses._BSD[:2] + licenses._BSD[3:], "ISC": licenses._ISC, "Zlib": licenses._ZLIB, "Unlicense": licenses._UNLICENSE}
    wrapped = lambda x, mark="": "\n".join(mark + " ".join(x.split()[i : i + 11]) for i in range(0, len(x.split()), 11))
    rows, want = [], {}
    for name, parts in full.items():
        for path, text in ((f"f/{name}/LICENSE", "Copyright (c) 2020 Some One\n\n" + "\n\n".join(map(wrapped, parts))), (f"h/{name}/a.c", wrapped("Copyright 2019 Some One. " + " ".join(parts), " * ") + "\n\nint main() {}\n")):
            want[len(rows)] = name
            rows.append((len(rows), path, text))
    for name in licenses.TEMPLATES:
        if name != "Proprietary":
            want[len(rows)] = name
            rows.append((len(rows), f"s/{name}/x.py", f"# SPDX-License-Identifier: {name}\nimport os\n"))
    for text in ("/* This program and the accompanying materials are made available under the\n * terms of the Eclipse Public License v. 2.0 which is available at\n * https://www.eclipse.org/legal/epl-2.0 */", "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED"):
        want[len(rows)] = "EPL-2.0"
        rows.append((len(rows), "e/LICENSE", text))
    want[len(rows)] = None
    rows.append((len(rows), "n/LICENSE", licenses._BSD[0] + "\n\nOnly for friends of the house, and on Sundays."))
    got = {r["doc_id"]: r["own_license"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id", "path", "text").collect()}
    assert got == want


def test_inheritance_equals_brute_force(spark):
    r = random.Random(17)
    said = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", None: "nothing of the kind"}
    rows = []
    for i in range(150):
        d = "/".join(r.choice("abc") for _ in range(r.randrange(0, 5)))
        name = r.choice(["LICENSE", "COPYING.txt", "x.py", "y.md", "z.c", "w.h"])
        rows.append((i, f"{d}/{name}" if d else name, said[r.choice(["MIT", "Apache-2.0", None, None])]))
    own = {i: next((k for k, v in said.items() if v == t), None) for i, _, t in rows}
    at = {}
    for i, path, _ in rows:
        d, _, name = path.rpartition("/")
        if re.match(licenses.FILE_NAMES, name) and own[i]:
            at.setdefault(d, set()).add(own[i])
    want = {}
    for i, path, _ in rows:
        d = path.rpartition("/")[0]
        up = [x for x in [d, *["/".join(d.split("/")[:k]) for k in range(len(d.split("/")) - 1, 0, -1)], ""] if x in at]
        want[i] = own[i] or (min(at[up[0]]) if up else None)
    got = {x["doc_id"]: x["license"] for x in licenses.scanned(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id", "path", "text").collect()}
    wrong = {i for i in want if got[i] != want[i]}
    # of two licence files in one directory the better cosine wins, which the brute force doesn't know
    assert all(len(at.get(d, ())) > 1 for i in wrong for d in [max((x for x in at if (rows[i][1].rpartition("/")[0] + "/").startswith(x + "/" if x else "")), key=len)])
    assert len(wrong) < 40 and sum(x is not None for x in want.values()) > 60


def test_license_versions_identifiers_and_cosines(spark):
    prose = "the garden of the house was in the water and it was the year of the king\n" * 3
    notice = "Licensed under the Apache License, Version 2.0."
    rows = {0: "Licensed under the Apache License, Version 1.1.", 1: "# SPDX-License-Identifier: MIT", 2: "// SPDX-License-Identifier: BSD-3-Clause\nint x;", 3: "SPDX-License-Identifier: GPL-3.0-or-later", 4: "SPDX-License-Identifier: WTFPL", 5: prose * 400 + notice, 6: prose, 7: notice, 8: notice}
    df = spark.createDataFrame([(i if i < 8 else 7, f"x/f{i}.c", t) for i, t in rows.items()], "doc_id long, path string, text string")
    got = sorted((r["doc_id"], r["own_license"] or "") for r in licenses.scanned(df, "doc_id", "path", "text").collect())
    assert got == [(0, ""), (1, "MIT"), (2, "BSD-3-Clause"), (3, "GPL-3.0"), (4, ""), (5, "Apache-2.0"), (6, ""), (7, "Apache-2.0"), (7, "Apache-2.0")]
    # every line and block against every template by plain cosines: the trigger words lose none
    r = random.Random(4)
    scanner = licenses.Scanner(50, {w: r.randrange(0, 40) for w in licenses.VOCABULARY})
    pool = [licenses.tokens(t) for group in licenses.TEMPLATES.values() for t in group]
    for _ in range(400):
        w = list(r.choice(pool))
        for _ in range(r.randrange(0, 6)):
            k = r.randrange(len(w))
            w = r.choice([w[:k] + w[k + 1 :] or w, [*w[:k], r.choice(["zz", "the", "of"]), *w[k:]]])
        line = " ".join(w)
        v = scanner.vector(line)
        cosines = [(-round(sum(x * v.get(y, 0) for y, x in t.items()), 9), name) for name, t, need in scanner.templates if need <= set(v)]
        best = min(cosines, default=(0, None))
        if -best[0] >= licenses.LEAST:
            assert scanner.best(line, False) == (best[1], -best[0])
        else:
            assert scanner.best(line, False)[1] < licenses.LEAST


def test_licenses(spark):
    rows = [
        (0, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (1, "a/b/c/f.txt", "plain text"), (2, "a/b/LICENSE.md", "Released under the MIT License."), (3, "a/b/g.txt", None),
        (4, "z/h.txt", "first line\nLicensed under CC BY-NC 4.0.\nmore"), (5, "z/i.txt", ""), (6, None, "This work is licensed under the GNU General Public License, version 3."), (7, "top.txt", "licence of my own making, ask me about it first"), (8, "ab/f.txt", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("score", F.lit("clash")).withColumn("dir", F.lit("clash"))
    got = {r["doc_id"]: (r["own_license"], r["license"], r["license_dir"]) for r in licenses.scanned(df, "doc_id", "path", "text").collect()}
    assert got == {0: ("Apache-2.0", "Apache-2.0", None), 1: (None, "MIT", "a/b"), 2: ("MIT", "MIT", None), 3: (None, "MIT", "a/b"), 4: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 5: (None, None, None), 6: ("GPL-3.0", "GPL-3.0", None), 7: (None, None, None), 8: (None, None, None)}
    assert licenses.scanned(df.where("false"), "doc_id", "path", "text").count() == 0
