"""The learned operators and pipeline stages against plain Python: counts, scores, predictions, sums of contexts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash

from respondex.llm import language, quality
from tests.llm.test_ops import docs


def brute_table(rows):
    """(languages, log-probabilities by language, log-probability of what no language has, languages of scripts)."""
    counts, scripts = {}, {}
    for text, lang in rows:
        if lang is None:
            continue
        counts.setdefault(lang, Counter())
        for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower()):
            padded = " " + w + " "
            for i in range(len(padded) - 2):
                counts[lang][padded[i : i + 3]] += 1
            if 2 <= len(w) <= 5:
                counts[lang][padded] += 1
            scripts.setdefault(lang, Counter())[next(s for a, s in reversed(language.SCRIPTS) if ord(w[0]) >= a)] += 1
    langs = sorted(k for k, c in counts.items() if c)
    known = {g for c in counts.values() for g in c}
    total = {k: sum(counts[k].values()) for k in langs}
    logp = {g: [math.log((counts[k][g] + 0.5) / (total[k] + 0.5 * (len(known) + 1))) for k in langs] for g in known}
    unseen = math.log(0.5 / (max(total.values()) + 0.5 * len(known)))
    allowed = {}
    for k in langs:
        for s, n in scripts[k].items():
            if n >= 0.01 * sum(scripts[k].values()):
                allowed.setdefault(s, set()).add(k)
    return langs, logp, unseen, allowed


def brute_language(text, table, penalty=language.PENALTY):
    langs, logp, unseen, allowed = table
    words = regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())
    if not words:
        return "und", 0.0
    rows = []
    for w in words:
        padded = " " + w + " "
        grams = [padded[i : i + 3] for i in range(len(padded) - 2)] + ([padded] if 2 <= len(w) <= 5 else [])
        s = [sum(logp[g][j] if g in logp else unseen for g in grams) for j in range(len(langs))]
        of = allowed.get(next(x for a, x in reversed(language.SCRIPTS) if ord(w[0]) >= a))
        if of:
            s = [x if k in of else -math.inf for x, k in zip(s, langs)]
        rows.append([max(x - max(s), -50.0) for x in s])
    # the best labelling, by all labels of each word given those of the word before
    best, back = list(rows[0]), []
    for s in rows[1:]:
        from_ = [max(range(len(langs)), key=lambda i: best[i] - penalty * (i != j)) for j in range(len(langs))]
        back.append(from_)
        best = [best[from_[j]] - penalty * (from_[j] != j) + s[j] for j in range(len(langs))]
    path = [max(range(len(langs)), key=best.__getitem__)]
    for from_ in reversed(back):
        path.append(from_[path[-1]])
    path.reverse()
    letters = Counter()
    for w, j in zip(words, path):
        letters[j] += len(w)
    top = max(range(len(langs)), key=lambda j: letters[j])
    mine = [s for s, j in zip(rows, path) if j == top]
    odds = [sum(s[j] for s in mine) / math.sqrt(len(mine)) for j in range(len(langs))]
    return langs[top], letters[top] / sum(letters.values()) / sum(math.exp(o - odds[top]) for o in odds)


def language_rows():
    r = random.Random(21)
    pools = {"en": ["the", "house", "and", "thing", "with", "water", "a"], "fr": ["le", "maison", "et", "chose", "avec", "été", "à"], "ru": ["дом", "и", "вода", "город"]}
    texts = [(" ".join(r.choice(pools[k]) for _ in range(r.randrange(1, 30))), k) for k in pools for _ in range(12)]
    mixed = [" ".join(r.choice(pools[k]) for k in [r.choice(list(pools))] * 9 + [r.choice(list(pools))] * 9) for _ in range(20)]
    noise = ["qzx wvk jjj", "The WATER!", "été", "word дом maison", "日本 the", None, "", "12 %%", "Ünïted thing"]
    return texts + [(t, None) for t in mixed + noise]


def test_language_predictions_equal_brute_force(spark):
    rows = language_rows()
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    table, plain = language.learn(df, "doc_id", "text", "lang"), brute_table(rows)
    assert table["langs"] == plain[0] == ["en", "fr", "ru"] and set(table["grams"]) == set(plain[1])
    for g, logp in zip(table["grams"], table["logp"]):
        assert list(logp) == pytest.approx(plain[1][g])
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.identify(df, table).collect()}
    want = {i: brute_language(t, plain) for i, (t, _) in enumerate(rows)}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-9) for i in want)
    assert len({x[0] for x in want.values()}) == 4 and any(0 < x[1] < 0.6 for x in want.values())
    kept = {x["doc_id"] for x in language.with_language(df, table).collect()}
    assert kept == {i for i, (k, s) in want.items() if k != "und" and s >= 0.2}


def brute_vectors(texts):
    """Unit vectors of the hashed terms: for each, the sum of index vectors of the terms near its places, by loops."""

    def terms(token):
        letters = token.strip("!?.,;:%$#&*|\"'()[]").lower()
        return xxhash.xxh3_64_intdigest(("w" + letters).encode()) % quality.BUCKETS, xxhash.xxh3_64_intdigest(("s" + quality.shape(token)).encode()) % quality.BUCKETS

    def index(term):
        v = [0.0] * quality.DIM
        for k in range(quality.SPARSE):
            h = xxhash.xxh3_64_intdigest(f"{term}/{k}".encode())
            v[h % quality.DIM] += 1 if h >> 63 else -1
        return v

    sums = {}
    for text in texts:
        both = [terms(t) for t in (text or "").split()]
        for i in range(len(both)):
            for j in range(max(0, i - quality.NEAR), min(len(both), i + quality.NEAR + 1)):
                if i != j:
                    for near in both[j]:
                        v = index(near)
                        for mine in both[i]:
                            old = sums.setdefault(mine, [0.0] * quality.DIM)
                            for d in range(quality.DIM):
                                old[d] += v[d]
    out = np.zeros((quality.BUCKETS, quality.DIM))
    for t, v in sums.items():
        out[t] = np.array(v) / (math.sqrt(sum(x * x for x in v)) + 1e-6)
    return out, terms


def brute_features(text, vectors, terms):
    both = [terms(t) for t in (text or "").split()]
    n, tokens = len(both), (text or "").split()
    if not n:
        return [0.0] * (4 * quality.DIM + 3)
    out = []
    for side in (0, 1):
        rows = [vectors[b[side]] for b in both]
        mean = [sum(r[d] for r in rows) / n for d in range(quality.DIM)]
        out += mean + [math.sqrt(max(0.0, sum(r[d] ** 2 for r in rows) / n - mean[d] ** 2)) for d in range(quality.DIM)]
    return [*out, len(set(tokens)) / n, sum(a[0] == b[0] for a, b in zip(both, both[1:])) / n, math.log1p(n) / 10]


def test_quality_scores_equal_brute_force(spark):
    r = random.Random(3)
    good = ["The river runs.", "A house", "stands near,", "Water falls;", "one (small) bird"]
    bad = ["BUY!!! now", "CLICK here!!", "$$$ 100 %%", "win WIN win", "###"]
    texts = [" ".join(r.choice(good if i % 2 else bad) for _ in range(r.randrange(1, 12))) for i in range(80)] + [None, "", "x", "Été ÀÉ ñ"]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(81, None), (500, 1)], "doc_id long, quality int")
    model = quality.learn(d, labels)
    vectors, terms = brute_vectors(texts[:80])
    assert np.allclose(model["vectors"], vectors, atol=1e-5)
    x = np.array([brute_features(t, vectors, terms) for t in texts])
    fold = np.array([xxhash.xxh3_64_intdigest(str(i).encode()) % quality.HOLD == 0 for i in range(80)])
    net = quality.fit(x[:80].astype(np.float32).astype(float), np.array([i % 2 for i in range(80)], float), fold)
    want = quality.probabilities(x, net)
    got = {row["doc_id"]: row["score"] for row in quality.scores(d, model).collect()}
    assert all(got[i] == pytest.approx(want[i], abs=2e-3) for i in range(len(texts)))
    assert sum((got[i] >= 0.5) == i % 2 for i in range(80)) > 76
    clear = [i for i in range(len(texts)) if abs(want[i] - 0.7) > 0.01]
    kept = {row["doc_id"] for row in quality.good(d, model).collect()}
    assert {i for i in clear if i in kept} == {i for i in clear if want[i] >= 0.7}
