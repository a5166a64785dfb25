"""Language identification of mixed text: script ranges, per-word scores, Viterbi.

The script of a word (the range of its first letter) narrows the languages to those
that use it.  A word's score for a language is the sum of log-probabilities of its
character n-grams.  The best labelling of all words by languages, where each change
costs ``penalty``, gives spans; the language of most letters is the prediction.

The n-gram table is learned from labelled rows.  At most about ``max_rows`` of them are
used (a classifier's documented bound): a language with less than an even share gives all
its rows, the others share the rest, picked evenly by a hash of the id.  The MAX_GRAMS
n-grams kept are those of the largest share of any one language's.

Null texts and texts without a letter are ``und`` with score 0.  A word whose script no
language uses may be any language.  Without labelled rows every text is ``und``.
Repeated rows are each predicted, and each count as labelled rows.  Texts of any length are labelled whole; of
equally good labels the first language by name is taken; an empty table gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondex.llm.batches import keep_rows, map_rows
from respondex.plans.staging import staged

#: First code points of ranges and their scripts (fixed values).
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"),
]
_STARTS = [a for a, _ in SCRIPTS]
#: Labelled rows to learn from, n-grams of the model, cost of a change, words that a worker remembers.
MAX_ROWS, MAX_GRAMS, PENALTY, MAX_CACHE = 20_000, 60_000, 12.0, 150_000
#: Counted n-grams that a task hands on before it counts anew.
MAX_COUNTED = 240_000
_find = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def script(word: str) -> str:
    """Script of a word's first letter."""
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def grams(word: str) -> list[str]:
    """Character triples of a word with its borders, and a short word itself."""
    w = f" {word} "
    n = len(w)
    out = [w[i : i + 3] for i in range(n - 2)]
    if 4 <= n <= 7:
        out.append(w)
    return out


class Model:
    """Log-probabilities of n-grams by language; languages by script."""

    def __init__(self, table: dict):
        self.langs: list[str] = table["langs"]
        self.row: dict[str, int] = {g: i for i, g in enumerate(table["grams"])}
        self.logp = np.vstack([*table["logp"], table["unseen"]])
        self.scripts: dict[str, np.ndarray] = table["scripts"]
        self.cache: dict[str, int] = {}
        self.scores = np.empty((0, len(self.langs)))

    def score(self, words: list[str]) -> np.ndarray:
        """Scores of words (rows) for each language, the best one's 0, none under -50."""
        get, none = self.row.get, len(self.row)
        rows, sizes = [], []
        for w in words:
            g = grams(w)
            rows += [get(x, none) for x in g]
            sizes.append(len(g))
        s = np.add.reduceat(self.logp[rows], np.concatenate(([0], np.cumsum(sizes[:-1], dtype=np.int64))), axis=0)
        for k in {x for x in map(script, words)} if len(self.scripts) > 1 or any(not a.all() for a in self.scripts.values()) else ():
            if (allowed := self.scripts.get(k)) is not None:
                mine = np.fromiter((script(w) == k for w in words), bool, len(words))
                s[mine] = np.where(allowed, s[mine], -np.inf)
        return np.maximum(s - s.max(axis=1, keepdims=True), -50.0)

    def numbers(self, words: list[str]) -> list[int]:
        """Row of the score table for each word."""
        if len(self.cache) > MAX_CACHE:
            self.cache.clear()
            self.scores = self.scores[:0]
        cache = self.cache
        new = list(set(words).difference(cache))
        if new:
            cache.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            self.scores = np.vstack([self.scores, self.score(new)])
        return list(map(cache.__getitem__, words))

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, list[str], np.ndarray]]:
        """For each text: language number of every word, the words, their scores."""
        split = [_find(t.lower()) if t else [] for t in texts]
        if not self.langs:
            return [(np.empty(0, np.int64), words, np.empty((len(words), 0))) for words in split]
        rows = self.numbers(list(chain.from_iterable(split)))
        out, at = [], 0
        for words in split:
            s = self.scores[rows[at : at + len(words)]].reshape(len(words), len(self.langs))
            at += len(words)
            out.append((viterbi(s, PENALTY) if len(words) else np.empty(0, np.int64), words, s))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans of words (from, to, language)) of each text.

        The score is the share of letters that the language's spans hold, times its chance
        against the other languages on their words, the log odds divided by sqrt(words).
        """
        out = []
        for labels, words, s in self.label(texts):
            if not len(labels):
                out.append(("und", 0.0, []))
                continue
            letters = np.fromiter(map(len, words), np.float64, len(words))
            share = np.bincount(labels, letters, minlength=len(self.langs))
            best = int(share.argmax())
            mine = labels == best
            odds = s[mine].sum(axis=0) / np.sqrt(mine.sum())
            chance = 1 / np.exp(odds - odds[best]).sum()
            cut = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
            out.append((self.langs[best], float(share[best] / letters.sum() * chance), [(a, b, self.langs[labels[a]]) for a, b in zip(cut, cut[1:])]))
        return out


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of largest total score less ``penalty`` for each change; s: words x labels; ties go to the lower label.

    Where no run of words favours another label by more than the penalty, no path that uses
    the best single label somewhere beats it: k runs of other labels need k changes at least
    and gain at most k penalties.  A path that never uses it has k runs but only k - 1 changes:
    it loses if no run gains more than half a penalty, or if even the best other label of
    each word, less one change, gains nothing.  Only other texts need the recursion.
    """
    one = int(s.sum(axis=0).argmax())
    gain = np.cumsum(s - s[:, one : one + 1], axis=0)
    before = np.minimum.accumulate(np.vstack([np.zeros((1, s.shape[1])), gain[:-1]]), axis=0)
    most = (gain - before).max()
    if most <= penalty / 2 or most <= penalty and np.delete(s - s[:, one : one + 1], one, axis=1).max(axis=1).sum() <= penalty:
        return np.full(len(s), one)
    n, k = s.shape
    back = np.empty((n, k), np.int8 if k < 128 else np.int32)
    stay = np.arange(k)
    v = s[0].copy()
    for i in range(1, n):
        top = int(v.argmax())
        change = v[top] - penalty
        keep = v >= change
        back[i] = np.where(keep, stay, top)
        v = np.where(keep, v, change) + s[i]
    out = np.empty(n, np.int64)
    out[-1] = int(v.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def even_share(sizes: list[int], total: int) -> float:
    """Most rows that any language may give so that all together give ``total``, small ones giving all they have."""
    left = total
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > left:
            return left / (len(sizes) - i)
        left -= n
    return float(max(sizes, default=0))


def learn(rows: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int = MAX_ROWS) -> dict:
    """N-gram table from labelled rows (null labels and texts don't count)."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = 1 << 20
    if sum(sizes.values()) > max_rows:
        most = even_share(list(sizes.values()), max_rows)
        limits = rows.sparkSession.createDataFrame([(lang, int(min(1.0, most / n) * share)) for lang, n in sizes.items()], "lang string, __limit long")
        rows = rows.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("id"), F.lit(share)) < F.col("__limit")).select("id", "text", "lang")

    def count(batches):
        seen: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def given() -> pa.RecordBatch:
            flat = [(lang, kind, x, k) for (lang, kind), c in seen.items() for x, k in c.items()]
            cols = list(zip(*flat, strict=True)) or [[], [], [], []]
            seen.clear()
            return pa.RecordBatch.from_pydict({"lang": pa.array(cols[0], pa.string()), "kind": pa.array(cols[1], pa.string()), "x": pa.array(cols[2], pa.string()), "n": pa.array(cols[3], pa.int64())})

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                for w, k in Counter(_find(text.lower()) if text else []).items():
                    for g in grams(w):
                        seen[lang, "g"][g] += k
                    seen[lang, "s"][script(w)] += k
                if sum(map(len, seen.values())) > MAX_COUNTED:
                    yield given()
        yield given()

    sums = staged(rows.mapInArrow(count, "lang string, kind string, x string, n long").groupBy("lang", "kind", "x").agg(F.sum("n").alias("n")), "language-counts")
    totals = {r["lang"]: r["t"] for r in sums.where("kind = 'g'").groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    of = sums.sparkSession.createDataFrame(list(totals.items()), "lang string, t long")
    top = sums.where("kind = 'g'").join(F.broadcast(of), "lang").groupBy("x").agg(F.max(F.col("n") / F.col("t")).alias("share")).orderBy(F.desc("share"), "x").limit(MAX_GRAMS).select("x")
    got = sums.where("kind = 'g'").join(F.broadcast(top), "x").select("lang", "x", "n").collect()
    by_script = sums.where("kind = 's'").select("lang", F.col("x"), "n").collect()
    langs = sorted(totals)
    at = {lang: i for i, lang in enumerate(langs)}
    names = sorted({r["x"] for r in got})
    where = {g: i for i, g in enumerate(names)}
    counts = np.zeros((len(names), len(langs)))
    for r in got:
        counts[where[r["x"]], at[r["lang"]]] = r["n"]
    total = np.array([totals[x] for x in langs], float)
    logp = np.log((counts + 0.5) / (total + 0.5 * (len(names) + 1))) if langs else counts
    scripts: dict[str, np.ndarray] = {}
    used = Counter()
    for r in by_script:
        used[r["lang"]] += r["n"]
    for r in by_script:
        if r["n"] >= 0.01 * used[r["lang"]]:
            scripts.setdefault(r["x"], np.zeros(len(langs), bool))[at[r["lang"]]] = True
    return {"langs": langs, "grams": names, "logp": list(logp.astype(np.float64)), "unseen": np.full(len(langs), np.log(0.5 / (total.max() + 0.5 * len(names)))) if langs else np.zeros(0), "scripts": scripts}


def identify(docs: DataFrame, table: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, spans array<struct<start,end,lang>> of words)`` of every row."""
    model = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        m = Model(model.value)

        def f(batch: pa.RecordBatch) -> dict:
            got = m.predict(batch.column("text").to_pylist())
            return {"id": batch.column("id"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "spans": [[{"start": a, "end": b, "lang": x} for a, b, x in g[2]] for g in got]}

        return f

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    return map_rows(rows, kind, "text", make).withColumnRenamed("id", id_col)


def with_language(docs: DataFrame, table: dict, text_col: str = "text", least: float = 0.2) -> DataFrame:
    """Rows of docs, all columns unchanged, whose language is known with a score of at least ``least``."""
    model = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        m = Model(model.value)
        return lambda texts: [lang != "und" and score >= least for lang, score, _ in m.predict(texts)]

    return keep_rows(docs, text_col, make)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def op2(spark, sf_dir: str) -> DataFrame:
    """Contract query: learned from the folds other than 1 of 3, applied to all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = learn(docs.where(~held_out("doc_id", 3, 1)), "doc_id", "text", "lang")
    return identify(docs, table).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
