"""Periodic runs of words by online dyadic square catching.

A run is a stretch of words with smallest period q, at least ``max(least, 2 * q)`` words
long, that no neighbouring word extends.  Its repeats after the first q words can be cut.

``Catchers`` reads words as they are appended.  For each power of two it keeps the names of
all blocks of that many words; a completed aligned block is a catcher.  A run of period p
holds, where its words equal those p on, an aligned block whenever that stretch is at least
twice as long less one, so each period has one block size, and each appended word
has its last 2^k words compared with the two catchers of size 2^k that can answer for it:
2 log(n) comparisons a word.  Equal names are squares' halves at a known distance; neighbouring
catches of one distance merge, grow to both sides by less than a block, and those that
are long enough are runs.  Names are 64-bit hashes of exact word numbers, so none is missed, and
each run is checked on the word numbers.  All texts of a step are appended together, with a
word of its own between two texts, which no run can hold.

Null and empty texts have no words and no runs.  Long texts take 8 bytes a word for each
power of two up to half their words.  Of stretches with several periods the smallest counts, so
a run is reported once; runs may overlap, and of runs of equal length the first stands first.
Repeated rows are each scanned; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.llm.batches import map_rows

#: Words of the shortest run.
LEAST = 12

_U = np.uint64
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


class Numbers(dict):
    """Words to their numbers, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Catchers:
    """Runs of the words appended so far.

    least: words of the shortest run.  longest: bound on the words of a run, if known; saves
    the block sizes that no shorter run needs.
    """

    def __init__(self, least: int = LEAST, longest: int | None = None):
        self.least, self.longest = least, longest
        self.words = np.empty(0, np.int64)
        self.names: list[np.ndarray] = []
        self.caught: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        # periods below half the least length have longer stretches than their own size; they and the rest of their class are compared one by one
        self.single = 0
        while self.single < (least - 1) // 2:
            self.single = 2 * self.single + 2

    def level(self, period: int) -> int:
        """The binary logarithm of the largest block that the stretch of a shortest run of this period surely holds."""
        return (max(self.least - period, period) + 1).bit_length() - 2

    def extend(self, words: np.ndarray) -> None:
        """Append words, given as numbers: complete blocks, and compare what now ends with the catchers at the right distances."""
        self.words = np.concatenate([self.words, words])
        n = len(self.words)
        most = max(min(n, self.longest or n) // 2, min(self.single, n))
        top = max([self.level(p) for p in range(1, self.single + 1)] + [(most + 1).bit_length() - 2])
        for k in range(top + 1):
            if k == len(self.names):
                self.names.append(np.empty(0, _U))
            old, size = len(self.names[k]), 1 << k
            if n - size + 1 <= old:
                break
            if k:
                below, half = self.names[k - 1], size >> 1
                new = mixed(below[old : n - size + 1] * _U(0x9E3779B97F4A7C15) + below[old + half : n - size + 1 + half])
            else:
                new = mixed(self.words[old:].view(_U) + _U(0x165667B19E3779F9))
            self.names[k] = np.concatenate([self.names[k], new])
            self.catch(k, old)

    def catch(self, k: int, old: int) -> None:
        """Compare the names from place ``old`` on with the catchers of 2^k words."""
        names, size = self.names[k], 1 << k
        for p in range(1, self.single + 1):
            if self.level(p) == k:
                first = max(0, -(-(old - p) // size)) * size
                at = np.arange(first, len(names) - p, size)
                at = at[names[at] == names[at + p]]
                self.caught.setdefault(k, []).append((at, np.full(len(at), p)))
        if 2 * size - 1 <= self.single:
            return
        for back in (2, 3):  # the second and the third last of the blocks that end before a place
            start = (back << k) - 1
            low = max(start, old)
            skip = (low - start) >> k
            tail = names[start + (skip << k) :]
            blocks = np.repeat(names[skip << k :: size][: -(-len(tail) // size)], size)[: len(tail)]
            hit = np.flatnonzero(tail == blocks) + (skip << k)
            hit = hit[hit + start >= old]
            self.caught.setdefault(k, []).append(((hit >> k) << k, start + (hit & (size - 1))))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, length, period)`` of all runs, by start, then period."""
        found = [self.grown(k, *map(np.concatenate, zip(*caught, strict=True))) for k, caught in self.caught.items()]
        starts, lengths, periods = map(np.concatenate, zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 3
        order = np.lexsort((periods, lengths, starts))
        s, n, p = starts[order], lengths[order], periods[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (n[1:] != n[:-1])
        s, n, p = s[first], n[first], p[first]
        true = np.fromiter((np.array_equal(self.words[a : a + m - q], self.words[a + q : a + m]) for a, m, q in zip(s.tolist(), n.tolist(), p.tolist(), strict=True)), bool, len(s))
        if not true.all():
            raise ArithmeticError("two different blocks have the same 64-bit name")
        order = np.lexsort((p, s))
        return s[order], n[order], p[order]

    def grown(self, k: int, at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Catches of blocks of 2^k words merged to stretches, grown to both sides, and those of runs kept."""
        order = np.lexsort((at, p))
        at, p, size, n = at[order], p[order], 1 << k, len(self.words)
        new = np.ones(len(at), bool)
        new[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + size)
        a, p, b = at[new], p[new], at[np.append(new, True)[1:]] + size if len(at) else at
        for j in range(k - 1, -1, -1):
            names, step = self.names[j], 1 << j
            low = np.maximum(a - step, 0)
            a = np.where((a >= step) & (names[low] == names[low + p]), low, a)
            fits = b + p + step <= n
            here = np.where(fits, b, 0)
            b = np.where(fits & (names[here] == names[np.where(fits, b + p, 0)]), b + step, b)
        long = b - a >= np.maximum(self.least - p, p)
        return a[long], (b - a + p)[long], p[long]


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of each list of words, by start, then period."""
    numbers = Numbers()
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) if len(sizes) else sizes
    words = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for i, (t, end) in enumerate(zip(texts, ends.tolist(), strict=True)):
        words[end - 1 - len(t) : end - 1] = list(map(numbers.__getitem__, t))
        words[end - 1] = -1 - i
    c = Catchers(least, int(sizes.max(initial=0)))
    c.extend(words)
    s, n, p = c.runs()
    owner = np.searchsorted(ends, s, "right")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, a, m, q in zip(owner.tolist(), (s - (ends - 1 - sizes)[owner]).tolist(), n.tolist(), p.tolist(), strict=True):
        out[i].append((a, m, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by spaces, without those that any run holds after its first period."""
    if runs:
        keep = bytearray(b"\x01") * len(words)
        for start, length, period in runs:
            keep[start + period : start + length] = bytes(length - period)
        words = [w for w, k in zip(words, keep, strict=True) if k]
    return b" ".join(words)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` of each row; words are split at ASCII white space.

    collapsed is the text without the repeats of its runs.  prepare: changes the words of a row first, given its id.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            texts = [t.encode().split() if t else [] for t in batch.column("text").to_pylist()]
            if prepare:
                texts = [prepare(i, t) for i, t in zip(batch.column("id").to_pylist(), texts, strict=True)]
            found = runs_of(texts, least)
            return {
                "id": batch.column("id"), "n_words": [len(t) for t in texts], "collapsed": [collapsed(t, r).decode() for t, r in zip(texts, found, strict=True)],
                "runs": pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], _RUNS),
            }

        return f

    kind = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_rows(rows, kind, "text", make).withColumnRenamed("id", id_col)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's repeats: in one text of ten, by the checksum of its id, a stretch is repeated to the end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def op13(spark, sf_dir: str) -> DataFrame:
    """Contract query: runs of whole documents, with the contract's repeats; a null id has none of these."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), prepare=planted)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("1000 * -best.l div best.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


SQL = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384)) AS c FROM (SELECT unnest(range(256)) AS i))),
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT))), lambda c, d: xor(c >> 8, tab[(xor(c, d) & 255) + 1])), 4294967295) AS h FROM documents, crc),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, h // 10 AS g FROM h),
a AS (SELECT *, CASE WHEN hit THEN g % n END AS a FROM g),
q AS (SELECT *, CASE WHEN hit THEN 1 + (n - a) // (3 + g % 8) END AS q FROM a),
d AS (SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % q + 1 END]) ELSE w END AS w FROM q),
t AS MATERIALIZED (SELECT doc_id, n, i, w[i + 1] AS word FROM (SELECT doc_id, n, w, unnest(range(0, n)) AS i FROM d)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e) GROUP BY doc_id, p, island HAVING count(*) >= greatest(12 - p, p)),
r AS (SELECT doc_id, start, length, min(p) AS period FROM s GROUP BY ALL),
m AS (SELECT doc_id, count(*) AS n_runs, min({'l': -length, 's': start, 'p': period}) AS best, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept FROM t LEFT JOIN x ON x.doc_id = t.doc_id AND x.i = t.i WHERE x.i IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.p AS period, 1000 * -best.l // best.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, n AS n_words
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""
