"""Spelling variants: words that differ by one inserted, deleted or replaced character, by dense prefix-suffix tiling.

Two different words differ by a single edit exactly if their common prefix and their common
suffix together reach the length of the longer one less one.  So one of the two is at least half
as long (``half``), and both words share it.  Each word stands in four groups: by the
half prefix and the half suffix that it would share with words up to its own length, and with
words longer by one.  In a group, words become padded matrices of code points,
from the left and from the right; pairs of blocks of rows are compared column by column, all pairs
of a block pair at once, and a pair counts if prefix plus suffix reach the limit (in a suffix group
only if the prefix falls short of half, so that each pair counts once).  A group of more than
``TILE`` words is cut into parts, and each pair of parts is a group of its own, so no
task holds a whole large group.  Tiles hand on counts and best neighbours, not pairs.

A word's form is its near word of largest count (ties: smallest in code-point order) if
that count is at least ``ratio`` times its own; the root is the end of the chain of forms.

Counting: each task adds up its words in bounded memory, so a hot word is few rows before the
shuffle.  Null and empty texts and words shorter than ``shortest`` give nothing; a text
or word may be of any length; repeated rows count each; words that nothing is near are kept with
``n_near`` 0 and themselves as root; an empty table gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.llm.batches import give_back, steps
from respondex.plans.shipping import ship
from respondex.plans.skew import broadcast_if_small
from respondex.plans.staging import discard, staged

#: Words of a group that one tile compares, rows of a block, words compared before their results are handed on, distinct words that a task counts at once.
TILE, ROWS, BUFFER, COUNTED = 4_096, 128, 32_768, 200_000

#: Latin-1 code points: letters with A-Z lower-cased, the others as spaces.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def letter_runs(text: str | None) -> list[str]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, with only A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_LETTERS).decode("latin-1").split(" ") if text else []


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, fewest: int = 3, change: Callable[[object, str], str] | None = None) -> DataFrame:
    """``(word, n)`` of the letter runs of all texts with at least ``shortest`` characters and ``fewest`` uses.

    change: gives another word for a run, by the id of its row.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def handed(counts: Counter) -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for at in range(0, len(words), 1 << 14):
            part = words[at : at + (1 << 14)]
            yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.string()), "n": pa.array([counts[w] for w in part], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in steps(batches, "text"):
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if change is None:
                    counts.update(w for w in letter_runs(text) if len(w) >= shortest)
                else:
                    for w, n in Counter(letter_runs(text)).items():
                        if len(w) >= shortest and len(w := change(i, w)) >= shortest:
                            counts[w] += n
                if len(counts) > COUNTED:
                    yield from handed(counts)
                    counts = Counter()
        yield from handed(counts)
        give_back()

    ship(docs.sparkSession)
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points padded with zeros: from the left, and backwards from the right."""
    width = max(map(len, words))
    left = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(-1, width)
    right = np.frombuffer("".join(w[::-1].ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(-1, width)
    return left, right


def common(a: np.ndarray, b: np.ndarray, live: np.ndarray) -> np.ndarray:
    """For each pair of rows of a and b that is live, the number of first columns in which they are equal and not padding."""
    out = np.zeros(live.shape, np.int32)
    for k in range(min(a.shape[1], b.shape[1])):
        live = live & (a[:, k, None] == b[None, :, k]) & (a[:, k, None] != 0)
        if not live.any():
            break
        out += live
    return out


def near_pairs(words: list[str], group: np.ndarray, longer: np.ndarray, suffix: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of near words, rows sorted by group.

    longer: the length of the longer word in pairs of the group.  suffix: whether the group shares a suffix.
    part: the side of a row where two parts of a large group meet (only pairs across count), or -1.
    """
    found, n = [], len(words)
    ends = np.searchsorted(group, group, "right")
    size = np.fromiter(map(len, words), np.int32, n)
    for i in range(0, n, ROWS):
        rows = slice(i, min(i + ROWS, n))
        own = matrices(words[rows])
        for j in range(i, int(ends[rows.stop - 1]), ROWS):
            cols = slice(j, min(j + ROWS, n))
            live = (group[rows, None] == group[None, cols]) & (np.maximum(size[rows, None], size[None, cols]) == longer[rows, None])
            live &= (part[rows, None] < 0) | (part[rows, None] != part[None, cols])
            if i == j:
                live = np.triu(live, 1)
            if not live.any():
                continue
            other = own if i == j else matrices(words[cols])
            prefix = common(own[0], other[0], live)
            live &= ~suffix[rows, None] | (prefix < longer[rows, None] // 2)
            whole = prefix + common(own[1], other[1], live)
            x, y = np.nonzero(live & (whole >= longer[rows, None] - 1))
            found.append((x + i, y + j))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def best_of(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words that have near ones: their index, how many, and the index of the one of largest count, ties by code points."""
    order = np.lexsort((np.argsort(np.argsort(np.array(words, object), kind="stable")), -n))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    k, best = np.bincount(np.concatenate([a, b]), minlength=len(words)), np.full(len(words), len(words), np.int64)
    np.minimum.at(best, a, rank[b])
    np.minimum.at(best, b, rank[a])
    at = np.flatnonzero(k)
    return at, k[at], order[best[at]]


def grouped(counts: DataFrame, tile: int = TILE) -> DataFrame:
    """``(key, x, y, part, longer, suffix, word, n)``: each word in its four groups, large ones cut into pairs of parts x, y."""
    m = F.length("word")
    kinds = F.array(*[F.struct((m + d).alias("longer"), F.lit(s).alias("suffix")) for d in (0, 1) for s in (False, True)])
    g = counts.select("word", "n", F.explode(kinds).alias("g")).select("word", "n", "g.longer", "g.suffix")
    half = F.expr("longer div 2").cast("int")
    shared = F.when(F.col("suffix"), F.substring("word", -half, half)).otherwise(F.substring("word", F.lit(1), half))
    g = g.withColumn("key", F.concat_ws(":", "longer", F.col("suffix").cast("int"), shared))
    large = g.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > tile).select("key", F.ceil(F.col("k") / tile).cast("int").alias("parts"))
    g = g.join(broadcast_if_small(large), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    g = g.withColumn("own", F.pmod(F.xxhash64("word"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x, y = F.least("own", "other"), F.greatest("own", "other")
    return g.select("key", x.alias("x"), y.alias("y"), F.when(x == y, -1).otherwise(F.col("own")).alias("part"), "longer", "suffix", "word", "n")


def neighbours(counts: DataFrame, tile: int = TILE) -> DataFrame:
    """``(word, n_near, best, best_n)`` of the words of ``counts (word, n)`` that have near words."""
    names = ["key", "x", "y"]

    def compared(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        words, n = t["word"].to_pylist(), t["n"].to_numpy()
        new = np.zeros(len(words), bool)
        for c in names:
            codes = t[c].combine_chunks().dictionary_encode().indices.to_numpy() if c == "key" else t[c].to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        a, b = near_pairs(words, np.cumsum(new), t["longer"].to_numpy().astype(np.int32), t["suffix"].to_numpy(zero_copy_only=False), t["part"].to_numpy())
        at, k, best = best_of(words, n, a, b)
        at, best_at = at.tolist(), best.tolist()
        return pa.RecordBatch.from_pydict({"word": pa.array([words[i] for i in at], pa.string()), "k": pa.array(k.astype(np.int64)), "best": pa.array([words[i] for i in best_at], pa.string()), "best_n": pa.array(n[best_at].astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < BUFFER:
                continue
            # the last group may go on in the next batch
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = [t.column(c)[n - 1] for c in names]
            lo, hi = 0, n - 1
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if all(t.column(c)[mid] == v for c, v in zip(names, last, strict=True)) else (mid + 1, hi)
            if lo:
                yield compared([t.slice(0, lo)])
            held, n = [t.slice(lo)], n - lo
        if n:
            yield compared(held)
        give_back()

    ship(counts.sparkSession)
    dealt = grouped(counts, tile).repartition(*names).sortWithinPartitions(*names)
    found = dealt.mapInArrow(run, "word string, k long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("o"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.o")).alias("best_n"))


def variants(counts: DataFrame, ratio: int = 2, tile: int = TILE) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each word of ``counts (word, n)``."""
    counts = staged(counts, "spelling-counts")
    near = neighbours(counts, tile)
    formed = F.col("best_n") >= ratio * F.col("n")
    found = counts.join(near, "word", "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n")
    )
    found = staged(found, "spelling-forms")
    discard(counts)
    jumps = staged(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    moved = True
    while moved:  # each round doubles the steps; counts double at each form, so chains are short
        on = broadcast_if_small(jumps.select(F.col("word").alias("root"), F.col("root").alias("next")))
        longer = staged(jumps.select("word", "root").join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(jumps)
        jumps, moved = longer, not longer.where("moved").isEmpty()
    return found.join(broadcast_if_small(jumps.select("word", "root")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spoiled(doc_id: int | None, run: str) -> str:
    """The contract's misspellings: by the checksum of id and run, one run of 97 loses a character; none of a null id."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % 97:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def op11(spark, sf_dir: str) -> DataFrame:
    """Contract query: words of whole documents, with the contract's misspellings, and their forms."""
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), change=spoiled))


SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384)) AS c FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
b AS (SELECT doc_id, run, n, hex(encode(concat(doc_id, ':', run))) AS x FROM r),
h AS (SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) // 2 + 1), lambda k: ('0x' || x[2 * k - 1 : 2 * k])::BIGINT)), lambda c, d: xor(c >> 8, tab[(xor(c, d) & 255) + 1])), 4294967295) AS h FROM b, crc),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN doc_id IS NOT NULL AND h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
d AS (SELECT DISTINCT word, n, left(word, k - 1) || substr(word, k + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w)),
s AS (SELECT word, n, k, left(word, k - 1) || '*' || substr(word, k + 1) AS hole FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM s a JOIN s b USING (k, hole) WHERE a.word <> b.word UNION ALL SELECT w.word, d.word, d.n FROM w JOIN d ON w.word = d.short UNION ALL SELECT d.word, w.word, w.n FROM w JOIN d ON w.word = d.short),
o AS (SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place FROM p),
f AS (SELECT w.word, CASE WHEN o.n >= 2 * w.n THEN o.near END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN o.n >= 2 * w.n THEN o.n END AS form_n FROM w LEFT JOIN o ON o.word = w.word AND place = 1),
c AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT c.word, f.form, steps + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(root, steps) AS root FROM c GROUP BY 1) r ON r.word = f.word
"""
