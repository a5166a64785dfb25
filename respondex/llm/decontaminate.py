"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased.
A window is ``window`` consecutive words of an item; an item of fewer words, but not
none, is one window.  The automaton accepts every run of words of every item.  Training
words stream through it and keep the length of the longest match that ends at each; a
word inside any occurrence of a window is hit.

The automaton grows with the items, so items are cut into blocks of at most
``block_words`` words, each broadcast and made into an automaton by each worker; a longer
item is cut into pieces that overlap by all but one word of a window, so no window is lost.
A pass over the documents meets HELD blocks at most, which bounds the memory of workers and
driver; if there are more, the spans found so far go along as a column and the table is
staged between passes.

Null and empty texts have no words; texts of any length stream through whole; an empty table on either side
gives no hits.  Only the named columns are read, so others may have any name.  Repeated rows are each scanned.  Items that repeat count each under its own id; items with a
null id take part in hits but are not listed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondex.llm.batches import map_rows
from respondex.plans.staging import staged

#: Words of items in one automaton (about half a kilobyte of a worker's memory each), and automata of a pass.
BLOCK_WORDS, HELD = 50_000, 4
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RUN = re.compile(rb"[^\x20]+")


def words(text: str | None) -> list[bytes]:
    """Normalised words of a text."""
    return text.encode().translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items of each window's state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.number = window, {}
        self.length, self.link, self.next = [0], [-1], [{}]
        coded = []
        for name, text in items:
            code = [self.number.setdefault(w, len(self.number)) for w in text]
            if code:
                coded.append((name, code))
                last = 0
                for c in code:
                    last = self.extend(last, c)
        self.least = min((min(window, len(c)) for _, c in coded), default=0)
        self.at_window = self.window_states()
        self.full: dict[int, set] = {}
        self.short: dict[int, set] = {}
        for name, code in coded:
            state = length = 0
            for c in code:
                state, length = self.next[state][c], length + 1
                if length >= window:
                    self.full.setdefault(self.at_window[state], set()).add(name)
            if length < window:
                while self.length[self.link[state]] >= length:  # under window links at most
                    state = self.link[state]
                self.short.setdefault(state, set()).add((length, name))
        self.above = self.nearest_short()

    def extend(self, last: int, c: int) -> int:
        """Add a word after the state ``last``; also where another item already led the same way."""
        length, link, follow = self.length, self.link, self.next
        to = follow[last].get(c)
        if to is not None and length[to] == length[last] + 1:
            return to
        new = -1
        if to is None:
            new = self.state(length[last] + 1, -1, {})
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p < 0:
                link[new] = 0
                return new
            to = follow[p][c]
            if length[to] == length[p] + 1:
                link[new] = to
                return new
        else:
            p = last
        copy = self.state(length[p] + 1, link[to], dict(follow[to]))
        while p >= 0 and follow[p].get(c) == to:
            follow[p][c] = copy
            p = link[p]
        link[to] = copy
        if new < 0:
            return copy
        link[new] = copy
        return new

    def state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        return len(self.length) - 1

    def window_states(self) -> list[int]:
        """For each state of at least a window's length, the state of its last ``window`` words; each follows one link."""
        out = list(range(len(self.length)))
        for s in sorted(out[1:], key=self.length.__getitem__):
            if self.length[self.link[s]] >= self.window:
                out[s] = out[self.link[s]]
        return out

    def nearest_short(self) -> list[int]:
        """For each state, itself or the nearest suffix that is a whole short item's; -1: none."""
        out = [-1] * len(self.length)
        for s in sorted(range(1, len(out)), key=self.length.__getitem__):
            out[s] = s if s in self.short else out[self.link[s]] if self.link[s] > 0 else -1
        return out

    def hits(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Half-open spans of words inside windows, merged, in order, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        if not self.least or len(text) < self.least:
            return spans, found
        code = np.fromiter(map(self.number.get, text, [-1] * len(text)), np.int64, len(text))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (code >= 0).view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # only runs of known words can match
            if b - a >= self.least:
                self.run(code[a:b].tolist(), a, spans, found)
        return merged(spans), found

    def run(self, code: list[int], at: int, spans: list, found: set) -> None:
        follow, link, lengths, window = self.next, self.link, self.length, self.window
        state = length = 0
        for i, c in enumerate(code, at + 1):
            to = follow[state].get(c)
            while to is None and state:
                state = link[state]
                length = lengths[state]
                to = follow[state].get(c)
            if to is None:
                continue
            state, length = to, length + 1
            if length >= window:
                spans.append((i - window, i))
                found |= self.full.get(self.at_window[state], ())
            s = self.above[state]
            while s > 0:
                for n, name in self.short.get(s, ()):
                    if n <= length:
                        spans.append((i - n, i))
                        found.add(name)
                s = self.above[link[s]] if link[s] > 0 else -1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[list]:
    """Broadcast items of each pass, in HELD blocks at most; the items pass through the driver a pass at a time."""
    sc = benchmark.sparkSession.sparkContext
    rows = staged(benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL"), "benchmark")
    out, items, n = [], [], 0
    for r in rows.toLocalIterator():
        w = words(r["text"])
        most = max(block_words, window)
        for a in range(0, max(1, len(w) - window + 1), most - window + 1):
            piece = w[a : a + most]
            if items and n + len(piece) > most:
                out.append(sc.broadcast((uuid.uuid4().hex, items, window)))
                items, n = [], 0
                if len(out) == HELD:
                    yield out
                    out = []
            items.append((r["item"], piece))
            n += len(piece)
    yield out + [sc.broadcast((uuid.uuid4().hex, items, window))] * bool(items)


_automata: dict[str, SuffixAutomaton] = {}


def automaton(part) -> SuffixAutomaton:
    """This process's automaton of a broadcast block."""
    key, items, window = part.value
    if key not in _automata:
        if len(_automata) >= HELD:
            _automata.clear()
        _automata[key] = SuffixAutomaton(items, window)
    return _automata[key]


def with_hits(docs: DataFrame, text_col: str, passes: Iterator[list], out: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs and ``out``: struct(n words, spans of hit words in order, sorted items)."""
    kind = "struct<n:int,spans:array<struct<start:int,end:int>>,items:array<string>>"
    df = docs.withColumn(out, F.lit(None).cast(kind))
    group = next(passes)
    while group is not None:
        after = next(passes, None)
        last = after is None
        columns = [*(keep if last else docs.columns), out]

        def make(group=group, columns=columns):
            def f(batch: pa.RecordBatch) -> dict:
                found = []
                for text, before in zip(batch.column(text_col).to_pylist(), batch.column(out).to_pylist(), strict=True):
                    w = words(text)
                    spans, items = ([(x["start"], x["end"]) for x in before["spans"]], set(before["items"])) if before else ([], set())
                    for part in group:
                        more, names = automaton(part).hits(w)
                        if more:
                            spans, items = merged(spans + more), items | {x for x in names if x is not None}
                    found.append({"n": len(w), "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(items)})
                return {c: batch.column(c) for c in columns if c != out} | {out: found}

            return f

        df = map_rows(df, df.select(*columns).schema, text_col, make)
        if not last:
            df = staged(df, "decontamination-pass")
            for part in group:
                part.destroy()
        group = after
    return df


def n_hit(hits: str) -> Column:
    return F.aggregate(F.col(hits)["spans"], F.lit(0), lambda a, x: a + x["end"] - x["start"])


def contaminated(hits: str, share: int) -> Column:
    """Whether at least one word and at least 1/share of all words are hit."""
    return (n_hit(hits) > 0) & (share * n_hit(hits) >= F.col(hits)["n"])


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(id, n_words, n_hit, items array<string> sorted, spans array<struct<start,end>> of words, contaminated)`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    d = with_hits(rows, "text", blocks(benchmark, item_col, item_text, window, block_words), "hits", ["id"])
    return d.select(F.col("id").alias(id_col), F.col("hits.n").cast("long").alias("n_words"), n_hit("hits").cast("long").alias("n_hit"), "hits.items", "hits.spans", contaminated("hits", share).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of docs, all columns unchanged, that are not contaminated."""
    out = "__respondex_hits"
    d = with_hits(docs, text_col, blocks(benchmark, item_col, item_text, window, block_words), out, docs.columns)
    return d.where(~contaminated(out, share)).drop(out)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given half-open spans of words (what separates a span from the next word stays)."""
    raw = text.encode()
    at = [m.span() for m in _RUN.finditer(raw.translate(_FOLD))]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, longest: int = 13, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows and columns of docs, with hit spans cut out of the text.

    Merged spans of at least ``longest`` words are cut; all spans of a document are cut if
    they cover 1/share of its words.
    """
    out = "__respondex_hits"
    d = with_hits(docs, text_col, blocks(benchmark, item_col, item_text, window, block_words), out, docs.columns)
    columns = docs.columns

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            texts = []
            for text, hits in zip(batch.column(text_col).to_pylist(), batch.column(out).to_pylist(), strict=True):
                spans = [(x["start"], x["end"]) for x in hits["spans"]]
                if share * sum(b - a for a, b in spans) < hits["n"]:
                    spans = [(a, b) for a, b in spans if b - a >= longest]
                texts.append(cut(text, spans) if spans else text)
            return {c: batch.column(c) for c in columns if c != text_col} | {text_col: texts}

        return f

    return map_rows(d, docs.schema, text_col, make)


def op3(spark, sf_dir: str) -> DataFrame:
    """Contract query: 13-word windows, contaminated from 1/20 of the words on."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = scan(read("documents"), read("benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH RECURSIVE doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lens WHERE len(w) >= n)),
hit AS (SELECT r, dw.i, dw.n, item_id, k FROM dw JOIN win USING (n, s)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
