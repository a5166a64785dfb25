"""Byte-level BPE: encoding by a trie of distinct words, and decoding.

The encoding of a prefix is fixed by its last token: it is the encoding of what
precedes that token, plus the token.  Of all vocabulary tokens that end a prefix,
exactly one may follow the last token of the rest, so one walk down a trie of
distinct words gives the last token of every prefix, each once, however many words
share it.  A word's tokens are then read backwards from its end.

Which tokens may follow each other comes from the merge order: two tokens are apart
in an encoding unless some merge across their border comes before the merges that
built them up to it.

Null and empty texts have no tokens; texts of any length are encoded whole; repeated rows are each encoded; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain
from math import inf

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.llm.batches import map_rows

#: Cached words at which a worker starts anew.
MAX_WORDS = 150_000
#: The pre-tokens of byte-level BPE: contractions, runs of letters, numbers, other signs, white space.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_signs() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file in JSON."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        signs = byte_signs()
        plain = lambda t: bytes(signs[c] for c in t)
        tokens = {t: i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*tokens.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for t, i in tokens.items():
            if t not in self.special:
                self.bytes[i] = plain(t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.built: dict[int, float] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = tokens[a], tokens[b], tokens[a + b]
            self.rank[left, right] = r
            if whole not in self.split:
                self.split[whole], self.built[whole] = (left, right), r
        self.right_edge: dict[int, list[tuple[int, float]]] = {}
        self.left_edge: dict[int, list[tuple[int, float]]] = {}
        self.follows: dict[int, bool] = {}
        usable = set()
        for t, i in sorted(tokens.items(), key=lambda x: self.built.get(x[1], -1)):
            if t not in self.special and (i not in self.split or set(self.split[i]) <= usable and not self.crossed(*self.split[i], self.built[i])):
                usable.add(i)
        self.ids = {self.bytes[i]: i for i in usable}
        self.longest: dict[bytes, int] = {}  # of the usable tokens that end with four given bytes
        for b in self.ids:
            if len(b) >= 4:
                self.longest[b[-4:]] = max(len(b), self.longest.get(b[-4:], 4))

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens along one edge of a token's merge tree, each with the rank of the merge that takes it up."""
        cache = (self.left_edge, self.right_edge)[side]
        if token not in cache:
            out, taken = [(token, inf)], token
            while taken in self.split:
                rank = self.built[taken]
                taken = self.split[taken][side]
                out.append((taken, rank))
            cache[token] = out
        return cache[token]

    def crossed(self, a: int, b: int, limit: float = inf) -> bool:
        """Whether a merge across the border of a and b comes before they are complete (of equal merges the left one is first)."""
        rank = self.rank
        for x, x_taken in self.edge(a, 1):
            for y, y_taken in self.edge(b, 0):
                q = rank.get((x, y))
                if q is not None and q < limit and q < x_taken and q <= y_taken:
                    return True
        return False

    def may_follow(self, a: int, b: int) -> bool:
        key = a * self.size + b
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 300_000:
                self.follows.clear()
            known = self.follows[key] = not self.crossed(a, b)
        return known


class Encoder:
    """Encodes texts; keeps a bounded cache of words."""

    def __init__(self, raw: bytes):
        self.vocabulary = Vocabulary(raw)
        self.find = regex.compile(PRETOKEN).findall
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def last_token(self, word: bytes, depth: int, lasts: list[int]) -> tuple[int, int]:
        """Last token of word[:depth] and where it begins; lasts: of all shorter prefixes."""
        v = self.vocabulary
        ids, follows, size = v.ids, v.follows, v.size
        most = v.longest.get(word[depth - 4 : depth], 3) if depth >= 4 else depth
        for at in range(max(0, depth - most), depth):
            token = ids.get(word[at:depth])
            if token is not None:
                if at == 0:
                    return token, at
                known = follows.get(lasts[at] * size + token)
                if v.may_follow(lasts[at], token) if known is None else known:
                    return token, at
        raise ValueError("the vocabulary lacks a byte")

    def walk(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Tokens of sorted distinct words, which are the leaves of their trie in depth-first order.

        The stack holds the states of the nodes on the way to the current word; what it
        shares with the one before is not computed again.
        """
        lasts, starts, before = [-1], [0], b""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del lasts[shared + 1 :], starts[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                token, at = self.last_token(word, depth, lasts)
                lasts.append(token)
                starts.append(at)
            out, depth, before = [], len(word), word
            while depth:
                out.append(lasts[depth])
                depth = starts[depth]
            yield tuple(out[::-1])

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that the cache lacks, depth first through their trie."""
        cache, distinct = self.cache, set(words)
        new = distinct.difference(cache)
        if len(cache) + len(new) > MAX_WORDS:
            cache.clear()
            new = distinct
        cache.update((s, (i,)) for s, i in self.vocabulary.special.items())
        order = sorted(w.encode() for w in new.difference(self.vocabulary.special))
        cache.update(zip((w.decode() for w in order), self.walk(order), strict=True))

    def words(self, text: str) -> list[str]:
        """Pre-tokens and, as they are, special strings."""
        if self.cut and any(s in text for s in self.vocabulary.special):
            out = []
            for part in self.cut(text):
                out += [part] if part in self.vocabulary.special else self.find(part)
            return out
        return self.find(text)

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        words = [self.words(t) if t else [] for t in texts]
        self.learn(chain.from_iterable(words))
        code = self.cache.__getitem__
        return [list(chain.from_iterable(map(code, w))) for w in words]

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes of the tokens, special ones included, as UTF-8; broken sequences become U+FFFD."""
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids)).decode("utf-8", "replace")


def tokenizer_file(path: str | None = None) -> bytes:
    """Content of a tokenizer file, read where the query is built and broadcast (it doesn't grow with data)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, texts: bool = False) -> DataFrame:
    """``(id, ids array<int>, ids_sha256, decoded_sha256[, decoded])`` of every row; null texts count as empty.

    The ids hash is of the decimal ids joined by commas; ``decoded`` is made from the ids.
    """
    raw = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def make():
        e = Encoder(raw.value)
        sign = list(map(str, range(e.vocabulary.size)))

        def f(batch: pa.RecordBatch) -> dict:
            ids = e.encode_all(batch.column("text").to_pylist())
            back = list(map(e.decode, ids))
            return {
                "id": batch.column("id"), "ids": ids, "decoded": back if texts else None,
                "ids_sha256": [hashlib.sha256(",".join(map(sign.__getitem__, x)).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in back],
            }

        return f

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_rows(rows, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, ids_sha256 string, decoded_sha256 string" + ", decoded string" * texts, "text", make)
    return out.withColumnRenamed("id", id_col)


def op1(spark, sf_dir: str) -> DataFrame:
    """Contract query: encode and decode every document."""
    out = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", "decoded_sha256")
