"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the token counts of frequent pre-tokens: pre-tokens are counted on a bounded
sample (the first ``SAMPLE`` rows that Spark finds), the ``FREQUENT`` most frequent are encoded once, and their bytes
and lengths are broadcast.  Tier two encodes the rest through the bounded cache of each worker.  Counts are exact
with any table; the sample only decides what is spared.  No pre-token is shuffled, and the table doesn't
grow with data.

Null texts count as empty; texts of any length are counted whole; special strings count as the special tokens;
repeated rows are each counted; of equally frequent pre-tokens the lower ones stay; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.llm.batches import map_rows
from respondex.llm.bpe import Encoder, tokenizer_file

#: Rows of the sample and their characters at most, entries of the table, and words that a worker keeps beside it.
SAMPLE, SAMPLE_CHARS, FREQUENT, KEPT = 2_000, 20_000, 65_536, 200_000


def frequent(rows: DataFrame, e: Encoder, size: int | None = None, sample: int = SAMPLE) -> list[str]:
    """The most frequent pre-tokens of the first ``sample`` rows (text) of at most SAMPLE_CHARS characters.

    Spark reads as many partitions as it needs for them; they are counted where the query is built.
    """
    seen: Counter = Counter()
    for r in rows.where(F.length("text") <= SAMPLE_CHARS).select("text").take(sample):
        seen.update(e.words(r["text"]))
    return [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: FREQUENT if size is None else size]]


class Sizes(dict):
    """Token counts of words: those of tier one always, others while they are few enough."""

    def __init__(self, e: Encoder, tier: dict[str, int]):
        super().__init__(tier)
        self.encoder, self.tier = e, tier

    def learn(self, words: set[str]) -> None:
        new = words.difference(self)
        if len(self) + len(new) > len(self.tier) + KEPT:
            self.clear()
            self.update(self.tier)
            new = words.difference(self)
        special = {w: 1 for w in new if w in self.encoder.vocabulary.special}
        order = sorted(w.encode() for w in new if w not in special)
        self.update(special)
        self.update(zip((w.decode() for w in order), map(len, self.encoder.walk(order)), strict=True))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row; null texts count as empty, special strings as special tokens."""
    sc = docs.sparkSession.sparkContext
    content = tokenizer_file(path)
    raw, e = sc.broadcast(content), Encoder(content)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = [w for w in frequent(rows, e) if "\0" not in w]
    lengths = dict(zip(words, map(len, e.encode_all(words)), strict=True))
    table = sc.broadcast(("\0".join(words).encode(), bytes(min(255, lengths[w]) for w in words)))

    def make():
        e = Encoder(raw.value)
        names, counts = table.value
        sizes = Sizes(e, {w: n for w, n in zip(names.decode().split("\0"), counts, strict=True) if n < 255} if counts else {})
        size = sizes.__getitem__

        def f(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            words = [e.words(t) if t else [] for t in texts]
            sizes.learn(set(chain.from_iterable(words)))
            return {"id": batch.column("id"), "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": [sum(map(size, w)) for w in words]}

        return f

    out = map_rows(rows, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long", "text", make)
    return out.withColumnRenamed("id", id_col)


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract query: token and byte counts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a table of fewer splits than cores; larger ones are never moved
        docs = docs.repartition(cores)
    return token_counts(docs).withColumn("over_limit", F.col("n_tokens") > 512)
