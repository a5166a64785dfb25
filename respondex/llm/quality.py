"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

A token stands for two terms: its letters, lower-cased, and its shape (upper, lower,
digit and sign runs).  Each term has a sparse random index vector made from its hash; its
word vector is the sum of the index vectors of the terms around it, over the training
rows, so nothing but hashing fixes the dimensions.  Word vectors are kept for BUCKETS
hashed terms.  A document is the mean and the spread of its terms' vectors, with three
ratios: distinct tokens, tokens equal to the one before, and log length.  A two-layer
network turns that into a logit; a temperature and an offset fitted on a part of the
training rows that the network doesn't see make its sigmoid a calibrated probability.

At most about ``max_rows`` labelled rows, picked evenly by a hash of the id, are used (a
classifier's documented bound); of rows that share an id one is used to learn, and each is scored.  Empty and null texts are scored as documents without
terms.  Without labels, or with one label only, the score is the share of label 1 (0.5
without any).  Texts of any length are pooled whole; repeated rows are each scored; of several labels of an id
the larger counts; equal documents have equal scores; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.llm.batches import keep_rows, map_rows, steps
from respondex.llm.language import held_out
from respondex.plans.staging import staged

#: Labelled rows; hashed terms; dimensions of a vector; entries of an index vector; terms on each side of a context.
MAX_ROWS, BUCKETS, DIM, SPARSE, NEAR = 20_000, 1 << 13, 48, 4, 2
#: Hidden units, passes over the training rows, share of them (1 in HOLD) that only calibrates, words a worker remembers.
HIDDEN, EPOCHS, HOLD, MAX_CACHE = 32, 60, 5, 150_000
#: Terms whose contexts are summed at once.
CHUNK = 60_000
_runs = regex.compile(r"\p{Lu}+|\p{L}+|\d+|[^\p{L}\d]+")


def shape(token: str) -> str:
    """Runs of a token as U, l, 9 or the sign itself: ``The!!`` gives ``Ul!``."""
    out = []
    for run in _runs.findall(token):
        c = run[0]
        out.append(("U" if c.isupper() else "l") if c.isalpha() else "9" if c.isdigit() else c)
    return "".join(out)


def bucket(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode()) % BUCKETS


def index_vectors() -> np.ndarray:
    """Sparse random vectors of the buckets: SPARSE entries of +1 or -1 placed by hash."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    for b in range(BUCKETS):
        for k in range(SPARSE):
            h = xxhash.xxh3_64_intdigest(f"{b}/{k}".encode())
            out[b, h % DIM] += 1.0 if h >> 63 else -1.0
    return out


class Terms:
    """Numbers of tokens' terms, remembered."""

    def __init__(self):
        self.cache: dict[str, tuple[int, int]] = {}
        self.shapes: dict[str, int] = {}

    def shape_bucket(self, token: str) -> int:
        name = "l" if token.isalpha() and token.islower() else shape(token)
        if name not in self.shapes:
            if len(self.shapes) > MAX_CACHE:
                self.shapes.clear()
            self.shapes[name] = bucket("s" + name)
        return self.shapes[name]

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(buckets of letters, buckets of shapes, tokens) of a text."""
        tokens = text.split() if text else []
        cache = self.cache
        if len(cache) > MAX_CACHE:
            cache.clear()
        for t in set(tokens).difference(cache):
            cache[t] = (bucket("w" + t.strip("!?.,;:%$#&*|\"'()[]").lower()), self.shape_bucket(t))
        both = np.array(list(map(cache.__getitem__, tokens)), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1], tokens


def context_sums(batches, index: np.ndarray):
    """Word vectors of a task's rows: for each bucket the sum of index vectors around it, in blocks of rows."""
    terms, sums = Terms(), np.zeros((BUCKETS, DIM), np.float32)
    seen: list[np.ndarray] = []
    around: list[np.ndarray] = []

    def flush() -> None:
        if seen:
            t, near = np.concatenate(seen), np.concatenate(around)
            for d in range(DIM):
                sums[:, d] += np.bincount(t, near[:, d], minlength=BUCKETS).astype(np.float32)
            seen.clear()
            around.clear()

    for step in steps(batches, "text"):
        for text in step.column("text").to_pylist():
            w, s, _ = terms.of(text)
            if len(w):
                at = index[w] + index[s]
                near = np.zeros_like(at)
                for k in range(1, NEAR + 1):
                    near[k:] += at[:-k]
                    near[:-k] += at[k:]
                seen += [w, s]
                around += [near, near]
                if sum(map(len, seen)) > CHUNK:
                    flush()
    flush()
    rows = 64
    yield pa.RecordBatch.from_pydict({"block": pa.array(range(BUCKETS // rows), pa.int32()), "sums": pa.array([sums[i * rows : (i + 1) * rows].tobytes() for i in range(BUCKETS // rows)], pa.binary())})


def pooled(texts: list[str | None], terms: Terms, vectors: np.ndarray) -> np.ndarray:
    """Feature rows of texts."""
    out = np.zeros((len(texts), 4 * DIM + 3), np.float64)
    for i, text in enumerate(texts):
        w, s, tokens = terms.of(text)
        n = len(tokens)
        if not n:
            continue
        for at, t in ((0, w), (2 * DIM, s)):
            b, k = np.unique(t, return_counts=True)
            v = vectors[b]
            mean = k @ v / n
            out[i, at : at + DIM] = mean
            out[i, at + DIM : at + 2 * DIM] = np.sqrt(np.maximum(k @ (v * v) / n - mean * mean, 0))
        out[i, -3:] = len(set(tokens)) / n, np.count_nonzero(w[1:] == w[:-1]) / n, np.log1p(n) / 10
    return out


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> dict:
    """Two-layer network by Adam on the rows of fold False, calibration on the others; always the same for the same rows."""
    base = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or base in (0.0, 1.0) or fold.all():
        return {"base": base}
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / std
    rng = np.random.default_rng(7)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    zt, yt, step = z[~fold], y[~fold], 0
    # labels are uneven: each class weighs as much as the square root of its share would
    weight = np.where(yt == 1, (1 / max(base, 1e-3)) ** 0.5, (1 / max(1 - base, 1e-3)) ** 0.5)
    weight /= weight.mean()
    for _ in range(EPOCHS):
        order = rng.permutation(len(zt))
        for at in range(0, len(order), 256):
            b = order[at : at + 256]
            h = np.tanh(zt[b] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - yt[b]) * weight[b] / len(b)
            back = np.outer(err, p[2]) * (1 - h * h)
            grads = [zt[b].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ err + 1e-4 * p[2], np.array([err.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = {"mean": mean, "std": std, "p": p, "temperature": 1.0, "offset": 0.0}
    if fold.any():
        net["temperature"], net["offset"] = calibration(logits(x[fold], net), y[fold])
    return net


def calibration(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature and offset of largest likelihood (Newton steps, drawn a little to 1 and 0; temperatures from 1/4 to 8).

    The network's class weights move its prior; the offset moves it back.
    """
    a, c = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * raw + c, -50, 50)))
        w = q * (1 - q)
        g = np.array([raw @ (q - y) + (a - 1), (q - y).sum() + c])
        h = np.array([[w @ (raw * raw) + 1, w @ raw], [w @ raw, w.sum() + 1]])
        move = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, c = float(np.clip(a - move[0], 0.125, 4.0)), float(c - move[1])
    return 1 / a, c / a


def logits(x: np.ndarray, net: dict) -> np.ndarray:
    z = (x - net["mean"]) / net["std"]
    return np.tanh(z @ net["p"][0] + net["p"][1]) @ net["p"][2] + net["p"][3]


def probabilities(x: np.ndarray, net: dict) -> np.ndarray:
    if "base" in net:
        return np.full(len(x), net["base"])
    return 1 / (1 + np.exp(-np.clip((logits(x, net) + net["offset"]) / net["temperature"], -50, 50)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> dict:
    """Word vectors and network from documents joined to labels (0/1; null labels, ids and clashing columns don't count)."""
    spark = docs.sparkSession
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    n, share = y.count(), 1 << 20
    if n > max_rows:
        y = y.where(F.pmod(F.xxhash64("id"), F.lit(share)) < max_rows * share // n)
    y = staged(y, "quality-labels")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(rows.join(F.broadcast(y), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "quality-rows")  # at most about max_rows rows
    index = index_vectors()
    sent = spark.sparkContext.broadcast(index)
    parts = rows.select("text").coalesce(24).mapInArrow(lambda batches: context_sums(batches, sent.value), "block int, sums binary")

    def add(pdf):
        import pandas as pd

        return pd.DataFrame({"block": [pdf["block"][0]], "sums": [np.sum([np.frombuffer(b, np.float32) for b in pdf["sums"]], axis=0).astype(np.float32).tobytes()]})

    vectors = np.zeros((BUCKETS // 64, 64 * DIM), np.float32)
    for r in parts.groupBy("block").applyInPandas(add, "block int, sums binary").collect():
        vectors[r["block"]] = np.frombuffer(r["sums"], np.float32)
    vectors = vectors.reshape(BUCKETS, DIM)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-6
    table = spark.sparkContext.broadcast(vectors)

    def make():
        terms = Terms()

        def f(batch: pa.RecordBatch) -> dict:
            x = pooled(batch.column("text").to_pylist(), terms, table.value).astype(np.float32)
            return {"id": batch.column("id"), "y": batch.column("y"), "x": [r.tobytes() for r in x]}

        return f

    # at most about max_rows rows of 195 numbers
    got = map_rows(rows, f"id {rows.schema['id'].dataType.simpleString()}, y int, x binary", "text", make).orderBy("id").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float64).reshape(len(got), 4 * DIM + 3)
    fold = np.array([xxhash.xxh3_64_intdigest(str(r["id"]).encode()) % HOLD == 0 for r in got], bool)
    return {"vectors": vectors, "net": fit(x, np.array([r["y"] for r in got], float), fold)}


def scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row: the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        terms = Terms()
        return lambda batch: {"id": batch.column("id"), "score": probabilities(pooled(batch.column("text").to_pylist(), terms, sent.value["vectors"]), sent.value["net"])}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, f"id {rows.schema['id'].dataType.simpleString()}, score double", "text", make).withColumnRenamed("id", id_col)


def good(docs: DataFrame, model: dict, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """Rows of docs, all columns unchanged, with a score of at least ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        terms = Terms()
        return lambda texts: (probabilities(pooled(texts, terms, sent.value["vectors"]), sent.value["net"]) >= least).tolist()

    return keep_rows(docs, text_col, make)


def op6(spark, sf_dir: str) -> DataFrame:
    """Contract query: labels of the folds other than 2 of 4, applied to all documents."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    model = learn(read("documents"), read("labels").where(~held_out("doc_id", 4, 2)))
    return scores(read("documents"), model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
