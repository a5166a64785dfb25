"""Connected components of an edge table.

Each task first reduces its edges to a union-find forest, of which at most one edge a node
leaves it.  Then rounds of alternating star contraction: every node points at the
least node that it sees, first from its larger neighbours, then from its smaller ones, so that chains
shrink geometrically; the edges that a task makes in a round are reduced to a forest again before they are
written.  No adjacency list is ever held by one task: a node's neighbours are
reduced with ``min`` (combined before the shuffle) and joined back.  A hub, a node of more than ``HUB``
edges, is no join key: hubs are few by their definition, so their minima are broadcast (after
a count) and their edges stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.plans.shipping import ship
from respondex.plans.skew import broadcast_if_small
from respondex.plans.staging import discard, staged

#: Edges of a node that make it a hub, and edges that a task reduces at a time.
HUB, HELD = 4_096, 1 << 18


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each component, for nodes 0 to n - 1 and edges a - b."""
    label = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label[label], label):
            label = label[label]
    return label


def forest(edges: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Edges (node u, least node v of its component), one for each node that isn't the least of its own; the list is emptied."""
    n = sum(b.num_rows for b in edges)
    ends = pa.concat_arrays([b.column(c) for c in "uv" for b in edges]).dictionary_encode()
    edges.clear()  # their memory is not needed any more
    names, code = ends.dictionary, ends.indices.to_numpy()
    order = pc.sort_indices(names).to_numpy()
    place = np.empty(len(order), np.int32)  # as the indices of a dictionary
    place[order] = np.arange(len(order), dtype=np.int32)
    code = place[code]
    label = least_labels(len(order), code[:n], code[n:])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(order[moved])), names.take(pa.array(order[label[moved]]))], ["u", "v"])


def in_forests(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what the edges of each task connect, at most one a node and step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                held = [forest(held)]
                n = held[0].num_rows
                if n > HELD // 2:
                    yield held.pop()
                    n = 0
        if held:
            yield forest(held)

    ship(edges.sparkSession)
    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with ``m`` of least (u, m, k) by u; hubs are joined by broadcast."""
    hubs = broadcast_if_small(least.where(F.col("k") > HUB).select("u", F.col("m").alias("hub")))
    d = edges.join(hubs, "u", "left")
    done = d.where("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m"))
    rest = d.where("hub IS NULL").select("u", "v").join(least.where(F.col("k") <= HUB).select("u", "m"), "u")
    return done.unionByName(rest.select("u", "v", "m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the least node reachable.

    Null ends and self loops link nothing (a node with only a self loop is its own
    component).  An empty table gives an empty result.
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = raw.where("u = v").select(F.col("u").alias("node"))
    e = staged(in_forests(raw.where("u <> v")), "cc-edges")
    alone = staged(loops.distinct(), "cc-loops")
    for _ in range(max_rounds):
        if is_stars(e):
            break
        # large star: each node's larger neighbours, and the node, move to the least node that it sees
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k")), "cc-least")
        big = with_least(e.select(F.col("v").alias("u"), F.col("u").alias("v")), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        big = staged(in_forests(big), "cc-edges")
        discard(least, e)
        # small star: a node and its smaller neighbours move to the least of them
        least = staged(big.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), "cc-least")
        ends = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")
        e = staged(in_forests(with_least(big, least).select(ends).select("p.u", "p.v").where("u <> v")), "cc-edges")
        discard(least, big)
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    named = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    own = e.select(F.col("v").alias("node")).unionByName(alone).distinct()
    return named.unionByName(own.join(named.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))


def is_stars(e: DataFrame) -> bool:
    """Whether edges (u, v), v the lesser, are stars already: no u has two v, and no v is a u."""
    ends = e.distinct().select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return ends.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 1 OR (a > 0 AND b > 0)").isEmpty()
