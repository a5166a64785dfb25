"""SimHash near-duplicates by vantage-point trees.

A document's fingerprint has a bit set if more than half the hashes of its shingles, repeats
included, have it set.  Two documents link if their fingerprints differ in at most
``limit`` bits; every link is found.

1. Equal fingerprints become one point, with the least id that has it.
2. The distances of two points to a vantage point differ by at most their own distance, and by
   an even number exactly if that is even.  So pairs an even number of bits apart are found among the points
   of equal parity, pairs an odd number apart between the two parities, and in each case only every
   other distance occurs: there are three joins, two within a parity and one across.
3. For each join a vantage-point tree is fitted on a bounded sample of the points (``SAMPLE``): a node
   has a vantage point and a radius, chosen among a few by the comparisons that they leave; its leaves are
   shards.  Each point goes down the tree; by the triangle inequality a branch that holds no point within
   the limit is pruned, and points near the boundary also go to the shard beyond it (of one side, if the
   join has two).  So each linked pair meets in a shard, whichever sample the tree came from.
4. The points of a shard are compared exactly, in dense blocks.  A shard of more than
   ``BLOCK`` points (many near copies, that no radius divides) is cut into blocks, and each pair
   of blocks is a task's group.  A group hands on a spanning forest of its links, never all pairs.
5. Connected components of the forests, and the least document id in each.

On fingerprints like random bits, which no radius divides well, the points of all shards grow as the
1.36th power of the points within a parity and as the 1.45th across.

Null and empty texts have fingerprint zero, linked like any other.  Null ids take part, but
never name a component unless no other id is in it (then null).  Ties of radii go to the
smaller one.  Texts of any length are hashed in parts; repeated rows are one point; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.llm.batches import give_back, map_rows
from respondex.operators.components import connected_components
from respondex.plans.shipping import ship
from respondex.plans.skew import broadcast_if_small
from respondex.plans.staging import discard, staged

#: Points that a tree is fitted on, points of a shard that is worth no further radius, points of a block of a larger shard, vantage points tried for a node.
SAMPLE, LEAF, BLOCK, TRIED = 32_768, 8_192, 16_384, 8
#: Hashes counted at once, rows of a block compared at once, links held before they are reduced.
COUNTED, ROWS, HELD = 65_536, 128, 500_000

_U = np.uint64


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint of a text as a signed 64-bit number; words are split at ASCII white space, A-Z lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, step = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - step + 1].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[step - 1 :].tolist(), strict=True)], _U)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id long, fp long)`` of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, "id long, fp long", "text", lambda: lambda b: {"id": b.column("id"), "fp": [fingerprint(t, size) for t in b.column("text").to_pylist()]})


class Tree:
    """A vantage-point tree of a join: shards in which all pairs of points at most ``limit`` apart meet.

    Points have a side; a join of two sides needs pairs across only.  A node is ``(vantage, radius,
    reach of side 0, reach of side 1, inner, outer)``: points up to the radius plus their side's first reach
    go to the inner child, those beyond the radius less its second reach to the outer one.
    A negative child is shard ``-1 - child``.
    """

    def __init__(self, sides: list[np.ndarray], total: int, limit: int, leaf: int = LEAF, seed: int = 7):
        self.limit, self.nodes, self.shards = limit, [], 0
        self._rng, self._least = np.random.default_rng(seed), max(leaf * sum(map(len, sides)) / max(total, 1), 16)
        self.root = self._grow(sides)

    def _reaches(self, sides: int) -> list[list[tuple[int, int]]]:
        """The choices of reaches (inner, outer) of each side: one side alone, or either of two, crosses the boundary."""
        return [[(0, self.limit)]] if sides == 1 else [[(self.limit, self.limit), (0, 0)], [(0, 0), (self.limit, self.limit)]]

    def _grow(self, sides: list[np.ndarray]) -> int:
        best = self._split(sides) if sum(map(len, sides)) > self._least * len(sides) and all(map(len, sides)) else None
        if best is None:
            self.shards += 1
            return -self.shards
        vantage, radius, reach = best
        self.nodes.append(None)
        at, inner, outer = len(self.nodes) - 1, [], []
        for points, (i, o) in zip(sides, reach, strict=True):
            d = np.bitwise_count(points ^ vantage).astype(np.int64)
            inner.append(points[d <= radius + i])
            outer.append(points[d > radius - o])
        self.nodes[at] = (vantage, radius, reach, self._grow(inner), self._grow(outer))
        return at

    def _split(self, sides: list[np.ndarray]) -> tuple[np.uint64, int, list[tuple[int, int]]] | None:
        """The vantage point, radius and reaches that leave the fewest comparisons; None if those are hardly fewer than all."""
        product = lambda x: x[0].astype(np.float64) * x[-1]  # noqa: E731  of one side with itself, or of two
        sizes = [np.array([len(p)]) for p in sides]
        best, radii = (0.97 * float(product(sizes)[0]), None), np.arange(65)
        for vantage in self._rng.choice(np.concatenate(sides), TRIED):
            upto = [np.concatenate([[0], np.cumsum(np.bincount(np.bitwise_count(p ^ vantage), minlength=65))]) for p in sides]
            for reach in self._reaches(len(sides)):
                inner = [u[np.minimum(radii + i, 64) + 1] for u, (i, _) in zip(upto, reach, strict=True)]
                outer = [u[-1] - u[np.maximum(radii - o, -1) + 1] for u, (_, o) in zip(upto, reach, strict=True)]
                cost = product(inner) + product(outer)
                radius = int(np.argmin(cost))
                if cost[radius] < best[0]:
                    best = (cost[radius], (vantage, radius, reach))
        return best[1]

    def shards_of(self, points: np.ndarray, side: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """``(index of the point, shard)`` of all shards that a point of this side goes to."""
        index, shard, todo = [], [], [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                index.append(at)
                shard.append(np.full(len(at), -1 - node, np.int32))
                continue
            vantage, radius, reach, inner, outer = self.nodes[node]
            d = np.bitwise_count(points[at] ^ vantage).astype(np.int64)
            todo += [(inner, at[d <= radius + reach[side][0]]), (outer, at[d > radius - reach[side][1]])]
        return (np.concatenate(index), np.concatenate(shard)) if index else (np.empty(0, np.int64), np.empty(0, np.int32))


def odd(points: np.ndarray) -> np.ndarray:
    """Whether a point has an odd number of set bits."""
    return (np.bitwise_count(points) & 1).astype(bool)


def joins(sample: np.ndarray, total: int, limit: int, leaf: int = LEAF) -> list[tuple[Tree, list[int]]]:
    """The trees of the joins that find all pairs at most ``limit`` apart, each with the parities of its sides."""
    parts = [sample[~odd(sample)], sample[odd(sample)]]
    across = [(Tree(parts, total, limit - 1 + limit % 2, leaf), [0, 1])] if limit else []
    return [*[(Tree([p], -(-total // 2), limit - limit % 2, leaf), [k]) for k, p in enumerate(parts)], *across]


def rooted(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a - b joined them: the least index of each component."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        label = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def forest(x: np.ndarray, y: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links within x (of x with y, if given) connect, at most one a point."""
    points = x if y is None else np.concatenate([x, y])
    label, held, n = np.arange(len(points)), [], 0
    for at in range(0, len(x), ROWS):
        rows = x[at : at + ROWS, None]
        others, first = (x[at:], at) if y is None else (y, len(x))
        i, j = np.nonzero(np.bitwise_count(rows ^ others[None, :]) <= limit)
        i, j = i + at, j + first
        held.append((i[i != j], j[i != j]))
        n += len(i)
        if n > HELD:
            label, held, n = rooted(label, *map(np.concatenate, zip(*held, strict=True))), [], 0
    if held:
        label = rooted(label, *map(np.concatenate, zip(*held, strict=True)))
    own = np.flatnonzero(label != np.arange(len(points)))
    return points[own], points[label[own]]


class NearDuplicates:
    """Components of ``docs`` by fingerprints that differ in at most ``limit`` bits.

    size: words of a shingle.  sample, leaf, block: see the module; they change the work, never the result.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, limit: int = 3, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK):
        self.spark, self.limit, self.sample, self.leaf, self.block = docs.sparkSession, limit, sample, leaf, block
        self.rows = staged(fingerprints(docs, id_col, text_col, size), "simhash-rows")
        self.points = staged(self.rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("k")), "simhash-points")

    def trees(self) -> list[tuple[Tree, list[int]]]:
        """The joins, fitted on at most ``sample`` points, taken by a hash of theirs."""
        total = self.points.count()
        share = int(min(1.0, self.sample / max(total, 1)) * (1 << 30))
        some = self.points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < share).select("fp").limit(self.sample).toArrow()
        return joins(np.sort(some["fp"].to_numpy()).view(_U), total, self.limit, self.leaf)

    def sharded(self) -> DataFrame:
        """``(tree, shard, side, fp)``: every point in its own shards and in those whose boundary it is near."""
        trees = self.spark.sparkContext.broadcast(self.trees())

        def run(batches):
            for batch in batches:
                all_points = batch.column("fp").to_numpy().view(_U)
                parts = [all_points[~odd(all_points)], all_points[odd(all_points)]]
                for n, (tree, sides) in enumerate(trees.value):
                    for side, parity in enumerate(sides):
                        index, shard = tree.shards_of(parts[parity], side)
                        same = lambda x: pa.array(np.full(len(index), x, np.int32))  # noqa: E731,B023
                        yield pa.RecordBatch.from_pydict({"tree": same(n), "shard": pa.array(shard), "side": same(side), "fp": pa.array(parts[parity][index].view(np.int64))})
            give_back()

        ship(self.spark)
        return self.points.select("fp").mapInArrow(run, "tree int, shard int, side int, fp long")

    def links(self) -> DataFrame:
        """Links ``(src, dst)`` between fingerprints that connect all that is linked."""
        key, across = ["tree", "shard"], 2
        sharded = staged(self.sharded(), "simhash-shards")
        cut = lambda side: F.ceil(F.count_if(F.col("side") == side) / self.block).cast("int")
        blocks = sharded.groupBy(*key).agg(cut(0).alias("b0"), cut(1).alias("b1")).where((F.col("tree") < across) | (F.col("b1") > 0))
        mine = F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))
        other = F.when((F.col("tree") == across) & (F.col("side") == 0), F.col("b1")).otherwise(F.col("b0"))
        dealt = sharded.join(broadcast_if_small(blocks), key).withColumns({"own": F.pmod(F.xxhash64("fp", F.lit(1)), mine).cast("int"), "others": other}).where("others > 0")
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        first = F.when(F.col("tree") < across, F.least("own", "other")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
        second = F.when(F.col("tree") < across, F.greatest("own", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
        tiles = dealt.select(*key, first.alias("x"), second.alias("y"), "own", "side", "fp")
        limit = self.limit

        def compared(table: pa.Table) -> pa.Table:
            own, side, fp = table["own"].to_numpy(), table["side"].to_numpy(), table["fp"].to_numpy().view(_U)
            tree, x, y = (table[c][0].as_py() for c in ("tree", "x", "y"))
            left = side == 0 if tree == across else own == x
            src, dst = forest(fp, None, limit) if tree < across and x == y else forest(fp[left], fp[~left], limit)
            return pa.table({"src": src.view(np.int64), "dst": dst.view(np.int64)})

        ship(self.spark)
        found = staged(tiles.groupBy(*key, "x", "y").applyInArrow(compared, "src long, dst long").distinct(), "simhash-links")
        discard(sharded)
        return found

    def components(self) -> DataFrame:
        """``(id, fp, component)`` of each row of docs; component is the least id reachable."""
        links = self.links()
        of = staged(connected_components(links).withColumnRenamed("node", "fp"), "simhash-components")
        linked = self.points.join(broadcast_if_small(of), "fp")
        least = linked.groupBy("component").agg(F.min("first").alias("least"))
        named = linked.select("fp", "component").join(broadcast_if_small(least), "component").select("fp", "least")
        # a fingerprint of one row that links with none names its own component
        alone = self.points.where("k > 1").select("fp", F.col("first").alias("least")).join(broadcast_if_small(of.select("fp")), "fp", "left_anti")
        named = staged(named.unionByName(alone), "simhash-named")
        discard(links, of)
        return self.rows.join(broadcast_if_small(named), "fp", "left").select("id", "fp", F.coalesce("least", "id").alias("component"))


def op12(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of whole documents from 3-word shingles, linked at 3 bits or fewer."""
    found = NearDuplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, limit=3).components()
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
