"""Exact Jaccard self-join of documents on word n-grams (size-aware, heavy and light).

A document's set holds its distinct word n-grams.  Two documents link when
``100 * |A & B| >= percent * |A | B|``.  Every link is found; nothing is capped.

1. Equal sets become one class, represented by its least id (hash aggregation).
2. Light sets (at most ``boundary`` members) enumerate fixed-size subsets: linked
   sets share the subset that is left when at most ``floor((100-percent)/100 * n)``
   members are deleted from either.
3. Heavy sets are put on inverted lists of single members, and only lists with two
   classes are scanned.  A set of n is on the lists of its first
   ``n - ceil(percent/100 * n) + 1`` members in an order that all sets share; linked sets
   meet on the list of the first member that they share.  The order puts members that many
   documents use last, so a common passage makes no long list.  How common a member is
   comes from bounded counts of all tasks; any order gives the same links.
4. ``boundary`` is the cheaper of the possible ones, by the keys that the sizes of all
   classes would emit.  Sets just below it also emit heavy keys, so no pair falls between.
5. On a list two classes are a pair only if their sizes and their places on it allow enough
   common members.  Each class first meets one hub of its list (never all pairs).  What is
   then connected needs no more comparisons; lists that still hold several components
   are tried with other hubs, and at last the classes outside a list's largest component
   meet the rest, in as many tasks as the list is long.  Pairs whose parity sketches
   prove too many differences are dropped; others are checked exactly on their texts.

Ids: rows that share an id are one document; rows with a null id get a null component.
Null and empty texts have no set, ``n_shingles`` 0 and link with nothing.  Repeated rows
are one document, or one class if their ids differ.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.llm.batches import give_back, map_rows, steps
from respondex.operators.components import connected_components
from respondex.plans.shipping import ship
from respondex.plans.skew import BROADCAST_ROWS
from respondex.plans.staging import discard, release, staged

#: What a heavy key costs, in light keys: its list may be scanned and its pairs compared.
SCAN_COST = 4
#: Rounds with other hubs before the remaining lists are compared outright.
STAR_ROUNDS = 3
#: Common members: members that a task holds at once, counts, and hands on; least uses in all and entries of the broadcast table.
HELD, COUNTED, OF_TASK, USES, COMMON = 1_000_000, 200_000, 50_000, 8, 500_000
#: Entries of a list that one task compares with the classes outside the list's largest component.
PER_SALT = 512

_USES = pa.list_(pa.struct([("m", pa.int64()), ("k", pa.int64())]))
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; words are split at ASCII white space, A-Z lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, _U)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], _U)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    n = len(w) - size + 1
    h = w[:n]
    for k in range(1, size):
        h = mixed(h * _A + _U(k)) ^ (w[k : k + n] * _B)
    return np.unique(mixed(h))


def sketch(members: np.ndarray) -> bytes:
    """Parities of the members dealt to cells, one bit each; as many cells as members, up to the next power of two (64 at least)."""
    cells = 1 << max(6, (len(members) - 1).bit_length())
    odd = np.bincount((members * _C >> _U(20)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Cells in which two sketches differ, the longer one folded to the shorter; never above the symmetric difference of the sets."""
    if len(x) < len(y):
        x, y = y, x
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    for size in range(len(x).bit_length() - 2, len(y).bit_length() - 2, -1):
        bits = 8 << size
        a = (a >> bits) ^ (a & ((1 << bits) - 1))
    return (a ^ b).bit_count()


def listed(n: int, percent: int) -> int:
    """Members by which a set of n is on inverted lists."""
    return n + n * -percent // 100 + 1


def deletions(n: int, percent: int) -> int:
    """Members that a set of n can lack in a linked one."""
    return n * (100 - percent) // 100


def light_cost(n: int, percent: int) -> int:
    return sum(comb(n, a) for a in range(deletions(n, percent) + 1))


def light_keys(members: np.ndarray, percent: int) -> np.ndarray:
    """A key for each subset that lacks at most deletions(n) members."""
    m = mixed(members)
    total, n = m.sum(dtype=_U), len(m)
    out = []
    for a in range(deletions(n, percent) + 1):
        gone = np.array([m[list(c)].sum(dtype=_U) for c in combinations(range(n), a)], _U) if a > 1 else m if a else np.zeros(1, _U)
        out.append(mixed((total - gone) * _A + _U(n - a)))
    return np.concatenate(out)


def heavy_keys(members: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first listed(n) members in order: rarely used ones first, then by hash; common: sorted members and the size class of their uses."""
    known, uses = common
    m = mixed(members + _C)
    n = listed(len(members), percent)
    if not len(known):
        return np.sort(m)[:n]
    at = np.minimum(np.searchsorted(known, members), len(known) - 1)
    use = np.where(known[at] == members, uses[at], 0)
    rare = m[use == 0]
    if len(rare) >= n:
        return np.sort(rare)[:n]
    return m[np.lexsort((m, use))[:n]]


class Uses:
    """Counts of the members that a task sees repeatedly, in bounded memory; the least used are forgotten first."""

    def __init__(self):
        self.held, self.n = [], 0
        self.m, self.k = np.empty(0, _U), np.empty(0, np.int64)

    def add(self, sets: list[np.ndarray]) -> None:
        self.held += sets
        self.n += sum(map(len, sets))
        if self.n >= HELD:
            self.settle()

    def settle(self) -> None:
        m, k = np.unique(np.concatenate([*self.held, np.empty(0, _U)]), return_counts=True)
        old = np.isin(m, self.m, assume_unique=True)
        keep = (k > 1) | old
        m, at = np.unique(np.concatenate([self.m, m[keep]]), return_inverse=True)
        k = np.bincount(at, np.concatenate([self.k, k[keep]]), len(m)).astype(np.int64)
        order = np.sort(np.lexsort((m, -k))[:COUNTED])
        self.m, self.k, self.held, self.n = m[order], k[order], [], 0

    def top(self) -> list[dict]:
        self.settle()
        order = np.lexsort((self.m, -self.k))[:OF_TASK]
        return [{"m": m, "k": k} for m, k in zip(self.m[order].view(np.int64).tolist(), self.k[order].tolist(), strict=True)]


class JaccardJoin:
    """The join over ``docs`` with columns ``id_col`` (integer) and ``text_col``.

    size: words of an n-gram.  percent: whole-number similarity limit, 50 to 99.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90):
        if not 50 <= percent <= 99:
            raise ValueError("percent is a whole number from 50 to 99")
        self.docs = docs.select(F.col(id_col).cast("long").alias("cid"), F.col(text_col).cast("string").alias("text"))
        self.size, self.percent = size, percent
        self._members: DataFrame | None = None
        self._components: DataFrame | None = None

    # step 1: sets and classes
    def members(self) -> DataFrame:
        """``(cid, n, digest, sketch)`` of each row of docs."""
        if self._members is None:
            size, kind = self.size, "cid long, n int, digest binary, sketch binary, uses array<struct<m:long,k:long>>"
            ship(self.docs.sparkSession)

            def run(batches):
                uses = Uses()
                for batch in steps(batches, "text"):
                    sets = [shingles(text, size) for text in batch.column("text").to_pylist()]
                    uses.add(sets)
                    digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                    sketches = pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())
                    yield pa.RecordBatch.from_pydict({"cid": batch.column("cid"), "n": pa.array([len(s) for s in sets], pa.int32()), "digest": digests, "sketch": sketches, "uses": pa.nulls(len(sets), _USES)})
                give_back()
                yield pa.RecordBatch.from_pydict({"cid": pa.nulls(1, pa.int64()), "n": pa.array([0], pa.int32()), "digest": pa.nulls(1, pa.binary()), "sketch": pa.nulls(1, pa.binary()), "uses": pa.array([uses.top()], _USES)})

            self._all = staged(self.docs.mapInArrow(run, kind), "jaccard-members")
            self._members = self._all.where("uses IS NULL").drop("uses")
        return self._members

    def live(self) -> DataFrame:
        return self.members().where("n > 0 AND cid IS NOT NULL")

    def classes(self) -> DataFrame:
        """``(digest, rep, n)``: each distinct set and the least id that has it."""
        return self.live().groupBy("digest").agg(F.min("cid").alias("rep"), F.min("n").alias("n"))

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """The COMMON most used members, sorted, and the binary logarithms of their uses."""
        self.members()
        total = self._all.where("uses IS NOT NULL").select(F.explode("uses").alias("u")).groupBy("u.m").agg(F.sum("u.k").alias("k")).where(F.col("k") >= USES)
        rows = total.orderBy(F.desc("k"), "m").limit(COMMON).toArrow()
        m = rows["m"].to_numpy().astype(np.int64).view(_U)
        order = np.argsort(m)
        return m[order], np.log2(rows["k"].to_numpy().astype(np.float64)[order]).astype(np.uint8)

    # step 4: the boundary
    def boundary(self, sizes: list[tuple[int, int]]) -> int:
        """Largest light size, by the keys that all classes would emit; sizes: (n, classes of n members)."""
        percent = self.percent
        step = 100 // (100 - percent)
        choices = range(step - 1, 5 * step, step)
        cost = {x: sum(k * ((light_cost(n, percent) if n <= x else 0) + (listed(n, percent) * SCAN_COST if 100 * n > percent * x else 0)) for n, k in sizes) for x in choices}
        return min(cost, key=lambda x: (cost[x], x))

    def keys(self, reps: DataFrame, boundary: int) -> DataFrame:
        """``(key, cid, n, pos)``: the subsets and lists of each representative, with the size of its set and its place on the list."""
        size, percent = self.size, self.percent
        sent = self.docs.sparkSession.sparkContext.broadcast(self.common())

        def make():
            def f(batch: pa.RecordBatch) -> dict:
                keys, owners, sizes, places = [np.empty(0, _U)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
                for cid, text in zip(batch.column("cid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    s = shingles(text, size)
                    n = len(s)
                    if not n:
                        continue
                    light = light_keys(s, percent) if n <= boundary else np.empty(0, _U)
                    heavy = heavy_keys(s, percent, sent.value) if 100 * n > percent * boundary else np.empty(0, _U)
                    keys += [light, heavy]
                    places += [np.zeros(len(light), np.int32), np.arange(len(heavy), dtype=np.int32)]
                    owners.append(np.full(len(light) + len(heavy), cid, np.int64))
                    sizes.append(np.full(len(light) + len(heavy), n, np.int32))
                return {"key": pa.array(np.concatenate(keys).view(np.int64)), "cid": pa.array(np.concatenate(owners)), "n": pa.array(np.concatenate(sizes)), "pos": pa.array(np.concatenate(places))}

            return f

        return map_rows(reps, "key long, cid long, n int, pos int", "text", make)

    def texts(self, ids: DataFrame, n_ids: int, how: str = "left_semi") -> DataFrame:
        """Rows of docs whose id is (left_anti: is not) in ids; ids is broadcast only if its counted rows are few."""
        ids = ids.select(F.col(ids.columns[0]).alias("cid"))
        return self.docs.where("cid IS NOT NULL").join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids, "cid", how)

    def possible(self, na, nb, pa_, pb):
        """Whether two sets of these sizes, whose first common member may have these places, can have enough common members."""
        least, left = (na + nb) * self.percent, F.least(na - pa_, nb - pb)
        return (F.least(na, nb) * 100 >= F.greatest(na, nb) * self.percent) & (left * (100 + self.percent) >= least)

    def close(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs ``(a, b, k)`` that sketches don't rule out; k is the number of lists on which they met, sketches ``(cid, n, sketch)``."""
        p = self.percent
        side = lambda c: sketches.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

        def make():
            def f(batch: pa.RecordBatch) -> dict:
                rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True)
                mask = pa.array([differing(sa, sb) * (100 + p) <= (na + nb) * (100 - p) for na, nb, sa, sb in rows], pa.bool_())
                return {c: batch.column(c).filter(mask) for c in ("a", "b", "k")}

            return f

        counted = pairs.groupBy("a", "b").agg(F.count("*").alias("k"))
        return map_rows(counted.join(side("a"), "a").join(side("b"), "b"), "a long, b long, k long", "sa", make)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sets, made anew from the texts, are similar enough."""
        size, percent = self.size, self.percent
        pairs = staged(pairs.select("a", "b"), "jaccard-pairs")
        if pairs.isEmpty():
            return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "jaccard-ids")
        texts = self.texts(ids, ids.count())
        side = lambda c: texts.select(F.col("cid").alias(c), F.col("text").alias(f"t{c}"))

        def make():
            def f(batch: pa.RecordBatch) -> dict:
                good, sets = [], {}
                for b, x, y in zip(batch.column("b").to_pylist(), batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                    x = shingles(x, size)
                    y = sets[b] if b in sets else sets.setdefault(b, shingles(y, size))
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(same > 0 and 100 * same >= percent * (len(x) + len(y) - same))
                mask = pa.array(good, pa.bool_())
                return {"src": batch.column("a").filter(mask), "dst": batch.column("b").filter(mask)}

            return f

        found = staged(map_rows(pairs.join(side("a"), "a").join(side("b"), "b"), "src long, dst long", "ta", make), "jaccard-links")
        discard(pairs, ids)
        return found

    def links(self) -> DataFrame:
        """Checked links (src, dst) between class representatives that connect all that is linked."""
        reps = staged(self.classes().select(F.col("rep").alias("cid"), "n", "digest"), "jaccard-classes")
        sketches = staged(self.live().join(reps.select("cid", "digest"), ["cid", "digest"], "left_semi").select("cid", "n", "sketch").dropDuplicates(["cid"]), "jaccard-sketches")
        copies = staged(self.live().select("cid").distinct().join(reps.select("cid"), "cid", "left_anti"), "jaccard-copies")
        histogram = [(r["n"], r["k"]) for r in reps.groupBy("n").agg(F.count("*").alias("k")).collect()]
        keys = staged(self.keys(self.texts(copies, copies.count(), "left_anti"), self.boundary(histogram)), "jaccard-keys")
        shared = staged(keys.groupBy("key").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x < y").select("key"), "jaccard-shared")
        lists = staged(keys.join(shared, "key").withColumn("component", F.col("cid")), "jaccard-lists")
        discard(keys, shared, copies, reps)
        release(self.docs.sparkSession)
        links = None
        for turn in range(STAR_ROUNDS):
            if lists.isEmpty():
                break
            found = self.verified(self.stars(lists, sketches, turn))
            links = found if links is None else staged(links.unionByName(found), "jaccard-links")
            lists = self.open_lists(lists, links)
            release(self.docs.sparkSession)
        if not lists.isEmpty():
            links = links.unionByName(self.verified(self.close(self.rest(lists), sketches)))
        discard(sketches, lists)
        return links if links is not None else lists.select(F.col("cid").alias("src"), F.col("cid").alias("dst")).limit(0)

    def stars(self, lists: DataFrame, sketches: DataFrame, turn: int) -> DataFrame:
        """For each class the hub that it meets on most lists, of those in other components that sizes, places and sketches don't rule out."""
        order = F.col("cid") if turn == 0 else F.xxhash64("cid", F.lit(turn))
        hubs = lists.groupBy("key").agg(F.min(F.struct(order.alias("o"), "cid", "n", "pos", "component")).alias("h")).select("key", F.col("h.cid").alias("b"), F.col("h.n").alias("nb"), F.col("h.pos").alias("pb"), F.col("h.component").alias("of"))
        met = lists.join(hubs, "key").where((F.col("component") != F.col("of")) & self.possible(F.col("n"), F.col("nb"), F.col("pos"), F.col("pb")))
        close = self.close(met.select(F.col("cid").alias("a"), "b"), sketches)
        return close.groupBy("a").agg(F.max_by("b", F.struct("k", -F.col("b"))).alias("b"))

    def open_lists(self, lists: DataFrame, links: DataFrame) -> DataFrame:
        """Entries of the lists whose classes are not all connected yet, with their components."""
        known = connected_components(links).withColumnRenamed("node", "cid")
        at = staged(lists.drop("component").join(known, "cid", "left").select("key", "cid", "n", "pos", F.coalesce("component", "cid").alias("component")), "jaccard-at")
        apart = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        found = staged(at.join(apart, "key"), "jaccard-open")
        discard(at, lists)
        return found

    def rest(self, lists: DataFrame) -> DataFrame:
        """Pairs of an open list in different components that sizes and places allow, one end outside the list's largest component."""
        per = lists.groupBy("key", "component").agg(F.count("*").alias("k"))
        main = staged(per.groupBy("key").agg(F.max(F.struct("k", "component")).alias("m"), F.ceil(F.sum("k") / PER_SALT).cast("int").alias("salts")).select("key", F.col("m.component").alias("main"), "salts"), "jaccard-main")
        full = staged(lists.join(main, "key"), "jaccard-full")
        side = lambda x, c: x.select("key", "salt", *[F.col(f).alias(f"{g}{c}") for f, g in (("cid", ""), ("n", "n"), ("pos", "p"), ("component", "c"))], *["main"] * (c == "b"))
        outside = side(full.where("component <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), "a")
        others = side(full.withColumn("salt", F.pmod(F.xxhash64("cid"), "salts").cast("int")), "b")
        on = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & self.possible(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"))
        return outside.join(others, ["key", "salt"]).where(on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # step 5: the result
    def components(self) -> DataFrame:
        """``(cid, n, component)`` for each row of docs."""
        if self._components is None:
            classes = self.classes().select("digest", "rep")
            of_rep = connected_components(self.with_shared_ids(self.links())).withColumnRenamed("node", "rep")
            classes = staged(classes.join(of_rep, "rep", "left").select("digest", F.coalesce("component", "rep").alias("c")), "jaccard-of-class")
            self._components = self.members().join(classes, "digest", "left").select("cid", "n", F.when(F.col("cid").isNotNull(), F.coalesce("c", "cid")).alias("component"))
        return self._components

    def with_shared_ids(self, links: DataFrame) -> DataFrame:
        """Links, and those between the classes of rows that share an id."""
        live = self.live().select("cid", "digest")
        twice = live.groupBy("cid").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("cid")
        reps = self.classes().select("digest", "rep")
        return links.unionByName(live.join(twice, "cid").join(reps, "digest").select(F.col("cid").alias("src"), F.col("rep").alias("dst")))


def op8(spark, sf_dir: str) -> DataFrame:
    """Contract query: 3-word shingles of whole texts, links at 90 of 100, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = JaccardJoin(docs, size=3, percent=90).components()
    return found.select(F.col("cid").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, all columns unchanged, without those linked to a document of a lower id.

    Of rows that share an id one stays.  Rows with a null id and those without words stay.
    """
    found = JaccardJoin(docs, id_col, text_col, size, percent).components().where("cid IS NOT NULL")
    gone = staged(found.where("cid <> component").select("cid").distinct(), "jaccard-gone")
    key, n = "__respondex_id", gone.count()
    ids = gone.select(F.col("cid").alias(key))
    kept = docs.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, F.col(id_col).cast("long") == F.col(key), "left_anti")
    again = staged(found.groupBy("cid").agg(F.count("*").alias("k")).where("k > 1").select(F.col("cid").alias(key)), "jaccard-again")
    if again.isEmpty():
        return kept
    same = F.col(id_col).cast("long") == F.col(key)
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col])).select(docs.columns)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
