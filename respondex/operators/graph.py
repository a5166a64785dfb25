"""Typed graphs of regulators, units and targets as edge and node tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.functions.scalar import CONFIDENCE, EFFECTS, lookup
from respondex.operators.classes import alike
from respondex.operators.components import connected_components
from respondex.plans.shipping import ship
from respondex.plans.skew import broadcast_if_small, crossed, dealt_by_rows
from respondex.plans.staging import staged


def collapsed_edges(raw: DataFrame, least: int = 0, keep: bool = False, rows: int | None = None) -> DataFrame:
    """One edge for each ``(src, dst)``: best confidence rank, joint effect (opposing signs are ``dual``), number of records.

    Rows of unknown sign or of a rank below ``least`` are left out first.  keep: each
    distinct kind of record with its number as ``evidence``, combined before the shuffle.
    rows: those of raw or more, if they are known, so that no task gets more of them as the table grows.
    """
    d = raw.withColumn("rank", F.coalesce(lookup(CONFIDENCE, F.col("confidence")), F.lit(0))).withColumn("effect", lookup(EFFECTS, F.col("sign"))).where(F.col("effect").isNotNull() & (F.col("rank") >= least))
    if keep:
        d = d.groupBy("src", "dst", "sign", "confidence", "rank", "effect").agg(F.count("*").alias("k"))
    records = F.sum("k") if keep else F.count("*")
    kept = [F.array_sort(F.collect_list(F.struct("sign", "confidence", "k"))).alias("evidence")] if keep else []
    # numbers, not texts: Spark can only sort all rows to find the least text of a group
    names = F.array(*[F.lit(x) for x in sorted(set(EFFECTS.values()))])
    d = d.withColumn("code", F.array_position(names, F.col("effect")).cast("int"))
    d = d if rows is None else dealt_by_rows(d, rows, "src", "dst")
    one = d.groupBy("src", "dst").agg(F.max("rank").alias("rank"), F.min("code").alias("a"), F.max("code").alias("b"), records.alias("n_evidence"), *kept)
    return one.select("src", "dst", "rank", F.when(F.col("a") == F.col("b"), F.element_at(names, F.col("a"))).otherwise("dual").alias("effect"), "n_evidence", *(["evidence"] if keep else []))


def nodes(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(node, kind, is_regulator)`` with string ids: a candidate that also regulates keeps its kind."""
    text = lambda c: F.col(c).cast("string").alias("node")
    reg = edges.select(text("src")).distinct().withColumn("r", F.lit(True))
    tar = edges.select(text("dst")).distinct().withColumn("t", F.lit(True))
    can = candidates.select(text("feature")).distinct().withColumn("c", F.lit(True))
    d = can.join(tar, "node", "full").join(reg, "node", "full")
    return d.select("node", F.when(F.col("c"), "candidate").when(F.col("t"), "target").otherwise("regulator").alias("kind"), F.coalesce("r", F.lit(False)).alias("is_regulator"))


def regulators_of(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Sorted regulators of each candidate."""
    e = edges.select("src", F.col("dst").alias("feature"))
    return candidates.select("feature").distinct().join(e, "feature", "left").groupBy("feature").agg(F.array_sort(F.collect_set("src")).alias("regulators"))


def candidate_subgraph(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    return edges.join(candidates.select(F.col("feature").alias("dst")).distinct(), "dst", "left_semi")


def least_units(lists: DataFrame) -> DataFrame:
    """``(member, unit)``: the least unit of each member."""
    return lists.where("member IS NOT NULL AND unit IS NOT NULL").groupBy("member").agg(F.min("unit").alias("unit"))


def unit_labels(lists: DataFrame, least: DataFrame) -> DataFrame:
    """``(unit, grp)`` as ``unit_groups`` has them; least: ``least_units``."""
    lists = lists.distinct()
    links = lists.join(least.select("member", F.col("unit").alias("hub")), "member").select(F.col("unit").alias("src"), F.col("hub").alias("dst"))
    alone = lists.where("member IS NULL").select(F.col("unit").alias("src"), F.col("unit").alias("dst"))
    return connected_components(links.unionByName(alone)).select(F.col("node").alias("unit"), F.col("component").alias("grp"))


def unit_groups(lists: DataFrame) -> DataFrame:
    """``(unit, grp, members)``: units that overlap, directly or through others, form a group named by its least unit; how many distinct members it has.

    A unit of unknown members alone overlaps with none, so it is a group of no members.
    """
    least = staged(least_units(lists), "least-units")
    groups = staged(unit_labels(lists, least), "unit-groups")
    sizes = least.join(groups, "unit").groupBy("grp").agg(F.count("*").alias("members"))
    return groups.join(broadcast_if_small(sizes), "grp", "left").select("unit", "grp", F.coalesce("members", F.lit(0).cast("long")).alias("members"))


def group_names(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """``(grp, name)``: sorted members joined, null if none is known; a name is as long as its group.

    groups: as ``unit_groups`` gives them, so a member's units are all of one group, which its least unit tells.
    """
    names = least_units(lists).join(groups, "unit").groupBy("grp").agg(F.array_join(F.array_sort(F.collect_list("member")), ";").alias("name"))
    return groups.where("unit = grp").select("grp").join(names, "grp", "left")


def co_members(members: DataFrame, candidates: DataFrame, typed: DataFrame, block: int | None = None) -> DataFrame:
    """``(a, b, shared, components)``: pairs of candidates that share components, with how many and which; pairs with a typed edge either way are left out.

    The result has all pairs of a component, so the work is cut into triangles: features are dealt to blocks of some ``block`` (None: a
    64th of all, 512 to 2,048), and each pair of blocks, at most ``block`` squared pairs, is a key of its own, to which the typed edges between the two
    go as well.  So a pair is made whole by one task, and no pair is shuffled.  A block goes to as many keys as there are blocks, as one
    packed row.
    """
    m = members.join(candidates.select("feature").distinct(), "feature", "left_semi").select("feature", "component").where("component IS NOT NULL").distinct()
    m = staged(m.groupBy("feature").agg(F.array_sort(F.collect_list("component")).alias("components")), "members")
    n = m.count()
    blocks = max(1, -(-n // (block or min(max(n // 64, 512), 2_048))))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    d = m.groupBy(of("feature").alias("own")).agg(F.collect_list(F.struct("feature", "components")).alias("rows")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", F.col("rows.feature").alias("feature"), F.transform("rows", lambda r: F.size(r["components"])).alias("n"), F.flatten("rows.components").alias("components"))
    known = typed.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()
    for c in ("a", "b"):
        known = known.join(broadcast_if_small(m.select(F.col("feature").alias(c))), c, "left_semi")
    known = known.select(*[F.col(c).cast(dict(m.dtypes)["feature"]).alias(c) for c in ("a", "b")])
    known = known.select(F.least(of("a"), of("b")).alias("x"), F.greatest(of("a"), of("b")).alias("y"), "a", "b")
    tasks = int(min(max(n * n // 8_000_000, 1), 100_000))
    kinds = dict(m.dtypes)
    ship(m.sparkSession)
    dealt = [t.repartition(tasks, "x", "y").groupBy("x", "y") for t in (d, known)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(lambda x, y: block_pairs(unpacked(x), y), f"a {kinds['feature']}, b {kinds['feature']}, shared long, components {kinds['components']}")


def unpacked(blocks: pa.Table) -> pa.Table:
    """A row (x, y, own, feature, components) for each feature of blocks (x, y, own, features, how many components each has, all these)."""
    features, sizes, items = (blocks[c].combine_chunks() for c in ("feature", "n", "components"))
    rows = blocks.select(["x", "y", "own"]).take(pc.list_parent_indices(features))
    starts = np.r_[0, np.cumsum(pc.list_flatten(sizes).to_numpy(zero_copy_only=False))]
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pc.list_flatten(items))
    return rows.append_column("feature", pc.list_flatten(features)).append_column("components", lists)


def block_pairs(members: pa.Table, known: pa.Table, each: int = 1 << 21) -> pa.Table:
    """``(a, b, shared, components)`` of a pair of blocks; members: (x, y, own, feature, components) of both blocks, known: pairs (a, b) to leave out.

    Features of one block are crossed by component with those of the other, as many at a time as make some ``each`` crossings.
    """
    lists = members["components"].combine_chunks()
    features, names = (sorted_values(x) for x in (members["feature"].combine_chunks(), pc.list_flatten(lists)))
    place = lambda x: pc.index_in(x, features).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(features)
    owner, item = pc.list_parent_indices(lists).to_numpy(), pc.index_in(pc.list_flatten(lists), names).to_numpy(zero_copy_only=False)
    at, own = place(members["feature"].combine_chunks())[owner], members["own"].to_numpy()[owner]
    order = np.lexsort((at, item))
    at, own, item = at[order], own[order], item[order].astype(np.int32)
    x, y = (members[c][0].as_py() if len(members) else -1 for c in "xy")
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    first, last = (np.searchsorted(item[right], item[left], s) for s in ("left", "right"))
    width = last - first
    part = (np.cumsum(np.bincount(at[left], width, n)) // each).astype(np.int64)[at[left]]
    barred = np.sort(place(known["a"].combine_chunks()) * n + place(known["b"].combine_chunks()))
    out = []
    for k in np.unique(part):
        chosen = np.flatnonzero(part == k)
        w = width[chosen]
        i, j = np.repeat(left[chosen], w), right[np.repeat(first[chosen] - np.cumsum(w) + w, w) + np.arange(w.sum())]
        code = np.minimum(at[i], at[j]) * n + np.maximum(at[i], at[j])
        use = at[i] < at[j] if x == y else np.ones(len(code), bool)
        if len(barred):
            use &= ~np.isin(code, barred)
        # crossings come by component, so a stable order keeps a pair's components sorted
        code, kind = code[use], item[i][use]
        order = np.argsort(code, kind="stable")
        code, kind = code[order], kind[order]
        starts = np.flatnonzero(np.r_[len(code) > 0, code[1:] != code[:-1]])
        ends = np.r_[starts, len(code)]
        pair = code[starts]
        components = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(kind)))
        out.append(pa.table([features.take(pa.array(pair // n)), features.take(pa.array(pair % n)), pa.array(np.diff(ends), pa.int64()), components], ["a", "b", "shared", "components"]))
    empty = pa.table([features[:0], features[:0], pa.array([], pa.int64()), lists[:0]], ["a", "b", "shared", "components"])
    return pa.concat_tables([empty, *(t.cast(empty.schema) for t in out)])


def sorted_values(values: pa.Array) -> pa.Array:
    one = pc.unique(values)
    return one.take(pc.sort_indices(one))


def neighbours(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """Members of the candidates' components that are no candidates, with the number of such components."""
    c = candidates.select("feature").distinct()
    near = members.join(c, "feature", "left_semi").select("component").distinct()
    return members.join(near, "component", "left_semi").join(c, "feature", "left_anti").groupBy("feature").agg(F.count_distinct("component").alias("components"))


def reachable(edges: DataFrame, starts: DataFrame, fold: int = 10, wide: int = 256) -> DataFrame:
    """``(start, node)`` reached along edges (src to dst) from each start, itself included, to a fixed point.

    Steps follow only nodes with edges of their own.  What they found is staged as one table every ``fold`` steps, so that a deep
    graph makes no long plan.  Nodes without edges come last: those below the same nodes that several starts reach are a class, a start
    reaches classes, and their nodes are listed without a shuffle or a search for repeats.  Nodes below a start alone
    are added unless a class has them; those below more than ``wide`` shared nodes are made distinct the plain way.
    """
    e = staged(edges.select(F.col("src").alias("node"), "dst").where("node IS NOT NULL").distinct(), "reach-edges")
    inner = staged(e.join(e.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("node", "dst"), "reach-inner")
    found = staged(starts.select(F.col(starts.columns[0]).alias("start"), F.col(starts.columns[0]).alias("node")).distinct(), "reach")
    new, step_no = found, 0
    while True:
        step = new.join(inner, "node").select("start", F.col("dst").alias("node")).distinct()
        new = staged(step.join(found, ["start", "node"], "left_anti"), "reach")
        if new.isEmpty():
            break
        found, step_no = found.unionByName(new), step_no + 1
        if step_no % fold == 0:
            found = staged(found, "reach")
    last = e.join(e.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti").select("node", "dst")
    by_node = found.groupBy("node").agg(F.count("*").alias("k"))
    last = staged(last.join(by_node, "node").select("node", "dst", (F.col("k") > 1).alias("shared")), "reach-last")
    many = last.where("dst IS NULL").select("dst").unionByName(last.where("shared").groupBy("dst").agg(F.count("*").alias("k")).where(F.col("k") > wide).select("dst")).distinct()
    many = staged(many, "reach-wide")
    is_wide = last["dst"].eqNullSafe(many["dst"])
    plain, rest = last.join(many, is_wide, "left_semi"), last.join(many, is_wide, "left_anti")
    of, above = alike(rest.where("shared"), "dst", "node")
    of = staged(of, "reach-classes")
    met = staged(found.join(above, "node").select("start", "cls").distinct(), "reach-met")
    listed = crossed(met, of, "cls").select("start", F.col("dst").alias("node"))
    own = found.join(rest.where("NOT shared"), "node").select("start", "dst").distinct().join(of, "dst", "left")
    own = own.join(met, ["start", "cls"], "left_anti").select("start", F.col("dst").alias("node"))
    wide_ones = found.join(plain.select("node", "dst"), "node").select("start", F.col("dst").alias("node")).distinct()
    return found.unionByName(listed).unionByName(own).unionByName(wide_ones)


def bundled(raw: DataFrame) -> DataFrame:
    """One edge for each source, target and confidence: number of records, sorted effects, whether all repress."""
    d = raw.withColumn("effect", lookup(EFFECTS, F.col("sign")))
    return d.groupBy("src", "dst", "confidence").agg(F.count("*").alias("records"), F.array_sort(F.collect_set("effect")).alias("effects"), F.bool_and(F.col("effect") == "represses").alias("all_repress"))


def unit_context(overlap: DataFrame, groups: DataFrame) -> DataFrame:
    """For each overlap set ``(set, feature)``: number of groups, features without one, the largest group and its share.

    Ties go to the group with the least feature.
    """
    g = overlap.join(groups, "feature", "left")
    per = g.where("grp IS NOT NULL").groupBy("set", "grp").agg(F.count("*").alias("n"), F.min("feature").alias("first"))
    top = per.groupBy("set").agg(F.count("*").alias("groups"), F.min_by(F.struct("grp", "n"), F.struct(-F.col("n"), F.col("first"))).alias("m"))
    size = g.groupBy("set").agg(F.count("*").alias("features"), F.count_if(F.col("grp").isNull()).alias("unannotated"))
    return size.join(top, "set", "left").select("set", "features", "unannotated", F.coalesce("groups", F.lit(0)).alias("groups"), F.col("m.grp").alias("main"), F.try_divide(F.col("m.n"), F.col("features")).alias("share"))
