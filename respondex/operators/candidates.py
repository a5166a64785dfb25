"""Candidates: seeding, evidence roll-up, ranking, stability, shortlists, set enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respondex.functions.tails import hypergeom_tail
from respondex.operators.fdr import adjust_all
from respondex.plans.ranges import places
from respondex.plans.skew import broadcast_if_small
from respondex.plans.staging import staged


def hit(p_max: float, lfc_min: float, up_only: bool = False) -> Column:
    """Whether a row responds: eligible (a missing flag means not), and beyond both limits, which are strict."""
    size = F.col("lfc") if up_only else F.abs("lfc")
    return F.coalesce(F.col("eligible") & (F.col("p") < p_max) & (size > lfc_min), F.lit(False))


def seeded(obs: DataFrame, p_max: float, lfc_min: float, up_only: bool = False) -> DataFrame:
    """All rows of the features that respond in some row outside challenge datasets."""
    keys = obs.where(hit(p_max, lfc_min, up_only) & (F.col("role") != "challenge")).select("feature").distinct()
    return obs.join(keys, "feature", "left_semi")


#: Support labels, best first (fixed values).
TIERS = ("multiple_comparisons_supported", "single_comparison_supported", "within_class_direction_difference")


def tier_rank(tier: Column) -> Column:
    """0 for the best label; unknown ones are last."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(TIERS) for x in (t, i)]), tier), F.lit(99))


def evidence(obs: DataFrame, configured: dict[str, list[str]], p_max: float, lfc_min: float, up_only: bool = True, lone: str | None = None, caveats: dict[str, str] | None = None) -> DataFrame:
    """One row for each candidate: a feature with a qualifying result outside challenge datasets.

    obs: (feature, dataset, class, role, lfc, p, eligible[, basis]), basis being that of
    ``identity.resolved``; a feature with another than ``mapped`` is flagged.  configured: datasets of each
    class, from the configuration.  A result is significant by size, if eligible, qualifying if its direction counts
    too.  A class conflicts if it has significant results of both signs.  Its tier says
    whether one or several datasets qualify, or that it conflicts; the feature's tier is the
    conflict, else the best.  support: share of a class's configured datasets that qualify.
    lone: a dataset whose sole support is flagged.  ``profile`` keeps each dataset's effects
    and p; it is as long as the configuration.  All is settled in one shuffle by feature.
    """
    d = obs if "basis" in obs.columns else obs.withColumn("basis", F.lit("mapped"))
    d = d.where("feature IS NOT NULL").withColumn("sig", hit(p_max, lfc_min)).withColumn("qual", hit(p_max, lfc_min, up_only))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = d.repartition("feature").groupBy("feature", "class", "dataset", "role").agg(
        F.bool_or("sig").alias("significant"), F.bool_or("qual").alias("qualifying"), some(F.col("sig") & (F.col("lfc") > 0)).alias("up"), some(F.col("sig") & (F.col("lfc") < 0)).alias("down"),
        some(F.col("eligible")).alias("usable"), F.max(F.when(F.col("qual"), F.abs("lfc"))).alias("strongest"),
        F.array_sort(F.collect_list("lfc")).alias("effects"), F.array_sort(F.collect_list("p")).alias("ps"), some(F.col("basis") != "mapped").alias("unverified"),
    )
    found = F.when(F.col("significant"), "significant_response").when(F.col("usable"), "no_detected_response").otherwise("unavailable")
    direction = F.array_compact(F.array(F.when(F.col("down"), F.lit("down")), F.when(F.col("up"), F.lit("up")), F.when(~F.col("significant"), F.lit("not_regulated"))))
    own = F.col("qualifying") & (F.col("role") != "challenge")
    by = per.groupBy("feature", "class").agg(
        F.array_sort(F.collect_set("dataset")).alias("observed"), F.array_sort(F.collect_set(F.when(F.col("qualifying"), F.col("dataset")))).alias("supporting"),
        F.bool_or("up").alias("up"), F.bool_or("down").alias("down"), F.bool_or("unverified").alias("unverified"), some(own).alias("seed"),
        F.count_if(F.col("qualifying") & F.col("up")).alias("ups"), F.count_if(F.col("qualifying") & F.col("down")).alias("downs"), F.max(F.when(own, F.col("strongest"))).alias("strongest"),
        F.collect_list(F.struct("dataset", "class", "role", "significant", "qualifying", found.alias("status"), direction.alias("regulation"), "strongest", "effects", "ps")).alias("profile"),
    )
    n = F.size("supporting")
    tier = F.when(n == 0, None).when(F.col("up") & F.col("down"), TIERS[2]).when(n > 1, TIERS[0]).otherwise(TIERS[1])
    sizes = F.create_map(*[F.lit(x) for k, v in configured.items() for x in (k, len(set(v)))])
    by = by.withColumn("tier", tier).withColumn("share", F.round(n / F.element_at(sizes, F.col("class")), 3))
    out = by.groupBy("feature").agg(
        some("seed").alias("seed"), F.sum(F.size("observed")).alias("n_seen"), F.sum(n).alias("n_hits"), F.sum("ups").alias("n_up"), F.sum("downs").alias("n_down"), F.bool_or("unverified").alias("unverified"), F.bool_or(F.col("up") & F.col("down")).alias("direction_conflict"), (F.bool_or("up") & F.bool_or("down")).alias("both"),
        F.array_sort(F.collect_list(F.when(F.col("tier").isNotNull(), F.struct("class", "tier")))).alias("tiers"), F.map_from_entries(F.collect_list(F.struct("class", "share"))).alias("shares"),
        F.array_sort(F.flatten(F.collect_list("supporting"))).alias("supporting"), F.array_sort(F.flatten(F.collect_list("observed"))).alias("observed"),
        F.max("strongest").alias("primary_effect"), F.array_sort(F.flatten(F.collect_list("profile"))).alias("profile"),
    )
    classes = F.transform("tiers", lambda x: x["class"])
    names = F.transform("tiers", lambda x: x["tier"])
    support = F.transform(F.array(*[F.lit(k) for k in sorted(configured)]), lambda k: F.struct(k.alias("class"), F.coalesce(F.element_at("shares", k), F.lit(0.0)).alias("share")))
    cross = F.col("both") & ~F.col("direction_conflict")
    flags = [F.when(F.col("direction_conflict"), F.lit("within_class_direction_difference")), F.when(cross, F.lit("cross_class_direction_difference"))]
    if lone:
        flags.append(F.when(F.array_distinct("supporting") == F.array(F.lit(lone)), F.lit(f"{lone}_only")))
    flags.append(F.when(F.col("unverified"), F.lit("identity_mapping_not_verified")))
    said = {k: v for k, v in (caveats or {}).items() if v}
    notes = F.array_sort(F.array_distinct(F.filter(F.transform("observed", lambda x: F.element_at(F.create_map(*[F.lit(y) for kv in said.items() for y in kv]), x)), lambda x: x.isNotNull()))) if said else F.array().cast("array<string>")
    best = F.when(F.col("direction_conflict"), TIERS[2]).when(F.array_contains(names, TIERS[0]), TIERS[0]).otherwise(TIERS[1])
    return out.where("seed").select(
        "feature", best.alias("tier"), F.when(F.size(classes) > 1, "cross").otherwise(F.get(classes, F.lit(0))).alias("grp"), classes.alias("classes"), "tiers", support.alias("support"), "n_seen", "n_hits", "n_up", "n_down",
        "direction_conflict", cross.alias("cross_difference"), F.array_compact(F.array(*flags)).alias("flags"), notes.alias("caveats"), "primary_effect", "profile",
    )


def ranked(ev: DataFrame) -> DataFrame:
    """Rank by tier, then largest effect (missing last), then id."""
    return global_rank(ev, [tier_rank(F.col("tier")).asc(), F.col("primary_effect").desc_nulls_last(), F.col("feature").asc()], "rank")


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """1-based place of each row in a total order."""
    return places(df, [], order, out)


def top_by_class(obs: DataFrame, n: int) -> DataFrame:
    """The n features of largest signal in each class, ties by id."""
    best = obs.groupBy("class", "feature").agg(F.max("signal").alias("signal"))
    w = Window.partitionBy("class").orderBy(F.col("signal").desc_nulls_last(), "feature")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def shortlist(ev: DataFrame, n: int | None = None) -> DataFrame:
    """For each class its supported candidates by class tier, largest qualifying effect of the class outside challenges, and id; n: only the first.

    ev: rows of ``evidence``.
    """
    d = ev.select("feature", "profile", F.explode("tiers").alias("t")).select("feature", "t.class", "t.tier", "profile")
    ours = F.filter("profile", lambda x: (x["class"] == F.col("class")) & x["qualifying"] & (x["role"] != "challenge"))
    d = d.select("class", "feature", "tier", F.array_max(F.transform(ours, lambda x: x["strongest"])).alias("effect"))
    order = [tier_rank(F.col("tier")).asc(), F.col("effect").desc_nulls_last(), F.col("feature").asc()]
    if n is None:
        return places(d, ["class"], order, "place")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(*order))).where(F.col("place") <= n)


def stability(obs: DataFrame, counts: DataFrame, floors: list[float], shifts: list[float], p_max: float, lfc_min: float, min_samples: int = 3) -> DataFrame:
    """For each class and candidate of it, the share of screens that it passes: every floor on counts with every shift of the effect limit, p fixed.

    obs: (feature, dataset, class, role, lfc, shrunk, p, eligible); challenge datasets, rows
    that are not eligible and effects downward don't count.  counts: (feature, value).  The grid has a few fixed rows, so
    screens are expressions of one row for each class and feature, not a join.
    """
    supply = counts.groupBy("feature").agg(*[F.count_if(F.col("value") >= f).alias(f"k{i}") for i, f in enumerate(floors)])
    sure = F.coalesce(F.col("eligible") & (F.col("p") < p_max), F.lit(False))
    hits = sure & (F.col("lfc") > lfc_min)
    d = obs.where("role <> 'challenge'").groupBy("feature", "class").agg(
        F.count_if(hits).alias("n_supporting"), F.max(F.when(hits, F.col("lfc"))).alias("raw_effect"), F.max(F.when(hits, F.col("shrunk"))).alias("effect"), F.max(F.when(sure, F.col("lfc"))).alias("top"),
    )
    d = d.where("n_supporting > 0").join(supply, "feature", "left")
    tests = [F.coalesce((F.col(f"k{i}") >= min_samples) & (F.col("top") > lfc_min + s), F.lit(False)).cast("int") for i in range(len(floors)) for s in shifts]
    passed = sum(tests[1:], tests[0])
    return d.select("feature", "class", "n_supporting", "raw_effect", "effect", passed.alias("passed"), (passed / len(tests)).alias("screen_fraction"))


def rank_change(stable: DataFrame) -> DataFrame:
    """Places within the class by raw and by shrunk effect, after the number of supporting comparisons; change: raw less shrunk place."""
    order = lambda c: [F.desc("n_supporting"), F.col(c).desc_nulls_last(), F.col("feature").asc()]
    d = places(places(stable, ["class"], order("raw_effect"), "raw_place"), ["class"], order("effect"), "shrunk_place")
    return d.withColumn("change", F.col("raw_place") - F.col("shrunk_place"))


def coverage(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """For each regulator: targets, those of several classes, number and share of each class's, whether several classes occur, and the dominant one (``mixed`` on ties).

    classes: (feature, class), one row for each class of a feature.
    """
    c = classes.distinct()
    one = edges.select("src", F.col("dst").alias("feature")).distinct()
    many = c.groupBy("feature").agg(F.count("*").alias("k"))
    size = one.join(many, "feature", "left").groupBy("src").agg(F.count("*").alias("targets"), F.count_if(F.col("k") > 1).alias("multi_class"))
    per = one.join(c, "feature").groupBy("src", "class").agg(F.count("*").alias("n"))
    top = per.groupBy("src").agg(F.max("n").alias("m"), F.array_sort(F.collect_list(F.struct("class", "n"))).alias("by_class"))
    lead = F.filter("by_class", lambda x: x["n"] == F.col("m"))
    by = F.transform(F.coalesce("by_class", F.array().cast("array<struct<class:string,n:bigint>>")), lambda x: F.struct(x["class"].alias("class"), x["n"].alias("n"), F.round(x["n"] / F.col("targets"), 3).alias("share")))
    return size.join(top, "src", "left").select("src", "targets", "multi_class", by.alias("by_class"), (F.size(by) > 1).alias("several"), F.when(F.size(lead) == 1, lead[0]["class"]).otherwise("mixed").alias("dominant"))


def universe(obs: DataFrame, p_max: float, lfc_min: float) -> DataFrame:
    """``(dataset, feature, up, down)``: the background of ``enrichment``, one row for each feature that was measured usably in a dataset.

    obs: (feature, dataset, lfc, p, eligible[, basis]).  Rows that are not eligible, and those whose
    identity is not ``mapped``, are no part of it.  Several rows of a feature count as one.
    """
    d = obs.where("eligible AND feature IS NOT NULL")
    d = d.where("basis = 'mapped'") if "basis" in obs.columns else d
    sig = hit(p_max, lfc_min)
    return d.groupBy("dataset", "feature").agg(F.bool_or(sig & (F.col("lfc") > 0)).alias("up"), F.bool_or(sig & (F.col("lfc") < 0)).alias("down"))


def enrichment(edges: DataFrame, universe: DataFrame, overlap: bool = False) -> DataFrame:
    """One-sided Fisher test of each set, contrast and direction against all measured features.

    edges: (src, dst, effect).  universe: (dataset, feature, up, down), one row for each
    measured feature that can be used, with two flags; those with both are measured, but
    respond in neither direction.  Sets without measured targets don't appear.  The
    universe is staged, then one join and conditional counts; the contrast sizes are a small table.
    """
    clash = F.col("up") & F.col("down")
    u = staged(universe.withColumns({"up": F.col("up") & ~clash, "down": F.col("down") & ~clash}), "universe")
    totals = u.groupBy("dataset").agg(F.count("*").alias("background"), F.count_if("up").alias("n_up"), F.count_if("down").alias("n_down"))
    one = edges.groupBy(F.col("src"), F.col("dst").alias("feature")).agg(F.max("effect").alias("effect"))
    j = one.join(u, "feature")
    sets = j.groupBy("src", "dataset").agg(
        F.count("*").alias("targets"), F.count_if("up").alias("a_up"), F.count_if("down").alias("a_down"),
        F.count_if(F.col("up") & (F.col("effect") == "activates")).alias("agree_up"), F.count_if(F.col("down") & (F.col("effect") == "represses")).alias("agree_down"),
        *([F.array_sort(F.collect_list(F.when(F.col("up") | F.col("down"), F.col("feature")))).alias("overlap")] if overlap else []),
    )
    d = sets.join(broadcast_if_small(totals), "dataset")
    sides = F.array(*[F.struct(F.lit(s).alias("direction"), F.col(f"a_{s}").alias("a"), F.col(f"n_{s}").alias("responsive"), F.col(f"agree_{s}").alias("agree")) for s in ("up", "down")])
    d = d.select("src", "dataset", "targets", "background", *(["overlap"] if overlap else []), F.explode(sides).alias("s")).select("src", "dataset", "targets", "background", *(["overlap"] if overlap else []), "s.*")
    d = d.withColumn("b", F.col("targets") - F.col("a")).withColumn("c", F.col("responsive") - F.col("a")).withColumn("d", F.col("background") - F.col("targets") - F.col("responsive") + F.col("a"))
    odds = F.when((F.col("a") + F.col("b") == 0) | (F.col("c") + F.col("d") == 0) | (F.col("a") + F.col("c") == 0) | (F.col("b") + F.col("d") == 0), None).when(F.col("b") * F.col("c") == 0, float("inf")).otherwise(F.try_divide(F.col("a") * F.col("d"), F.col("b") * F.col("c")))
    return d.withColumn("odds", odds)


def enrichment_tests(table: DataFrame, places: int | None = None) -> DataFrame:
    """Adds p and padj over all sets, contrasts and directions as one family; places: digits that p is rounded to first."""
    p = hypergeom_tail("a", "b", "c", "d")
    return adjust_all(table.withColumn("p", p if places is None else F.round(p, places)))
