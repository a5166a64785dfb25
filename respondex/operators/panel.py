"""Promoter maps and balanced panels."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from respondex.operators.graph import least_units, unit_labels
from respondex.plans.staging import staged


def promoter_map(candidates: DataFrame, tu_genes: DataFrame, tu_promoters: DataFrame) -> DataFrame:
    """``(feature, tu, promoter, status)``: mapped, a unit without promoter, or no unit."""
    t = candidates.select("feature").distinct().join(tu_genes.select(F.col("gene").alias("feature"), "tu").distinct(), "feature", "left")
    d = t.join(tu_promoters.distinct(), "tu", "left")
    return d.select("feature", "tu", "promoter", F.when(F.col("tu").isNull(), "no_unit").when(F.col("promoter").isNull(), "unit_without_promoter").otherwise("mapped").alias("status"))


def promoter_rollup(mapped: DataFrame, tiers: DataFrame) -> DataFrame:
    """For each promoter its distinct features, units and tiers, sorted."""
    d = mapped.where("status = 'mapped'").join(tiers.select("feature", "tier"), "feature", "left")
    return d.groupBy("promoter").agg(F.array_sort(F.collect_set("feature")).alias("features"), F.array_sort(F.collect_set("tu")).alias("units"), F.array_sort(F.collect_set("tier")).alias("tiers"))


def feature_groups(units: DataFrame) -> DataFrame:
    """``(feature, grp)``: the connected group of overlapping units that a feature is in; units: (unit, member)."""
    return units.join(unit_labels(units, least_units(units)), "unit").groupBy(F.col("member").alias("feature")).agg(F.min("grp").alias("grp"))


def options(stability: DataFrame, cross: DataFrame, cv: DataFrame, regulators: DataFrame, mapped: DataFrame, groups: DataFrame, fragments: DataFrame) -> DataFrame:
    """Panel options: one row for each class, candidate and promoter; a feature without a unit group is its own group.

    stability, cross: by (feature, class).  cv: (feature, cv), the largest counts.
    regulators: (feature, regulators).  mapped: (feature, promoter) of mapped promoters, through
    however many units.  groups: (feature, grp) of ``feature_groups``.  fragments: (promoter, confidence_rank, matches).
    """
    d = stability.join(cross, ["feature", "class"], "left").join(cv.groupBy("feature").agg(F.max("cv").alias("max_cv")), "feature", "left")
    d = d.join(regulators.select("feature", "regulators"), "feature").join(mapped.where("promoter IS NOT NULL").select("feature", "promoter").distinct(), "feature")
    d = d.join(groups.select("feature", "grp"), "feature", "left")
    d = d.join(fragments.select("promoter", F.coalesce("confidence_rank", F.lit(0)).alias("confidence_rank"), "matches"), "promoter")
    return d.withColumn("grp", F.coalesce("grp", -F.col("feature")) if dict(d.dtypes)["grp"] != "string" else F.coalesce("grp", F.col("feature").cast("string")))


#: Sort keys of the balanced panel and of the baseline, best first: (column, largest first); missing values are last.
BALANCED = [("n_supporting", True), ("screen_fraction", True), ("confidence_rank", True), ("reuse", False), ("stronger_fraction", True), ("max_other", False), ("effect", True), ("feature", False), ("promoter", False)]
EFFECT_ONLY = [("effect", True), ("confidence_rank", True), ("feature", False), ("promoter", False)]


def greedy(opts: DataFrame, per_class: int, order: list[tuple[str, bool]], once: list[str], classes: list[str] | None = None) -> DataFrame:
    """One pick a class in turn: the best option whose ``once`` columns have no value that was picked before.

    A pick depends on those before it, so it takes per_class top-one jobs for each class over
    the staged options; each reads them once and returns one row.  A class with nothing left
    is passed over.  Options whose sequence doesn't match the reference are not eligible.
    ``reuse`` counts how often an option's regulators were picked; null without regulators.
    """
    spark = opts.sparkSession
    opts = staged(opts.where("matches"), "panel-options")
    classes = classes or [r["class"] for r in opts.select("class").distinct().orderBy("class").collect()]
    picked: list[dict] = []
    for _ in range(per_class):
        for name in classes:
            left = opts.where(F.col("class") == name)
            for c in once:
                if taken := [r[c] for r in picked]:
                    left = left.where(~F.col(c).isin(taken))
            uses = Counter(x for r in picked for x in r["regulators"] or [])
            table = F.create_map(*[F.lit(x) for kv in uses.items() for x in kv]) if uses else None
            count = F.aggregate(F.transform("regulators", lambda r: F.coalesce(F.element_at(table, r), F.lit(0))), F.lit(0), lambda a, x: a + x) if uses else F.lit(0)
            keys = [F.col(c).desc_nulls_last() if most else F.col(c).asc_nulls_last() for c, most in order]
            best = left.withColumn("reuse", F.when(F.size("regulators") > 0, count)).orderBy(*keys).limit(1).collect()
            picked += [r.asDict() | {"place": len(picked) + 1} for r in best]
    names = [*opts.columns, "reuse", "place"]
    kind = StructType([*opts.schema.fields, StructField("reuse", IntegerType()), StructField("place", IntegerType())])
    return spark.createDataFrame([tuple(r[c] for c in names) for r in picked], kind)


def balanced(opts: DataFrame, per_class: int, classes: list[str] | None = None) -> DataFrame:
    """Panel of ``per_class`` options a class, no promoter or unit group twice; used regulators count against an option."""
    return greedy(opts, per_class, BALANCED, ["promoter", "grp"], classes)


def effect_only(opts: DataFrame, per_class: int, classes: list[str] | None = None) -> DataFrame:
    """Baseline: the largest effects of each class in turn, features distinct across classes, promoters and groups as they come."""
    return greedy(opts.where("effect IS NOT NULL"), per_class, EFFECT_ONLY, ["feature"], classes)


def listing(panel: DataFrame) -> DataFrame:
    """A panel in the order of its picks (a panel is as small as its budget)."""
    return panel.orderBy("place")


def quality_listing(quality: DataFrame) -> DataFrame:
    """Sample quality by sample (one row a sample)."""
    return quality.orderBy("sample")


def metrics(panel: DataFrame) -> DataFrame:
    """Slots, distinct features, promoters and groups, medians and missing values of a panel."""
    return panel.agg(
        F.count("*").alias("n"), F.count_distinct("feature").alias("features"), F.count_distinct("promoter").alias("promoters"), F.count_distinct("grp").alias("groups"), F.median("effect").alias("median_effect"),
        F.median("screen_fraction").alias("median_screen"), F.median("max_other").alias("median_other"), F.count_if(F.col("max_other").isNull()).alias("missing_other"),
    )


def violations(panel: DataFrame, opts: DataFrame, per_class: int) -> DataFrame:
    """``(check, key)``: classes over budget, repeated options, picks outside the eligible pool, and picks whose metrics are not the pool's."""
    key = ["class", "feature", "promoter"]
    pool = opts.where("matches")
    name = lambda d, check: d.select(F.lit(check).alias("check"), F.concat_ws("|", *[c for c in key if c in d.columns]).alias("key"))
    over = panel.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") > per_class)
    twice = pool.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    fields = ["effect", "screen_fraction", "max_other"]
    stale = compared(panel.select(*key, *fields), pool.select(*key, *fields).join(panel.select(*key), key, "left_semi"), key)
    outside = panel.select(*key).join(pool.select(*key), key, "left_anti")
    return name(over, "budget").unionByName(name(twice, "repeated_option")).unionByName(name(outside, "outside_pool")).unionByName(name(stale.join(outside, key, "left_anti").select(*key).distinct(), "stale_metrics"))


def compared(a: DataFrame, b: DataFrame, key: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Numbers of a and b that differ by more than a relative tolerance, or are missing on one side: ``(key..., metric, a, b)``."""
    long = lambda d, v: d.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(v)) for c, t in d.dtypes if c not in key and t in ("double", "bigint", "int")])).alias("x")).select(*key, "x.*")
    d = long(a, "a").join(long(b, "b"), [*key, "metric"], "full")
    far = F.abs(F.col("a") - F.col("b")) > F.greatest(F.lit(1e-12), tolerance * F.greatest(F.abs("a"), F.abs("b")))
    return d.where(F.coalesce(far, F.col("a").isNull() != F.col("b").isNull()))
