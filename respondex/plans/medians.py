"""Exact medians of groups of any size: no task reads a whole group.

A sketch brackets the middle of each group (its ranks are surely within ``1 / ACCURACY`` of the
group).  One aggregation then counts what lies below and above the bracket, combined before the
shuffle to a row a task, and the distinct values inside it, spread by value.  Only those, some
``6 / ACCURACY`` of a group, are ranked: by a weighted percentile while they are few, else by range
partitions.  Counts of both sides make the result exact whatever the sketch said; a group whose
middle was outside its bracket is ranked whole by range partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.plans.ranges import cumulated, same
from respondex.plans.skew import broadcast_if_small
from respondex.plans.staging import discard, staged

#: Accuracy of the sketch; distinct values of a group that one task may rank.
ACCURACY, FEW = 10_000, 1_000_000


def group_medians(df: DataFrame, by: str, value: str, out: str = "median", accuracy: int = ACCURACY, few: int = FEW) -> DataFrame:
    """``(by, out)``: the median of the values that are not null in each group, as ``F.median`` gives it; groups without values are left out.

    df is staged, as it is read three times.
    """
    d = staged(df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL"), "median-rows")
    edge = 2.0 / accuracy
    bounds = d.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", [0.5 - edge, 0.5 + edge], accuracy).alias("q"))
    bounds = staged(bounds.select("g", "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi")), "median-bounds")
    small = broadcast_if_small(bounds.withColumnRenamed("g", "of"))
    side = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), 1).otherwise(0)
    j = d.join(small, same(d, small, [("g", "of")])).select("g", side.alias("side"), F.when(side == 0, F.col("v")).alias("v"))
    counts = staged(j.groupBy("g", "side", "v").agg(F.count("*").alias("k")), "median-counts")
    sums = counts.groupBy("g").agg(F.sum(F.when(F.col("side") < 0, F.col("k")).otherwise(0)).alias("below"), F.sum("k").alias("n"), F.sum(F.when(F.col("side") == 0, F.col("k")).otherwise(0)).alias("inside"), F.count_if(F.col("side") == 0).alias("values"))
    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1  # places of the two middle values
    sums = staged(sums.select("g", (first - F.col("below")).alias("a"), (second - F.col("below")).alias("b"), "inside", "values"), "median-sums")
    caught = (F.col("a") >= 1) & (F.col("b") <= F.col("inside"))
    most = sums.agg(F.max("values").alias("m"), F.coalesce(F.bool_and(caught), F.lit(True)).alias("ok")).first()
    if not most["ok"] or (most["m"] or 0) > few:
        return _by_ranges(d, sums, counts, caught).select(F.col("g").alias(by), F.col("m").alias(out))
    inside = counts.where("side = 0")
    places = broadcast_if_small(sums.select(F.col("g").alias("of"), "a", "b"))
    ranked = inside.join(places, same(inside, places, [("g", "of")])).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("v", "k"))).alias("l"), F.first("a").alias("a"), F.first("b").alias("b"))
    at = lambda p: F.aggregate("l", F.struct(F.lit(0).cast("long").alias("k"), F.lit(None).cast("double").alias("v")), lambda s, x: F.struct((s["k"] + x["k"]).alias("k"), F.when(s["k"] < p, x["v"]).otherwise(s["v"]).alias("v")))["v"]
    discard(d, bounds)
    return ranked.select(F.col("g").alias(by), (0.5 * at(F.col("a")) + 0.5 * at(F.col("b"))).alias(out))


def _by_ranges(d: DataFrame, sums: DataFrame, counts: DataFrame, caught) -> DataFrame:
    """Medians through range partitions of the values inside the brackets, or of all values of groups whose bracket missed the middle."""
    side = lambda x: broadcast_if_small(x.withColumnRenamed("g", "of"))
    good, bad = side(sums.where(caught).select("g")), side(sums.where(~caught).select("g"))
    inside = counts.where("side = 0")
    rows = inside.join(good, same(inside, good, [("g", "of")])).select("g", "v", "k").unionByName(d.join(bad, same(d, bad, [("g", "of")])).select("g", "v", F.lit(1).cast("long").alias("k")))
    ranked = cumulated(rows, ["g"], "v", weight="k")
    n = F.col("__total")
    # inside a bracket the places are those less what lies below; of a whole group they are the middle ones
    places = side(sums.select("g", F.when(caught, F.col("a")).alias("a"), F.when(caught, F.col("b")).alias("b")))
    j = ranked.join(places, same(ranked, places, [("g", "of")]))
    a, b = F.coalesce("a", F.floor((n + 1) / 2)), F.coalesce("b", F.floor(n / 2) + 1)
    two = j.groupBy("g").agg(F.min(F.when(F.col("__upto") >= a, F.col("v"))).alias("x"), F.min(F.when(F.col("__upto") >= b, F.col("v"))).alias("y"))
    return two.select("g", (0.5 * F.col("x") + 0.5 * F.col("y")).alias("m"))
