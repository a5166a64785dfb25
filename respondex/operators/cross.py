"""Responses of the same feature across classes: oriented pairs, counterparts, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.operators.fdr import adjust_all


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs and their reverses: effect negated, interval negated and swapped."""
    back = pairs.withColumns({"numerator": F.col("denominator"), "denominator": F.col("numerator"), "lfc": -F.col("lfc"), "ci_low": -F.col("ci_high"), "ci_high": -F.col("ci_low")})
    return pairs.unionByName(back)


def oriented_pairs(wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pair result of each wanted (feature, numerator, denominator), however it was stored."""
    return wanted.join(both_ways(pairs), ["feature", "numerator", "denominator"], "left")


def counterparts(seeds: DataFrame, obs: DataFrame, contrasts: list[tuple[str, str]]) -> DataFrame:
    """Each seed (feature, dataset, class) with the results of all contrasts of other classes; contrasts: (dataset, class) of the configuration.

    obs: (feature, dataset, lfc, p[, ci_low, ci_high, eligible]).
    """
    others = F.filter(F.array(*[F.struct(F.lit(n).alias("other"), F.lit(k).alias("other_class")) for n, k in contrasts]), lambda x: x["other_class"] != F.col("class"))
    w = seeds.select("*", F.explode(others).alias("x")).select(*seeds.columns, "x.*")
    named = {"lfc": "other_lfc", "p": "other_p", "ci_low": "other_low", "ci_high": "other_high", "eligible": "other_eligible"}
    o = obs.select("feature", F.col("dataset").alias("other"), *[F.col(c).alias(n) for c, n in named.items() if c in obs.columns])
    return w.join(o, ["feature", "other"], "left")


def family_adjusted(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Pair results with ``family_padj``, over all features and pairs as one family."""
    return adjust_all(pairs, p, "family_padj")


def status(d: DataFrame, p_max: float, lfc_min: float, bound: float) -> DataFrame:
    """Whether the pair difference shows the seed or its counterpart to be stronger; no difference shown is inconclusive, never absence.

    d has family_padj, ci_low, ci_high and eligible of the pair, and other_lfc, other_p,
    other_low, other_high and other_eligible of the counterpart.  A pair that is not eligible (or
    whose flag is missing) is inconclusive; its interval must lie on one side of zero.  ``detected``:
    the counterpart is eligible and responds itself; ``within_bound``: it is, and its own interval
    stays inside the limit.
    """
    sure = F.coalesce(F.col("eligible") & (F.col("family_padj") < p_max), F.lit(False))
    s = F.when(sure & (F.col("ci_low") > 0), "discovery_response_stronger").when(sure & (F.col("ci_high") < 0), "counterpart_response_stronger").otherwise("inconclusive")
    usable = F.col("other_eligible")
    detected = usable & (F.col("other_p") < p_max) & (F.abs("other_lfc") > lfc_min)
    inside = usable & (F.col("other_low") > -bound) & (F.col("other_high") < bound)
    return d.withColumn("status", s).withColumn("detected", F.coalesce(detected, F.lit(False))).withColumn("within_bound", F.coalesce(inside, F.lit(False)))


def summary(cross: DataFrame) -> DataFrame:
    """For each feature and class, the share of comparisons in which the discovery response is stronger, and the largest counterpart effect."""
    return cross.groupBy("feature", "class").agg(F.avg((F.col("status") == "discovery_response_stronger").cast("double")).alias("stronger_fraction"), F.max(F.abs("other_lfc")).alias("max_other"))
