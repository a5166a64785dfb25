"""Differential response of features between conditions, from long count tables.

Counts are rows ``(feature, sample, condition, replicate, value)``; every feature has a
row for every sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondex.functions.scalar import response_label, signal
from respondex.functions.tails import normal_sf2, student_t_sf2
from respondex.operators.fdr import adjust_by_family
from respondex.plans.medians import group_medians
from respondex.plans.skew import broadcast_if_small
from respondex.plans.staging import staged


def dense_counts(rows: DataFrame, feature: str, condition: Column, replicate: Column, value: str, conditions: list[str], replicates: list[int]) -> DataFrame:
    """One row for each feature and sample, zeros included; one shuffle, no grid join."""
    grid = [(c, r) for c in conditions for r in replicates]
    sums = [F.coalesce(F.sum(F.when((condition == c) & (replicate == r), F.col(value))), F.lit(0.0)).alias(f"v{i}") for i, (c, r) in enumerate(grid)]
    wide = rows.groupBy(F.col(feature).alias("feature")).agg(*sums)
    cells = F.array(*[F.struct(F.lit(f"{c}{r}").alias("sample"), F.lit(c).alias("condition"), F.lit(r).alias("replicate"), F.col(f"v{i}").alias("value")) for i, (c, r) in enumerate(grid)])
    return wide.select("feature", F.explode(cells).alias("x")).select("feature", "x.*")


def size_factors(counts: DataFrame) -> DataFrame:
    """``(sample, size_factor)``: exact median over features of the ratio to the feature's geometric mean of positive counts; 0 or none gives 1."""
    center = counts.where("value > 0").groupBy("feature").agg(F.avg(F.log("value")).alias("g"))
    ratio = counts.join(center, "feature").select("sample", (F.col("value") / F.exp("g")).alias("ratio"))
    return group_medians(ratio, "sample", "ratio", "m").select("sample", F.when(F.col("m") > 0, F.col("m")).otherwise(1.0).alias("size_factor"))


def normalised(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """Counts with ``norm`` and ``log2``; factors has one row a sample."""
    return counts.join(broadcast_if_small(factors), "sample").withColumn("norm", F.col("value") / F.col("size_factor")).withColumn("log2", F.log2(F.col("norm") + 1))


def moments(norm: DataFrame) -> DataFrame:
    """``(feature, condition, n, mean, var, base)`` of log2 values; base is the mean of norm."""
    return norm.groupBy("feature", "condition").agg(F.count("log2").alias("n"), F.avg("log2").alias("mean"), F.var_samp("log2").alias("var"), F.avg("norm").alias("base"))


def two_groups(norm: DataFrame, treated: str, control: str) -> DataFrame:
    """Means, effect and moments of one contrast: one row a feature, one shuffle."""
    of = lambda c, x: F.when(F.col("condition") == c, F.col(x))
    d = norm.where(F.col("condition").isin(treated, control)).groupBy("feature").agg(
        F.avg(of(treated, "log2")).alias("mean_treated"), F.avg(of(control, "log2")).alias("mean_control"),
        F.var_samp(of(treated, "log2")).alias("var_treated"), F.var_samp(of(control, "log2")).alias("var_control"),
        F.count(of(treated, "log2")).alias("n_treated"), F.count(of(control, "log2")).alias("n_control"), F.avg("norm").alias("base_mean"),
    )
    d = d.withColumn("lfc", F.col("mean_treated") - F.col("mean_control"))
    return d.withColumn("fold_change", F.pow(F.lit(2.0), F.col("lfc")))


def welch(groups: DataFrame) -> DataFrame:
    """Adds ``t`` and ``df``; null with under two values in a group or no variance."""
    a, b = F.col("var_treated") / F.col("n_treated"), F.col("var_control") / F.col("n_control")
    ok = (F.col("n_treated") >= 2) & (F.col("n_control") >= 2) & (a + b > 0)
    df = (a + b) * (a + b) / (a * a / (F.col("n_treated") - 1) + b * b / (F.col("n_control") - 1))
    return groups.withColumn("t", F.when(ok, F.col("lfc") / F.sqrt(a + b))).withColumn("df", F.when(ok, df))


def with_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", student_t_sf2("t", "df"))


def pooled_p4(groups: DataFrame) -> DataFrame:
    """Adds ``p`` of Student's test for three against three values, whose four degrees of freedom have a closed form."""
    t = F.col("lfc") / F.sqrt((F.col("var_treated") + F.col("var_control")) / 3)
    u = F.abs(t) / F.sqrt(4 + t * t)
    p = F.greatest(F.lit(0.0), 1 - u * (1.5 - 0.5 * u * u))
    ok = (F.col("n_treated") == 3) & (F.col("n_control") == 3) & (F.col("var_treated") + F.col("var_control") > 0)
    return groups.withColumn("p", F.when(ok, p))


def count_filter(counts: DataFrame, min_count: float = 10, min_samples: int = 3) -> DataFrame:
    """Features with at least ``min_samples`` samples of at least ``min_count``."""
    return counts.groupBy("feature").agg(F.count_if(F.col("value") >= min_count).alias("k")).where(F.col("k") >= min_samples).select("feature")


def dispersions(norm: DataFrame) -> DataFrame:
    """``(feature, dispersion)``: pooled within-condition moment estimate, at least 0.00000001."""
    by = norm.groupBy("feature", "condition").agg(F.avg("norm").alias("m"), F.var_samp("norm").alias("v"), F.count("*").alias("n"))
    d = by.groupBy("feature").agg(F.try_divide(F.sum((F.col("n") - 1) * (F.col("v") - F.col("m"))), F.sum((F.col("n") - 1) * F.col("m") * F.col("m"))).alias("a"))
    return d.select("feature", F.greatest(F.coalesce("a", F.lit(1e-8)), F.lit(1e-8)).alias("dispersion"))


def shared_dispersions(norm: DataFrame, least: float = 1e-8) -> DataFrame:
    """``(feature, mean, own, trend, dispersion)``: own moment estimates drawn to a trend over the mean, in closed form.

    The trend is ``a0 + a1 / mean``, by least squares of the own estimates that are above ``least`` (sums of five moments
    of all features: one row), not below ``least``.  On the log scale an estimate of f degrees of freedom has about 2 / f
    variance; what the scatter round the trend has beyond that, at least 0.25, is the spread of true dispersions.  The
    log of a feature's dispersion is the mean of own and trend, weighted by the inverse of both.
    """
    by = norm.groupBy("feature", "condition").agg(F.avg("norm").alias("m"), F.var_samp("norm").alias("v"), F.count("*").alias("n"))
    d = by.groupBy("feature").agg(F.sum(F.col("m") * F.col("n")).alias("total"), F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("f"), F.try_divide(F.sum((F.col("n") - 1) * (F.col("v") - F.col("m"))), F.sum((F.col("n") - 1) * F.col("m") * F.col("m"))).alias("a"))
    d = staged(d.select("feature", (F.col("total") / F.col("n")).alias("mean"), "f", F.greatest(F.coalesce("a", F.lit(least)), F.lit(least)).alias("own")), "dispersions")
    x, y = 1 / F.col("mean"), F.col("own")
    used = (y > least) & (F.col("mean") > 0)
    fit = d.where(used).agg(F.count("*").alias("k"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy")).first()
    k, sx, sxx, sy, sxy = (float(v or 0) for v in fit)
    det = k * sxx - sx * sx
    a1 = (k * sxy - sx * sy) / det if det > 0 else 0.0
    a0 = (sy - a1 * sx) / k if k else least
    d = d.withColumn("trend", F.greatest(F.lit(least), F.lit(a0) + F.when(F.col("mean") > 0, F.lit(a1) * x).otherwise(0.0)))
    off = F.log("own") - F.log("trend")
    seen = d.where(used).agg(F.avg(off * off).alias("s"), F.avg(2 / F.col("f")).alias("e")).first()
    spread = max(0.25, (seen["s"] or 0.0) - (seen["e"] or 0.0))
    noise = 2 / F.col("f")
    share = F.when(F.col("own") > least, spread / (spread + noise)).otherwise(0.0)  # an estimate at the floor says nothing
    return d.select("feature", "mean", "own", "trend", F.exp(share * F.log("own") + (1 - share) * F.log("trend")).alias("dispersion"))


def count_model(norm: DataFrame, pseudo: float = 0.5, prior: float = 1.0, dispersion: DataFrame | None = None) -> DataFrame:
    """Negative-binomial Wald contrasts of all pairs of conditions, as rows ``(feature, numerator, denominator, ...)``.

    Group means (plus ``pseudo``) and a pooled moment dispersion give lfc, se and z; p is
    the normal tail, padj is per contrast, and a normal prior of scale ``prior`` shrinks.
    This is a closed form in place of an iterative joint fit, so its numbers are its own.
    dispersion: (feature, dispersion), such as ``shared_dispersions``; None takes each feature's own.
    """
    by = norm.groupBy("feature", "condition").agg(F.avg("norm").alias("m"), F.count("*").alias("n"))
    by = by.join(dispersions(norm) if dispersion is None else dispersion.select("feature", "dispersion"), "feature")
    mu = F.col("m") + pseudo
    by = by.select("feature", "condition", mu.alias("mu"), ((1 + F.col("dispersion") * mu) / (F.col("n") * mu)).alias("v"))
    a = by.select("feature", F.col("condition").alias("numerator"), F.col("mu").alias("mu_a"), F.col("v").alias("v_a"))
    b = by.select("feature", F.col("condition").alias("denominator"), F.col("mu").alias("mu_b"), F.col("v").alias("v_b"))
    d = a.join(b, "feature").where("numerator < denominator")
    d = d.withColumn("lfc", F.log2(F.col("mu_a") / F.col("mu_b"))).withColumn("se", F.sqrt(F.col("v_a") + F.col("v_b")) / F.log(F.lit(2.0)))
    d = d.withColumn("z", F.col("lfc") / F.col("se"))
    share = prior * prior / (prior * prior + F.col("se") * F.col("se"))
    return d.select("feature", "numerator", "denominator", "lfc", "se", "z", (F.col("lfc") - 1.96 * F.col("se")).alias("ci_low"), (F.col("lfc") + 1.96 * F.col("se")).alias("ci_high"), (F.col("lfc") * share).alias("shrunk_lfc"), (F.col("se") * F.sqrt(share)).alias("shrunk_se"))


def count_model_tests(model: DataFrame) -> DataFrame:
    return adjust_by_family(model.withColumn("p", normal_sf2("z")), ["numerator", "denominator"])


def stabilised(norm: DataFrame) -> DataFrame:
    """``vst``: log2 scale with the variance of a negative binomial of the feature's dispersion taken out."""
    a, q = F.col("dispersion"), F.col("norm")
    v = F.log((1 + 2 * a * q + 2 * F.sqrt(a * q * (1 + a * q))) / (4 * a)) / F.log(F.lit(2.0))
    return norm.join(dispersions(norm), "feature").withColumn("vst", v)


def sample_quality(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample").agg(F.sum("value").alias("library_size"), F.count_if(F.col("value") > 0).alias("features_detected"))


def gram(norm: DataFrame, value: str = "log2") -> DataFrame:
    """``(a, b, dot)`` of samples over feature-centred values; tasks sum matrix products of Arrow batches, only sample pairs leave them."""
    rows = norm.groupBy("feature").agg(F.collect_list("sample").alias("s"), F.collect_list(F.col(value) - F.lit(0.0)).alias("v"), F.avg(value).alias("c"))

    def products(batches):
        names: dict[str, int] = {}
        dots = np.zeros((0, 0))
        for batch in batches:
            s, v = batch.column("s"), batch.column("v")
            at = np.array([names.setdefault(x, len(names)) for x in s.flatten().to_pylist()], np.int64)
            if len(names) > len(dots):
                dots = np.pad(dots, (0, len(names) - len(dots)))
            of = np.repeat(np.arange(batch.num_rows), s.value_lengths().to_numpy())
            x = np.zeros((batch.num_rows, len(names)))
            x[of, at] = v.flatten().to_numpy() - batch.column("c").to_numpy()[of]
            dots += x.T @ x
        keys = list(names)
        yield pa.RecordBatch.from_pydict({"a": pa.array([k for k in keys for _ in keys], pa.string()), "b": pa.array(keys * len(keys), pa.string()), "d": pa.array(dots.ravel(), pa.float64())})

    return rows.mapInArrow(products, "a string, b string, d double").groupBy("a", "b").agg(F.sum("d").alias("dot"))


def distances(g: DataFrame) -> DataFrame:
    """Euclidean distances of sample pairs a < b from the Gram table (one row a pair)."""
    own = g.where("a = b")
    d = g.where("a < b").join(F.broadcast(own.select("a", F.col("dot").alias("aa"))), "a").join(F.broadcast(own.select("b", F.col("dot").alias("bb"))), "b")
    return d.select("a", "b", F.sqrt(F.greatest(F.lit(0.0), F.col("aa") + F.col("bb") - 2 * F.col("dot"))).alias("distance"))


def principal_components(g: DataFrame, k: int = 2, most: int = 4_096) -> DataFrame:
    """``(sample, component, score, share)`` from the Gram table; the largest score of a component is positive.

    The table's size is samples squared, and it is solved where the query is built, so more than ``most`` samples are an error.
    """
    g = staged(g, "gram")
    n = g.where("a = b").count()
    if n > most:
        raise ValueError(f"{n} samples are more than the {most} that one machine solves")
    rows = g.collect()
    names = sorted({r["a"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r["a"]], at[r["b"]]] = r["dot"]
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    order, total = np.argsort(values)[::-1][:k], max(values.clip(0).sum(), 1e-300)
    out = []
    for c, i in enumerate(order, 1):
        s = vectors[:, i] * np.sqrt(max(values[i], 0))
        s = s if s[np.abs(s).argmax()] >= 0 else -s
        out += [(n, c, float(s[at[n]]), float(max(values[i], 0) / total)) for n in names]
    return g.sparkSession.createDataFrame(out, "sample string, component int, score double, share double")


def replicate_summary(norm: DataFrame, by: list[str]) -> DataFrame:
    """Mean, sd, cv (null for means up to 0), least and largest, and all values by sample."""
    d = norm.groupBy(*by).agg(F.avg("norm").alias("mean"), F.stddev_samp("norm").alias("sd"), F.min("norm").alias("min"), F.max("norm").alias("max"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("sample", "norm")))).alias("values"))
    return d.withColumn("cv", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")))


def finalised(results: DataFrame, alpha: float = 0.05, effect: float = 2.0, family: list[str] | None = None) -> DataFrame:
    """Fills padj and its source, drops rows without an effect, labels and scores; input has lfc and p, and may have padj."""
    have = "padj" in results.columns
    d = results.withColumnRenamed("padj", "given") if have else results.withColumn("given", F.lit(None).cast("double"))
    d = adjust_by_family(d, family or [], "p", "bh")  # without a family all rows are one
    source = F.when(F.col("p").isNull(), "no_valid_pvalue_set_to_1").when(F.col("given").isNotNull(), "input").otherwise("BH_from_pvalue")
    d = d.withColumn("padj_source", source).withColumn("padj", F.coalesce("given", "bh")).drop("given", "bh").where("lfc IS NOT NULL")
    return d.withColumn("regulation", response_label(F.col("lfc"), F.col("padj"), effect, alpha)).withColumn("signal", signal(F.col("lfc"), F.col("padj")))
