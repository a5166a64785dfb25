"""Queries: counts to responses, sample quality, adjustment."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.functions.tails import student_t_sf2
from respondex.operators import fdr, response
from respondex.plans import bindings as b
from respondex.plans.registry import query, rounded

_R = lambda *cols: ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


@query("a1_size_factors", b.with_tables("factors", "SELECT sample, round(size_factor, 6) AS size_factor FROM factors"))
def a1(spark, d):
    return rounded(response.size_factors(b.counts(spark, d)))


@query("a2_normalised", b.with_tables("norm", f"SELECT feature, sample, condition, replicate, {_R('value', 'size_factor', 'norm', 'log2')} FROM norm"))
def a2(spark, d):
    return rounded(b.norm(spark, d).select("feature", "sample", "condition", "replicate", "value", "size_factor", "norm", "log2"))


_GROUPS = "a.feature, a.mean AS mean_treated, b.mean AS mean_control, a.var AS var_treated, b.var AS var_control, a.n AS n_treated, b.n AS n_control, (a.base * a.n + b.base * b.n) / (a.n + b.n) AS base_mean, a.mean - b.mean AS lfc, pow(2.0, a.mean - b.mean) AS fold_change FROM moments a JOIN moments b ON a.feature = b.feature AND a.condition = 'A' AND b.condition = 'N'"


@query("a3_two_groups", b.with_tables("moments", f"SELECT feature, n_treated, n_control, {_R('mean_treated', 'mean_control', 'var_treated', 'var_control', 'base_mean', 'lfc', 'fold_change')} FROM (SELECT {_GROUPS})"))
def a3(spark, d):
    return rounded(response.two_groups(b.norm(spark, d), "A", "N"))


@query("a4_welch", b.with_tables("moments", f"""SELECT feature, {_R('lfc', 't', 'df')} FROM (SELECT *, CASE WHEN x + y > 0 THEN lfc / sqrt(x + y) END AS t, CASE WHEN x + y > 0 THEN (x + y) * (x + y) / (x * x / (n_treated - 1) + y * y / (n_control - 1)) END AS df
FROM (SELECT *, var_treated / n_treated AS x, var_control / n_control AS y FROM (SELECT {_GROUPS})))"""))
def a4(spark, d):
    return rounded(response.welch(response.two_groups(b.norm(spark, d), "A", "N")).select("feature", "lfc", "t", "df"))


@query("minimum_slice")
def minimum_slice(spark, d):
    """Which parts respond in return class A against control N; Student p of Welch's test, so without SQL."""
    tests = response.with_p(response.welch(response.two_groups(b.norm(spark, d), "A", "N")))
    return rounded(response.finalised(tests, 0.2, 1.0).orderBy(F.desc("signal"), F.desc("lfc"), "feature"))


@query("a5_count_filter", b.with_tables("counts", "SELECT feature FROM counts GROUP BY 1 HAVING count(*) FILTER (WHERE value >= 60) >= 7"))
def a5(spark, d):
    return response.count_filter(b.counts(spark, d), 60, 7)


_DISP = "disp AS (SELECT feature, greatest(coalesce(sum((n - 1) * (v - m)) / nullif(sum((n - 1) * m * m), 0), 1e-8), 1e-8) AS dispersion FROM (SELECT feature, condition, avg(norm) AS m, var_samp(norm) AS v, count(*) AS n FROM norm GROUP BY 1, 2) GROUP BY 1)"


@query("a6_count_model", b.with_tables("norm", f""", {_DISP}, g AS (SELECT feature, condition, m + 0.5 AS mu, (1 + dispersion * (m + 0.5)) / (n * (m + 0.5)) AS v FROM (SELECT feature, condition, avg(norm) AS m, count(*) AS n FROM norm GROUP BY 1, 2) JOIN disp USING (feature)),
w AS (SELECT a.feature, a.condition AS numerator, b.condition AS denominator, log2(a.mu / b.mu) AS lfc, sqrt(a.v + b.v) / ln(2.0) AS se FROM g a JOIN g b ON a.feature = b.feature AND a.condition < b.condition)
SELECT feature, numerator, denominator, {_R('lfc', 'se', 'z', 'ci_low', 'ci_high', 'shrunk_lfc', 'shrunk_se')} FROM (SELECT *, lfc / se AS z, lfc - 1.96 * se AS ci_low, lfc + 1.96 * se AS ci_high, lfc / (1 + se * se) AS shrunk_lfc, se * sqrt(1 / (1 + se * se)) AS shrunk_se FROM w)"""))
def a6(spark, d):
    return rounded(response.count_model(b.norm(spark, d)))


@query("a6_shared_dispersions", b.with_tables("norm", ", o AS (SELECT feature, sum(m * n) / sum(n) AS mean, sum(n - 1) AS f, greatest(coalesce(sum((n - 1) * (v - m)) / nullif(sum((n - 1) * m * m), 0), 1e-8), 1e-8) AS own FROM (SELECT feature, condition, avg(norm) AS m, var_samp(norm) AS v, count(*) AS n FROM norm GROUP BY 1, 2) GROUP BY 1), l AS (SELECT regr_slope(own, 1 / mean) AS a1, regr_intercept(own, 1 / mean) AS a0 FROM o WHERE own > 1e-8 AND mean > 0), t AS (SELECT o.*, greatest(1e-8, a0 + CASE WHEN mean > 0 THEN a1 / mean ELSE 0 END) AS trend FROM o, l), s AS (SELECT greatest(0.25, avg((ln(own) - ln(trend)) ** 2) - avg(2 / f)) AS s FROM t WHERE own > 1e-8 AND mean > 0) SELECT feature, round(own, 6) AS own, round(trend, 6) AS trend, round(exp(w * ln(own) + (1 - w) * ln(trend)), 6) AS dispersion FROM (SELECT t.*, CASE WHEN own > 1e-8 THEN s / (s + 2 / f) ELSE 0 END AS w FROM t, s)"))
def a6_shared(spark, d):
    return rounded(response.shared_dispersions(b.norm(spark, d)).select("feature", "own", "trend", "dispersion"))


@query("a6_count_model_tests")
def a6_tests(spark, d):
    return rounded(response.count_model_tests(response.count_model(b.norm(spark, d))))


@query("a7_condition_means", b.with_tables("norm", "SELECT feature, condition, round(avg(norm), 6) AS mean FROM norm GROUP BY 1, 2"))
def a7(spark, d):
    return rounded(b.norm(spark, d).groupBy("feature", "condition").agg(F.avg("norm").alias("mean")))


@query("a8_stabilised", b.with_tables("norm", f", {_DISP} SELECT feature, sample, round(ln((1 + 2 * dispersion * norm + 2 * sqrt(dispersion * norm * (1 + dispersion * norm))) / (4 * dispersion)) / ln(2.0), 6) AS vst FROM norm JOIN disp USING (feature)"))
def a8(spark, d):
    return rounded(response.stabilised(b.norm(spark, d)).select("feature", "sample", "vst"))


@query("a9_sample_quality", b.with_tables("counts", "SELECT sample, sum(value) AS library_size, count(*) FILTER (WHERE value > 0) AS features_detected FROM counts GROUP BY 1"))
def a9(spark, d):
    return response.sample_quality(b.counts(spark, d))


@query("a10_sample_distances", b.with_tables("norm", "SELECT a.sample AS a, b.sample AS b, round(sqrt(sum((a.log2 - b.log2) * (a.log2 - b.log2))), 6) AS distance FROM norm a JOIN norm b ON a.feature = b.feature AND a.sample < b.sample GROUP BY 1, 2"))
def a10(spark, d):
    return rounded(response.distances(response.gram(b.norm(spark, d))))


@query("a10_sample_components")
def a10_pca(spark, d):
    return rounded(response.principal_components(response.gram(b.norm(spark, d))))


@query("a11_replicates", b.with_tables("norm", f"SELECT feature, condition, {_R('mean', 'sd', 'min', 'max', 'cv')} FROM (SELECT *, CASE WHEN mean > 0 THEN sd / mean END AS cv FROM (SELECT feature, condition, avg(norm) AS mean, stddev_samp(norm) AS sd, min(norm) AS min, max(norm) AS max FROM norm GROUP BY 1, 2))"))
def a11(spark, d):
    return rounded(response.replicate_summary(b.norm(spark, d), ["feature", "condition"]).drop("values"))


_BH = "SELECT *, least(1.0, min(raw) OVER (PARTITION BY {f} ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS padj FROM (SELECT *, p * count(p) OVER (PARTITION BY {f}) / count(p) OVER (PARTITION BY {f} ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM {t})"


@query("w1_bh_by_family", b.with_tables("obs", "SELECT feature, dataset, round(padj, 6) AS padj FROM (" + _BH.format(f="dataset", t="(SELECT feature, dataset, coalesce(p, 1.0) AS p FROM obs)") + ")"))
def w1(spark, d):
    return rounded(fdr.adjust_by_family(b.observations(spark, d), ["dataset"]).select("feature", "dataset", "padj"))


@query("w2_bh_global", b.with_tables("obs", "SELECT feature, dataset, round(padj, 6) AS padj FROM (" + _BH.format(f="1", t="(SELECT * FROM obs WHERE p IS NOT NULL)") + ") UNION ALL SELECT feature, dataset, NULL FROM obs WHERE p IS NULL"))
def w2(spark, d):
    return rounded(fdr.adjust_all(b.observations(spark, d)).select("feature", "dataset", "padj"))


@query("k1_finalised", b.with_tables("obs", "SELECT feature, dataset, round(lfc, 6) AS lfc, round(padj, 6) AS padj, padj_source, CASE WHEN padj < 0.9 AND lfc > 1 THEN 'up' WHEN padj < 0.9 AND lfc < -1 THEN 'down' ELSE 'not_significant' END AS regulation, round(abs(lfc) * -log10(greatest(padj, 2.2250738585072014e-308)) + 0.0, 6) + 0.0 AS signal FROM ("
    + _BH.format(f="dataset", t="(SELECT feature, dataset, lfc, CASE WHEN p IS NULL THEN 'no_valid_pvalue_set_to_1' ELSE 'BH_from_pvalue' END AS padj_source, coalesce(p, 1.0) AS p FROM obs)") + ") WHERE lfc IS NOT NULL"))
def k1(spark, d):
    return rounded(response.finalised(b.observations(spark, d), 0.9, 1.0, ["dataset"]).select("feature", "dataset", "lfc", "padj", "padj_source", "regulation", "signal"))
