"""Golden numbers of responses and adjustment."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from respondex.functions import scalar
from respondex.functions.tails import hypergeom_tail, normal_sf2, student_t_sf2
from respondex.operators import fdr, response


def brute_bh(p):
    order = np.argsort(p)
    out, low = [0.0] * len(p), 1.0
    for rank in range(len(p), 0, -1):
        i = order[rank - 1]
        low = min(low, p[i] * len(p) / rank)
        out[i] = low
    return out


def test_bh_golden(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.03), ("c", 0.04)], "id string, p double").withColumn("f", F.lit(1))
    got = {r["id"]: round(r["padj"], 9) for r in fdr.adjust_by_family(df, ["f"]).collect()}
    assert got == {"a": 0.03, "b": 0.04, "c": 0.04}


def test_bh_missing(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", None), ("c", float("nan"))], "id string, p double").withColumn("f", F.lit(1))
    one = {r["id"]: r["padj"] for r in fdr.adjust_by_family(df, ["f"]).collect()}
    assert one == {"a": pytest.approx(0.03), "b": 1.0, "c": 1.0}
    out = {r["id"]: r["padj"] for r in fdr.adjust_by_family(df, ["f"], nulls="exclude").collect()}
    assert out["a"] == pytest.approx(0.01) and out["b"] is None and out["c"] is None


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.001, 0.01, 0.02, 0.2, 0.5, 0.9, 1.0]), min_size=1, max_size=60))
def test_bh_forms_agree(spark, ps):
    df = spark.createDataFrame(list(enumerate(ps)), "id int, p double").withColumn("f", F.lit(1))
    want = brute_bh(ps)
    for got in (fdr.adjust_by_family(df, ["f"]), fdr.adjust_all(df, partitions=3)):
        assert [r["padj"] for r in got.orderBy("id").collect()] == pytest.approx(want)


def test_bh_global_has_no_single_partition(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") / 100).alias("p"))
    plan = fdr.adjust_all(df)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_no_task_reads_a_whole_family(spark):
    df = spark.range(4000).select(F.col("id"), F.lit("f").alias("f"), ((F.col("id") % 977 + 1) / 977).alias("p"), F.lit(1.0).alias("lfc"))
    out = response.finalised(df, family=["f"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    # by the family alone go only the sums of its partitions, one row each
    assert "SinglePartition" not in plan and all("HashAggregate(keys=[f#" in below and "__part#" in below for line, below in zip(lines, lines[1:]) if "hashpartitioning(f#" in line and "__" not in line.split("hashpartitioning(")[1].split(")")[0])
    assert "SinglePartition" not in response.finalised(df)._jdf.queryExecution().executedPlan().toString()


def test_bh_joins_back_a_hot_value(spark, monkeypatch):
    from respondex.plans import ranges

    monkeypatch.setattr(ranges, "broadcast_if_small", lambda df: df)
    ps = [1.0] * 50 + [0.01, 0.02, None]
    df = spark.createDataFrame([(i, "f" if i % 2 else None, p) for i, p in enumerate(ps)], "id int, f string, p double")
    got = {r["id"]: r["padj"] for r in fdr.adjust_by_family(df, ["f"], nulls="exclude").collect()}
    for odd in (0, 1):
        ids = [i for i, p in enumerate(ps) if i % 2 == odd and p is not None]
        assert [got[i] for i in ids] == pytest.approx(brute_bh([ps[i] for i in ids]))
    assert got[52] is None and len(got) == 53


def test_bh_empty(spark):
    assert fdr.adjust_all(spark.createDataFrame([], "id int, p double")).count() == 0


def test_tails(spark):
    r = spark.range(1).select(student_t_sf2(F.lit(2.0), F.lit(10.0)).alias("t"), normal_sf2(F.lit(1.959963984540054)).alias("z"), hypergeom_tail(F.lit(3), F.lit(0), F.lit(0), F.lit(17)).alias("h"), student_t_sf2(F.lit(None).cast("double"), F.lit(3.0)).alias("n")).first()
    assert r["t"] == pytest.approx(0.07338803, abs=1e-8) and r["z"] == pytest.approx(0.05) and r["h"] == pytest.approx(1 / math.comb(20, 3)) and r["n"] is None


def exact_tail(a, b, c, d):
    row, col, n = a + b, a + c, a + b + c + d
    top = sum(math.comb(col, k) * math.comb(n - col, row - k) for k in range(a, min(row, col) + 1) if row - k <= n - col)
    return float(Fraction(top, math.comb(n, row)))


def test_hypergeometric_tail_equals_fractions(spark):
    r = random.Random(5)
    tables = [(0, 2000, 2000, 0), (0, 1500, 2000, 500), (10, 1990, 1500, 500), (2000, 0, 0, 2000), (1990, 10, 20, 7980), (0, 0, 0, 5), (0, 0, 3, 4), (5, 0, 3, 4), (1, 0, 0, 0)]
    tables += [tuple(r.randrange(r.choice([3, 40, 2500])) for _ in range(4)) for _ in range(60)]
    tables = [t for t in tables if sum(t)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, a long, b long, c long, d long")
    got = {x["i"]: x["p"] for x in df.select("i", hypergeom_tail("a", "b", "c", "d").alias("p")).collect()}
    for i, t in enumerate(tables):
        assert got[i] == pytest.approx(exact_tail(*t), rel=1e-8, abs=1e-12), t
    assert got[0] == got[1] == got[2] == 1.0


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_group_medians_are_exact(spark, few):
    from respondex.plans.medians import group_medians

    r = random.Random(few)
    rows = [("a", r.gauss(0, 1)) for _ in range(2001)] + [("b", float(r.randrange(3))) for _ in range(1000)] + [("c", 7.0), ("d", 1.0), ("d", 2.0), ("e", None), (None, 3.0), (None, 5.0)] + [("z", 0.0)] * 400 + [("z", 1.0)] * 400
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {x["k"]: x["m"] for x in df.groupBy("k").agg(F.median("v").alias("m")).where("m IS NOT NULL").collect()}
    for accuracy in (10, 1000):
        assert {x["k"]: x["m"] for x in group_medians(df, "k", "v", "m", accuracy, few).collect()} == want


def test_no_task_reads_a_whole_sample(spark):
    """What is shuffled by the sample alone is sketches and sums; rows inside the bracket go by sample and value."""
    from respondex.plans import medians

    rows = spark.range(200_000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").cast("double").alias("v"))
    held, keep = {}, medians.staged

    def watched(df, name):
        out = keep(df, name)
        held[name] = (df._jdf.queryExecution().executedPlan().toString(), out.count())
        return out

    medians.staged = watched
    try:
        assert medians.group_medians(rows, "k", "v", accuracy=100).count() == 2
    finally:
        medians.staged = keep
    plan, n = held["median-counts"]
    assert all("side#" in line and "v#" in line for line in plan.split("\n") if "hashpartitioning(g#" in line) and "hashpartitioning(g#" in plan
    assert n < 0.08 * 200_000


def counts(spark, table):
    rows = [(f, s, s[0], int(s[1]), float(v)) for f, vs in table.items() for s, v in zip(("A0", "A1", "N0", "N1"), vs)]
    return spark.createDataFrame(rows, "feature string, sample string, condition string, replicate int, value double")


def test_size_factors_undo_depth(spark):
    c = counts(spark, {"x": [10, 20, 10, 20], "y": [20, 40, 20, 40], "z": [30, 60, 30, 60]})
    n = response.normalised(c, response.size_factors(c))
    assert all(len({round(r["norm"], 6) for r in n.where(F.col("feature") == f).collect()}) == 1 for f in "xyz")


def test_thresholds_are_strict(spark):
    rows = [(2.01, 0.049), (-2.01, 0.049), (2.0, 0.01), (3.0, 0.05), (None, 0.01), (3.0, None)]
    df = spark.createDataFrame(rows, "lfc double, padj double")
    got = [r[0] for r in df.select(scalar.response_label(F.col("lfc"), F.col("padj"), 2.0, 0.05)).collect()]
    assert got == ["up", "down", *["not_significant"] * 4]


def test_planted_responses_are_found(spark):
    rng = np.random.default_rng(42)
    rows = []
    for f in range(150):
        for c, up in (("A", 12 if f < 10 else 1), ("N", 1), ("R", 1)):
            for r in range(3):
                mu = 50 * up
                rows.append((f"g{f}", f"{c}{r}", c, r, float(rng.negative_binomial(10, 10 / (10 + mu)))))
    c = spark.createDataFrame(rows, "feature string, sample string, condition string, replicate int, value double")
    t = response.count_model_tests(response.count_model(response.normalised(c, response.size_factors(c)))).where("numerator = 'A' AND denominator = 'N'").collect()
    hits = {r["feature"] for r in t if r["padj"] < 0.05 and r["lfc"] > 2}
    assert len(hits & {f"g{i}" for i in range(10)}) >= 8 and len(hits) <= 12


def test_finalised_sources(spark):
    df = spark.createDataFrame([("a", 3.0, 0.01), ("b", -1.0, 0.5), ("c", 1.0, None), ("d", None, 0.2)], "id string, lfc double, p double").withColumn("f", F.lit(1))
    got = {r["id"]: (r["padj_source"], r["regulation"]) for r in response.finalised(df, family=["f"]).collect()}
    assert got == {"a": ("BH_from_pvalue", "up"), "b": ("BH_from_pvalue", "not_significant"), "c": ("no_valid_pvalue_set_to_1", "not_significant")}


def test_distances_and_components_agree_with_numpy(spark):
    c = counts(spark, {"x": [1, 5, 2, 8], "y": [3, 3, 9, 1], "z": [4, 7, 7, 2]})
    n = response.normalised(c, response.size_factors(c))
    m = np.array([[r["log2"] for r in n.where(F.col("sample") == s).orderBy("feature").collect()] for s in ("A0", "A1", "N0", "N1")])
    g = response.gram(n)
    got = {(r["a"], r["b"]): r["distance"] for r in response.distances(g).collect()}
    assert got["A0", "N1"] == pytest.approx(np.linalg.norm(m[0] - m[3]))
    score = {r["sample"]: r["score"] for r in response.principal_components(g).where("component = 1").collect()}
    u, s, _ = np.linalg.svd(m - m.mean(axis=0))
    assert [abs(score[x]) for x in ("A0", "A1", "N0", "N1")] == pytest.approx(np.abs(u[:, 0] * s[0]).tolist())


def test_shared_dispersions_are_nearer_the_planted_ones(spark):
    rng = np.random.default_rng(11)
    rows, true = [], {}
    for f in range(400):
        mu = float(np.exp(rng.uniform(3, 8)))
        true[f"g{f}"] = a = (0.05 + 3 / mu) * float(np.exp(rng.normal(0, 0.3)))
        rows += [(f"g{f}", c, float(rng.negative_binomial(1 / a, 1 / (1 + a * mu)))) for c in "AN" for _ in range(3)]
    d = response.shared_dispersions(spark.createDataFrame(rows, "feature string, condition string, norm double")).collect()
    off = lambda c: np.mean([(math.log(r[c]) - math.log(true[r["feature"]])) ** 2 for r in d])
    assert len(d) == 400 and off("dispersion") < 0.5 * off("own")
    one = response.shared_dispersions(spark.createDataFrame([("x", "A", 3.0), ("x", "A", 3.0)], "feature string, condition string, norm double")).first()
    assert one["dispersion"] == pytest.approx(1e-8)
    assert response.shared_dispersions(spark.createDataFrame([], "feature string, condition string, norm double")).count() == 0
