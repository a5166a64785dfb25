"""Queries: identities, pairs across classes, intervals, panels, component models."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.operators import candidates as c
from respondex.operators import checks, cross, identity, interval, modules, panel, response, reviews, store
from respondex.plans import bindings as b
from respondex.plans.q_candidates import stable
from respondex.plans.registry import query, rounded, table
from respondex.plans.staging import staged

_BRAND = "lower(p_brand || '-' || p_size || '-' || p_type)"


def _aliases(spark, d):
    p = table(spark, d, "part")
    brand = F.lower(F.concat_ws("-", "p_brand", "p_size", "p_type"))
    return p.select(brand.alias("token"), F.col("p_partkey").alias("feature"), F.col("p_partkey").alias("ord")).unionByName(p.select(F.lower(F.trim("p_name")).alias("token"), F.col("p_partkey").alias("feature"), (F.col("p_partkey") + 1_000_000_000).alias("ord")))


_AL = f"al AS (SELECT token, min_by(feature, (ord, feature)) AS feature FROM (SELECT {_BRAND} AS token, p_partkey AS feature, p_partkey AS ord FROM part UNION ALL SELECT lower(trim(p_name)), p_partkey, p_partkey + 1000000000 FROM part) GROUP BY 1)"


@query("j1_identity", f"WITH {_AL}, r AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN {_BRAND} ELSE 'b' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') END AS t0, CASE WHEN p_partkey % 4 < 2 THEN lower(trim(p_name)) WHEN p_partkey % 8 = 6 THEN 'orphan' || p_partkey END AS t1, CASE WHEN p_partkey % 4 < 2 THEN upper(p_name) WHEN p_partkey % 8 = 6 THEN 'Orphan' || p_partkey END AS s1 FROM part), j AS (SELECT r.*, coalesce(a.feature, c.feature) AS f FROM r LEFT JOIN al a ON a.token = t0 LEFT JOIN al c ON c.token = t1) SELECT key, CASE WHEN f IS NOT NULL THEN CAST(f AS VARCHAR) ELSE coalesce(s1, t0) END AS feature, CASE WHEN f % 2 = 0 THEN 'b' || lpad(CAST(f % 10000 AS VARCHAR), 4, '0') WHEN f IS NULL AND regexp_matches(t0, '^b\\d{{4}}$') THEN t0 END AS locus, CASE WHEN f IS NOT NULL THEN 'mapped' ELSE 'source_name' END AS basis FROM j")
def j1(spark, d):
    k = F.col("p_partkey")
    number = lambda c: F.concat(F.lit("b"), F.lpad((c % 10000).cast("string"), 4, "0"))
    rows = table(spark, d, "part").select(k.alias("key"), F.when(k % 3 == 0, F.concat_ws("-", "p_brand", "p_size", "p_type")).otherwise(number(k)).alias("locus"), F.when(k % 4 < 2, F.upper("p_name")).when(k % 8 == 6, F.concat(F.lit("Orphan"), k)).alias("symbol"))
    aliases = _aliases(spark, d).withColumn("locus", F.when(F.col("feature") % 2 == 0, number(F.col("feature"))))
    return identity.resolved(rows, "key", ["locus", "symbol"], identity.alias_map(aliases), ["symbol", "locus"], ["locus"])


@query("j26_component_features", f"WITH {_AL} SELECT s_suppkey AS key, a.feature, CASE WHEN a.feature IS NOT NULL THEN 'mapped' ELSE 'unknown' END AS basis FROM supplier LEFT JOIN (SELECT p_partkey, lower(trim(p_name)) AS t FROM part) p ON p_partkey = s_suppkey LEFT JOIN al a ON a.token = t")
def j26(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_name"), "s_suppkey", "left").select(F.col("s_suppkey").alias("key"), "p_name")
    return identity.resolved(rows, "key", ["p_name"], identity.alias_map(_aliases(spark, d))).drop("locus")


@query("j2_annotation", "SELECT l_partkey AS feature, p_name, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 > 0) ON p_partkey = l_partkey GROUP BY 1, 2")
def j2(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(F.count("*").alias("n"))
    return n.join(table(spark, d, "part").where("p_partkey % 7 > 0").select(F.col("p_partkey").alias("feature"), "p_name"), "feature", "left")


@query("j3_shared_samples", b.with_tables("counts", "SELECT sample, count(*) AS n, sum(CASE WHEN feature % 97 = 0 AND condition = 'N' THEN 1 ELSE 0 END)::BIGINT AS disagree FROM counts GROUP BY 1"))
def j3(spark, d):
    x = b.counts(spark, d)
    again = x.where("condition = 'N'").select(F.lit("two").alias("dataset"), "sample", "feature", "condition", (F.col("value") + F.when(F.col("feature") % 97 == 0, 1).otherwise(0)).alias("value"))
    once, bad = identity.shared_samples(x.select(F.lit("one").alias("dataset"), "sample", "feature", "condition", "value").unionByName(again))
    return once.groupBy("sample").agg(F.count("*").alias("n")).join(bad.groupBy("sample").agg(F.count("*").alias("disagree")), "sample", "left").withColumn("disagree", F.coalesce("disagree", F.lit(0)))


_MAP = "SELECT feature, tu, promoter, CASE WHEN tu IS NULL THEN 'no_unit' WHEN promoter IS NULL THEN 'unit_without_promoter' ELSE 'mapped' END AS status FROM (SELECT p_partkey AS feature FROM part) LEFT JOIN (SELECT DISTINCT tu, gene AS feature FROM tu_genes WHERE gene % 6 > 0) USING (feature) LEFT JOIN tu_promoters USING (tu)"


def _mapped(spark, d):
    t = b.tu_genes(spark, d)
    return panel.promoter_map(table(spark, d, "part").select(F.col("p_partkey").alias("feature")), t.where("gene % 6 > 0"), b.tu_promoters(t))


@query("j4_promoter_map", b.with_tables("tu_promoters", _MAP))
def j4(spark, d):
    return _mapped(spark, d)


@query("a17_promoter_rollup", b.with_tables("tu_promoters", f", m AS ({_MAP}) SELECT promoter, list_sort(list(DISTINCT feature)) AS features, list_sort(list(DISTINCT tu)) AS units, list_sort(list(DISTINCT CASE WHEN p_size > 25 THEN 'A' ELSE 'B' END)) AS tiers FROM m JOIN part ON p_partkey = feature WHERE status = 'mapped' GROUP BY 1"), lists=("features", "units", "tiers",))
def a17(spark, d):
    tiers = table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.when(F.col("p_size") > 25, "A").otherwise("B").alias("tier"))
    return panel.promoter_rollup(_mapped(spark, d), tiers)


def _pairs(spark, d):
    """Pair results of all conditions with a p from the effect."""
    return response.count_model(b.norm(spark, d)).select("feature", "numerator", "denominator", "lfc", "ci_low", "ci_high")


_PAIRS = ", disp AS (SELECT feature, greatest(coalesce(sum((n - 1) * (v - m)) / nullif(sum((n - 1) * m * m), 0), 1e-8), 1e-8) AS dispersion FROM (SELECT feature, condition, avg(norm) AS m, var_samp(norm) AS v, count(*) AS n FROM norm GROUP BY 1, 2) GROUP BY 1), gm AS (SELECT feature, condition, m + 0.5 AS mu, (1 + dispersion * (m + 0.5)) / (n * (m + 0.5)) AS v FROM (SELECT feature, condition, avg(norm) AS m, count(*) AS n FROM norm GROUP BY 1, 2) JOIN disp USING (feature)), pr AS (SELECT a.feature, a.condition AS numerator, b.condition AS denominator, log2(a.mu / b.mu) AS lfc, sqrt(a.v + b.v) / ln(2.0) AS se FROM gm a JOIN gm b ON a.feature = b.feature AND a.condition <> b.condition)"


@query("j6_oriented_pairs", b.with_tables("obs", _PAIRS + " SELECT feature, numerator, denominator, round(lfc, 6) + 0.0 AS lfc, round(lfc - 1.96 * se, 6) + 0.0 AS ci_low, round(lfc + 1.96 * se, 6) + 0.0 AS ci_high FROM pr WHERE (feature % 2 = 0 AND numerator = 'R' AND denominator = 'A') OR (feature % 2 = 1 AND numerator = 'A' AND denominator = 'N')"))
def j6(spark, d):
    even = F.col("p_partkey") % 2 == 0
    wanted = table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.when(even, "R").otherwise("A").alias("numerator"), F.when(even, "A").otherwise("N").alias("denominator"))
    return rounded(cross.oriented_pairs(wanted, _pairs(spark, d)))


def _seeds(spark, d, o=None):
    o = staged(b.observations(spark, d), "observations") if o is None else o
    return o, o.where(c.hit(b.P_MAX, b.LFC_MIN, up_only=True) & (F.col("role") == "discovery")).select("feature", "dataset", "class", "lfc")


def _counterparts(spark, d, o=None):
    o, s = _seeds(spark, d, o)
    o = o.withColumn("ci_low", F.col("lfc") - 0.5).withColumn("ci_high", F.col("lfc") + 0.5)
    return cross.counterparts(s, o, [(n, cls) for n, _, _, cls, _ in b.CONTRASTS])


@query("j7_counterparts", b.with_tables("hits", "SELECT h.feature, h.dataset, o.dataset AS other, round(o.lfc, 6) + 0.0 AS other_lfc, round(o.p, 6) AS other_p FROM hits h JOIN obs o ON o.feature = h.feature AND o.class <> h.class WHERE h.hit AND h.lfc > 0 AND h.role = 'discovery'"))
def j7(spark, d):
    return rounded(_counterparts(spark, d).select("feature", "dataset", "other", "other_lfc", "other_p"))


_CROSS = ", fam AS (SELECT feature, lfc, eligible, least(1.0, min(raw) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS family_padj FROM (SELECT feature, lfc, p, eligible, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM obs WHERE dataset = 'versus' AND p IS NOT NULL)), cr AS (SELECT h.feature, h.dataset, h.class, o.dataset AS other, o.lfc AS other_lfc, o.p AS other_p, o.eligible AS other_eligible, v.eligible, family_padj, CASE h.dataset WHEN 'alpha' THEN v.lfc ELSE -v.lfc END AS lfc FROM hits h JOIN obs o ON o.feature = h.feature AND o.class <> h.class LEFT JOIN fam v ON v.feature = h.feature AND o.role = 'discovery' WHERE h.hit AND h.lfc > 0 AND h.role = 'discovery'), st AS (SELECT *, CASE WHEN eligible AND family_padj < 0.9 AND lfc - 0.5 > 0 THEN 'discovery_response_stronger' WHEN eligible AND family_padj < 0.9 AND lfc + 0.5 < 0 THEN 'counterpart_response_stronger' ELSE 'inconclusive' END AS status, coalesce(other_eligible AND other_p < 0.9 AND abs(other_lfc) > 1, false) AS detected, coalesce(other_eligible AND other_lfc - 0.5 > -1 AND other_lfc + 0.5 < 1, false) AS within_bound FROM cr)"


def _cross(spark, d, o=None):
    o = staged(b.observations(spark, d), "observations") if o is None else o
    drug = lambda c: F.when(F.col(c) == "alpha", "A").when(F.col(c) == "rho", "R")  # noqa: E731  a challenge has no pair result of its own
    w = _counterparts(spark, d, o).withColumns({"numerator": drug("dataset"), "denominator": drug("other")}).drop("lfc")
    v = o.where("dataset = 'versus'").select("feature", F.lit("A").alias("numerator"), F.lit("R").alias("denominator"), "lfc", "p", "eligible", (F.col("lfc") - 0.5).alias("ci_low"), (F.col("lfc") + 0.5).alias("ci_high"))
    return cross.status(cross.oriented_pairs(w, cross.family_adjusted(v).drop("p")), 0.9, b.LFC_MIN, 1.0)


@query("i4_cross_status", b.with_tables("hits", _CROSS + " SELECT feature, dataset, other, status, detected, within_bound FROM st"))
def i4(spark, d):
    return _cross(spark, d).select("feature", "dataset", "other", "status", "detected", "within_bound")


@query("a18_cross_summary", b.with_tables("hits", _CROSS + " SELECT feature, class, round(avg(CASE WHEN status = 'discovery_response_stronger' THEN 1.0 ELSE 0.0 END), 6) AS stronger_fraction, round(max(abs(other_lfc)), 6) AS max_other FROM st GROUP BY 1, 2"))
def a18(spark, d):
    return rounded(cross.summary(_cross(spark, d)))


@query("j8_interval_overlap", b.with_tables("events_iv", "SELECT a.event_id, b.event_id AS event_id_b FROM events_iv a JOIN events_iv b ON a.user_id = b.user_id AND a.s <= b.e AND b.s <= a.e WHERE a.event_id < b.event_id AND a.s <= a.e AND b.s <= b.e"))
def j8(spark, d):
    iv = b.intervals(spark, d)
    return interval.overlaps(iv, iv, ["user_id"], 3600).where("event_id < event_id_b").select("event_id", "event_id_b")


_PROM = ", prom AS (SELECT p_partkey AS promoter, CASE WHEN p_partkey % 9 > 0 THEN p_partkey * 37 % 100000 END AS tss, CASE p_partkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '?' ELSE '+' END AS strand FROM part), sites AS (SELECT p_partkey AS promoter, p_partkey * 37 % 100000 + p_size * 3 - 80 AS left, p_partkey * 37 % 100000 + p_size * 5 - 100 AS right FROM part UNION ALL SELECT p_partkey, p_partkey * 37 % 100000 - 300, p_partkey * 37 % 100000 - 280 FROM part WHERE p_size % 4 = 0), vs AS (SELECT * FROM sites WHERE \"left\" > 0 AND \"right\" >= \"left\"), ln AS (SELECT promoter, min(\"left\") AS l, max(\"right\") AS r, count(*) AS sites FROM vs GROUP BY 1), w AS (SELECT *, tss IS NOT NULL AND strand IN ('+', '-') AS ok, CASE strand WHEN '+' THEN tss - 200 ELSE tss - 30 END AS lo, CASE strand WHEN '+' THEN tss + 30 ELSE tss + 200 END AS hi FROM prom LEFT JOIN ln USING (promoter)), frag AS (SELECT promoter, tss, strand, CASE WHEN ok THEN greatest(1, least(lo, coalesce(l, lo))) END AS start, CASE WHEN ok THEN least(100000, greatest(hi, coalesce(r, hi))) END AS \"end\", coalesce(sites, 0) AS sites, coalesce(ok AND (l < lo OR r > hi), false) AS stretched, CASE WHEN ok THEN 'ready' ELSE 'missing_coordinates' END AS status FROM w)"


def _promoters(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    prom = p.select(k.alias("promoter"), F.when(k % 9 > 0, k * 37 % 100000).alias("tss"), F.when(k % 5 == 0, "-").when(k % 5 == 1, "?").otherwise("+").alias("strand"))
    at = k * 37 % 100000
    sites = p.select(k.alias("promoter"), (at + F.col("p_size") * 3 - 80).alias("left"), (at + F.col("p_size") * 5 - 100).alias("right")).unionByName(p.where("p_size % 4 = 0").select(k.alias("promoter"), (at - 300).alias("left"), (at - 280).alias("right")))
    return prom, sites


@query("i1_fragments", b.with_tables("cells", _PROM + ", gn AS (SELECT s_suppkey AS gene, s_suppkey * 91 % 100000 AS s, s_suppkey * 91 % 100000 + 60 AS e FROM supplier) SELECT frag.*, coalesce(sl.site_list, []) AS site_list, coalesce(gl.genes, []) AS genes FROM frag LEFT JOIN (SELECT promoter, list_transform(list_sort(list(DISTINCT {'a': \"left\", 'b': \"right\"})), lambda x: x.a || '-' || x.b) AS site_list FROM vs GROUP BY 1) sl USING (promoter) LEFT JOIN (SELECT promoter, list_sort(list(DISTINCT gene)) AS genes FROM frag JOIN gn ON s <= \"end\" AND e >= start WHERE status = 'ready' GROUP BY 1) gl USING (promoter)"), lists=("site_list", "genes"))
def i1(spark, d):
    prom, sites = _promoters(spark, d)
    at = F.col("s_suppkey") * 91 % 100_000
    genes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("gene"), at.alias("s"), (at + 60).alias("e"))
    return interval.fragments(prom, sites, 100_000, 200, 30, genes).withColumn("site_list", F.transform("site_list", lambda x: F.concat_ws("-", x["left"], x["right"])))


@query("i3_valid_sites", b.with_tables("cells", _PROM + " SELECT promoter, \"left\", \"right\" FROM vs"))
def i3(spark, d):
    return interval.valid_sites(_promoters(spark, d)[1])


@query("j9_linked_sites", b.with_tables("cells", _PROM + " SELECT promoter, count(DISTINCT (\"left\", \"right\")) AS linked, count(DISTINCT CASE WHEN \"left\" < start OR \"right\" > \"end\" THEN (\"left\", \"right\") END) AS outside FROM frag JOIN vs USING (promoter) WHERE status = 'ready' GROUP BY 1"))
def j9(spark, d):
    prom, sites = _promoters(spark, d)
    return interval.linked_sites(interval.fragments(prom, sites, 100_000, 200, 30).where("status = 'ready'"), sites)


_GENOME = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


_CUT = f"SELECT doc_id, upper({_GENOME}) AS g FROM documents WHERE text IS NOT NULL"


@query("i2_reference_match", f"SELECT doc_id * 1000 + k AS id, CASE WHEN k % 5 < 4 THEN k % 3 > 0 AND 40 * k + 51 <= length(g) END AS matches FROM (SELECT doc_id, g, unnest(range(0, greatest(1, length(g) // 40))) AS k FROM ({_CUT})) WHERE k < 1000")
def i2(spark, d):
    """A 20-base sequence at every 40th base of each document's letters as a genome, one of three spoiled, one of five without a start."""
    g = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    docs = table(spark, d, "documents").select("doc_id", g.alias("g")).where("g IS NOT NULL")
    width, k = 256, F.col("k")
    chunks = interval.chunked(docs, "doc_id", "g", width)
    blocks = F.when(F.length("g") < 32, F.array(F.lit(""))).otherwise(interval.cut(F.substring("g", 32, 1 << 30), 40))  # a block begins with its piece
    at = docs.select("doc_id", F.length("g").alias("n"), F.posexplode(blocks).alias("k", "block")).where(k < F.greatest(F.lit(1), F.floor(F.col("n") / 40)))
    piece = F.substring("block", 1, 20)
    spoiled = F.when(k % 3 > 0, piece).otherwise(F.concat(F.lit("n"), F.substring(piece, 2, 19)))
    filled = F.rpad(F.lower(spoiled), 20, "a")  # past the end of a genome nothing is there to match
    seq = F.concat(F.substring(filled, 1, 10), F.upper(F.substring(filled, 11, 1)), F.substring(filled, 12, 9))
    rows = at.where(k < 1000).select((F.col("doc_id") * 1000 + k).alias("id"), F.col("doc_id").alias("contig"), seq.alias("seq"), F.when(k % 5 < 4, 40 * k + 42).alias("tss"), F.lit("+").alias("strand"))
    return interval.reference_match(rows, chunks, width)


def _options(spark, d):
    """Panel options, rounded as their SQL is, staged; normalised counts and observations are made once."""
    n = staged(b.norm(spark, d), "norm")
    o = staged(b.observations(spark, d, n), "observations")
    s = staged(stable(spark, d, o), "stable")
    regs = b.edges(spark, d, s).groupBy(F.col("dst").alias("feature")).agg(F.array_sort(F.collect_set("src")).alias("regulators"))
    cv = response.replicate_summary(n, ["feature", "condition"]).where("condition <> 'N'").select("feature", "cv")
    mapped = _mapped(spark, d).where("status = 'mapped'").select("feature", "promoter")
    groups = panel.feature_groups(b.tu_genes(spark, d).where("gene % 6 > 0").select(F.col("tu").alias("unit"), F.col("gene").alias("member")))
    fragments = b.tu_promoters(b.tu_genes(spark, d)).select("promoter").distinct().select("promoter", (F.col("promoter") % 4).cast("int").alias("confidence_rank"), (F.col("promoter") % 5 > 0).alias("matches"))
    return staged(rounded(panel.options(s, cross.summary(_cross(spark, d, o)), cv, regs, mapped, groups, fragments)), "options")


_OPT = _CROSS + ", sm AS (SELECT feature, class, avg(CASE WHEN status = 'discovery_response_stronger' THEN 1.0 ELSE 0.0 END) AS stronger_fraction, max(abs(other_lfc)) AS max_other FROM st GROUP BY 1, 2), rg AS (SELECT dst AS feature, list_sort(list(DISTINCT src)) AS regulators FROM edges GROUP BY 1), cvs AS (SELECT feature, max(CASE WHEN m > 0 THEN s / m END) AS max_cv FROM (SELECT feature, condition, avg(norm) AS m, stddev_samp(norm) AS s FROM norm WHERE condition <> 'N' GROUP BY 1, 2) GROUP BY 1), tl AS (SELECT DISTINCT a.tu AS x, b.tu AS y FROM tu_genes a JOIN tu_genes b USING (gene) WHERE gene % 6 > 0), tr AS (SELECT x, x AS y FROM tl UNION SELECT tr.x, tl.y FROM tr JOIN tl ON tl.x = tr.y), tg AS (SELECT gene AS feature, min(y) AS grp FROM tu_genes JOIN tr ON x = tu WHERE gene % 6 > 0 GROUP BY 1), opt AS (SELECT stab.feature, stab.class, promoter, coalesce(grp, -stab.feature) AS grp, n_supporting, round(raw_effect, 6) AS raw_effect, round(effect, 6) AS effect, CAST(passed AS INTEGER) AS passed, round(passed / 9, 6) AS screen_fraction, round(stronger_fraction, 6) AS stronger_fraction, round(max_other, 6) AS max_other, round(max_cv, 6) AS max_cv, regulators, CAST(promoter % 4 AS INTEGER) AS confidence_rank, promoter % 5 > 0 AS matches FROM stab JOIN rg USING (feature) JOIN (SELECT DISTINCT feature, promoter FROM (" + _MAP + ") WHERE status = 'mapped') m ON m.feature = stab.feature LEFT JOIN tg ON tg.feature = stab.feature LEFT JOIN sm ON sm.feature = stab.feature AND sm.class = stab.class LEFT JOIN cvs ON cvs.feature = stab.feature)"
_REUSE = "CASE WHEN len(regulators) > 0 THEN coalesce(list_sum(list_transform(regulators, lambda r: len(list_filter(rs, lambda x: x = r)))), 0) END"


def _picks(name: str, order: str, once: dict[str, str], more: str = "") -> str:
    """A recursive table ``name`` of greedy picks, a class in turn; once: lists of values that were taken, by column."""
    lists = {"rs": "regulators"} | once
    start = ", ".join(f"CAST([] AS BIGINT[]) AS {x}" for x in lists)
    grown = ", ".join(f"CASE WHEN feature IS NULL THEN {x} WHEN {c} IS NULL THEN {x} ELSE {'list_concat' if x == 'rs' else 'list_append'}({x}, {c}) END" for x, c in lists.items())
    free = " AND ".join(f"NOT list_contains(s.{x}, o.{c})" for x, c in once.items())
    fields = ["class", "feature", "promoter", "grp", "effect", "screen_fraction", "max_other"]
    kinds = ["VARCHAR", "BIGINT", "BIGINT", "BIGINT", "DOUBLE", "DOUBLE", "DOUBLE"]
    empty = ", ".join(f"CAST(NULL AS {k}) AS {f}" for f, k in zip(fields, kinds))
    return f", {name} AS (SELECT 0 AS step, {start}, {empty} UNION ALL SELECT step + 1, {grown}, {', '.join(fields)} FROM (SELECT s.step, {', '.join('s.' + x for x in lists)}, o.* FROM {name} s LEFT JOIN opt o ON o.matches AND o.class = (CASE s.step % 2 WHEN 0 THEN 'one' ELSE 'two' END) AND {free} {more} WHERE s.step < 12 ORDER BY {order} LIMIT 1))"


_BALANCED = _picks("pick", f"n_supporting DESC NULLS LAST, screen_fraction DESC NULLS LAST, confidence_rank DESC NULLS LAST, {_REUSE} ASC NULLS LAST, stronger_fraction DESC NULLS LAST, max_other ASC NULLS LAST, effect DESC NULLS LAST, feature, promoter", {"ps": "promoter", "gs": "grp"})
_BASELINE = _picks("base", "effect DESC NULLS LAST, confidence_rank DESC NULLS LAST, feature, promoter", {"fs": "feature"}, "AND o.effect IS NOT NULL")
_PICKED = "SELECT CAST(row_number() OVER (ORDER BY step) AS INTEGER) AS place, class, feature, promoter, grp, effect FROM {} WHERE feature IS NOT NULL"
_SHOWN = ["place", "class", "feature", "promoter", "grp", "effect"]


@query("j5_panel_options", b.with_tables("tu_promoters", _OPT + " SELECT * FROM opt", recursive=True), lists=("regulators",))
def j5(spark, d):
    return _options(spark, d)


@query("k5_balanced_panel", b.with_tables("tu_promoters", _OPT + _BALANCED + _PICKED.format("pick"), recursive=True))
def k5(spark, d):
    return panel.balanced(_options(spark, d), 6).select(_SHOWN)


@query("k6_effect_only_panel", b.with_tables("tu_promoters", _OPT + _BASELINE + _PICKED.format("base"), recursive=True))
def k6(spark, d):
    return panel.effect_only(_options(spark, d), 6).select(_SHOWN)


_METRICS = "SELECT '{0}' AS panel, count(*) AS n, count(DISTINCT feature) AS features, count(DISTINCT promoter) AS promoters, count(DISTINCT grp) AS groups, round(median(effect), 6) AS median_effect, round(median(screen_fraction), 6) AS median_screen, round(median(max_other), 6) AS median_other, count(*) FILTER (WHERE max_other IS NULL) AS missing_other FROM {0} WHERE feature IS NOT NULL"


@query("k7_selection_comparison", b.with_tables("tu_promoters", _OPT + _BALANCED + _BASELINE + _METRICS.format("pick") + " UNION ALL " + _METRICS.format("base"), recursive=True))
def k7(spark, d):
    o = _options(spark, d)
    named = lambda p, n: panel.metrics(p).withColumn("panel", F.lit(n))
    return rounded(named(panel.balanced(o, 6), "pick").unionByName(named(panel.effect_only(o, 6), "base")))


#: Checks of a panel ``pn`` of at most 6 options a class against the pool ``pl``.
_VIOLATIONS = " SELECT 'budget' AS \"check\", class AS key FROM pn GROUP BY 2 HAVING count(*) > 6 UNION ALL SELECT 'repeated_option', concat_ws('|', class, feature, promoter) FROM pl GROUP BY class, feature, promoter HAVING count(*) > 1 UNION ALL SELECT 'outside_pool', concat_ws('|', class, feature, promoter) FROM pn WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.class = pn.class AND pl.feature = pn.feature AND pl.promoter = pn.promoter) UNION ALL SELECT DISTINCT 'stale_metrics', concat_ws('|', pn.class, pn.feature, pn.promoter) FROM pn JOIN pl USING (class, feature, promoter) WHERE abs(pn.effect - pl.effect) > 1e-9 * greatest(abs(pn.effect), abs(pl.effect)) OR abs(pn.screen_fraction - pl.screen_fraction) > 1e-9 OR abs(pn.max_other - pl.max_other) > 1e-9 * greatest(abs(pn.max_other), abs(pl.max_other)) OR (pn.effect IS NULL) <> (pl.effect IS NULL) OR (pn.max_other IS NULL) <> (pl.max_other IS NULL)"
_CHOSEN = ", pk AS (SELECT step, class, feature, promoter, effect, screen_fraction, max_other FROM pick WHERE feature IS NOT NULL)"


@query("k7_panel_violations", b.with_tables("tu_promoters", _OPT + _BALANCED + _CHOSEN + ", pl AS (SELECT * FROM opt WHERE matches), pn AS (SELECT * FROM pk)" + _VIOLATIONS, recursive=True))
def k7_violations(spark, d):
    """A panel made from its own pool within its budget violates nothing, as every option is there once."""
    o = _options(spark, d)
    return panel.violations(panel.balanced(o, 6), o, 6)


@query("k7_planted_violations", b.with_tables("tu_promoters", _OPT + _BALANCED + _CHOSEN + ", pl AS (SELECT class, feature, promoter, effect, screen_fraction, max_other FROM opt WHERE matches UNION ALL SELECT class, feature, promoter, effect, screen_fraction, max_other FROM opt WHERE matches AND feature = (SELECT min(feature) FROM opt WHERE matches)), pn AS (SELECT class, feature, promoter, CASE WHEN class = 'one' THEN effect + 1 ELSE effect END AS effect, screen_fraction, max_other FROM pk UNION ALL SELECT class, -feature, promoter, effect, screen_fraction, max_other FROM pk WHERE class = 'two')" + _VIOLATIONS, recursive=True))
def k7_planted(spark, d):
    """The same checks of a panel with changed effects in one class, picks from outside the pool in the other, and a pool that repeats the options of its first feature."""
    o = _options(spark, d)
    p = panel.balanced(o, 6)
    first = o.where("matches").agg(F.min("feature").alias("feature"))
    changed = p.withColumn("effect", F.when(F.col("class") == "one", F.col("effect") + 1).otherwise(F.col("effect")))
    outside = p.where("class = 'two'").withColumn("feature", -F.col("feature"))
    return panel.violations(changed.unionByName(outside), o.unionByName(o.join(first, "feature", "left_semi").select(o.columns)), 6)


@query("k8_panel_listing", b.with_tables("tu_promoters", _OPT + _BALANCED + " SELECT CAST(row_number() OVER (ORDER BY step) AS INTEGER) AS place, class, feature, promoter FROM pick WHERE feature IS NOT NULL", recursive=True))
def k8_listing(spark, d):
    return panel.listing(panel.balanced(_options(spark, d), 6)).select("place", "class", "feature", "promoter")


@query("k8_quality_listing", b.with_tables("counts", "SELECT sample, sum(value) AS library_size, count(*) FILTER (WHERE value > 0) AS features_detected FROM counts GROUP BY 1"))
def k8_quality(spark, d):
    return panel.quality_listing(response.sample_quality(b.counts(spark, d)))


@query("k8_first_choice", b.with_tables("tu_promoters", _OPT + " SELECT class, min_by(feature, (-effect, feature)) AS feature FROM opt GROUP BY 1", recursive=True))
def k8(spark, d):
    """The largest effect of each class."""
    return _options(spark, d).groupBy("class").agg(F.min_by("feature", F.struct(-F.col("effect"), F.col("feature"))).alias("feature"))


_REV = ", nw AS (SELECT user_id AS feature, max_by(event_type, (ts, event_id)) AS status FROM events GROUP BY 1)"


@query("j15_panel_review", b.with_tables("tu_promoters", _OPT + _BALANCED + _REV + " SELECT feature, promoter, coalesce(status, 'unreviewed') AS status FROM pick LEFT JOIN nw USING (feature) WHERE feature IS NOT NULL", recursive=True))
def j15(spark, d):
    newest = reviews.latest(table(spark, d, "events").select(F.col("user_id").alias("feature"), F.col("event_id").alias("edit_id"), F.col("ts").alias("edited_at"), F.col("event_type").alias("status")), ["feature"])
    return store.panel_review(panel.balanced(_options(spark, d), 6), newest).select("feature", "promoter", "status")


@query("a22_panel_metrics", b.with_tables("tu_promoters", _OPT + " SELECT class, count(*) AS n, count(DISTINCT promoter) AS promoters, count(DISTINCT grp) AS groups, round(median(effect), 6) AS median_effect, count(*) FILTER (WHERE max_other IS NULL) AS missing FROM opt GROUP BY 1", recursive=True))
def a22(spark, d):
    o = _options(spark, d)
    return rounded(o.groupBy("class").agg(F.count("*").alias("n"), F.count_distinct("promoter").alias("promoters"), F.count_distinct("grp").alias("groups"), F.median("effect").alias("median_effect"), F.count_if(F.col("max_other").isNull()).alias("missing")))


@query("a19_response_pivot", b.with_tables("obs", "SELECT feature, round(max(lfc) FILTER (WHERE dataset = 'alpha'), 6) + 0.0 AS alpha, round(max(lfc) FILTER (WHERE dataset = 'rho'), 6) + 0.0 AS rho, round(max(lfc) FILTER (WHERE dataset = 'versus'), 6) + 0.0 AS versus FROM obs GROUP BY 1"))
def a19(spark, d):
    return rounded(b.observations(spark, d).groupBy("feature").pivot("dataset", ["alpha", "rho", "versus"]).agg(F.max("lfc")))


@query("a23_paired_summary", "SELECT feature, round(median(basal) FILTER (WHERE delta IS NOT NULL), 6) AS basal, round(median(induced) FILTER (WHERE delta IS NOT NULL), 6) AS induced, round(median(delta), 6) + 0.0 AS delta, count(delta) AS backgrounds, count(*) FILTER (WHERE delta IS NULL) AS unavailable FROM (SELECT *, induced - basal AS delta FROM (SELECT user_id AS feature, event_id % 4 AS background, median(value) FILTER (WHERE event_type IN ('view', 'click')) AS basal, median(value) FILTER (WHERE event_type NOT IN ('view', 'click')) AS induced FROM events GROUP BY 1, 2)) GROUP BY 1")
def a23(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("feature"), (F.col("event_id") % 4).alias("background"), F.when(F.col("event_type").isin("view", "click"), "basal").otherwise("induced").alias("side"), "value")
    return rounded(modules.paired(e))


@query("a24_membership", b.with_tables("weights", "SELECT feature, component, round(weight, 6) AS weight FROM weights WHERE abs(weight) > 0.25"))
def a24(spark, d):
    return rounded(modules.membership(b.weights(spark, d), 0.25).drop("label"))


@query("a24_primary_component", b.with_tables("weights", "SELECT feature, CAST(min_by(component, (-abs(weight), component)) AS INTEGER) AS component FROM weights GROUP BY 1"))
def a24_primary(spark, d):
    return modules.primary(b.weights(spark, d)).select("feature", "component")


@query("a25_burden", b.with_tables("weights", "SELECT feature, CASE WHEN component % 3 = 0 THEN 'growth' ELSE 'stress' END AS category, round(sum(abs(weight)), 6) AS total FROM weights GROUP BY 1, 2"))
def a25(spark, d):
    w = b.weights(spark, d)
    cats = w.select("component").distinct().withColumn("category", F.when(F.col("component") % 3 == 0, "growth").otherwise("stress"))
    return rounded(modules.burden(w, cats))


@query("a26_component_sets", b.with_tables("weights", ", m AS (SELECT DISTINCT component, feature FROM weights WHERE abs(weight) > 0.2), s AS (SELECT DISTINCT label AS set, feature FROM weights), x AS (SELECT component, set, count(*) AS shared FROM m JOIN s USING (feature) GROUP BY 1, 2), y AS (SELECT x.*, n AS in_component, k AS in_set FROM x JOIN (SELECT component, count(*) AS n FROM m GROUP BY 1) USING (component) JOIN (SELECT set, count(*) AS k FROM s GROUP BY 1) USING (set)) SELECT component, set, shared, in_component, in_set, round(shared / in_component, 6) AS precision, round(shared / in_set, 6) AS recall, round(2 * shared / (in_component + in_set), 6) AS f1 FROM y QUALIFY row_number() OVER (PARTITION BY component ORDER BY round(2 * shared / (in_component + in_set), 9) DESC, round(shared / in_component, 9) DESC, set) = 1"))
def a26(spark, d):
    w = b.weights(spark, d)
    t = modules.component_sets(modules.membership(w, 0.2), w.select(F.col("label").alias("set"), "feature"))
    return rounded(modules.top_set(t, [F.round("f1", 9).desc(), F.round("precision", 9).desc()]))


@query("a26_enriched_sets", b.with_tables("weights", ", m AS (SELECT DISTINCT component, feature FROM weights WHERE abs(weight) > 0.2), s AS (SELECT DISTINCT label AS set, feature FROM weights), u AS (SELECT count(DISTINCT feature) AS features FROM weights), y AS (SELECT x.*, n AS in_component, k AS in_set, features FROM (SELECT component, set, count(*) AS shared FROM m JOIN s USING (feature) GROUP BY 1, 2) x JOIN (SELECT component, count(*) AS n FROM m GROUP BY 1) USING (component) JOIN (SELECT set, count(*) AS k FROM s GROUP BY 1) USING (set), u), f AS (SELECT component, set, shared, in_component, in_set, round(least(1.0, sum(exp(lgamma(in_component + 1) + lgamma(features - in_component + 1) + lgamma(in_set + 1) + lgamma(features - in_set + 1) - lgamma(features + 1) - lgamma(j + 1) - lgamma(in_component - j + 1) - lgamma(in_set - j + 1) - lgamma(features - in_component - in_set + j + 1)))), 9) AS p FROM (SELECT *, unnest(range(shared, least(in_component, in_set) + 1)) AS j FROM y) WHERE features - in_component - in_set + j >= 0 GROUP BY 1, 2, 3, 4, 5), q AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM f)) SELECT component, set, shared, round(shared / in_component, 6) AS precision, round(shared / in_set, 6) AS recall, round(2 * shared / (in_component + in_set), 6) AS f1, round(p, 6) AS p, round(q, 5) AS q FROM q WHERE round(q, 6) <= 0.9 QUALIFY row_number() OVER (PARTITION BY component ORDER BY round(q, 6), round(2 * shared / (in_component + in_set), 9) DESC, round(shared / in_component, 9) DESC, set) = 1"))
def a26_enriched(spark, d):
    """The set of the least q of each component, cut at q 0.9 as the vectors are random."""
    w = b.weights(spark, d)
    t = modules.enriched_sets(modules.membership(w, 0.2), w.select(F.col("label").alias("set"), "feature"), w.select("feature").distinct().count(), 1.0).where(F.round("q", 6) <= 0.9)
    top = modules.top_set(t, [F.round("q", 6), F.round("f1", 9).desc(), F.round("precision", 9).desc()])
    return rounded(top.withColumn("q", F.round("q", 5)).drop("in_component", "in_set"))


_SETS = "SELECT DISTINCT label AS set, feature FROM weights UNION SELECT DISTINCT 100 + feature % 7, feature FROM weights UNION SELECT DISTINCT 200 + feature % 11, feature FROM weights UNION SELECT DISTINCT 300 + feature // 60, feature FROM weights"


@query("a26_combined_sets", b.with_tables("weights", f", m AS (SELECT DISTINCT component, feature FROM weights WHERE abs(weight) > 0.2), s AS ({_SETS}), u AS (SELECT count(DISTINCT feature) AS features FROM weights), nc AS (SELECT component, count(*) AS n_c FROM m GROUP BY 1), h AS (SELECT component, set, count(*) AS hit FROM m JOIN s USING (feature) GROUP BY 1, 2), r AS (SELECT component, count(*) * count(*) AS tests FROM h GROUP BY 1), pr AS (SELECT x.component, x.set AS a, y.set AS b FROM h x JOIN h y ON x.component = y.component AND x.set < y.set), o AS (SELECT component, set AS a, NULL::BIGINT AS b, 'one' AS op, feature FROM h JOIN s USING (set) UNION ALL SELECT component, a, b, 'or', feature FROM pr JOIN s ON s.set = a UNION SELECT component, a, b, 'or', feature FROM pr JOIN s ON s.set = b UNION ALL SELECT component, a, b, 'and', x.feature FROM pr JOIN s x ON x.set = a JOIN s y ON y.set = b AND y.feature = x.feature), c AS (SELECT o.component, a, b, op, count(*) AS in_set, count(m.feature) AS shared FROM o LEFT JOIN m ON m.component = o.component AND m.feature = o.feature GROUP BY 1, 2, 3, 4), t AS (SELECT c.*, n_c, tests, features FROM c JOIN nc USING (component) JOIN r USING (component), u WHERE shared > 0), f AS (SELECT component, a, b, op, shared, n_c, in_set, tests, round(least(1.0, sum(exp(lgamma(n_c + 1) + lgamma(features - n_c + 1) + lgamma(in_set + 1) + lgamma(features - in_set + 1) - lgamma(features + 1) - lgamma(j + 1) - lgamma(n_c - j + 1) - lgamma(in_set - j + 1) - lgamma(features - n_c - in_set + j + 1)))), 9) AS p FROM (SELECT *, unnest(range(shared, least(n_c, in_set) + 1)) AS j FROM t) WHERE features - n_c - in_set + j >= 0 GROUP BY ALL), q AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY component ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (SELECT *, p * tests / count(*) OVER (PARTITION BY component ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM f)) SELECT component, a, b, op, shared, n_c AS in_component, in_set, round(shared / n_c, 6) AS precision, round(shared / in_set, 6) AS recall, round(2 * shared / (n_c + in_set), 6) AS f1, round(p, 6) AS p, round(q, 6) AS q FROM q WHERE q <= 0.45"))
def a26_combined(spark, d):
    """Sets by label, two remainders and the neighbourhood of ids, alone and two at a time, cut at q 0.45 as the vectors are random."""
    w = staged(b.weights(spark, d), "weights")
    f = F.col("feature")
    sets = w.select(F.explode(F.array(F.col("label").cast("long"), 100 + f % 7, 200 + f % 11, 300 + F.floor(f / 60))).alias("set"), "feature")
    return rounded(modules.combined_sets(modules.membership(w, 0.2), sets, w.select("feature").distinct().count(), 0.45))


@query("w7_percentile", b.with_tables("hits", "SELECT feature, dataset, CASE WHEN hit THEN round_even(cume_dist() OVER (PARTITION BY dataset, hit ORDER BY lfc) * 100, 2) END AS percentile FROM hits"))
def w7(spark, d):
    o = b.observations(spark, d).withColumn("hit", c.hit(b.P_MAX, b.LFC_MIN))
    return modules.percentile(o, "lfc", "dataset", "hit").select("feature", "dataset", "percentile")


@query("v6_panel_unique", b.with_tables("tu_promoters", _OPT + _BALANCED + _BASELINE + ", pn AS (SELECT 'balanced' AS run, promoter, grp FROM pick WHERE feature IS NOT NULL UNION ALL SELECT 'effect', promoter, grp FROM base WHERE feature IS NOT NULL) SELECT 'panel_promoter' AS \"check\", run || '|' || promoter AS key FROM pn GROUP BY run, promoter HAVING count(*) > 1 UNION ALL SELECT 'panel_grp', run || '|' || grp FROM pn GROUP BY run, grp HAVING count(*) > 1", recursive=True))
def v6_panel(spark, d):
    """A balanced panel names no promoter and no unit group twice; the baseline may."""
    o = _options(spark, d)
    named = lambda p, n: p.select(F.lit(n).alias("run"), "promoter", "grp")
    return checks.unique_in_panel(named(panel.balanced(o, 6), "balanced").unionByName(named(panel.effect_only(o, 6), "effect")), ["run"])


@query("j24_attached_pairs", b.with_tables("obs", _PAIRS + ", al AS (SELECT lower(trim(p_name)) AS token, min(p_partkey) AS gene FROM part GROUP BY 1) SELECT gene, count(*) AS n, list_sort(list(DISTINCT numerator || '/' || denominator)) AS contrasts, list_transform(list_sort(list({'n': numerator, 'd': denominator, 'f': feature, 'l': CAST(round(lfc * 1000) AS BIGINT)})), lambda x: concat_ws('/', x.n, x.d, x.f, x.l)) AS nested FROM pr JOIN part ON p_partkey = feature JOIN al ON token = lower(trim(p_name)) WHERE numerator < denominator GROUP BY 1"), lists=("contrasts", "nested"))
def j24(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.lower(F.trim("p_name")).alias("token"))
    first = p.groupBy("token").agg(F.min("feature").alias("gene"))
    named = _pairs(spark, d).join(p, "feature").join(first, "token").withColumn("thousandths", F.round(F.col("lfc") * 1000).cast("long"))
    out = store.attached_pairs(named, "gene", ["numerator", "denominator", "feature", "thousandths"])
    return out.withColumn("nested", F.transform("nested", lambda x: F.concat_ws("/", x["numerator"], x["denominator"], x["feature"], x["thousandths"])))


@query("j27_pairings", "SELECT a.c_nationkey AS background, a.c_custkey AS condition, b.c_custkey AS control FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE a.c_mktsegment = 'BUILDING' AND b.c_mktsegment <> 'BUILDING'")
def j27(spark, d):
    """Customers of one market segment are treated."""
    return modules.pairings(table(spark, d, "customer").select(F.col("c_custkey").alias("condition"), F.col("c_nationkey").alias("background"), (F.col("c_mktsegment") == "BUILDING").alias("treated")))
