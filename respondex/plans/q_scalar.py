"""Queries: scalar rules over columns of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.functions import scalar as s
from respondex.plans import bindings as b
from respondex.plans.registry import query, rounded, table


@query("p1_response_label", b.with_tables("obs", "SELECT feature, dataset, CASE WHEN p < 0.2 AND lfc > 1 THEN 'up' WHEN p < 0.2 AND lfc < -1 THEN 'down' ELSE 'not_significant' END AS label FROM obs"))
def p1(spark, d):
    return b.observations(spark, d).select("feature", "dataset", s.response_label(F.col("lfc"), F.col("p"), 1.0, 0.2).alias("label"))


@query("p2_signal", b.with_tables("obs", "SELECT feature, dataset, round(abs(lfc) * -log10(greatest(coalesce(p, 1.0), 2.2250738585072014e-308)), 6) + 0.0 AS signal FROM obs"))
def p2(spark, d):
    return rounded(b.observations(spark, d).select("feature", "dataset", s.signal(F.col("lfc"), F.col("p")).alias("signal")))


@query("p3_token", "SELECT p_partkey, lower(trim(coalesce('  ' || upper(p_name) || ' ', ''))) AS token FROM part")
def p3(spark, d):
    return table(spark, d, "part").select("p_partkey", s.token(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).alias("token"))


@query("p4_first_filled", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment END), ''), nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END), ''), nullif(trim(CAST(c_nationkey AS VARCHAR)), '')) AS first FROM customer")
def p4(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", s.first_filled(F.when(k % 3 == 0, "  ").otherwise(F.col("c_mktsegment")), F.when(k % 2 != 0, F.col("c_name")), F.col("c_nationkey").cast("string")).alias("first"))


@query("p5_identifiers", "SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(p_type || '; ' || p_brand || ',, ' || p_brand || '|' || p_size, '[;,|]'), lambda x: trim(x)), lambda x: x <> ''))) AS ids FROM part", lists=("ids",))
def p5(spark, d):
    return table(spark, d, "part").select("p_partkey", s.identifiers(F.concat("p_type", F.lit("; "), "p_brand", F.lit(",, "), "p_brand", F.lit("|"), "p_size")).alias("ids"))


@query("p6_normalise", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '+' WHEN 3 THEN '-' END AS strand, event_id % 3 < 2 AS flag, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 6) END AS number FROM events""")
def p6(spark, d):
    i = F.col("event_id")
    text = F.element_at(F.array(*[F.lit(x) for x in ("+", " -1", "Forward", "REVERSE ", "?")]), (i % 5 + 1).cast("int"))
    flag = F.element_at(F.array(*[F.lit(x) for x in (" True", "1", "no")]), (i % 3 + 1).cast("int"))
    return rounded(table(spark, d, "events").select("event_id", s.strand(text).alias("strand"), s.boolean(flag).alias("flag"), s.number(F.when(i % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))).alias("number")))


@query("p7_effects", b.with_tables("edges_raw", "SELECT sign, confidence, CASE sign WHEN '+' THEN 'activates' ELSE 'represses' END AS effect, CAST(CASE confidence WHEN 'C' THEN 3 WHEN 'S' THEN 2 ELSE 1 END AS INTEGER) AS rank, count(*) AS n FROM edges_raw GROUP BY 1, 2"))
def p7(spark, d):
    e = b.edges_raw(spark, d).groupBy("sign", "confidence").agg(F.count("*").alias("n"))
    return e.select("sign", "confidence", s.lookup(s.EFFECTS, F.col("sign")).alias("effect"), F.coalesce(s.lookup(s.CONFIDENCE, F.col("confidence")), F.lit(0)).alias("rank"), "n")


@query("p8_wald_interval", b.with_tables("moments", "SELECT a.feature, round(a.mean - b.mean - 1.96 * sqrt((a.var + b.var) / 3), 6) + 0.0 AS low, round(a.mean - b.mean + 1.96 * sqrt((a.var + b.var) / 3), 6) + 0.0 AS high FROM moments a JOIN moments b ON a.feature = b.feature AND a.condition = 'A' AND b.condition = 'N'"))
def p8(spark, d):
    from respondex.operators.response import two_groups

    g = two_groups(b.norm(spark, d), "A", "N")
    low, high = s.interval(F.col("lfc"), F.sqrt((F.col("var_treated") + F.col("var_control")) / 3))
    return rounded(g.select("feature", low.alias("low"), high.alias("high")))


_DNA_FROM, _DNA_TO = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
_SEQ = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_DNA_FROM}', '{_DNA_TO}')"


@query("p9_oriented_slice", f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN p ELSE reverse(translate(p, 'ACGT', 'TGCA')) END AS piece FROM (SELECT doc_id, substr({_SEQ}, CAST(doc_id % 50 + 1 AS INTEGER), 31) AS p FROM documents)""")
def p9(spark, d):
    i = F.col("doc_id")
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _DNA_FROM, _DNA_TO)
    return table(spark, d, "documents").select("doc_id", s.oriented(seq, (i % 50 + 1).cast("int"), (i % 50 + 31).cast("int"), F.when(i % 2 == 0, "+").otherwise("-")).alias("piece"))


@query("p10_anchor", "SELECT doc_id, CAST(nullif(length(regexp_extract(text, '(?s)^[^A-Z]*[A-Z]')), 0) - 1 AS INTEGER) AS anchor FROM documents")
def p10(spark, d):
    return table(spark, d, "documents").select("doc_id", s.anchor(F.col("text")).alias("anchor"))


_LOCUS = "'[OLD:b' || lpad(CAST(c_custkey % 9973 AS VARCHAR), 4, '0') || '] b' || lpad(CAST(c_nationkey * 37 AS VARCHAR), 4, '0') || CASE WHEN c_custkey % 4 = 0 THEN ' xb12345' ELSE '' END"


@query("p11_loci", f"SELECT c_custkey, loci, CASE WHEN len(loci) = 1 THEN 'mapped' WHEN len(loci) > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM (SELECT c_custkey, CASE WHEN l[1] = l[2] THEN l[1:1] ELSE l END AS loci FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN [] ELSE regexp_extract_all({_LOCUS}, '\\b(b\\d{{4}})\\b', 1) END AS l FROM customer))", lists=("loci",))
def p11(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit("[OLD:b"), F.lpad((k % 9973).cast("string"), 4, "0"), F.lit("] b"), F.lpad((F.col("c_nationkey") * 37).cast("string"), 4, "0"), F.when(k % 4 == 0, " xb12345").otherwise(""))
    found = s.loci(F.when(k % 5 != 0, text))
    return table(spark, d, "customer").select("c_custkey", found.alias("loci"), s.locus_status(found).alias("status"))


@query("p12_version_at_least", "SELECT c_custkey, (c_nationkey > 14 OR c_nationkey = 14 AND (c_custkey % 12 > 5 OR c_custkey % 12 = 5)) AS recent FROM customer")
def p12(spark, d):
    v = F.concat_ws(".", "c_nationkey", F.col("c_custkey") % 12, F.col("c_custkey") % 3)
    return table(spark, d, "customer").select("c_custkey", (s.version(v) >= s.version(F.lit("14.5"))).alias("recent"))


@query("p13_volcano", b.with_tables("obs", "SELECT feature, dataset, round(lfc, 6) + 0.0 AS lfc, round(-log10(greatest(p, 2.2250738585072014e-308)), 6) + 0.0 AS strength FROM obs WHERE lfc IS NOT NULL AND p IS NOT NULL"))
def p13(spark, d):
    o = b.observations(spark, d).where("lfc IS NOT NULL AND p IS NOT NULL")
    return rounded(o.select("feature", "dataset", "lfc", (-F.log10(F.greatest("p", F.lit(s.TINY)))).alias("strength")))


@query("p15_replicate", "SELECT c_custkey, TRY_CAST(nullif(regexp_extract(c_name, '(\\d+)$', 1), '') AS INTEGER) AS replicate FROM customer")
def p15(spark, d):
    return table(spark, d, "customer").select("c_custkey", s.replicate(F.col("c_name")).alias("replicate"))


@query("p16_json_evidence", b.with_tables("obs", "SELECT feature, len(x) AS n, x[1].dataset AS first_dataset, CAST(to_json({'dataset': x[1].dataset, 'role': x[1].role}) AS VARCHAR) AS text FROM (SELECT feature, list_sort(list({'dataset': dataset, 'role': role})) AS x FROM obs GROUP BY 1)"))
def p16(spark, d):
    o = b.observations(spark, d).groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("dataset", "role"))).alias("x"))
    back = F.from_json(F.to_json("x"), "array<struct<dataset:string,role:string>>")
    return o.select("feature", F.size(back).cast("long").alias("n"), back[0]["dataset"].alias("first_dataset"), F.to_json(F.col("x")[0]).alias("text"))


@query("p17_eligible", b.with_tables("obs", "SELECT feature, dataset, coalesce(isfinite(lfc) AND p BETWEEN 0 AND 1, false) AND feature % 3 < 2 AS eligible FROM obs"))
def p17(spark, d):
    flag = F.element_at(F.array(F.lit("TRUE"), F.lit("1"), F.lit("0")), (F.col("feature") % 3 + 1).cast("int"))
    return b.observations(spark, d).select("feature", "dataset", s.eligible(F.col("lfc"), F.col("p"), flag).alias("eligible"))


@query("p18_condition", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'bg' || p_size || '_x' END AS background, CASE WHEN p_size % 2 = 0 THEN 'ampicillin' || p_size END AS treatment FROM part")
def p18(spark, d):
    name = F.concat(F.lit("bg"), "p_size", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_Ampicillin"), "p_size")).otherwise(""), F.lit("_x"))
    back, drug = s.condition_parts(name, ["ampicillin", "tobramycin"])
    return table(spark, d, "part").select("p_partkey", back.alias("background"), drug.alias("treatment"))
