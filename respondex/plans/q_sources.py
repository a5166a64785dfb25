"""Queries: the layouts of files, written from the driver tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from respondex.operators import response
from respondex.plans import bindings as b
from respondex.plans.registry import query, rounded, table
from respondex.plans.staging import shared_dir
from respondex.sources import archives, readers, sinks
from respondex.sources.keyed_store import KeyedStore


def fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/respondex/{name}-{uuid.uuid4().hex}"


@query("s1_member_tables", b.with_tables("counts", "SELECT CAST(feature AS VARCHAR) AS feature, condition || '_' || replicate AS sample, condition AS grp, CAST(replicate AS VARCHAR) AS replicate, value FROM counts"))
def s1(spark, d):
    path, counts = fresh(spark, "members"), b.counts(spark, d)
    counts.select("feature", "value", F.concat_ws("-", "condition", "replicate").alias("sample")).write.partitionBy("sample").option("sep", "\t").option("header", True).csv(path)
    return readers.member_tables(spark, path, r"sample=([A-Z])-(\d)", "feature").select("feature", "sample", "grp", "replicate", "value")


def _archives(spark, d, column):
    """Counts as tar archives, one for every 1000 features, of a gzipped table for each sample; the folder's URI."""
    path, x = fresh(spark, "archives"), b.counts(spark, d)
    path = path if "://" in path else f"file://{path}"
    member = F.concat(F.lit("GSM_"), "sample", F.lit(".txt.gz"))
    f = F.floor(F.col("feature") / 1000)
    body = x.select(f.alias("archive"), member.alias("member"), F.col("feature").alias("line_no"), F.concat_ws("\t", "feature", F.lit("note"), F.col("value").cast("string")).alias("line"))
    head = x.select(f.alias("archive"), member.alias("member"), "condition", "replicate").distinct().select("archive", "member", F.lit(-1).cast("long").alias("line_no"), F.concat_ws("\t", F.lit("Gene_id"), F.lit("kind"), column).alias("line"))
    archives.write_archives(body.unionByName(head).withColumn("archive", F.concat(F.lit("a"), "archive")), path).collect()  # one row an archive
    return path


@query("s1_archive_tables", b.with_tables("counts", "SELECT CAST(feature AS VARCHAR) AS feature, condition || '_r' || replicate AS sample, condition AS grp, CAST(replicate AS VARCHAR) AS replicate, CASE condition WHEN 'N' THEN 'control' ELSE 'treated' END AS condition, value, 'note' AS kind FROM counts WHERE condition <> 'R'"))
def s1_archives(spark, d):
    """Tables of tar archives whose value column ends with a suffix; samples are known by their members' names, and those of no group are left out."""
    path = _archives(spark, d, F.concat("condition", F.lit("_r"), "replicate", F.lit("_readcount")))
    return archives.member_values(archives.members(spark, path, "GSM"), "Gene_id", r"GSM_([A-Z])(\d)", "readcount", {"control": ["N"], "treated": ["A"]}, notes=["kind"], heads=archives.members(spark, path, "GSM", True)).drop("member")


@query("s2_archive_text", b.with_tables("counts", "SELECT CAST(feature AS VARCHAR) AS feature, CASE WHEN condition = 'A' THEN 'drug A, ' || replicate ELSE 'unnamed' || replicate END AS sample, CASE WHEN condition = 'A' THEN 'A' ELSE condition END AS grp, CAST(replicate AS VARCHAR) AS replicate, value FROM counts"))
def s2_archives(spark, d):
    """The last column is the value; its name says the sample where the pattern fits it, else the member's does."""
    path = _archives(spark, d, F.when(F.col("condition") == "A", F.concat(F.lit("drug A, "), "replicate")).otherwise(F.concat(F.lit("unnamed"), "replicate")))
    return archives.member_values(archives.members(spark, path), "Gene_id", r"(?:drug |GSM_)([A-Z])(?:, )?(\d)", heads=archives.members(spark, path, first=True)).select("feature", "sample", "grp", "replicate", "value")


@query("s2_processed_text", b.with_tables("counts", "SELECT CAST(feature AS VARCHAR) AS feature, condition || '_' || replicate AS sample, value, p_name AS annotation FROM counts LEFT JOIN part ON p_partkey = feature"))
def s2(spark, d):
    path, counts = fresh(spark, "processed"), b.counts(spark, d)
    names = table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.col("p_name").alias("annotation"))
    counts.join(names, "feature", "left").select("feature", "annotation", F.col("value").alias("normalised"), F.concat_ws("-", "condition", "replicate").alias("sample")).write.partitionBy("sample").option("sep", "\t").option("header", True).csv(path)
    values = readers.member_tables(spark, path, r"sample=([A-Z])-(\d)", "feature")
    raw = spark.read.option("header", True).option("sep", "\t").option("recursiveFileLookup", True).csv(path)
    notes = readers.first_annotations(raw, "feature", ["annotation"], [F.col("_metadata.file_path")])
    return values.select("feature", "sample", "value").join(notes, "feature", "left")


@query("s3_matrix", "SELECT p_brand AS feature, sample, CAST(sum(value) AS DOUBLE) AS value FROM (SELECT p_brand, unnest(['p_size', 'p_partkey']) AS sample, unnest([CAST(p_size AS DOUBLE), CAST(p_partkey AS DOUBLE)]) AS value FROM part) GROUP BY 1, 2")
def s3(spark, d):
    return readers.matrix(table(spark, d, "part"), "p_brand", ["p_size", "p_partkey"])


@query("s3_first_annotations", "SELECT p_brand AS feature, min_by(p_type, p_partkey) AS p_type, min_by(p_name, p_partkey) AS p_name FROM part GROUP BY 1")
def s3_annotations(spark, d):
    return readers.first_annotations(table(spark, d, "part"), "p_brand", ["p_type", "p_name"], [F.col("p_partkey")])


@query("s4_sectioned", "SELECT CAST(p_partkey AS VARCHAR) AS feature, sample, CAST(value AS DOUBLE) AS value FROM (SELECT p_partkey, unnest(['size', 'price']) AS sample, unnest([CAST(p_size AS DOUBLE), round(p_retailprice, 2)]) AS value FROM part)")
def s4(spark, d):
    path = fresh(spark, "sections")
    files = max(1, table(spark, d, "part").count() // 5000)
    p = table(spark, d, "part").select((F.col("p_partkey") % files).alias("f"), F.col("p_partkey").alias("n"), F.concat_ws("\t", F.concat(F.lit('"'), "p_partkey", F.lit('"')), "p_size", F.round("p_retailprice", 2).cast("string")).alias("value"))
    frame = spark.range(files).select(F.col("id").alias("f"), F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(x).alias("value")) for n, x in ((-3, "!title"), (-2, "!begin"), (-1, '"ID"\t"size"\t"price"'), (1 << 60, "!end"), ((1 << 60) + 1, "rest"))])).alias("x")).select("f", "x.*")
    p.unionByName(frame).repartition("f").sortWithinPartitions("f", "n").select("f", "value").write.partitionBy("f").text(path)
    return readers.section_values(readers.sectioned(spark, path, "!begin", "!end")).select("feature", "sample", "value")


@query("s5_platform", "SELECT p_brand AS id, min_by(p_type, p_partkey) AS symbol FROM part GROUP BY 1")
def s5(spark, d):
    p = table(spark, d, "part")
    body = p.select(F.lit("x").alias("file"), (F.col("p_partkey") + 1).cast("int").alias("row"), F.array("p_brand", F.lit("?"), F.concat("p_type", F.lit(" /// other"))).alias("cells"))
    head = p.limit(1).select(F.lit("x").alias("file"), F.lit(0).alias("row"), F.array(F.lit("ID"), F.lit("skip"), F.lit("Gene Symbol")).alias("cells"))
    return readers.platform(body.where("row > 0").unionByName(head), {"ID": "id", "Gene Symbol": "symbol"})


@query("s6_imported_results", b.with_tables("obs", "SELECT feature, dataset, CASE WHEN feature % 11 = 0 THEN NULL ELSE round(lfc, 6) + 0.0 END AS log2FoldChange, round(p, 6) AS padj FROM obs"))
def s6(spark, d):
    o = b.observations(spark, d).select("feature", "dataset", F.col("feature").alias("gene"), F.when(F.col("feature") % 11 == 0, "NA").otherwise(F.col("lfc").cast("string")).alias("log2FoldChange"), F.col("p").cast("string").alias("padj"))
    return rounded(readers.imported_results(o).drop("gene"))


@query("s7_reference", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier")
def s7(spark, d):
    path = fresh(spark, "reference")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("1)id"), F.concat(F.lit(" "), "s_name").alias("2) name")).write.option("header", True).option("sep", "\t").option("ignoreLeadingWhiteSpace", False).csv(path)
    return readers.reference(spark, path)


@query("s8_edge_lines", b.with_tables("edges_raw", "SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, sign, CASE WHEN confidence = 'W' THEN '?' ELSE confidence END AS confidence, count(*) AS n FROM edges_raw GROUP BY 1, 2, 3, 4"))
def s8(spark, d):
    path = fresh(spark, "edges")
    e = b.edges_raw(spark, d).select(F.concat_ws("\t", "src", "dst", "sign", F.when(F.col("confidence") == "W", "").otherwise(F.col("confidence"))).alias("value"))
    e.unionByName(spark.range(1).select(F.explode(F.array(F.lit("# comment"), F.lit("1)src\t2)dst"), F.lit(""))).alias("value"))).write.text(path)
    return readers.edge_lines(spark, path, ["src", "dst", "sign", "confidence"], 4).groupBy("src", "dst", "sign", "confidence").agg(F.count("*").alias("n"))


@query("s9_sigma_genes", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'rpod' WHEN 1 THEN 'rpos' ELSE lower(p_brand) END AS gene FROM part")
def s9(spark, d):
    name = F.element_at(F.array(F.lit("Sigma70"), F.lit(" sigma38"), F.col("p_brand")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", readers.sigma_gene(name).alias("gene"))


@query("s10_fasta", "SELECT CAST(doc_id AS VARCHAR) AS contig, count(*) AS chunks, CAST(sum(length(seq)) AS BIGINT) AS bases FROM (SELECT doc_id, unnest(regexp_extract_all(" + "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')" + ", '.{1,500}')) AS seq FROM documents) GROUP BY 1")
def s10(spark, d):
    path = fresh(spark, "fasta")
    docs = table(spark, d, "documents").select("doc_id", F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("s"))
    sinks.write_fasta(docs.where("s <> ''"), "doc_id", "s", path)
    return readers.fasta(spark, path, 500).groupBy("contig").agg(F.count("*").alias("chunks"), F.sum(F.length("seq")).alias("bases"))


@query("s11_component_weights", b.with_tables("weights", "SELECT 'c' || component AS component, count(*) AS n, round(sum(weight), 4) + 0.0 AS total FROM weights GROUP BY 1"))
def s11(spark, d):
    """The vectors as a wide text matrix, read back as component weights."""
    path, e = fresh(spark, "matrix"), table(spark, d, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    e.select(F.concat(F.lit(" "), "vec_id").alias("gene"), *[F.get("embedding", F.lit(i)).cast("double").cast("string").alias(f"c{i}") for i in range(width)]).write.option("header", True).option("sep", "\t").csv(path)
    wide = spark.read.option("header", True).option("sep", "\t").csv(path)
    return rounded(readers.component_weights(wide, "gene").groupBy("component").agg(F.count("weight").alias("n"), F.sum("weight").alias("total")), 4)


@query("s11_expression", "SELECT CAST(p_partkey AS VARCHAR) AS feature, sample, value, 'log2(TPM+1)' AS units, 'embedded_log_tpm' AS normalization FROM (SELECT p_partkey, unnest(['size', 'price']) AS sample, unnest([CAST(p_size AS DOUBLE), round(p_retailprice, 2)]) AS value FROM part)")
def s11_expression(spark, d):
    p = table(spark, d, "part")
    own = p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("size"), F.round("p_retailprice", 2).cast("string").alias("price"))
    return rounded(readers.expression(own, own.withColumn("price", F.lit("0")), "id"))


def _config(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    return n.select(F.col("n_name").alias("name"), F.col("r_name").alias("class"), F.when(k % 7 == 0, "other").when(k % 2 == 0, "discovery").otherwise("challenge").alias("role"), F.when(k % 3 == 0, "small").alias("caveat"), F.when(k % 5 == 0, 1.5).otherwise(0.05).alias("padj"), F.lit(2.0).alias("log2_fold_change"))


@query("s12_dataset_config", "SELECT r_name AS class, list_sort(list(n_name || CASE WHEN n_nationkey % 7 = 0 THEN ':other' WHEN n_nationkey % 2 = 0 THEN ':discovery' ELSE ':challenge' END || CASE WHEN n_nationkey % 3 = 0 THEN ':small' ELSE '' END)) AS datasets FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1", lists=("datasets",))
def s12(spark, d):
    return readers.dataset_config(_config(spark, d), [])[0].withColumn("datasets", F.array_sort(F.transform("datasets", lambda x: F.concat_ws(":", x["name"], x["role"], x["caveat"]))))


@query("s12_config_violations", "SELECT 'unknown_class' AS \"check\", n_name AS key FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE') UNION ALL SELECT 'unknown_role', n_name FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT 'limits', n_name FROM nation WHERE n_nationkey % 5 = 0")
def s12_violations(spark, d):
    return readers.dataset_config(_config(spark, d), ["ASIA", "EUROPE"])[1]


@query("s6_listed_counts", "SELECT CASE WHEN sample = 'p_size' THEN 'a' ELSE 'b' END AS dataset, p_brand AS feature, sample, CAST(sum(value) AS DOUBLE) AS value FROM (SELECT p_brand, unnest(['p_size', 'p_partkey']) AS sample, unnest([CAST(p_size AS DOUBLE), CAST(p_partkey AS DOUBLE)]) AS value FROM part) GROUP BY 1, 2, 3")
def s6_counts(spark, d):
    return readers.listed_counts(table(spark, d, "part"), "p_brand", {"a": ["p_size"], "b": ["p_partkey"]})


@query("s13_standardised", b.with_tables("obs", "SELECT dataset, 'results' AS part, count(*) AS n, round(sum(lfc), 5) + 0.0 AS total FROM obs GROUP BY 1 UNION ALL SELECT dataset, 'expression', count(*), round(sum(log2), 4) + 0.0 FROM norm JOIN contrasts ON condition IN (tr, co) GROUP BY 1 UNION ALL SELECT dataset, 'samples', 6, 6.0 FROM contrasts"))
def s13(spark, d):
    """Results, normalised expression of each contrast's samples, and their metadata, written and read back."""
    path, n = fresh(spark, "standardised"), b.norm(spark, d)
    of = F.explode(F.filter(F.array(*[F.struct(F.lit(name).alias("dataset"), F.lit(t).alias("t"), F.lit(c).alias("c")) for name, t, c, *_ in b.CONTRASTS]), lambda x: (x["t"] == F.col("condition")) | (x["c"] == F.col("condition")))).alias("x")
    expression = n.select("feature", "sample", "condition", "replicate", F.col("log2").alias("value"), of).withColumn("dataset", F.col("x.dataset"))
    samples = expression.select("dataset", "sample", "condition", "replicate").distinct()
    sinks.standardised(b.observations(spark, d), path, expression.select("dataset", "feature", "sample", "value"), samples)
    part = lambda name, total: spark.read.parquet(f"{path}/{name}").groupBy("dataset").agg(F.lit(name).alias("part"), F.count("*").alias("n"), total.alias("total"))
    return rounded(part("results", F.round(F.sum("lfc"), 5)).unionByName(part("expression", F.round(F.sum("value"), 4))).unionByName(part("samples", F.count_distinct("sample").cast("double"))), 5)


@query("s14_display", "SELECT l_partkey AS feature, round_even(sum(l_discount), 1) AS shown, CASE WHEN l_partkey % 2 = 0 THEN 'up' ELSE 'down' END AS regulation FROM lineitem GROUP BY 1")
def s14(spark, d):
    path = fresh(spark, "display")
    x = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(F.sum("l_discount").alias("shown")).withColumn("regulation", F.when(F.col("feature") % 2 == 0, "up").otherwise("down"))
    sinks.by_regulation(x, path, 1)
    return spark.read.parquet(path)


@query("s15_fasta_records", "SELECT doc_id, '>' || doc_id || chr(10) || text AS record FROM documents WHERE text IS NOT NULL")
def s15(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", sinks.fasta_lines(F.col("doc_id").cast("string"), F.col("text")).alias("record"))


@query("s16_incremental_store", "SELECT user_id AS key, min_by(event_type, event_id) AS first_wins, max_by(event_type, event_id) FILTER (WHERE value > 5) AS last_filled, min_by(event_type, event_id) FILTER (WHERE value > 5) AS first_filled FROM events GROUP BY 1")
def s16_incremental(spark, d):
    """Three loads, the last in order first, into a store that merges the buckets that a load names."""
    store = KeyedStore(spark, fresh(spark, "store"), ["key"], "event_id", first=["v"], last_filled=["w"], first_filled=["w"])
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.col("event_type").alias("v"), F.when(F.col("value") > 5, F.col("event_type")).alias("w"))
    for third in (2, 0, 1):
        store.load(e.where(F.col("event_id") % 3 == third))
    return store.current().select("key", F.col("v_first").alias("first_wins"), F.col("w_last_filled").alias("last_filled"), F.col("w_first_filled").alias("first_filled"))


@query("s16_store_upsert", "SELECT user_id AS key, min_by(event_type, event_id) AS first_wins, max_by(event_type, event_id) FILTER (WHERE value > 5) AS last_filled, min_by(event_type, event_id) FILTER (WHERE value > 5) AS first_filled FROM events GROUP BY 1")
def s16(spark, d):
    from respondex.operators.store import upserted

    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.col("event_type").alias("v"), F.when(F.col("value") > 5, F.col("event_type")).alias("w"))
    return upserted(e, ["key"], F.col("event_id"), first=["v"], last_filled=["w"], first_filled=["w"]).select("key", F.col("v_first").alias("first_wins"), F.col("w_last_filled").alias("last_filled"), F.col("w_first_filled").alias("first_filled"))
