"""The driver tables read as this library's nouns, and the same in SQL.

Counts: feature = part, condition = return flag (N control), replicate = supplier mod 3.
Observations: effects of three contrasts with a closed-form p.  Edges: supplier to part,
sign from the line status, confidence from the order's priority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respondex.functions.scalar import eligible
from respondex.operators import response
from respondex.plans.registry import table
from respondex.plans.skew import broadcast_if_small, dealt_by_rows

CONDITIONS, REPLICATES = ["A", "N", "R"], [0, 1, 2]
#: Contrasts: dataset, treated, control, class, role.
CONTRASTS = [("alpha", "A", "N", "one", "discovery"), ("rho", "R", "N", "two", "discovery"), ("versus", "A", "R", "one", "challenge")]
#: Limits under which the random driver data have responses.
P_MAX, LFC_MIN = 0.2, 1.0
#: Datasets of each class.
CONFIGURED = {k: [n for n, _, _, cls, _ in CONTRASTS if cls == k] for k in ("one", "two")}


def counts(spark: SparkSession, d: str) -> DataFrame:
    return response.dense_counts(table(spark, d, "lineitem"), "l_partkey", F.col("l_returnflag"), F.col("l_suppkey") % 3, "l_quantity", CONDITIONS, REPLICATES)


def norm(spark: SparkSession, d: str) -> DataFrame:
    c = counts(spark, d)
    return response.normalised(c, response.size_factors(c))


def observations(spark: SparkSession, d: str, n: DataFrame | None = None) -> DataFrame:
    """``(feature, dataset, class, role, lfc, p, eligible)``; one feature of 13 is flagged as not eligible by its source; n: ``norm``, if it is there."""
    m = response.moments(norm(spark, d) if n is None else n)
    wide = m.groupBy("feature").agg(*[F.max(F.when(F.col("condition") == c, F.col(x))).alias(f"{x}_{c}") for c in CONDITIONS for x in ("mean", "var", "n")])
    each = [
        F.struct(F.lit(name).alias("dataset"), F.lit(cls).alias("class"), F.lit(role).alias("role"), *[F.col(f"{x}_{c}").alias(f"{y}_{side}") for x, y in (("mean", "mean"), ("var", "var"), ("n", "n")) for c, side in ((t, "treated"), (u, "control"))])
        for name, t, u, cls, role in CONTRASTS
    ]
    long = wide.select("feature", F.explode(F.array(*each)).alias("o")).select("feature", "o.*").withColumn("lfc", F.col("mean_treated") - F.col("mean_control"))
    return response.pooled_p4(long).select("feature", "dataset", "class", "role", F.round("lfc", 9).alias("lfc"), F.round("p", 9).alias("p"), eligible(F.col("lfc"), F.col("p"), F.when(F.col("feature") % 13 > 0, "True").otherwise("no")).alias("eligible"))


def shrunk(spark: SparkSession, d: str, o: DataFrame | None = None) -> DataFrame:
    """Observations (o, if they are there) with a shrunk effect."""
    return (observations(spark, d) if o is None else o).withColumn("shrunk", F.round(F.col("lfc") * (1 - F.col("p")), 9))


def edges_raw(spark: SparkSession, d: str, features: DataFrame | None = None) -> DataFrame:
    """``(src, dst, sign, confidence)``: one row a line item; features: only those to its features, chosen before any other is shuffled."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linestatus")
    if features is not None:
        lines = lines.join(broadcast_if_small(features.select(F.col("feature").alias("l_partkey")).distinct()), "l_partkey", "left_semi")
    else:
        lines = dealt_by_rows(lines, lines.count(), "l_orderkey")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    rank = F.substring("o_orderpriority", 1, 1)
    conf = F.when(rank == "1", "C").when(rank.isin("2", "3"), "S").otherwise("W")
    return lines.join(orders, "l_orderkey").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("sign"), conf.alias("confidence"))


_PIECES = [
    ("cells", "SELECT l_partkey AS feature, l_returnflag AS condition, CAST(l_suppkey % 3 AS INTEGER) AS replicate, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3"),
    ("counts", "SELECT feature, condition || replicate AS sample, condition, replicate, coalesce(v, 0.0) AS value FROM (SELECT DISTINCT feature FROM cells) CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS condition) CROSS JOIN (SELECT unnest([0, 1, 2]) AS replicate) LEFT JOIN cells USING (feature, condition, replicate)"),
    ("center", "SELECT feature, avg(ln(value)) AS g FROM counts WHERE value > 0 GROUP BY 1"),
    ("factors", "SELECT sample, CASE WHEN median(value / exp(g)) > 0 THEN median(value / exp(g)) ELSE 1.0 END AS size_factor FROM counts JOIN center USING (feature) GROUP BY 1"),
    ("norm", "SELECT counts.*, size_factor, value / size_factor AS norm, log2(value / size_factor + 1) AS log2 FROM counts JOIN factors USING (sample)"),
    ("moments", "SELECT feature, condition, count(log2) AS n, avg(log2) AS mean, var_samp(log2) AS var, avg(norm) AS base FROM norm GROUP BY 1, 2"),
    ("contrasts", "SELECT * FROM (VALUES ('alpha', 'A', 'N', 'one', 'discovery'), ('rho', 'R', 'N', 'two', 'discovery'), ('versus', 'A', 'R', 'one', 'challenge')) t(dataset, tr, co, class, role)"),
    ("obs0", "SELECT a.feature, dataset, class, role, a.mean - b.mean AS lfc, CASE WHEN a.n = 3 AND b.n = 3 AND a.var + b.var > 0 THEN (a.mean - b.mean) / sqrt((a.var + b.var) / 3) END AS t FROM contrasts JOIN moments a ON a.condition = tr JOIN moments b ON b.condition = co AND b.feature = a.feature"),
    ("obs", "SELECT feature, dataset, class, role, round(lfc, 9) AS lfc, round(greatest(0.0, 1 - abs(t) / sqrt(4 + t * t) * (1.5 - 0.5 * t * t / (4 + t * t))), 9) AS p, coalesce(lfc IS NOT NULL AND t IS NOT NULL, false) AND feature % 13 > 0 AS eligible FROM obs0"),
    ("edges_raw", "SELECT l_suppkey AS src, l_partkey AS dst, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS sign, CASE WHEN o_orderpriority[1] = '1' THEN 'C' WHEN o_orderpriority[1] IN ('2', '3') THEN 'S' ELSE 'W' END AS confidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey"),
    ("edges", "SELECT src, dst, max(CASE confidence WHEN 'C' THEN 3 WHEN 'S' THEN 2 ELSE 1 END) AS rank, CASE WHEN count(DISTINCT sign) > 1 THEN 'dual' WHEN max(sign) = '+' THEN 'activates' ELSE 'represses' END AS effect, count(*) AS n_evidence FROM edges_raw GROUP BY 1, 2"),
    ("hits", "SELECT *, coalesce(eligible AND p < 0.2 AND abs(lfc) > 1.0, false) AS hit FROM obs"),
    ("seeds", "SELECT DISTINCT feature FROM hits WHERE hit AND role <> 'challenge'"),
    ("evc", "SELECT feature, class, count(DISTINCT dataset) AS seen, count(DISTINCT dataset) FILTER (WHERE qual) AS n, max(dataset) FILTER (WHERE qual) AS ds, bool_or(hit AND lfc > 0) AS up, bool_or(hit AND lfc < 0) AS down, bool_or(qual AND role <> 'challenge') AS seed, max(lfc) FILTER (WHERE qual AND role <> 'challenge') AS strongest FROM (SELECT *, hit AND lfc > 0 AS qual FROM hits) GROUP BY 1, 2"),
    ("evt", "SELECT *, CASE WHEN n = 0 THEN NULL WHEN up AND down THEN 'within_class_direction_difference' WHEN n > 1 THEN 'multiple_comparisons_supported' ELSE 'single_comparison_supported' END AS tier FROM evc"),
    ("ev", "SELECT feature, CASE WHEN bool_or(up AND down) THEN 'within_class_direction_difference' WHEN bool_or(tier = 'multiple_comparisons_supported') THEN 'multiple_comparisons_supported' ELSE 'single_comparison_supported' END AS tier, CASE WHEN count(*) FILTER (WHERE n > 0) > 1 THEN 'cross' ELSE max(class) FILTER (WHERE n > 0) END AS grp, CAST(sum(seen) AS BIGINT) AS n_seen, CAST(sum(n) AS BIGINT) AS n_hits, bool_or(up AND down) AS direction_conflict, bool_or(up) AND bool_or(down) AND NOT bool_or(up AND down) AS cross_difference, sum(n) = 1 AND max(ds) = 'alpha' AS lone, max(strongest) AS primary_effect, coalesce(max(round(n / 2, 3)) FILTER (WHERE class = 'one'), 0) AS support_one, coalesce(max(round(n / 1, 3)) FILTER (WHERE class = 'two'), 0) AS support_two FROM evt GROUP BY 1 HAVING bool_or(seed)"),
    ("supply", "SELECT feature, count(*) FILTER (WHERE value >= 40) AS k0, count(*) FILTER (WHERE value >= 80) AS k1, count(*) FILTER (WHERE value >= 200) AS k2 FROM counts GROUP BY 1"),
    ("stab", "SELECT feature, class, n_supporting, raw_effect, effect, " + " + ".join(f"CASE WHEN k{i} >= 3 AND top > 1.0 + {s} THEN 1 ELSE 0 END" for i in range(3) for s in (-0.5, 0.0, 0.5)) + " AS passed FROM (SELECT feature, class, count(*) FILTER (WHERE p < 0.2 AND lfc > 1.0) AS n_supporting, max(lfc) FILTER (WHERE p < 0.2 AND lfc > 1.0) AS raw_effect, max(round(lfc * (1 - p), 9)) FILTER (WHERE p < 0.2 AND lfc > 1.0) AS effect, max(lfc) FILTER (WHERE p < 0.2) AS top FROM obs WHERE role <> 'challenge' AND eligible GROUP BY 1, 2) LEFT JOIN supply USING (feature) WHERE n_supporting > 0"),
    ("events_iv", "SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(floor(value * 600) AS BIGINT) AS e FROM events"),
    ("unit_lists", "SELECT l_orderkey AS unit, l_partkey AS member FROM lineitem JOIN orders ON o_orderkey = l_orderkey"),
    ("tu_genes", "SELECT p_partkey % 70 AS tu, p_partkey AS gene FROM part UNION ALL SELECT 1000 + p_partkey % 13, p_partkey FROM part WHERE p_partkey % 5 = 0"),
    ("tu_promoters", "SELECT DISTINCT tu, tu % 40 AS promoter FROM tu_genes WHERE tu % 3 <> 0 UNION SELECT DISTINCT tu, 100 + tu % 7 FROM tu_genes WHERE tu % 2 = 0"),
    ("interactions", "SELECT src || '-' || dst AS interaction, src AS regulator, CASE dst % 3 WHEN 0 THEN 'gene' WHEN 1 THEN 'promoter' ELSE 'tu' END AS kind, CASE WHEN dst % 3 = 0 THEN dst END AS gene, CASE WHEN dst % 3 = 1 THEN dst % 150 END AS promoter, CASE WHEN dst % 3 = 2 THEN dst % 90 END AS tu, effect FROM edges"),
    ("weights", "SELECT vec_id AS feature, CAST(i - 1 AS INTEGER) AS component, CAST(embedding[i] AS DOUBLE) AS weight, label FROM (SELECT vec_id, embedding, label, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"),
]
_NAMES = [n for n, _ in _PIECES]


def with_tables(upto: str, body: str, recursive: bool = False) -> str:
    """body after the named pieces up to ``upto``."""
    pieces = ", ".join(f"{n} AS ({q})" for n, q in _PIECES[: _NAMES.index(upto) + 1])
    return f"WITH {'RECURSIVE ' if recursive else ''}{pieces} {body}"


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """``(event_id, user_id, event_type, s, e)`` in whole seconds."""
    s = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(s / 1_000_000).alias("s"), (F.floor(s / 1_000_000) + F.floor(F.col("value") * 600)).alias("e"))


def unit_lists(spark: SparkSession, d: str) -> DataFrame:
    """``(unit, member)``: parts of all orders."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("member")).join(orders, "unit")


def weights(spark: SparkSession, d: str) -> DataFrame:
    """``(feature, component, weight, label)``: vectors in long form."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("feature"), F.posexplode("embedding").alias("component", "weight"), "label").withColumn("weight", F.col("weight").cast("double"))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """``(feature)``: the features that ``candidates.seeded`` keeps rows of, without those rows, so that observations are made once."""
    from respondex.operators.candidates import hit

    found = observations(spark, d).where(hit(P_MAX, LFC_MIN) & (F.col("role") != "challenge"))
    return found.where("feature IS NOT NULL").select("feature").distinct()


def edges(spark: SparkSession, d: str, features: DataFrame | None = None) -> DataFrame:
    from respondex.operators.graph import collapsed_edges

    return collapsed_edges(edges_raw(spark, d, features), rows=table(spark, d, "lineitem").count() if features is None else None)


def tu_genes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("gene"))
    return p.select((F.col("gene") % 70).alias("tu"), "gene").unionByName(p.where("gene % 5 = 0").select((F.lit(1000) + F.col("gene") % 13).alias("tu"), "gene"))


def tu_promoters(genes: DataFrame) -> DataFrame:
    t = genes.select("tu").distinct()
    return t.where("tu % 3 <> 0").select("tu", (F.col("tu") % 40).alias("promoter")).union(t.where("tu % 2 = 0").select("tu", (F.lit(100) + F.col("tu") % 7).alias("promoter"))).distinct()


def interactions(spark: SparkSession, d: str) -> DataFrame:
    dst, kind = F.col("dst"), F.col("dst") % 3
    return edges(spark, d).select(
        F.concat_ws("-", "src", "dst").alias("interaction"), F.col("src").alias("regulator"), F.when(kind == 0, "gene").when(kind == 1, "promoter").otherwise("tu").alias("kind"),
        F.when(kind == 0, dst).alias("gene"), F.when(kind == 1, dst % 150).alias("promoter"), F.when(kind == 2, dst % 90).alias("tu"), "effect",
    )
