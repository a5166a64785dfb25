"""Identities of features across naming schemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondex.functions.scalar import token
from respondex.plans.skew import broadcast_if_small, salted_join
from respondex.plans.staging import staged


#: A locus number.
LOCUS = r"^b\d{4}$"


def alias_map(aliases: DataFrame) -> DataFrame:
    """First owner of each token, in the given order: (token, feature, ord[, locus]) to (token, feature[, locus])."""
    more = ["locus"] if "locus" in aliases.columns else []
    one = F.min_by(F.struct("feature", *more), F.struct("ord", "feature")).alias("o")
    return aliases.where("token IS NOT NULL AND token <> ''").groupBy("token").agg(one).select("token", "o.feature", *[f"o.{c}" for c in more])


def resolved(rows: DataFrame, key: str, names: list[str], mapping: DataFrame, own: list[str] = (), loci: list[str] = ()) -> DataFrame:
    """``(key, feature, locus, basis)`` of each row: the owner of the first of the named columns that the map knows.

    mapping: ``alias_map``.  A row that the map doesn't know keeps its own name, the first filled
    of the columns ``own``, so that no measured row is lost; a mapped feature is text then too.
    locus: the map's; without one, the name that was found if it is a locus number; of
    a row that keeps its name, the first of ``loci`` that is one.  basis: ``mapped``,
    ``source_name``, or ``unknown`` where there is no name either.  All tokens go through one join.
    """
    asked = rows.select(F.col(key), F.posexplode(F.array(*[token(F.col(n)) for n in names])).alias("place", "token"))
    known = mapping if "locus" in mapping.columns else mapping.withColumn("locus", F.lit(None).cast("string"))
    found = salted_join(asked.where("token <> ''"), known, ["token"], how="inner")
    found = found.withColumn("locus", F.coalesce(F.nullif("locus", F.lit("")), F.when(F.col("token").rlike(LOCUS), F.col("token"))))
    hits = found.groupBy(key).agg(F.min_by(F.struct("feature", "locus"), "place").alias("hit"))
    name = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in own], F.lit(None))
    place = F.coalesce(*[F.when(token(F.col(c)).rlike(LOCUS), token(F.col(c))) for c in loci], F.lit(None))
    mapped = F.col("hit").isNotNull()
    feature = F.when(mapped, F.col("hit.feature").cast("string")).otherwise(name) if own else F.col("hit.feature")
    basis = F.when(mapped, "mapped").when(name.isNotNull(), "source_name").otherwise("unknown")
    return rows.join(hits, key, "left").select(key, feature.alias("feature"), F.when(mapped, F.col("hit.locus")).otherwise(place).alias("locus"), basis.alias("basis"))


def exact(asked: DataFrame, ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each asked text as an exact id, else a case-insensitive alias; several owners are ``ambiguous``, none ``unknown``.

    asked: (text).  ids: (id) as text.  aliases: (alias, id).
    """
    a = asked.select("text").distinct()
    direct = a.join(ids.select(F.col("id").alias("text"), F.col("id").alias("found")).distinct(), "text", "left")
    low = aliases.select(F.lower("alias").alias("low"), "id").distinct().groupBy("low").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    d = direct.withColumn("low", F.lower("text")).join(low, "low", "left")
    s = F.when(F.col("found").isNotNull(), "exact").when(F.col("n") == 1, "alias").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return d.select("text", F.coalesce("found", F.when(F.col("n") == 1, F.col("one"))).alias("id"), s.alias("status"))


def matching(ids: DataFrame, aliases: DataFrame, text: str) -> DataFrame:
    """Ids that hold the text, or have an alias that does, ignoring case."""
    low = text.lower()
    direct = ids.where(F.contains(F.lower("id"), F.lit(low))).select("id")
    return direct.union(aliases.where(F.contains(F.lower("alias"), F.lit(low))).select("id")).distinct()


def grams(text: Column, size: int) -> Column:
    """The distinct pieces of a text that have ``size`` characters."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def matching_all(asked: DataFrame, ids: DataFrame, aliases: DataFrame, size: int = 3) -> DataFrame:
    """``(text, id)`` for each asked text and each id that holds it, or has an alias that does, ignoring case.

    Names are put on inverted lists of their pieces of up to ``size`` characters.  A text is looked up on one
    list only, that of its rarest piece of ``size`` characters (itself, if it is shorter), and what stands there is checked
    exactly.  Lists that no text asks for are not joined.  An empty text asks nothing.
    asked: (text).  ids: (id).  aliases: (alias, id).
    """
    names = ids.select(F.lower("id").alias("name"), "id").unionByName(aliases.where("alias IS NOT NULL").select(F.lower("alias").alias("name"), "id")).distinct()
    named = names.select("name").distinct()
    texts = asked.where("text IS NOT NULL AND text <> ''").select("text", F.lower("text").alias("low")).distinct()
    pieces = texts.select("text", "low", F.explode(F.when(F.length("low") < size, F.array("low")).otherwise(grams(F.col("low"), size))).alias("gram"))
    wanted = pieces.select("gram").distinct()
    all_grams = F.flatten(F.array(*[grams(F.col("name"), n) for n in range(1, size + 1)]))
    lists = staged(named.select("name", F.explode(all_grams).alias("gram")).join(broadcast_if_small(wanted), "gram", "left_semi"), "gram-lists")
    rare = pieces.join(lists.groupBy("gram").agg(F.count("*").alias("k")), "gram", "left")
    rare = rare.groupBy("text", "low").agg(F.min_by("gram", F.struct(F.coalesce("k", F.lit(0)), F.col("gram"))).alias("gram"))
    found = rare.join(lists, "gram").where(F.contains("name", "low")).select("text", "name")
    return found.join(names, "name").select("text", "id").distinct()


def unique_alias(aliases: DataFrame) -> DataFrame:
    """Owner of each alias that has only one."""
    return aliases.groupBy("alias").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).where("n = 1").drop("n")


def shared_samples(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples given by several datasets, once, and the cells where they disagree.

    rows: (dataset, sample, feature, condition, value).
    """
    d = rows.groupBy("sample", "feature").agg(F.min("value").alias("value"), F.max("value").alias("v"), F.min("condition").alias("condition"), F.max("condition").alias("c"), F.count_distinct("dataset").alias("datasets"))
    return d.drop("v", "c"), d.where("value <> v OR condition <> c").select("sample", "feature")
