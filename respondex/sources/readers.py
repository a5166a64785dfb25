"""Readers of the text layouts that measurements and reference tables come in.

Files are read where they lie by Spark's readers; each gives a long or all-string table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from respondex.functions.scalar import SIGMA_GENES, lookup, token
from respondex.plans.ranges import with_side
from respondex.plans.skew import broadcast_if_small
from respondex.plans.staging import staged


def member_tables(spark: SparkSession, path: str, pattern: str, id_column: str, value_column: str | None = None, sep: str = "\t") -> DataFrame:
    """``(feature, sample, grp, replicate, value)`` from one delimited file for each sample.

    pattern: groups 1 and 2 in a file's path are its group and replicate; other files are
    skipped.  value_column: None takes the last column.  Gzipped files are read as well.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("recursiveFileLookup", True).csv(path)
    name = F.col("_metadata.file_path")
    value = value_column or raw.columns[-1]
    d = raw.select(F.col(f"`{id_column}`").alias("feature"), F.col(f"`{value}`").try_cast("double").alias("value"), F.regexp_extract(name, pattern, 1).alias("grp"), F.regexp_extract(name, pattern, 2).alias("replicate"))
    return d.where("grp <> ''").withColumn("sample", F.concat_ws("_", "grp", "replicate"))


def matrix(df: DataFrame, id_column: str, samples: list[str], annotations: list[str] = (), agg: str = "sum") -> DataFrame:
    """Wide rows to ``(feature, sample, value)``; repeated ids are aggregated. Missing sample columns are an error."""
    missing = sorted(set(samples) - set(df.columns))
    if missing:
        raise ValueError(f"missing sample columns: {missing}")
    long = df.select(F.col(id_column).alias("feature"), F.explode(F.array(*[F.struct(F.lit(c).alias("sample"), F.col(c).try_cast("double").alias("value")) for c in samples])).alias("x")).select("feature", "x.*")
    return long.where("feature IS NOT NULL").groupBy("feature", "sample").agg(getattr(F, agg)("value").alias("value"))


def first_annotations(df: DataFrame, id_column: str, columns: list[str], order: list[Column]) -> DataFrame:
    """First row's annotation of each id, in the given order."""
    return df.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("feature")).agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in columns])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, at, line)``: lines of text files of any size, read by their splits.

    block is where a split begins in its file, at grows with the lines of a split, so (block, at)
    orders the lines of a file, though no task sees more of it than splits.
    """
    meta = F.col("_metadata")
    return spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def running(d: DataFrame, groups: list[str], amount: Column, out: str) -> DataFrame:
    """The sum of an amount over the rows before each, in the order of (block, at), of rows with ``groups``, block and at.

    A split is summed by itself, and the sums of splits, one row each, give what stands before it.
    """
    d = d.withColumn("__x", amount)
    inside = F.sum("__x").over(Window.partitionBy(*groups, "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    splits = d.groupBy(*groups, "block").agg(F.sum("__x").alias("__n"))
    offset = F.sum("__n").over(Window.partitionBy(*groups).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select(*groups, "block", F.coalesce(offset, F.lit(0)).alias("__before"))
    return with_side(d.withColumn("__inside", F.coalesce(inside, F.lit(0))), offsets, [*groups, "block"]).withColumn(out, F.col("__inside") + F.col("__before")).drop("__x", "__inside", "__before")


def sectioned(spark: SparkSession, path: str, begin: str, end: str, sep: str = "\t") -> DataFrame:
    """``(file, row, cells)`` of the lines between two markers of each file, unquoted; row 0 is the header.

    A first pass finds the markers (of several the last), one row a file; a second keeps the lines between
    them.  Files are read by splits and rows numbered by sums of splits, so a section may be as large as it likes.
    """
    lines = numbered_lines(spark, path)
    place = F.struct("block", "at")
    marks = lines.where(F.col("line").isin(begin, end)).groupBy("file").agg(F.max(F.when(F.col("line") == begin, place)).alias("a"), F.max(F.when(F.col("line") == end, place)).alias("z"))
    d = lines.join(broadcast_if_small(marks), "file").where((place > F.col("a")) & (place < F.col("z"))).select("file", "block", "at", "line")
    d = running(d, ["file"], F.lit(1), "row").where("trim(line) <> ''")
    cells = F.transform(F.split("line", sep), lambda x: F.regexp_replace(x, '^"|"$', ""))
    return d.select("file", F.col("row").cast("int").alias("row"), cells.alias("cells"))


def section_values(rows: DataFrame) -> DataFrame:
    """``(file, feature, sample, value)``: cells of a section below its header, which is joined by file and place."""
    head = rows.where("row = 0").select("file", F.posexplode("cells").alias("at", "sample"))
    body = rows.where("row > 0").select("file", F.col("cells")[0].alias("feature"), F.posexplode("cells").alias("at", "value")).where("at > 0")
    return body.join(broadcast_if_small(head), ["file", "at"]).select("file", "feature", "sample", F.col("value").try_cast("double").alias("value"))


def platform(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Annotation table of a section: chosen columns renamed, first token of ``///`` lists, first row of each id wins."""
    head = {c: i for i, c in enumerate(rows.where("row = 0").select("cells").first()["cells"])}
    first = lambda c: F.nullif(F.trim(F.split(F.get("cells", F.lit(head[c])), "///")[0]), F.lit(""))
    d = rows.where("row > 0").select("row", *[first(c).alias(n) for c, n in names.items()])
    key = next(iter(names.values()))
    return d.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(n, "row").alias(n) for n in list(names.values())[1:]])


def reference(spark: SparkSession, path: str) -> DataFrame:
    """All-string table with ``#`` comments whose headers may begin with ``1)``; cells are trimmed."""
    raw = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path)
    return raw.toDF(*[re.sub(r"^\d+\)\s*", "", c.strip()) for c in raw.columns]).transform(lambda d: d.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in d.columns]))


def edge_lines(spark: SparkSession, path: str, fields: list[str], least: int) -> DataFrame:
    """Named tab fields of each line; blank lines, comments, numbered headers and short lines are skipped; ids (the first two fields) are lower-cased; confidence defaults to ``?``."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").rlike(r"^(#|\d+\))"))
    cells = F.split("value", "\t")
    d = lines.where(F.size(cells) >= least).select(*[F.trim(F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(fields)])
    d = d.withColumns({c: F.lower(c) for c in fields[:2]})
    return d.withColumn("confidence", F.coalesce(F.nullif("confidence", F.lit("")), F.lit("?"))) if "confidence" in fields else d


def sigma_gene(c: Column) -> Column:
    """Gene of a sigma factor; other names as they are."""
    return F.coalesce(lookup(SIGMA_GENES, token(c)), token(c))


def fasta(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """``(contig, chunk_no, start, seq)``: sequences without headers, cut into chunks of ``chunk`` bases.

    Lines are read by the splits of a file; how many bases of its contig stand before a line comes
    from sums of splits, so a contig may be larger than a task.  A line lies in the chunks that it
    touches, and each chunk is put together from its lines.  A contig without bases has one empty chunk.
    """
    d = numbered_lines(spark, path).withColumn("head", F.regexp_extract("line", r"^>\s*(\S+)", 1)).where("trim(line) <> ''")
    d = running(d, ["file"], F.when(F.col("line").startswith(">"), 1).otherwise(0), "upto")  # headers before the line
    d = staged(d.withColumn("nth", F.col("upto") + F.when(F.col("line").startswith(">"), 1).otherwise(0)), "fasta-lines")
    names = d.where(F.col("line").startswith(">")).select("file", "nth", F.col("head").alias("contig"))
    body = d.where(~F.col("line").startswith(">")).select("file", "nth", "block", "at", F.regexp_replace("line", r"\s+", "").alias("s"))
    body = running(body, ["file", "nth"], F.length("s"), "base")
    first, last = F.floor(F.col("base") / chunk), F.floor((F.col("base") + F.length("s") - 1) / chunk)
    pieces = body.where("s <> ''").withColumn("chunk_no", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    low = F.greatest(F.lit(0), F.col("chunk_no") * chunk - F.col("base"))
    piece = F.substring("s", (low + 1).cast("int"), F.least(F.lit(chunk), (F.col("chunk_no") + 1) * chunk - F.col("base") - low).cast("int"))
    chunks = pieces.select("file", "nth", "chunk_no", F.col("base").alias("o"), piece.alias("x")).groupBy("file", "nth", "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda p: p["x"]), "").alias("seq"))
    named = names.join(chunks, ["file", "nth"], "left").select("contig", F.coalesce("chunk_no", F.lit(0)).alias("chunk_no"), F.coalesce("seq", F.lit("")).alias("seq"))
    return named.select("contig", "chunk_no", (F.col("chunk_no").cast("long") * chunk + 1).alias("start"), "seq")


def component_weights(wide: DataFrame, id_column: str) -> DataFrame:
    """``(feature, component, weight)`` of a matrix with a column for each component; ids are trimmed, what is no number is null."""
    columns = [c for c in wide.columns if c != id_column]
    long = wide.select(F.trim(F.col(f"`{id_column}`").cast("string")).alias("feature"), F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"`{c}`").cast("string").try_cast("double").alias("weight")) for c in columns])).alias("x"))
    return long.select("feature", "x.*").where("feature <> ''")


def expression(log_tpm: DataFrame | None, centred: DataFrame | None, id_column: str) -> DataFrame:
    """``(feature, sample, value, units, normalization)``: the embedded log-TPM matrix where there is one, else the centred one; activities are never expression."""
    source = log_tpm if log_tpm is not None else centred
    if source is None:
        raise ValueError("neither log-TPM nor centred expression is there")
    units, how = ("log2(TPM+1)", "embedded_log_tpm") if log_tpm is not None else ("centred log2", "control_centred")
    return component_weights(source, id_column).select("feature", F.col("component").alias("sample"), F.col("weight").alias("value"), F.lit(units).alias("units"), F.lit(how).alias("normalization"))


def dataset_config(df: DataFrame, classes: list[str], roles: tuple[str, ...] = ("discovery", "challenge")) -> tuple[DataFrame, DataFrame]:
    """Datasets by class with role and caveat, and violations ``(check, key)``: blank or repeated names, unknown classes or roles, limits out of range.

    df: (name, class, role, caveat, padj, log2_fold_change).
    """
    by = df.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("name", "role", "caveat"))).alias("datasets"))
    wrong = lambda check, rows: rows.select(F.lit(check).alias("check"), F.col("name").alias("key"))
    known = lambda c, values: F.coalesce(F.col(c).isin(list(values)), F.lit(False))
    bad = wrong("repeated_name", df.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"))
    bad = bad.unionByName(wrong("blank_name", df.where(F.trim(F.coalesce("name", F.lit(""))) == ""))).unionByName(wrong("unknown_class", df.where(~known("class", classes))))
    limits = F.coalesce(F.col("padj").between(0, 1) & (F.col("log2_fold_change") >= 0), F.lit(False))
    return by, bad.unionByName(wrong("unknown_role", df.where(~known("role", roles)))).unionByName(wrong("limits", df.where(~limits)))


def listed_counts(df: DataFrame, id_column: str, samples: dict[str, list[str]]) -> DataFrame:
    """``(dataset, feature, sample, value)``: counts of the explicit samples of each dataset; overlapping lists and missing columns are an error."""
    named = [x for xs in samples.values() for x in xs]
    if len(named) != len(set(named)):
        raise ValueError("a sample is listed twice")
    of = F.create_map(*[F.lit(y) for k, xs in samples.items() for x in xs for y in (x, k)])
    return matrix(df, id_column, named).select(F.element_at(of, F.col("sample")).alias("dataset"), "feature", "sample", "value")


def imported_results(df: DataFrame, required: tuple[str, ...] = ("gene", "log2FoldChange", "padj")) -> DataFrame:
    """A results table with numbers cast where they can be; missing required columns are an error."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    numbers = [c for c in ("baseMean", "log2FoldChange", "FoldChange", "pvalue", "padj") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in numbers})
