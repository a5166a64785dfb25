"""Intervals on sequences: overlap by nested bins, fragment windows, sequence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondex.functions.scalar import anchor, oriented
from respondex.plans.staging import staged


def level_of(width: int) -> Column:
    """The first level of bins at least as wide as an interval (s, e)."""
    return F.greatest(F.lit(0), F.ceil(F.log2((F.col("e") - F.col("s") + 1) / width))).cast("int")


def bin_of(at: Column, level: Column, width: int) -> Column:
    """The bin of a level that holds a position."""
    return F.floor(at / (F.lit(width).cast("long") * F.pow(F.lit(2), level).cast("long")))


def in_bins(d: DataFrame, width: int, levels: list[int] | None = None, above: int = 0) -> DataFrame:
    """Rows of d (with level ``__l``) in the bins ``(__at, __bin)`` of their own level, or of those of levels that are at least ``above`` higher: one or two a level."""
    at = F.array("__l") if levels is None else F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n >= F.col("__l") + above)
    d = d.withColumn("__at", F.explode(at))
    ends = F.array_distinct(F.array(*[bin_of(F.col(c), F.col("__at"), width) for c in ("s", "e")]))
    return d.withColumn("__bin", F.explode(ends)).drop("__l")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of inclusive intervals ``(s, e)`` of a and b that share a position, each once.

    Bins are nested: those of level l are ``width * 2**l`` wide.  An interval lies in one or two
    neighbouring bins of the first level at least as wide as itself, however long it is.  Where
    two intervals meet, the shorter one's bin lies in one of the longer one's bins, or is it; so each
    is joined to the ancestors, on the levels that the other side has, of the bins where it begins and
    ends: equi-joins by level and bin, in which rows grow with the number of levels, never with the length.
    Columns of b end in ``_b``.  Intervals with missing or reversed ends are left out.
    """
    x, y = (d.where("s <= e").withColumn("__l", level_of(width)) for d in (a, b))
    levels = sorted({r["__l"] for d in (x, y) for r in d.select("__l").distinct().collect()})  # at most 64: the logarithm of a length
    named = lambda d: d.select(*keys, "__at", "__bin", *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys])
    meet = (F.col("s") <= F.col("e_b")) & (F.col("s_b") <= F.col("e"))
    once = F.col("__bin") == bin_of(F.greatest("s", "s_b"), F.col("__at"), width)  # the bin of the later start
    joined = lambda p, q: p.join(named(q), [*keys, "__at", "__bin"]).where(meet & once).drop("__at", "__bin")
    return joined(in_bins(x, width, levels, 0), in_bins(y, width)).unionByName(joined(in_bins(x, width), in_bins(y, width, levels, 1)))


def valid_sites(sites: DataFrame) -> DataFrame:
    """Sites with a positive left end and no reversed ends."""
    return sites.where("left > 0 AND right >= left")


def fragments(promoters: DataFrame, sites: DataFrame, length: int, up: int, down: int, genes: DataFrame | None = None, width: int = 5000) -> DataFrame:
    """Window of each promoter along its strand, stretched to linked sites and clamped to the sequence, with the sites and the genes that overlap it.

    promoters: (promoter, tss, strand).  sites: (promoter, left, right).  genes: (gene, s, e).
    A missing start or strand gives a status row without a window.
    """
    ok = F.col("tss").isNotNull() & F.col("strand").isin("+", "-")
    lo = F.when(F.col("strand") == "+", F.col("tss") - up).otherwise(F.col("tss") - down)
    hi = F.when(F.col("strand") == "+", F.col("tss") + down).otherwise(F.col("tss") + up)
    linked = valid_sites(sites).groupBy("promoter").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.count("*").alias("sites"), F.array_sort(F.collect_set(F.struct("left", "right"))).alias("site_list"))
    d = promoters.withColumn("lo", F.when(ok, lo)).withColumn("hi", F.when(ok, hi)).join(linked, "promoter", "left")
    out = d.select(
        "promoter", "tss", "strand", F.when(ok, F.greatest(F.lit(1), F.least("lo", F.coalesce("left", "lo")))).alias("start"), F.when(ok, F.least(F.lit(length), F.greatest("hi", F.coalesce("right", "hi")))).alias("end"),
        F.coalesce("sites", F.lit(0)).alias("sites"), F.coalesce((F.col("left") < F.col("lo")) | (F.col("right") > F.col("hi")), F.lit(False)).alias("stretched"), F.when(ok, "ready").otherwise("missing_coordinates").alias("status"),
        F.coalesce("site_list", F.array().cast(dict(linked.dtypes)["site_list"])).alias("site_list"),
    )
    if genes is None:
        return out
    near = overlaps(out.where("status = 'ready'").select("promoter", F.col("start").alias("s"), F.col("end").alias("e")), genes.select("gene", "s", "e"), [], width)
    names = near.groupBy("promoter").agg(F.array_sort(F.collect_set("gene_b")).alias("genes"))
    return out.join(names, "promoter", "left").withColumn("genes", F.coalesce("genes", F.array().cast(dict(names.dtypes)["genes"])))


def linked_sites(windows: DataFrame, sites: DataFrame) -> DataFrame:
    """Distinct linked sites of each promoter, and those not wholly inside its window."""
    j = windows.join(valid_sites(sites), "promoter")
    return j.groupBy("promoter").agg(F.count_distinct("left", "right").alias("linked"), F.count_distinct(F.when((F.col("left") < F.col("start")) | (F.col("right") > F.col("end")), F.struct("left", "right"))).alias("outside"))


def chunked(d: DataFrame, contig: str, seq: str, width: int) -> DataFrame:
    """``(contig, chunk_no, seq)``: sequences, one a row, cut into chunks of ``width`` bases; of a large file ``readers.fasta`` makes the same."""
    return d.where(F.length(seq) > 0).select(F.col(contig).alias("contig"), F.posexplode(cut(F.col(seq), width)).alias("chunk_no", "seq"))


def cut(seq: Column, width: int) -> Column:
    """A text in pieces of ``width``, the last one what is left, in one pass: a substring for each would read the text from its start again."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def slices(asked: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """``(id, piece)``: the bases start to end (from 1, inclusive) of a contig, for each row of asked (id, contig, start, end).

    A row is joined by number to the chunks that it touches, and the parts are put together in their order;
    no row holds more of a contig than a chunk.  What lies outside the contig is left out; no base at all gives no row.
    """
    a = asked.where((F.col("end") >= 1) & (F.col("start") <= F.col("end")))
    from_, to = F.floor((F.greatest(F.col("start"), F.lit(1)) - 1) / width), F.floor((F.col("end") - 1) / width)
    touched = a.withColumn("chunk_no", F.explode(F.sequence(from_.cast("int"), to.cast("int"))))
    j = touched.join(chunks.select("contig", "chunk_no", "seq"), ["contig", "chunk_no"])
    base = F.col("chunk_no").cast("long") * width
    low = F.greatest(F.col("start") - base, F.lit(1))
    part = F.substring("seq", low.cast("int"), (F.least(F.col("end") - base, F.lit(width)) - low + 1).cast("int"))
    parts = j.select("id", "chunk_no", part.alias("x")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "x"))).alias("l"))
    return parts.select("id", F.array_join(F.transform("l", lambda p: p["x"]), "").alias("piece"))


def reference_match(d: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """``(id, matches)``: whether an annotated sequence, placed by its upper-case anchor on the start, equals the genome there; null without a start, strand, sequence or anchor.

    d: (id, contig, seq, tss, strand).  chunks: (contig, chunk_no, seq), ``width`` bases each.
    """
    n = F.length("seq")
    d = staged(d.withColumn("__at", anchor(F.col("seq"))), "placed-sequences")  # used on both sides below; what makes a sequence would run anew for each use of it
    at = F.col("__at")
    start = F.when(F.col("strand") == "+", F.col("tss") - at).otherwise(F.col("tss") - (n - 1 - at))
    asks = F.col("tss").isNotNull() & F.col("strand").isin("+", "-") & at.isNotNull()
    a = d.select("id", "contig", F.upper("seq").alias("want"), "strand", start.cast("long").alias("start"), (start + n - 1).cast("long").alias("end"), F.coalesce(asks, F.lit(False)).alias("asks"))
    got = slices(a.where("asks AND start >= 1"), chunks, width)
    found = oriented(F.col("piece"), F.lit(1), F.length("piece"), F.col("strand"))
    return a.join(got, "id", "left").select("id", F.when(F.col("asks"), F.coalesce(found == F.col("want"), F.lit(False))).alias("matches"))
