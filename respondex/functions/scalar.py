"""Scalar rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest positive normal double.
TINY = 2.2250738585072014e-308
#: Sign text to direction, confidence letter to rank, sigma factor to gene (fixed values).
EFFECTS = {"+": "activates", "-": "represses", "+-": "dual", "-+": "dual"}
CONFIDENCE = {"C": 3, "S": 2, "W": 1}
SIGMA_GENES = {"sigma70": "rpod", "sigma54": "rpon", "sigma38": "rpos", "sigma32": "rpoh", "sigma28": "flia", "sigma24": "rpoe", "sigma19": "feci"}


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def half_even(c: Column, places: int) -> Column:
    """Doubles rounded half to even as numpy, pandas and DuckDB do: scaled first, so the float noise of 0.8500000000000001 is gone before the half is seen, which ``bround`` of its digits rounds up."""
    scale = F.lit(10.0**places)
    return F.when(F.abs(c) < float(1 << 52), F.rint(c * scale) / scale).otherwise(c)  # larger ones, NaN and infinities have no places


def lookup(table: dict, c: Column) -> Column:
    """Value of a small fixed table; null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def response_label(lfc: Column, padj: Column, effect: float, alpha: float) -> Column:
    """``up``, ``down`` or ``not_significant``; both limits are strict, missing values are not significant."""
    hit = F.coalesce(padj < alpha, F.lit(False))
    return F.when(hit & F.coalesce(lfc > effect, F.lit(False)), "up").when(hit & F.coalesce(lfc < -effect, F.lit(False)), "down").otherwise("not_significant")


def signal(lfc: Column, padj: Column) -> Column:
    """abs(lfc) times -log10 of padj, where a missing padj is 1 and none is below TINY."""
    return F.abs(lfc) * -F.log10(F.greatest(F.coalesce(padj, F.lit(1.0)), F.lit(TINY)))


def token(c: Column) -> Column:
    """Trimmed and lower-cased; null becomes empty."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def first_filled(*cols: Column) -> Column:
    """First column that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def identifiers(c: Column) -> Column:
    """Sorted distinct parts of a list separated by ``;``, ``,`` or ``|``; blanks are dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;,|]"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def strand(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("+", "1", "forward", "plus"), "+").when(t.isin("-", "-1", "reverse", "minus"), "-")


def boolean(c: Column) -> Column:
    """True for true, 1 and yes; false for everything else."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def number(c: Column) -> Column:
    return finite(F.expr("1.0D") * F.trim(c).try_cast("double"))


def interval(lfc: Column, se: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wald interval."""
    return lfc - z * se, lfc + z * se


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(F.upper(c), "ACGT", "TGCA"))


def oriented(sequence: Column, start: Column, end: Column, direction: Column) -> Column:
    """1-based inclusive slice, read along the strand."""
    piece = F.upper(F.substring(sequence, start, end - start + 1))
    return F.when(direction == "-", reverse_complement(piece)).otherwise(piece)


def anchor(sequence: Column) -> Column:
    """0-based place of the first upper-case base; null if there is none."""
    at = F.regexp_instr(sequence, F.lit("[A-Z]"))
    return F.when(at > 0, at - 1)


def loci(c: Column) -> Column:
    """Distinct locus numbers (b and four digits) in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b(b\d{4})\b"), F.lit(1)))


def locus_status(found: Column) -> Column:
    return F.when(F.size(found) == 1, "mapped").when(F.size(found) > 1, "ambiguous").otherwise("missing")


def version(c: Column, width: int = 4) -> Column:
    """Version as an array of numbers padded with zeros, which compares in the right order."""
    parts = F.transform(F.split(F.trim(c), r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^(\d+)", 1).try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), width)), 1, width)


def replicate(c: Column) -> Column:
    """Number at the end of a sample's name."""
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("int")


def eligible(lfc: Column, padj: Column, flag: Column) -> Column:
    """Whether a result can be used: finite effect, padj in [0, 1], flag set."""
    return F.coalesce(finite(lfc).isNotNull() & finite(padj).between(0, 1), F.lit(False)) & boolean(flag)


def condition_parts(name: Column, words: list[str]) -> tuple[Column, Column]:
    """(background, treatment) of ``background_treatment``, lower-cased: the treatment is the first part that contains one of the words.

    The background is the name without ``_treatment`` and outer ``_``, or the first part if nothing is left.
    """
    low = F.lower(name)
    parts = F.split(low, "_")
    drug = F.get(F.filter(parts, lambda x: F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(x, F.lower(w))), True)), F.lit(0))
    rest = F.nullif(F.btrim(F.replace(low, F.concat(F.lit("_"), drug), F.lit("")), F.lit("_")), F.lit(""))
    return F.when(drug.isNotNull(), F.coalesce(rest, F.get(parts, F.lit(0)))), drug
