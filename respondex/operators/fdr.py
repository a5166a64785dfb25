"""Benjamini-Hochberg adjustment, within families or over one family, of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respondex.plans.ranges import cumulated, joined_by_value, with_side
from respondex.plans.staging import staged


def adjust_by_family(df: DataFrame, family: list[str], p: str = "p", out: str = "padj", nulls: str = "as_one", partitions: int | None = None) -> DataFrame:
    """Adjusted p within each family; ties share a value.

    nulls: ``as_one`` counts missing p as 1 and adjusts them, ``exclude`` leaves them null.
    The input is staged, as it is read twice.  The distinct p with their counts are
    range-partitioned by family and p; each partition's number of rows and least raw value
    give the offsets of ranks and of the running minimum, and the adjusted value of each
    distinct p is joined back, so no task reads a whole family.
    """
    v = "__p"
    value = F.when(~F.isnan(p), F.col(p))
    df = df.withColumn(v, F.coalesce(value, F.lit(1.0)) if nulls == "as_one" else value)
    by = family or ["__all"]
    df = staged(df if family else df.withColumn("__all", F.lit(0)), "bh-input")
    raw = staged(cumulated(df, by, v, partitions).withColumn("__raw", F.col(v) * F.col("__total") / F.col("__upto")), "bh-raw")
    least = raw.groupBy(*by, "__part").agg(F.min("__raw").alias("__least"))
    later = F.min("__least").over(Window.partitionBy(*by).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1))
    d = with_side(raw, least.select(*by, "__part", later.alias("__later")), [*by, "__part"])
    # from the largest p down: a frame that ends with the partition would be read anew for each row
    here = F.min("__raw").over(Window.partitionBy("__part", *by).orderBy(F.desc(v)).rowsBetween(Window.unboundedPreceding, 0))
    done = d.select(*by, v, F.least(F.lit(1.0), here, F.col("__later")).alias(out))
    return joined_by_value(df, done, by, v).drop(v, "__all")


def adjust_all(df: DataFrame, p: str = "p", out: str = "padj", partitions: int | None = None) -> DataFrame:
    """Adjusted p over all rows as one family; missing p stay null."""
    return adjust_by_family(df, [], p, out, "exclude", partitions)
