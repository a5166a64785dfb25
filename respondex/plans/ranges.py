"""Ranks within groups of any size: range partitions of (group, value) with one offset for each group and partition.

No task reads a whole group, and no window is without a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respondex.plans.skew import broadcast_if_small
from respondex.plans.staging import staged

_ALL, _PART = "__all", "__part"


def same(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equal keys, nulls among them."""
    return reduce(lambda x, y: x & y, [a[p].eqNullSafe(b[q]) for p, q in pairs])


def with_side(d: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """d with the other columns of side, which has one row for each value of keys."""
    s = side.withColumnsRenamed({k: f"__side_{k}" for k in keys})
    s = broadcast_if_small(s)
    return d.join(s, same(d, s, [(k, f"__side_{k}") for k in keys]), "left").drop(*[f"__side_{k}" for k in keys])


def parted(df: DataFrame, by: list[str], order: list[Column], n: int | None = None) -> DataFrame:
    """df in range partitions of (by, order) with their numbers."""
    keys = [*[F.col(b) for b in by], *order]
    return (df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)).withColumn(_PART, F.spark_partition_id())


def places(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """1-based place of each row among those of its group, in a total order."""
    d, by = (df, by) if by else (df.withColumn(_ALL, F.lit(0)), [_ALL])
    d = parted(d, by, order)
    d = staged(d.withColumn("__place", F.row_number().over(Window.partitionBy(_PART, *by).orderBy(*order))), "places")
    sizes = d.groupBy(*by, _PART).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    d = with_side(d, sizes.select(*by, _PART, F.coalesce(before, F.lit(0)).alias("__before")), [*by, _PART])
    return d.withColumn(out, (F.col("__place") + F.col("__before")).cast("long")).drop("__place", "__before", _PART, _ALL)


def cumulated(df: DataFrame, by: list[str], value: str, n: int | None = None, weight: str | None = None) -> DataFrame:
    """Distinct values of each group: ``(by..., value, __k rows, __upto rows up to it, __total rows, __part)``; missing values don't count. weight: how many rows a row stands for."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("__k"))
    parts = staged(parted(counts, by, [F.col(value)], n), "distinct-values")
    sizes = parts.groupBy(*by, _PART).agg(F.sum("__k").alias("__n"))
    w = Window.partitionBy(*by)
    before = F.sum("__n").over(w.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    d = with_side(parts, sizes.select(*by, _PART, F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(w).alias("__total")), [*by, _PART])
    inside = F.sum("__k").over(Window.partitionBy(_PART, *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("__upto", F.col("__before") + inside).drop("__before")


def joined_by_value(df: DataFrame, done: DataFrame, by: list[str], value: str, salts: int = 16) -> DataFrame:
    """df with the other columns of done, one row for each group and value; a value that many rows share is salted, if done isn't small."""
    keys = [*by, value]
    small = done.withColumnsRenamed({k: f"__side_{k}" for k in keys})
    marked = broadcast_if_small(small)
    pairs = [(k, f"__side_{k}") for k in keys]
    if marked is not small:
        return df.join(marked, same(df, marked, pairs), "left").drop(*[q for _, q in pairs])
    left = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    right = small.withColumn("__side_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    pairs.append(("__salt", "__side_salt"))
    return left.join(right, same(left, right, pairs), "left").drop("__salt", *[q for _, q in pairs])
