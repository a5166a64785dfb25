"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.plans.staging import staged

#: Rows of a right side that may be broadcast after they were counted.
BROADCAST_ROWS = 500_000
#: Rows of a right side that ``crossed`` gathers into lists and broadcasts.
LISTED_ROWS = 2_000_000
#: Rows of a large table that one task sorts or groups, about.
TASK_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it has at most ``limit`` rows; otherwise leave the choice to Spark."""
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, how: str = "left") -> DataFrame:
    """Equi-join of a possibly skewed left side to a right side of one row per key.

    Every left row takes one of ``salts`` values and every right row appears once for
    each, so that a hot key is read by ``salts`` tasks.  Nulls never match.
    """
    salt = "__salt"
    l = left.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns if c not in keys] or [F.lit(0)]), F.lit(salts)).cast("int"))
    r = right.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return l.join(r, [*keys, salt], how).drop(salt)


def dealt_by_output(df: DataFrame, expected: DataFrame, rows: str, *keys: str, each: int = 4_000_000) -> DataFrame:
    """df dealt by keys to as many partitions as a join that multiplies it needs, some ``each`` rows of the result in one: Spark sizes them by what goes in.

    expected: a table whose column ``rows`` adds up to the rows of the result.
    """
    n = expected.agg(F.sum(rows)).first()[0] or 0
    return df.repartition(int(min(max(n // each, 1), 100_000)), *keys)


def dealt_by_rows(df: DataFrame, rows: int, *keys: str, each: int | None = None) -> DataFrame:
    """df, which has some ``rows`` rows, dealt by keys to partitions of some ``each`` (None: ``TASK_ROWS``), if that needs more of them than the session's shuffles have; else as it is."""
    n = min(rows // (each or TASK_ROWS) + 1, 100_000)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def crossed(left: DataFrame, right: DataFrame, key: str, run: int = 256, each: int = 4_000_000, how: str = "inner") -> DataFrame:
    """All pairs of left and right rows of a key (``left.join(right, key, how)``, inner or left, other columns distinct), for keys of many rows on both sides; a null key meets nothing.

    What is shuffled are blocks of left rows, of some 16 ``run`` rows and a sixteenth of ``each`` pairs at most, and lists of
    as many right rows, not pairs.  Pairs are unfolded last: each left row of a block before a whole run of right rows.  So columns of the left side
    are long repeats and those of the right side come back in short cycles, and Parquet stores a pair in a fraction of a byte.
    Right sides of up to ``LISTED_ROWS`` rows are broadcast and blocks are dealt evenly; of larger ones each list is a key of its own, which blocks go to.
    """
    l_cols, r_cols = ([c for c in d.columns if c != key] for d in (left, right))
    of = lambda d, n: d.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n))
    pairs, up = F.col("__l") * F.col("__r"), lambda c, n: F.ceil(c / n).cast("int")
    sizes = of(left, "__l").join(of(right, "__r"), key).select(key, pairs.alias("__pairs"), F.greatest(up(F.col("__l"), 16 * run), up(pairs, max(each // 16, 1))).alias("__blocks"), up(F.col("__r"), 16 * run).alias("__lists"))
    sizes = staged(sizes, "crossed-sizes")
    tasks = int(min(max((sizes.agg(F.sum("__pairs")).first()[0] or 0) // each, 1), 100_000))
    counts = broadcast_if_small(sizes.drop("__pairs"))
    at = lambda cols, parts: F.pmod(F.xxhash64(*cols), F.col(parts)).cast("int")
    lists = right.join(counts, key).groupBy(key, at(r_cols, "__lists").alias("__list")).agg(F.collect_list(F.struct(*r_cols)).alias("__js"))
    blocks = left.join(counts, key).groupBy(key, "__lists", at(l_cols, "__blocks").alias("__block")).agg(F.collect_list(F.struct(*l_cols)).alias("__is"))
    alone = left.join(right.select(key).distinct(), key, "left_anti").select(key, F.lit(1).alias("__lists"), F.lit(0).alias("__block"), F.array(F.struct(*l_cols)).alias("__is"))
    if right.limit(LISTED_ROWS + 1).count() <= LISTED_ROWS:
        blocks = blocks.unionByName(alone) if how == "left" else blocks
        met = blocks.repartition(tasks).join(F.broadcast(lists), key, how)
    else:
        blocks = blocks.withColumn("__list", F.explode(F.sequence(F.lit(0), F.col("__lists") - 1)))
        met = blocks.repartition(tasks, key, "__list").join(lists.repartition(tasks, key, "__list").hint("merge"), [key, "__list"])
        met = met.unionByName(alone, allowMissingColumns=True) if how == "left" else met
    runs = F.transform(F.sequence(F.lit(0), up(F.size("__js"), run) - 1), lambda k: F.slice("__js", k * run + 1, run))
    runs = F.when(F.col("__js").isNotNull(), runs)
    met = met.select(key, "__is", F.explode_outer(runs).alias("__js")).select(key, F.explode("__is").alias("__i"), "__js").select(key, "__i", F.explode_outer("__js").alias("__j"))
    return met.select(key, *[F.col(f"__i.{c}").alias(c) for c in l_cols], *[F.col(f"__j.{c}").alias(c) for c in r_cols])
