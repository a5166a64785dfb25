"""Append-only reviews: latest state, history, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respondex.plans.ranges import parted, with_side
from respondex.plans.staging import staged

_ORDER = ("edited_at", "edit_id")


def latest(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row of each entity: by time, then by edit id. Rows of a hot entity are combined before the shuffle."""
    rest = [c for c in reviews.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*_ORDER)).alias("r")
    return reviews.groupBy(*keys).agg(newest).select(*keys, "r.*")


def history(reviews: DataFrame, keys: list[str], value: str, parts: int | None = None) -> DataFrame:
    """Every review with the value before it.

    Reviews lie in range partitions (``parts``; None: the session's number) of entity and time, so a hot entity is
    in several.  Within a partition the row before is at hand; for the first row of an entity there it is the
    last one of the partition before, of which there is one row an entity and partition.
    """
    d = staged(parted(reviews, keys, [F.col(c) for c in _ORDER], parts), "history")
    w = Window.partitionBy("__part", *keys).orderBy(*_ORDER)
    d = d.withColumn("__first", F.row_number().over(w) == 1).withColumn("__lag", F.lag(value).over(w))
    ends = d.groupBy("__part", *keys).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*_ORDER)).alias("__end"))
    before = ends.select("__part", *keys, F.lag("__end").over(Window.partitionBy(*keys).orderBy("__part")).alias("__before"))
    out = with_side(d, before, ["__part", *keys])
    return out.withColumn("old_value", F.when(F.col("__first"), F.col("__before.v")).otherwise(F.col("__lag"))).drop("__part", "__first", "__lag", "__before")


def invalid(reviews: DataFrame, known: DataFrame, keys: list[str], statuses: list[str]) -> DataFrame:
    """``(edit_id, problem)``: unknown status, blank editor or reason, negative priority, unknown entity."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    tests = {"status": ~F.coalesce(F.col("status").isin(statuses), F.lit(False)), "editor": blank("editor"), "reason": blank("reason"), "priority": F.coalesce(F.col("priority") < 0, F.lit(False))}
    found = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    d = reviews.select("edit_id", F.explode(found).alias("problem"))
    return d.unionByName(reviews.join(known.select(*keys).distinct(), keys, "left_anti").select("edit_id", F.lit("unknown_entity").alias("problem")))


def carried_over(reviews: DataFrame, run_id: str) -> DataFrame:
    """Reviews of the given run; those of others stay in the history only."""
    return reviews.where(F.col("run_id") == run_id)


def latest_run(runs: DataFrame) -> DataFrame:
    """The completed run created last, ties by id."""
    return runs.where("status = 'completed'").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
