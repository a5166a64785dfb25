"""The latest review of each entity, kept current from a stream in keyed state.

Each entity's newest review is a value in the query's state store, partitioned by entity and
checkpointed with the stream: a batch touches the entities that it names, and what is held grows with
entities, never with reviews or batches.  After a failure the query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegralType, StructType

from respondex.plans.shipping import ship

_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """Holds the newest row of a key by (edited_at, edit_id) and emits it when it changes."""

    def __init__(self, kind: StructType, keys: list[str]):
        self.kind, self.order = kind, [kind.names.index(c) for c in ("edited_at", "edit_id")]
        self.whole = {i for i, f in enumerate(kind) if isinstance(f.dataType, IntegralType)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", self.kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        best = held
        for part in rows:
            for row in part[self.kind.names].itertuples(index=False, name=None):
                row = tuple(self.plain(i, x) for i, x in enumerate(row))
                if best is None or self.place(row) > self.place(best):
                    best = row
        if best is not held:
            self.held.update(best)
            yield pd.DataFrame([best], columns=self.kind.names)

    def plain(self, i: int, x):
        """A value as the state takes it: missing ones as None, whole numbers as such."""
        if x is None or x is pd.NaT or isinstance(x, float) and x != x and i in self.whole:
            return None
        return int(x) if i in self.whole else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x

    def place(self, row: tuple) -> tuple:
        return tuple(row[i] for i in self.order)

    def close(self) -> None:
        return None


def newest(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """A stream of the reviews that become the newest of their entity (``keys``), from a stream of reviews.

    Repeats and late reviews older than what is held change nothing; no review is too late.  Reviews
    without a time or an edit id are passed over.
    """
    spark = reviews.sparkSession
    ship(spark)
    spark.conf.set(_STORE, _ROCKS)
    d = reviews.withColumn("edited_at", F.col("edited_at").cast("timestamp")).where("edited_at IS NOT NULL AND edit_id IS NOT NULL")
    return d.groupBy(*keys).transformWithStateInPandas(statefulProcessor=Newest(d.schema, keys), outputStructType=d.schema, outputMode="Update", timeMode="None")


def keep_latest(reviews: DataFrame, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Start a query that brings the state at ``checkpoint`` up to date with all reviews there are; ``current`` reads it."""
    stream = newest(reviews, keys).writeStream.outputMode("update").format("noop")
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The newest review of each entity as of the last complete batch, read from the state store; one row an entity."""
    return spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint).select("value.*")
