"""Arrow batches in, Arrow batches out, with bounded memory per step."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from respondex.plans.shipping import ship

#: Rows that a worker handles at once; texts can be long.
STEP_ROWS = 512
#: Bytes of the handled column at which a step ends early.
STEP_BYTES = 2 << 20


def give_back() -> None:
    """Return freed memory to the machine at the end of a task, as workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def steps(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no step has more than STEP_ROWS rows or, but for one long row, STEP_BYTES bytes."""
    for batch in batches:
        at = 0
        sizes = batch.column(column)
        while at < batch.num_rows:
            part = batch.slice(at, STEP_ROWS)
            n = part.num_rows
            while n > 1 and sizes.slice(at, n).nbytes > STEP_BYTES:
                n //= 2
            yield batch.slice(at, n)
            at += n


def map_rows(df: DataFrame, schema: StructType | str, column: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]]) -> DataFrame:
    """Apply ``make()`` (called once a task) to steps of df; it returns a column list or array for each field of schema."""
    ship(df.sparkSession)
    kind = schema if isinstance(schema, StructType) else df.sparkSession.createDataFrame([], schema).schema
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for step in steps(batches, column):
            got = f(step)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := got[field.name], pa.Array) and x.type == field.type else pa.array(x, field.type) for field in out], schema=out)
        f = None
        give_back()

    return df.mapInArrow(run, kind)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """Rows of df, all columns unchanged, whose value in ``column`` the function of ``make()`` keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for step in steps(batches, column):
            yield step.filter(pa.array(f(step.column(column).to_pylist()), pa.bool_()))
        f = None
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, df.schema)
