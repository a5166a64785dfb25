"""Queries of the library over the driver tables, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, lists: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under an operator's id; sql is DuckDB's for the same rows and columns.

    lists: columns of arrays, which both sides give as text joined by ``;``.
    """

    def put(f: Query) -> Query:
        QUERIES[name] = (lambda spark, d: f(spark, d).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ";") for c in lists})) if lists else f
        if sql:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f"array_to_string({c}, ';') AS {c}" for c in lists)}) FROM ({sql})" if lists else sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; negative zero becomes zero."""
    from pyspark.sql import functions as F

    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
