"""Cutting lineage with tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Only where it is unset
and Spark runs on one machine, as in tests, a temporary folder is chosen.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="respondex-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/respondex/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written; results not yet written need them."""
    _delete(spark, run_dir(spark))


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The result has no lineage beyond the files, so a lost executor costs a re-read
    only, and its size is known to the planner.  codec: None takes the session's.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._respondex_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``staged`` returned, once nothing reads them any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_respondex_path", None):
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more (they go when the driver collects its garbage)."""
    gc.collect()
    spark._jvm.System.gc()
