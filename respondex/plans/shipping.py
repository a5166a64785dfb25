"""Sends this package to Python workers, which may run where it is not installed, and keeps their batches small."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of the Arrow batches that workers get, unless the session has set its own; rows may be long texts.
BATCH_ROWS, _CONF, _DEFAULT = 512, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Add the package's source to the session's Python files, once for each Spark context.

    Call it before a Python function is handed to Spark; the files of a function are fixed then.
    """
    if spark.conf.get(_CONF, _DEFAULT) == _DEFAULT:
        spark.conf.set(_CONF, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_respondex_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    path = os.path.join(tempfile.mkdtemp(prefix="respondex-"), "respondex_code.zip")
    with open(path, "wb") as out:
        out.write(content.getvalue())
    sc.addPyFile(path)
    sc._respondex_shipped = True
