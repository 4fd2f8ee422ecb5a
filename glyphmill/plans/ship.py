"""Make this package importable in Python workers that don't share the driver's folders."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


BATCH_DEFAULT = "67108864b"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Hand the package to the cluster's file server, once per application.

    Batches to Python are bounded by bytes as well as by rows, unless the session has a bound of its own: rows of long texts else
    make batches of any size.
    """
    if spark.conf.get(BATCH_BYTES) == BATCH_DEFAULT:
        spark.conf.set(BATCH_BYTES, "4m")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    fd, name = tempfile.mkstemp(prefix="glyphmill-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "glyphmill").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def shipped(query):
    """The query, run after the package has been handed over."""

    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    run.__name__ = getattr(query, "__name__", "query")
    run.__doc__ = query.__doc__
    return run
