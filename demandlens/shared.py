"""The folder that driver and executors share, and the rows that Python workers are given at once."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import SparkSession


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        with suppress(Exception):  # the JVM may be gone; a folder left behind does no harm
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, removed when the program ends; below a temporary folder of our own
    only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("demandlens.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-demandlens-")
        spark.conf.set("demandlens.shared.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows at once for the Python workers, while a table of large rows is written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
