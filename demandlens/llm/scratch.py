"""Tables written to the folder that driver and executors share; what is left of them is removed when the program ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("demandlens.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-demandlens-")
        spark.conf.set("demandlens.scratch.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession, root: str) -> None:
    """What results may have read until the end of the program; nothing where the session has ended before."""
    if spark.sparkContext._jsc is not None:
        with suppress(Exception):  # the JVM may be gone; a folder left behind does no harm
            _remove(spark, root)


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run meanwhile go when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Cuts lineage by writing a table and reading it back: a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.saved: list[DataFrame] = []
        atexit.register(_at_exit, spark, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.saved):03d}-{name}"
        with _shuffles_end(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.saved.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for t in tables:
            _remove(self.spark, t._scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Removes all tables but these."""
        self.drop(*(t for t in self.saved if not any(t is k for k in tables)))
