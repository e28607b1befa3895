"""Stored tables in buckets: a feed is dealt out like the table, which then isn't shuffled, and only the buckets that it
touches are read and rewritten."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MODE = "spark.sql.sources.partitionOverwriteMode"


class BucketedTable:
    """A catalog table, bucketed and sorted by its key and partitioned by the bucket's number (column ``bucket``), so that
    one bucket can be overwritten alone."""

    def __init__(self, spark: SparkSession, name: str, key: Sequence[str], buckets: int):
        self.spark, self.name, self.key, self.buckets = spark, name, tuple(key), buckets

    @property
    def number(self) -> Column:
        """The bucket of a row, as Spark's writer and its shuffles number them."""
        return F.pmod(F.hash(*self.key), F.lit(self.buckets))

    def create(self, rows: DataFrame, path: str) -> BucketedTable:
        out = rows.withColumn("bucket", self.number).repartition(self.buckets, *self.key)
        out.write.partitionBy("bucket").bucketBy(self.buckets, self.key[0], *self.key[1:]).sortBy(self.key[0], *self.key[1:]).option("path", path).saveAsTable(self.name)
        return self

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The rows, with ``bucket``; of some buckets only."""
        df = self.spark.table(self.name)
        return df if only is None else df.where(F.col("bucket").isin(*only) if only else F.lit(False))

    def touched(self, new: DataFrame) -> list[int]:
        """Buckets that have rows of a feed: at most as many numbers as there are buckets reach the driver."""
        return sorted(r.bucket for r in new.select(self.number.alias("bucket")).distinct().collect())

    def merge(self, new: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], every: bool = False) -> list[int]:
        """Replaces the touched buckets by ``change(stored rows, new rows)`` and returns their numbers.

        ``change`` gives the state of all rows of these buckets, in the table's columns (others are left out). With
        ``every`` all buckets count as touched, for changes that concern rows which the feed hasn't (a sweep). Buckets are staged and moved
        in when all are written; the others keep their files. One writer at a time.
        """
        touched = list(range(self.buckets)) if every else self.touched(new)
        if touched:
            stored = self.read(None if every else touched)
            state = change(stored.drop("bucket"), new).withColumn("bucket", self.number)
            rows = state.repartition(self.buckets, *self.key).select(*self.spark.table(self.name).columns)
            before = self.spark.conf.get(_MODE, None)
            self.spark.conf.set(_MODE, "dynamic")  # insertInto takes it from the session only
            try:
                rows.write.mode("overwrite").insertInto(self.name)
            finally:
                self.spark.conf.set(_MODE, before) if before else self.spark.conf.unset(_MODE)
        return touched
