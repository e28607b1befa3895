"""Versions of a set of tables: readers see one version whole, and of two writers that began from the same one, one wins.

A version is a manifest that names a folder for each table. A writer fills new folders first and publishes its manifest
last, under the number after the version it read; which fails if that number is taken. What a failed or beaten writer
leaves behind is in no manifest. Folders are never changed, so whoever holds a version goes on reading it.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionConflict(RuntimeError):
    """Another writer published first."""


class Version:
    """One version; what it reads doesn't change."""

    def __init__(self, spark: SparkSession, number: int, manifest: dict):
        self.spark, self.number, self.folders, self.reason = spark, number, manifest["tables"], manifest.get("reason", "")

    def read(self, name: str) -> DataFrame:
        found = self.folders[name]
        return self.spark.read.schema(found["schema"]).parquet(found["path"])


class VersionedTables:
    """Tables below a folder of any file system that Spark writes to. Renaming to a file that exists must fail there, as in
    HDFS in one step."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, number: int):
        return self._path(f"{self.root}/_manifests/{number:012d}.json")

    def current(self) -> Version:
        """The last version published; number 0, without tables, before the first."""
        folder = self._path(f"{self.root}/_manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        number = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        return self.version(number)

    def version(self, number: int) -> Version:
        if not number:
            return Version(self.spark, 0, {"tables": {}})
        lines = self.spark.read.text(self._manifest(number).toString(), wholetext=True).collect()
        return Version(self.spark, number, json.loads(lines[0].value))

    def publish(self, tables: Mapping[str, DataFrame], read: Version, reason: str = "") -> Version:
        """A new version with these tables and, of the others, those of the version that the writer read.

        Raises VersionConflict, before or after writing, if that isn't the last one any more; the caller reads and
        computes again.
        """
        if self.current().number != read.number:
            raise VersionConflict(f"version {read.number} isn't the last one")
        folders = dict(read.folders)
        for name, df in tables.items():
            path = f"{self.root}/{name}/{read.number + 1:012d}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            folders[name] = {"path": path, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
        manifest = {"version": read.number + 1, "tables": folders, "reason": reason, "published_at": dt.datetime.now(dt.timezone.utc).isoformat()}
        self._create(self._manifest(read.number + 1), json.dumps(manifest))
        return Version(self.spark, read.number + 1, manifest)

    def _create(self, path, text: str) -> None:
        """The whole file or none: written under another name and then renamed, which fails where the file exists."""
        jvm = self.spark._jvm
        draft = self._path(f"{self.root}/_drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(path.getParent())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark._sc._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, path, options)
        except Exception as e:  # py4j wraps what the file system raises
            raise VersionConflict(f"{path.getName()} is published already") from e


def bump_evidence(tables: VersionedTables, read: Version, plan: DataFrame, postings: DataFrame, reason: str) -> Version:
    """Publishes the next evidence version and, with it, the matches of active postings as stale; nothing if the chunk plan
    changes nothing. The tables are ``evidence`` (version, reason) and ``matches``."""
    from ..operators.changes import mark_stale

    if plan.where("action <> 'unchanged'").isEmpty():
        return read
    matches = read.read("matches")
    evidence = read.read("evidence").select((F.max("version") + 1).alias("version"), F.lit(reason).alias("reason"))
    return tables.publish({"evidence": evidence, "matches": mark_stale(matches, postings).select(*matches.columns)}, read, reason)
