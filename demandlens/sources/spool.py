"""A spool of JSON messages as a data source: written exactly once, read in planned parts.

    spark.dataSource.register(SpoolSource)
    df.write.format("spool").mode("append").save(folder)
    spark.read.format("spool").schema(...).load(folder)

Every task writes one file under a name of its own and hands its name, rows and bytes to the commit, which publishes a
manifest of all of them; only files in manifests are read. A task that fails removes its file, a failed write its folder; what a
task that is killed leaves later is in no manifest. The folder may be in any file system that Arrow
opens and all executors see.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a planned part, about; parts end with a line.
PART = 16 << 20


def _opened(folder: str):
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _manifests(folder: str) -> list[dict]:
    from pyarrow import fs

    system, root = _opened(folder)
    found = system.get_file_info(fs.FileSelector(f"{root}/_published", allow_not_found=True))
    out = []
    for info in sorted((f for f in found if f.base_name.endswith(".json")), key=lambda f: f.base_name):
        with system.open_input_stream(info.path) as f:
            out.append(json.loads(f.read()))
    return out


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    size: int


@dataclass
class Part(InputPartition):
    name: str
    start: int
    end: int


class SpoolWriter(DataSourceWriter):
    def __init__(self, folder: str, names: list[str], overwrite: bool):
        self.folder, self.names, self.overwrite = folder, names, overwrite
        self.own = uuid.uuid4().hex  # this write's folder

    def write(self, iterator: Iterator) -> Written:
        system, root = _opened(self.folder)
        name = f"{self.own}/{uuid.uuid4().hex}.jsonl"
        path, rows, size = f"{root}/data/{name}", 0, 0
        system.create_dir(f"{root}/data/{self.own}", recursive=True)
        try:
            with system.open_output_stream(path) as f:
                for row in iterator:
                    line = json.dumps(dict(zip(self.names, row)), default=str, ensure_ascii=False).encode() + b"\n"
                    f.write(line)
                    rows, size = rows + 1, size + len(line)
        except BaseException:
            system.delete_file(path)
            raise
        if not rows:
            system.delete_file(path)
        return Written(name, rows, size)

    def commit(self, messages: list) -> None:
        """One manifest, complete before it has its name."""
        system, root = _opened(self.folder)
        files = [{"name": m.name, "rows": m.rows, "size": m.size} for m in messages if m is not None and m.rows]
        number = len(_manifests(self.folder))
        system.create_dir(f"{root}/_published", recursive=True)
        draft = f"{root}/_published/{uuid.uuid4().hex}.draft"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps({"files": files, "replaces": self.overwrite}).encode())
        system.move(draft, f"{root}/_published/{number:012d}-{uuid.uuid4().hex}.json")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, root = _opened(self.folder)
        if system.get_file_info(f"{root}/data/{self.own}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/data/{self.own}")


class SpoolReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.names = folder, [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def partitions(self) -> list[Part]:
        files: list[dict] = []
        for m in _manifests(self.folder):
            files = m["files"] if m["replaces"] else files + m["files"]
        return [Part(f["name"], at, min(at + PART, f["size"])) for f in files for at in range(0, f["size"], PART)] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        """The lines that begin inside the part; values as the schema's types (strings, numbers, booleans)."""
        if not partition.name:
            return
        system, root = _opened(self.folder)
        with system.open_input_file(f"{root}/data/{partition.name}") as f:
            at = partition.start
            f.seek(max(0, at - 1))
            stream = iter(_lines(f))
            if at:
                at += len(next(stream, b"\n")) - 1  # what belongs to the part before, perhaps only its line feed
            for line in stream:
                if at >= partition.end:
                    return
                at += len(line)
                got = json.loads(line)
                yield tuple(_cast(got.get(n), kind) for n, kind in self.names)


def _lines(f) -> Iterator[bytes]:
    held = b""
    while block := f.read(1 << 16):
        lines = (held + block).split(b"\n")
        held = lines.pop()
        yield from (x + b"\n" for x in lines)
    if held:
        yield held


def _cast(value: object, kind: str) -> object:
    if value is None or isinstance(value, str) and kind == "string":
        return value
    if kind == "string":
        return json.dumps(value, ensure_ascii=False)
    return float(value) if kind in ("double", "float") else value


class SpoolSource(DataSource):
    """Options: ``path``. Without a schema: id bigint, payload string."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return "id bigint, payload string"

    def reader(self, schema: StructType) -> SpoolReader:
        return SpoolReader(self.options["path"].rstrip("/"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> SpoolWriter:
        return SpoolWriter(self.options["path"].rstrip("/"), schema.names, overwrite)
