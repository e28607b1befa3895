"""Large JSON arrays, one a file, read in many tasks.

Spark's text source cuts a file into records at commas and deals out byte ranges of it, from any file system. Whether a
comma ends an element depends on all that stands before it, but only by two things: whether a string is open, and how
deep the brackets are. Every byte range is therefore reduced to its effect on either start (a string open or not): the end
state, the change of depth, and how many commas it has at each relative depth. A scan over the few ranges of a file
then gives each one's true start, and a second pass cuts the elements at the commas of depth 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_BLANK = b" \t\r\n"


class Reader:
    """Follows one start through the records of a byte range, a batch at a time."""

    def __init__(self, in_string: bool, depth: int = 0):
        self.in_string, self.depth = in_string, depth

    def read(self, marks: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each comma that ends a record: is it outside strings, and at which depth."""
        quotes, turns, ends = marks
        inside = (np.cumsum(quotes) + self.in_string) % 2 == 1
        depth = self.depth + np.cumsum(np.where(inside, 0, turns))
        if len(depth):
            self.in_string, self.depth = bool(inside[-1]), int(depth[-1])
        return ~inside[ends], depth[ends]


def _marks(records: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the records with a comma after each: which bytes are quotes, opening and closing brackets, and where each comma is."""
    data = b",".join(records) + b","
    if b"\\" in data:
        data = _ESCAPED.sub(b"aa", data)
    b = np.frombuffer(data, dtype=np.uint8)
    turns = (b == 123).astype(np.int8) + (b == 91) - (b == 125) - (b == 93)
    return b == 34, turns, np.cumsum([len(r) + 1 for r in records]) - 1


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """Batches of records as (path, first byte of the range, records), never of two ranges."""
    for batch in batches:
        path, start = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        records, first = batch.column(2).to_pylist(), 0
        for i in range(1, len(records) + 1):
            if i == len(records) or (path[i], start[i]) != (path[first], start[first]):
                yield path[first], start[first], records[first:i]
                first = i


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range: path, start, bytes (a comma after each record too), first and last byte that isn't blank, and for both starts the end state, the change of
    depth and the commas outside strings by relative depth."""
    now, done = None, []

    def row() -> tuple:
        path, start, edges, readers, commas, taken = now
        return (path, start, taken[0], *edges, *(x for r, c in zip(readers, commas) for x in (r.in_string, r.depth, list(c), list(c.values()))))

    for path, start, records in _ranges(batches):
        if now is None or now[:2] != (path, start):
            if now:
                done.append(row())
            now = (path, start, ["", ""], (Reader(False), Reader(True)), (Counter(), Counter()), [0])
        now[5][0] += sum(map(len, records)) + len(records)
        text = b",".join(records).strip(_BLANK)
        if text:
            now[2][:] = [now[2][0] or chr(text[0]), chr(text[-1])]
        marks = _marks(records)
        for reader, commas in zip(now[3], now[4]):
            outside, depth = reader.read(marks)
            commas.update(dict(zip(*(x.tolist() for x in np.unique(depth[outside], return_counts=True)))))
    if now:
        done.append(row())
    if done:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())] * 2]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], _EFFECT_NAMES)


_EFFECT_NAMES = ["path", "start", "taken", "first", "last", *(f"{n}{s}" for s in "01" for n in ("open", "depth", "at", "commas"))]
_EFFECTS = "path string, start long, taken long, first string, last string, " + ", ".join(f"open{s} boolean, depth{s} long, at{s} array<long>, commas{s} array<long>" for s in "01")


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scan, of files' rows in order: each range's true start (a string open, depth, elements before), the number of
    elements of the whole file (known in its last range) and what is wrong with the file."""
    path, opened, depth, elements, first, wrong, taken = None, False, 0, 0, "", False, 0
    rows: list[tuple] = []

    def check(last: str) -> None:
        rows[-1] = (*rows[-1][:-2], elements + 1, wrong or opened or depth != 0 or first != "[" or last != "]")

    last = ""
    for batch in batches:
        for r in batch.to_pylist():
            if r["path"] != path:
                if path is not None:
                    check(last)
                path, opened, depth, elements, first, last, wrong, taken = r["path"], False, 0, 0, "", "", False, 0
            s = "01"[opened]
            rows.append((path, r["start"], opened, depth, elements, None, False))
            first, last = first or r["first"], r["last"] or last
            taken += r["taken"]
            # the comma after the file's last record is none, except where the file ends in one
            wrong |= r["ends"] and taken != r["size"] + 1
            commas = dict(zip(r[f"at{s}"], r[f"commas{s}"]))
            end = depth + r[f"depth{s}"]
            if r["ends"] and not r[f"open{s}"]:
                commas[r[f"depth{s}"]] -= 1
            wrong |= any(n and depth + d < 1 for d, n in commas.items())
            elements += commas.get(1 - depth, 0)
            opened, depth = r[f"open{s}"], end
        if len(rows) > 10_000:
            yield _start_batch(rows[:-1])
            rows = rows[-1:]
    if rows:
        check(last)
        yield _start_batch(rows)


def _start_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "start", "open", "depth", "before", "elements", "wrong"])


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """path, pos and element (variant) of the JSON array in each file under a path; a file that isn't one is fatal.

    Files of any size are read in tasks of ``spark.sql.files.maxPartitionBytes``, twice: once for the ranges' effects, whose rows (one
    a range) are scanned in order by file, and once for the elements. Only what a range's ends cut off is shuffled. An empty array gives no rows, and so does a file of no
    bytes, which Spark's sources skip. The scan runs when the
    plan is built; its rows, one a range, go to the driver and to the tasks. Compressed files are read in one task each.
    """
    records = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("record"))
    effects = records.mapInArrow(_effects, _EFFECTS)
    sizes = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"))
    ordered = effects.join(sizes, "path").withColumn("ends", F.col("start") == F.max("start").over(Window.partitionBy("path"))).repartition("path").sortWithinPartitions("path", "start")
    starts = ordered.select(*_EFFECT_NAMES, "ends", "size").mapInArrow(_starts, "path string, start long, open boolean, depth long, before long, elements long, wrong boolean").collect()
    if bad := sorted(r.path for r in starts if r.wrong):
        raise ValueError(f"not a JSON array: {', '.join(bad[:10])}")
    totals = {r.path: r.elements for r in starts if r.elements is not None}
    sent = spark.sparkContext.broadcast(({(r.path, r.start): (r.open, r.depth, r.before) for r in starts}, totals))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = sent.value[0], None
        names, kinds = ["path", "start", "pos", "whole", "text"], (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        rows: list[tuple] = []
        held: list[bytes] = []
        reader, pos, fresh = Reader(False), 0, False

        def close() -> None:
            # what the range's end cuts off; of a file's last range, its last element
            rows.append((*now, pos, False, b"".join(held)))

        for path, start, records in _ranges(batches):
            if now != (path, start):
                if now is not None:
                    close()
                now, held = (path, start), []
                opened, depth, pos = at[now]
                reader, fresh = Reader(opened, depth), False
            outside, depths = reader.read(_marks(records))
            ends = outside & (depths == 1)
            for record, end in zip(records, ends.tolist()):
                held.append(record)
                if end:
                    # the first one may have begun in an earlier range
                    rows.append((*now, pos, fresh, b"".join(held)))
                    held, pos, fresh = [], pos + 1, True
                else:
                    held.append(b",")
            if len(rows) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []
        if now is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    pieces = records.mapInArrow(cut, "path string, start long, pos long, whole boolean, text binary")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"].cast("string"))
    cut_off = pieces.where("NOT whole").groupBy("path", "pos").agg(F.array_join(parts, "").alias("text"))
    # brackets at the array's ends, and the comma that follows every record here but none in the file
    cut_off = cut_off.join(spark.createDataFrame(list(totals.items()) or [("", 0)], "path string, elements long"), "path")
    text = F.when(F.col("pos") == 0, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text"))
    text = F.when(F.col("pos") == F.col("elements") - 1, F.regexp_replace(text, r"\]\s*,?$", "")).otherwise(text)
    bare = cut_off.withColumn("text", text).where((F.col("elements") > 1) | (F.trim(F.regexp_replace("text", r"[\s,]+", "")) != ""))
    rows = pieces.where("whole").select("path", "pos", F.col("text").cast("string").alias("text")).unionByName(bare.select("path", "pos", "text"))
    # as an array of one, for a parser that doesn't look past a value
    one = F.expr("cast(try_parse_json(concat('[', text, ']')) AS array<variant>)")
    wrong = F.raise_error(F.concat(F.lit("no JSON at element "), F.col("pos"), F.lit(" of "), F.col("path"))).cast("variant")
    checked = F.when(F.coalesce(F.size("one"), F.lit(0)) != 1, wrong).otherwise(F.get("one", F.lit(0)))
    rows = rows.withColumn("one", one)
    return rows.select("path", "pos", checked.alias("element"))
