"""Token ids of documents in binary files (operator 11).

A file is a row of segments, each with a directory of documents and up to ``lanes`` blocks of ids that are coded, checked
and decoded alone (see id_coder). All numbers are little-endian:

    segment    'IDSG', then 32-bit numbers: bytes of the directory, blocks, ids of all blocks but the last, crc32 of all of
               this header and the directory; then the directory, the table of blocks, the blocks' bytes; then END
    directory  of each document with ids here: id (64 bits), number of its ids here (32 bits), flags (8 bits: 1 the
               document goes on from the segment before, 2 it goes on in the next, 4 its id is null)
    table      of each block: number of ids, number of bytes, crc32 of the bytes (32 bits each)

Spark's text writer puts the segments of a task in one file and commits it as it does any other output, so a lost executor
leaves nothing behind; file names count up with the documents' ids.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .id_coder import decode_blocks, encode_blocks
from .scratch import Scratch

MAGIC, END = b"IDSG", "\nIDSE\n"
HEADER = struct.Struct("<4s4I")
ENTRY = np.dtype([("id", "<i8"), ("n", "<u4"), ("flags", "u1")])
BLOCK = np.dtype([("ids", "<u4"), ("bytes", "<u4"), ("crc", "<u4")])
GOES_ON, TO_NEXT, NULL_ID = 1, 2, 4


class ChunkIds(dict):
    """Packed ids (uint16) of what stands between white space, by its UTF-8 bytes, as the library encodes it.

    The normalizer and the pattern of a word-level file never look past white space, so a text's ids are those of its
    chunks. Chunks of plain Latin letters are cut on by that file's pattern first, as their parts recur more often. Both
    tables hold at most ``limit`` entries and then start anew; chunks of over 48 bytes aren't kept.
    """

    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, vocabulary: str, limit: int = 400_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("the coder takes ids below 65,536")
        made = json.loads(vocabulary)
        self.special = [t["content"] for t in made["added_tokens"]]
        #: The parts above are those of this pattern alone; any other file's chunks are encoded whole.
        self.cut = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(made["pre_tokenizer"]).replace("\\\\", "\\")
        if made["pre_tokenizer"]["type"] != "Sequence" or "\\s+" not in json.dumps(made["normalizer"]).replace("\\\\", "\\"):
            raise ValueError("texts are split at white space, which this vocabulary doesn't drop")
        self.parts: dict[str, bytes] = {}
        self.limit = limit

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.cut and self.PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            out = []
            for part in self.PARTS.findall(text.lower()):
                ids = self.parts.get(part)
                if ids is None:
                    ids = self._encode(part)
                    if len(self.parts) >= self.limit:
                        self.parts.clear()
                    if len(part) <= 48:
                        self.parts[part] = ids
                out.append(ids)
            ids = b"".join(out)
        else:
            ids = self._encode(text)
        if len(chunk) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: bytes, end: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())) + end, dtype="<u2")


_KEPT: dict[int, ChunkIds] = {}


def _chunk_ids(vocabulary: str) -> ChunkIds:
    """One table a worker, for the vocabulary it used last."""
    key = hash(vocabulary)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = ChunkIds(vocabulary)
    return _KEPT[key]


def pack_segment(entries: list[tuple[int, int, int]], ids: np.ndarray, block: int) -> bytes:
    directory = np.array(entries, dtype=ENTRY).tobytes()
    blocks = [ids[i : i + block] for i in range(0, len(ids), block)]
    coded = encode_blocks(blocks)
    table = np.array([(len(b), len(c), zlib.crc32(c)) for b, c in zip(blocks, coded)], dtype=BLOCK).tobytes()
    head = struct.pack("<3I", len(directory), len(blocks), block)
    return MAGIC + head + struct.pack("<I", zlib.crc32(head + directory)) + directory + table + b"".join(coded)


def unpack_segments(content: memoryview) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each segment of a file: its directory and all its ids (uint16). Raises ValueError at a wrong checksum."""
    at, end = 0, END.encode()
    while at < len(content):
        magic, size, n, block, crc = HEADER.unpack_from(content, at)
        directory = bytes(content[at + HEADER.size : at + HEADER.size + size])
        if magic != MAGIC or zlib.crc32(bytes(content[at + 4 : at + 16]) + directory) != crc:
            raise ValueError(f"no segment at byte {at}")
        at += HEADER.size + size
        table = np.frombuffer(content, dtype=BLOCK, count=n, offset=at)
        at += n * BLOCK.itemsize
        coded = []
        for b in table:
            coded.append(bytes(content[at : at + b["bytes"]]))
            if zlib.crc32(coded[-1]) != b["crc"]:
                raise ValueError(f"the block at byte {at} is damaged")
            at += int(b["bytes"])
        if bytes(content[at : at + len(end)]) != end:
            raise ValueError(f"no end of a segment at byte {at}")
        at += len(end)
        yield np.frombuffer(directory, dtype=ENTRY), np.concatenate([np.zeros(0, np.uint16), *decode_blocks(coded, table["ids"].tolist())])


def write_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = 8192, lanes: int = 1024) -> None:
    """Writes the ids of every whole text, each text's end marked by ``end_id``, in ascending order of the document's id.

    ``vocabulary``: path of a tokenizers file on the driver. Rows are dealt by ranges of (id, hash of the text) and sorted:
    the one exchange. Null ids come first, null texts are empty and have the end id only, repeated rows are written as often as they occur, in the order
    of their texts' hashes; other columns are ignored; an empty table gives no segments. Ids must be integers. A task
    holds one text and the ids of a segment (16 MB); a text of more ids goes on in the next segment.
    """
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} must be an integer column")
    with open(vocabulary, encoding="utf-8") as f:
        known = docs.sparkSession.sparkContext.broadcast(f.read())
    end, most = np.array([end_id], dtype="<u2").tobytes(), block * lanes

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
        table = _chunk_ids(known.value)
        entries: list[tuple[int, int, int]] = []
        held: list[np.ndarray] = []
        size = 0

        def segment() -> pa.RecordBatch:
            nonlocal entries, held, size
            packed = pack_segment(entries, np.concatenate(held), block)
            entries, held, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["segment"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids = table.encode(text.as_py() or b"", end)
                flags = 0 if key is not None else NULL_ID
                while size + len(ids) > most:
                    part, ids = ids[: most - size], ids[most - size :]
                    if len(part):
                        entries.append((key or 0, len(part), flags | TO_NEXT))
                        held.append(part)
                        flags |= GOES_ON
                    yield segment()
                entries.append((key or 0, len(ids), flags))
                held.append(ids)
                size += len(ids)
        if held:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    sorted_rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    # the cast takes the bytes as they are
    sorted_rows.mapInArrow(encode, "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("lineSep", END).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of such files: file (number), before (ids of the documents before it in its file), doc_id, ids (binary:
    unsigned 32-bit little-endian numbers, the end id last). Files are read one a row, so each must be under 2 GB."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                before, open_doc = 0, []
                for directory, ids in unpack_segments(memoryview(content.as_buffer())):
                    rows, at, size = [], 0, 0
                    for key, n, flags in zip(directory["id"].tolist(), directory["n"].tolist(), directory["flags"].tolist()):
                        open_doc.append(ids[at : at + n])
                        at += n
                        if not flags & TO_NEXT:
                            whole = np.concatenate(open_doc).astype("<u4")
                            rows.append((file, before, None if flags & NULL_ID else key, whole.tobytes()))
                            before, open_doc = before + len(whole), []
                            size += 4 * len(whole)
                        if rows and (size > 4_000_000 or at == len(ids)):
                            columns = zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["file", "before", "doc_id", "ids"])
                            rows, size = [], 0
                    if open_doc:
                        open_doc = [np.concatenate(open_doc).copy()]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = F.regexp_extract("path", r"part-([0-9]+)", 1).cast("int")
    return files.select(number.alias("file"), "content").mapInArrow(decode, "file int, before long, doc_id long, ids binary")


def digest(read: DataFrame, scratch: Scratch) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it, over all files), n_tokens, ids_crc32."""
    rows = scratch.save(read.select("file", "before", "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "documents")
    # one row a file, so as many as the writer had tasks
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(before, F.lit(0)).alias("first"))
    return rows.join(F.broadcast(files), "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files below the shared folder, reads them back and returns their ``digest``; the files go at exit."""
    scratch = Scratch(docs.sparkSession, "id-files")
    path = f"{scratch.root}/files"
    write_ids(docs, vocabulary, path, id_col=id_col, text_col=text_col)
    return digest(read_ids(docs.sparkSession, path), scratch)
