"""Encoding and decoding of documents with a unigram piece model (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .unigram import Packed, UnigramModel, kept


def _typed(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", scores: str = "zipf") -> DataFrame:
    """Per row: id and ``ids`` (array of int), the pieces of the whole text.

    Null texts give null, empty ones an empty array; repeated rows give repeated rows; other columns are ignored. Rows
    are independent, so nothing is shuffled. A batch's ids leave it in parts of about 8 MB.
    """
    model = docs.sparkSession.sparkContext.broadcast(UnigramModel(model_path, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept(Packed, model.value)
        get, chunks = memo.__getitem__, memo.model.chunks

        def packed(keys: list, rows: list) -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(r or b"") // 4 for r in rows)])
            mask = pa.array([r is None for r in rows])
            values = pa.array(np.frombuffer(b"".join(r or b"" for r in rows), dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=mask)
            return pa.RecordBatch.from_arrays([pa.array(keys, batch.schema[0].type), lists], [id_col, "ids"])

        for batch in batches:
            keys, rows, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                keys.append(key)
                rows.append(None if text is None else b"".join(map(get, chunks(text))) if text else b"")
                size += len(rows[-1] or b"")
                if size > 8_000_000:
                    yield packed(keys, rows)
                    keys, rows, size = [], [], 0
            if keys:
                yield packed(keys, rows)

    return docs.select(id_col, text_col).mapInArrow(run, f"{_typed(docs, id_col)}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", scores: str = "zipf") -> DataFrame:
    """Per row: id and ``text``, the pieces joined, byte pieces as bytes, markers as spaces. Null ids give null.

    Texts come back as they were, except that U+2581 in a text comes back as a space.
    """
    model = encoded.sparkSession.sparkContext.broadcast(UnigramModel(model_path, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if not ids.is_valid else model.value.decode(ids.values.to_numpy(zero_copy_only=False).tolist()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{_typed(encoded, id_col)}, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", scores: str = "zipf") -> DataFrame:
    """Encodes and decodes every text in one pass: id, n_ids, n_byte_ids (long), ids_sha256 (of the ids as 32-bit
    little-endian numbers) and restored (null for null texts). The same tables serve ``encode`` and ``decode``."""
    model = docs.sparkSession.sparkContext.broadcast(UnigramModel(model_path, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        memo = kept(Packed, model.value)
        get, chunks, decoded = memo.__getitem__, memo.model.chunks, memo.model.decode
        spelled = np.zeros(len(memo.model.text), dtype=bool)
        spelled[memo.model.byte_ids] = True
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                packed = b"".join(map(get, chunks(text))) if text else b""
                ids = np.frombuffer(packed, dtype=np.int32)
                rows.append((len(ids), int(spelled[ids].sum()), hashlib.sha256(packed).hexdigest(), None if text is None else decoded(ids.tolist()) == text))
            columns = zip(*rows) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_())))], [id_col, "n_ids", "n_byte_ids", "ids_sha256", "restored"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{_typed(docs, id_col)}, n_ids long, n_byte_ids long, ids_sha256 string, restored boolean")
