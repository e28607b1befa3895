"""Token counts of documents by a trie-shared dynamic program (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .unigram import ForwardTrie, UnigramModel, kept


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", scores: str = "zipf") -> DataFrame:
    """Per row: id, n_pretokens and n_tokens (long) of the whole text under the unigram model.

    No shuffle: each task inserts the distinct pre-tokens of a batch in a trie (see ForwardTrie) and adds up terminal
    counts. Null and empty texts have 0 of both. A text of any length, also without a blank, takes memory in proportion to the
    text and time in proportion to its length. Null ids stay null, repeated rows give repeated rows, other columns
    are ignored, an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(UnigramModel(model_path, scores))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = kept(ForwardTrie, model.value)
        for batch in batches:
            ids, pre, out = batch.column(0), [], []
            for text in batch.column(1):
                chunks = trie.model.chunks(text.as_py()) if text.is_valid and text.as_py() else []
                pre.append(len(chunks))
                out.append(trie.count(chunks))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pre, pa.int64()), pa.array(out, pa.int64())], [id_col, "n_pretokens", "n_tokens"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_pretokens long, n_tokens long")
