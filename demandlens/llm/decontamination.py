"""Benchmark decontamination by a prefix-filtered set join (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import ALNUM, LOWER, ngram_hashes, word_hashes

WINDOW, SHINGLE = 10, 3
#: Distinct windows held by a task at once; a larger benchmark is joined in blocks of items, one pass each.
BLOCK_WINDOWS = 200_000


def item_windows(text: bytes | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Runs of ``window`` words of an item; of fewer, but not none, the whole item."""
    low = (text or b"").translate(LOWER)
    starts, ends, _ = word_hashes(low, ALNUM)
    words = [low[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


class Block:
    """Windows of some items with their items, and the hashes of their shingles."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        found: dict[tuple[bytes, ...], set[str | None]] = {}
        for item, text in items:
            for w in item_windows(text, window):
                found.setdefault(w, set()).add(item)
        self.windows, self.items = list(found), list(found.values())
        self.text = [b" ".join(w) for w in self.windows]
        #: One row for each shingle of each window: its width, hash, window and offset. Windows under SHINGLE words are one shingle.
        rows = []
        for i, (w, joined) in enumerate(zip(self.windows, self.text)):
            width = min(SHINGLE, len(w))
            for offset, h in enumerate(ngram_hashes(word_hashes(joined, ALNUM)[2], width).tolist()):
                rows.append((width, h, i, offset))
        self.rows = rows

    def rarest(self, frequency: dict[tuple[int, int], int]) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """Every window's rarest shingle: containment needs all of a window, so a prefix of one shingle is necessary.
        By width and hash: the windows that it stands for, with its offset."""
        first: dict[int, tuple] = {}
        for width, h, i, offset in self.rows:
            key = (frequency.get((width, h), 0), h, offset, width)
            if i not in first or key < first[i]:
                first[i] = key
        out: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, (n, h, offset, width) in first.items():
            if n:  # a shingle that no document has
                out.setdefault(width, {}).setdefault(h, []).append((i, offset))
        return out


class Lookup:
    """Positions of wanted hashes in an array: a bitmap of low bits, then a binary search."""

    def __init__(self, wanted: set[int] | dict):
        self.sorted = np.array(sorted(wanted), dtype=np.uint64)
        self.low = np.zeros(1 << 20, dtype=bool)
        self.low[self.sorted & np.uint64((1 << 20) - 1)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted) or not len(h):
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.low[h & np.uint64((1 << 20) - 1)])
        near = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        return at[self.sorted[near] == h[at]]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Block]:
    """Items are read in an iterator, a partition at a time; a block has at most BLOCK_WINDOWS windows (one item more)."""
    held, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        held.append((row[0], None if row[1] is None else bytes(row[1])))
        size += len(row[1] or b"") // 2
        if size >= BLOCK_WINDOWS:
            yield Block(held, window)
            held, size = [], 0
    if held:
        yield Block(held, window)


def _frequencies(docs: DataFrame, text_col: str, block: Block) -> dict[tuple[int, int], int]:
    """Occurrences of the block's shingles in all documents; a task adds up what it has before the shuffle."""
    by_width = {w: {h for x, h, _, _ in block.rows if x == w} for w in {r[0] for r in block.rows}}
    shared = docs.sparkSession.sparkContext.broadcast({w: Lookup(hs) for w, hs in by_width.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = shared.value
        totals = {w: np.zeros(len(x.sorted), dtype=np.int64) for w, x in lookups.items()}
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    h = word_hashes(text.as_py().translate(LOWER), ALNUM)[2]
                    for w, x in lookups.items():
                        grams = ngram_hashes(h, w)
                        np.add.at(totals[w], np.searchsorted(x.sorted, grams[x.find(grams)]), 1)
        for w, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), w), pa.int32()), pa.array(lookups[w].sorted[at].view(np.int64)), pa.array(n[at])], ["width", "h", "n"])

    counted = docs.select(F.col(text_col).cast("binary")).mapInArrow(count, "width int, h long, n long").groupBy("width", "h").agg(F.sum("n").alias("n"))
    return {(r.width, r.h % (1 << 64)): r.n for r in counted.collect()}


def _hits(docs: DataFrame, id_col: str, text_col: str, block: Block) -> DataFrame:
    frequency = _frequencies(docs, text_col, block)
    shared = docs.sparkSession.sparkContext.broadcast((block.text, [len(w) for w in block.windows], block.items, {w: (Lookup(x), x) for w, x in block.rarest(frequency).items()}))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, sizes, items, index = shared.value
        for batch in batches:
            n_words, spans, found = [], [], []
            for text in batch.column(1):
                low = (text.as_py() or b"").translate(LOWER)
                starts, ends, h = word_hashes(low, ALNUM)
                n, hit, own = len(h), [], set()
                for width, (lookup, at) in index.items():
                    grams = ngram_hashes(h, width)
                    for pos in lookup.find(grams).tolist():
                        for i, offset in at[int(grams[pos])]:
                            first, last = pos - offset, pos - offset + sizes[i]
                            if first < 0 or last > n:  # the window would not fit here
                                continue
                            if b" ".join([low[s:e] for s, e in zip(starts[first:last].tolist(), ends[first:last].tolist())]) == texts[i]:
                                hit.append((first, last))
                                own.update(items[i])
                merged: list[list[int]] = []
                for first, last in sorted(hit):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], last)
                    else:
                        merged.append([first, last])
                n_words.append(n)
                spans.append([{"first": a, "last": b} for a, b in merged])
                found.append(sorted(own, key=lambda x: (x is None, x)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(found, pa.list_(pa.string()))], [id_col, "n_words", "hits", "items"])

    chosen = docs.select(id_col, F.col(text_col).cast("binary"))
    rest = T.StructType.fromDDL("n_words long, hits array<struct<first:long,last:long>>, items array<string>")
    return chosen.mapInArrow(join, T.StructType([chosen.schema[0], *rest.fields]))


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: id, n_words, hits (disjoint ranges of word positions inside occurring windows), items (sorted ids).

    A block of the benchmark is held by every task (its size is bounded by BLOCK_WINDOWS); a larger benchmark takes one
    pass for each block, and the passes' results are joined by a row number; the results are the same. Null and empty texts have no words.
    Items without words match nothing; an empty benchmark gives no hits. Items without an id count as hits like others, and all
    of them as one item, a null at the end of ``items``; items that share an id are one. Of a window's equally rare
    shingles the one with the smallest hash, then the first, is looked up, which changes no result. Whole texts are read, however long. Repeated rows
    give repeated rows; other columns are ignored, and the id may be any column, also a struct of all.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return _hits(docs, id_col, text_col, first or Block([], window))
    from .scratch import Scratch

    scratch = Scratch(docs.sparkSession, "decontamination")
    number = "_number"
    while number in (id_col, text_col):
        number += "_"
    rows = scratch.save(docs.select(id_col, text_col).withColumn(number, F.monotonically_increasing_id()), "rows")
    parts = scratch.save(_hits(rows, number, text_col, first), "hits")
    for block in (second, *blocks):
        parts = parts.unionByName(scratch.save(_hits(rows, number, text_col, block), "hits"))
    merged = parts.groupBy(number).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # at most one hit list a block: fold sorted ranges into disjoint ones
    disjoint = F.expr(
        "aggregate(hits, cast(array() as array<struct<first:bigint,last:bigint>>), (acc, x) -> CASE WHEN size(acc) > 0 AND x.first <= element_at(acc, -1).last"
        " THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, x.last)))) ELSE concat(acc, array(x)) END)"
    )
    return rows.select(number, id_col).join(merged, number).select(id_col, "n_words", disjoint.alias("hits"), "items")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and the hash of the items that ``contamination`` found."""
    hit = F.expr("aggregate(hits, 0L, (n, x) -> n + x.last - x.first)")
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
