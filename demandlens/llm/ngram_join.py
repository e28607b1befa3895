"""N-gram Jaccard join over a count-vector R-tree (operator 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .similarity import DIMENSIONS, TEXTS_AT_ONCE, Bound, KeyFilter, Pairwise, linked, shared_cells, small_batches
from .words import U, mix, shingles


def set_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


class Partition:
    """Cells of shingle sets for a Jaccard similarity of at least ``percent`` / 100.

    Two similar sets whose larger one has at most u elements differ in at most d = 2u(100 - percent) / (100 + percent).
    Sizes are cut into ranges; for the range with bound u the hash space is cut into more than d intervals, so that the
    sets agree exactly on one of them. A cell is a range, an interval and a hash of the elements in it. A set stands in
    the cells of its own range and of those above that hold partners. Where the sets agree on empty intervals only, each
    has at most d others: only such sets have cells for empty intervals. There are a sixth more intervals than needed: a set with m
    intervals that aren't empty then shares at least m - d of them with each similar one, and few sets without one share so many by chance.
    Here d is the set's own: one of n elements has partners of at most min(u, 100n / percent), from which it differs less than two sets of u may.
    """

    def __init__(self, percent: int, growth: float = 1.6):
        self.percent = percent
        self.growth = growth
        self.upper = [1]

    def differ(self, u: int) -> int:
        return 2 * u * (100 - self.percent) // (100 + self.percent)

    def own_differ(self, n: int, u: int) -> int:
        """Elements in which a set of n and a similar one of at most u differ at most."""
        return (n + min(u, 100 * n // self.percent)) * (100 - self.percent) // (100 + self.percent)

    def range_of(self, n: int) -> int:
        while self.upper[-1] < n:
            self.upper.append(max(self.upper[-1] + 1, int(self.upper[-1] * self.growth)))
        return int(np.searchsorted(self.upper, n))

    def cells(self, s: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """Cells of a set in each range, the range, and how many of them it shares with any similar set at least."""
        n = len(s)
        last = self.range_of(100 * n // self.percent)
        for j in range(self.range_of(n), last + 1):
            d = self.differ(self.upper[j])
            if d == 0:  # only equal sets are similar
                continue
            k = d + 1 + max(2, d // 6)
            part = ((s >> U(32)) * U(k)) >> U(32)  # s is sorted, so its parts are too
            at = np.flatnonzero(np.diff(part, prepend=U(k)))
            sums, own = np.add.reduceat(s, at), part[at]
            d = self.own_differ(n, self.upper[j])
            if len(at) <= d:
                empty = np.setdiff1d(np.arange(k, dtype=U), own)
                sums, own = np.concatenate([sums, np.zeros(len(empty), dtype=U)]), np.concatenate([own, empty])
            yield mix(sums ^ mix(own + (U(j) << U(32)))).view(np.int64), j, max(1, len(at) - d)


class Seen:
    """Keys that this task has had; forgets beyond a limit, as repeated rows do no harm."""

    def __init__(self, limit: int = 500_000):
        self.keys: set[int] = set()
        self.limit = limit

    def first(self, key: int) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= self.limit:
            self.keys.clear()
        self.keys.add(key)
        return True


def set_profiles(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles and the key of its shingle set (null for an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py() or b"", n) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], [id_col, "n_shingles", "key"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` {kind}, n_shingles long, key long")


def _cells(docs: DataFrame, n: int, percent: int, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen = Partition(percent), Seen()
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["sig", "key", "tag", "need"])

        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py() or b"", n)
                if len(s) and seen.first(key := set_key(s)):
                    for cells, tag, need in plan.cells(s):
                        parts.append((cells, np.full(len(cells), key), np.full(len(cells), tag, dtype=np.int32), np.full(len(cells), need, dtype=np.int32)))
                        size += len(cells)
                    if size >= 100_000:
                        yield out()
                        parts, size = [], 0
        if parts:
            yield out()

    return shared_cells(docs.select(F.col(text_col).cast("binary")), run, counted=True)


def _describe(docs: DataFrame, n: int, text_col: str, wanted: KeyFilter) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                s = shingles(text.as_py() or b"", n)
                if len(s) and shared.value.has(np.array([key := set_key(s)]))[0] and seen.first(key):
                    rows.append((key, len(s), 0, np.bincount((s & U(DIMENSIONS - 1)).astype(np.int64), minlength=DIMENSIONS).tolist(), s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()))], ["key", "n", "slack", "vec", "payload"])

    return docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "key long, n long, slack long, vec array<int>, payload binary")


class JaccardAtLeast(Pairwise):
    """Of sorted distinct 64-bit hashes."""

    def __init__(self, percent: int):
        self.percent = percent

    def enough(self, common, n1: int, n2):
        return common * (100 + self.percent) >= self.percent * (n1 + n2)

    def __call__(self, x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
        if len(a) > len(b):
            a, b = b, a
        common = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
        return self.enough(common, len(a), len(b))

    def over(self, payloads: list[bytes]) -> Callable[[bytes], Callable[[int], bool]]:
        """All overlaps of a set with a leaf's sets are counted at once, from lists of the sets that have each element."""
        sizes = np.array([len(p) // 8 for p in payloads])
        whole = np.frombuffer(b"".join(payloads), dtype=U)
        order = np.argsort(whole, kind="stable")
        owner = np.repeat(np.arange(len(payloads)), sizes)[order]
        elements, first = np.unique(whole[order], return_index=True)
        many = np.diff(np.append(first, len(whole)))

        def against(x: bytes) -> Callable[[int], bool]:
            a = np.frombuffer(x, dtype=U)
            at = np.minimum(np.searchsorted(elements, a), len(elements) - 1)
            at = at[elements[at] == a]
            n = many[at]
            # the places of all owners of all common elements
            places = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found = self.enough(np.bincount(owner[places], minlength=len(sizes)), len(a), sizes)
            return lambda j: bool(found[j])

        return against


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id reachable over links of Jaccard similarity >= percent / 100.

    Sets of n-word shingles of lower-cased whole texts; texts without words (null, empty) are linked with nothing and
    are their own components. Equal sets are one class from the first step on, so copies cost nothing further. Ids should be integers; a null
    id never names a component unless its component has no other. Repeated rows give repeated rows; other columns are
    ignored; an empty table gives an empty one. Texts are read whole, one at a time.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    with small_batches(docs.sparkSession, TEXTS_AT_ONCE):
        profiles = scratch.save(set_profiles(docs, n, id_col, text_col), "profiles")
    found = linked(_cells(docs, n, percent, text_col), lambda wanted: _describe(docs, n, text_col, wanted), Bound(100 + percent, percent), JaccardAtLeast(percent), scratch)
    classes = profiles.where("key is not null").groupBy("key").agg(F.min(id_col).alias("rep"))
    if found is not None:
        classes = scratch.save(classes, "classes")
        joined = classes.join(found, "key")
        least = joined.groupBy("comp").agg(F.min("rep").alias("least"))
        renamed = joined.join(least, "comp").select("key", "least")
        classes = classes.join(renamed, "key", "left").select("key", F.coalesce("least", "rep").alias("rep"))
    own = profiles.where("key is null").select(id_col, "n_shingles", F.col(id_col).alias("component_id"))
    whole = profiles.where("key is not null").join(classes, "key").select(id_col, "n_shingles", F.col("rep").alias("component_id")).unionByName(own)
    out = scratch.save(whole, "components")
    scratch.keep(out)
    return out
