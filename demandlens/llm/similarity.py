"""Linking of distinct objects (shingle sets, lines) that are similar enough, without listing all pairs of a group.

1. Cells: every object stands in some cells, such that any two similar objects share one. Tasks pack cells by ranges of their
   hash, so that ranges are shuffled, not cells; cells of one object fall away where ranges are read.
2. Every object that shares a cell has a point: its elements counted in DIMENSIONS hashed groups. The sum of the coordinate
   minima of two points bounds the overlap of the objects. Members of a cell are first verified against the cell's first
   one, as far as the bound allows: this settles cells of two and most groups of copies, with a pair for each member.
3. Cells whose other members aren't all connected by then are searched with an R-tree over their members' points. Cells whose
   first members are in one component are a group, and a point stands in the tree once for each of its groups: objects that meet are
   neighbours there, so that what is sent grows as the memberships do, not as all pairs of leaves. The tree has leaves of
   neighbouring points with their objects, and nodes over FANOUT leaves, each with its corner of largest coordinates and its
   range of sizes. Pairs of nodes that share a group and whose corners allow enough overlap are followed down to pairs of
   leaves; each pair of leaves is searched once, whatever number of groups it shares. Pairs are dealt by pairs of blocks of BLOCK leaves, so
   that a leaf is sent once to such a pair, not to each leaf that it meets. The search keeps the components of
   its leaves, verifies the pairs of points that the bound leaves and that are in different ones, and emits a link only where it
   joins two: fewer rows than the leaves have points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import small_batches
from .components import connected_components
from .scratch import Scratch

DIMENSIONS = 128
#: Points of a leaf at most; a leaf of larger objects is closed at so many bytes of them. Leaves of a node.
LEAF, LEAF_BYTES, FANOUT = 128, 1 << 19, 32
#: Leaves of a block: a search holds those of two blocks, each of LEAF_BYTES and one object more at most.
BLOCK = 8
#: Leaves that a search reads at once.
LEAVES_AT_ONCE = 16
#: Whole texts that a task reads at once.
TEXTS_AT_ONCE = 1000
#: Ranges of cells for each shuffle partition, cells of a range that are packed in one row, cells that are packed at once, and
#: cells of a range from which on the shared ones are passed on before the range ends.
RANGES, ROW_CELLS, PACK_CELLS, RANGE_CELLS = 8, 2048, 1 << 20, 1 << 21
#: Bits of the filter of member keys, whatever their number: 8 MB. Beyond some 10 million members it lets others pass too, which costs time only.
FILTER_BITS = 1 << 26


@dataclass(frozen=True)
class Bound:
    """Similar objects have a * overlap >= b * (n1 + n2) - least(slack1, slack2); so has the sum of coordinate minima, which
    is no less. ``slack`` belongs to an object."""

    a: int
    b: int

    def column(self, overlap, n1, n2, slack):
        return overlap * self.a >= (n1 + n2) * self.b - slack


class KeyFilter:
    """Fixed-size bitmap of keys; true for every key put in."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.uint64) & np.uint64(FILTER_BITS - 1)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def key_filter(keys: DataFrame) -> KeyFilter:
    """Bits are or-ed on the executors; at most FILTER_BITS / 64 numbers come to the driver."""
    slot = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = keys.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast((key & {FILTER_BITS - 1}) & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    words = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    found = rows.toArrow()
    words[found.column("w").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return KeyFilter(words)


def overlap(a: str, b: str) -> F.Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> least(x, y)), 0L, (s, x) -> s + x)")


def _met(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (sig, key, ...) of cells with two objects at least, each once, and one row of every cell."""
    order = np.argsort(columns[0])
    sig = columns[0][order]
    new = np.append(True, sig[1:] != sig[:-1])
    one = order[new]
    again = order[~(new & np.append(new[1:], True))]  # cells of several rows, most of them of equal objects
    again = again[np.lexsort((columns[1][again], columns[0][again]))]
    sig, key = columns[0][again], columns[1][again]
    if not len(again):
        return again, one
    new = np.append(True, sig[1:] != sig[:-1])
    other = np.append(True, key[1:] != key[:-1]) | new
    cell = np.cumsum(new) - 1
    return again[other & (np.bincount(cell[other])[cell] > 1)], one


def shared_cells(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], counted: bool = False) -> DataFrame:
    """Of the cells that ``run`` makes of ``rows`` (sig, key and, if counted, tag and need) those of two objects at least; rows may repeat.

    A task reads a range's cells at once, of a large range RANGE_CELLS and one of each cell: many objects of one cell are passed on as they come.
    """
    kinds = {"sig": np.int64, "key": np.int64} | ({"tag": np.int32, "need": np.int32} if counted else {})
    ranges = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(PACK_CELLS, ROW_CELLS * ranges)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held)]
            own = (((columns[0].view(np.uint64) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(own, kind="stable")
            at = np.flatnonzero(np.diff(own[order], prepend=-1))
            ends = np.append(at, len(order))
            blobs = [pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((ends * c.itemsize).astype(np.int32)), pa.py_buffer(c[order])]) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(own[order[at]].astype(np.int32)), *blobs], ["range", *kinds])

        for made in run(batches):
            held.append([c.to_numpy() for c in made.columns])
            size += made.num_rows
            if size >= most:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now, size, limit = None, 0, RANGE_CELLS

        def found() -> tuple[pa.RecordBatch, list[np.ndarray]]:
            columns = [np.concatenate(x) for x in zip(*held)]
            met, one = _met(columns)
            return pa.RecordBatch.from_arrays([pa.array(c[met]) for c in columns], list(kinds)), [c[one] for c in columns]

        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for i, own in enumerate(numbers):
                if own != now:
                    if held:
                        yield found()[0]
                    now, held, size, limit = own, [], 0, RANGE_CELLS
                # a copy: batches go before the range ends
                held.append([np.frombuffer(c[i].as_buffer(), dtype=k).copy() for c, k in zip(batch.columns[1:], kinds.values())])
                size += len(held[-1][0])
                if size >= limit:
                    out, one = found()
                    yield out
                    held, size = [one], len(one[0])
                    limit = max(RANGE_CELLS, 2 * size)
        if held:
            yield found()[0]

    packed = rows.mapInArrow(pack, ", ".join(["range int", *(f"{c} binary" for c in kinds)]))
    dealt = packed.repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(unpack, ", ".join(f"{c} {'long' if k is np.int64 else 'int'}" for c, k in kinds.items()))


class Pairwise:
    """Decides on two payloads at a time; ``over`` gives the same decisions for one payload against those of a leaf."""

    def __call__(self, x: bytes, y: bytes) -> bool:
        raise TypeError("a rule for two payloads is needed")

    def over(self, payloads: list[bytes]) -> Callable[[bytes], Callable[[int], bool]]:
        return lambda x: lambda j: self(x, payloads[j])


def _leaves(members: DataFrame) -> DataFrame:
    """Bulk-loaded leaves of ``members`` (group, comp, n, key, slack, vec, payload; a key in several groups has a row for each), sorted by
    group, component and size."""

    fields = "leaf long, high array<int>, least long, most long, slack long, low_comp long, high_comp long, groups array<long>, keys array<long>, comps array<long>, ns array<long>, slacks array<long>, ends array<long>, vecs binary, payloads binary"
    kinds = [pa.int64(), pa.list_(pa.int32()), *[pa.int64()] * 5, *[pa.list_(pa.int64())] * 6, pa.binary(), pa.binary()]
    names = [x.split()[0] for x in fields.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        size = 0

        def leaf() -> pa.RecordBatch:
            groups, comps, ns, keys, slacks, vecs, payloads = zip(*held)
            vecs = np.array(vecs, dtype=np.int32)
            row = (first + made, vecs.max(axis=0).tolist(), min(ns), max(ns), max(slacks), min(comps), max(comps), list(dict.fromkeys(groups)), keys, comps, ns, slacks, np.cumsum([len(x) for x in payloads]).tolist(), vecs.tobytes(), b"".join(payloads))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        for batch in batches:
            for m in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) >= LEAF or size + len(m[6]) > LEAF_BYTES):
                    yield leaf()
                    made, held, size = made + 1, [], 0
                held.append(m)
                size += len(m[6])
        if held:
            yield leaf()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = members.repartitionByRange(parts, "group", "comp", "n", "key").sortWithinPartitions("group", "comp", "n", "key")
    return ordered.select("group", "comp", "n", "key", "slack", "vec", "payload").mapInArrow(pack, fields)


def _leaf_pairs(leaves: DataFrame, bound: Bound, scratch: Scratch) -> DataFrame:
    """leaf_1 <= leaf_2 and the blocks that they are in: the pairs of leaves that have points of one group and that the bound allows, each once.

    A group is the component that first members of its cells are in. Leaves all of whose points are in that one are met by others, not
    by each other: two of their points need no link.
    """
    # leaves are numbered through all partitions, so that nodes are full; there is a start for each partition
    part = F.shiftright("leaf", 32)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = leaves.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    node, block = (F.expr(f"((leaf & 4294967295) + before) div {n}").alias(name) for n, name in ((FANOUT, "node"), (BLOCK, "block")))
    numbered = leaves.select("leaf", part.alias("part"), "high", "least", "most", "slack", "low_comp", "high_comp").join(F.broadcast(starts), "part")
    heads = scratch.save(numbered.select("leaf", node, block, "high", "least", "most", "slack", "low_comp", "high_comp"), "heads")
    nodes = heads.groupBy("node").agg(
        F.aggregate(F.collect_list("high"), F.array_repeat(F.lit(0), DIMENSIONS), lambda x, y: F.zip_with(x, y, lambda a, b: F.greatest(a, b))).alias("high"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("slack").alias("slack")
    )
    own = scratch.save(leaves.select("leaf", F.explode("groups").alias("group")), "leaf-groups")

    def allowed(pairs: DataFrame, boxes: DataFrame, name: str) -> DataFrame:
        for i in (1, 2):
            pairs = pairs.join(boxes.select(F.col(name).alias(f"{name}_{i}"), *(F.col(c).alias(f"{c}_{i}") for c in boxes.columns if c not in (name, "node"))), f"{name}_{i}")
        # sizes nearest to each other that the two boxes allow, then the corners
        small, slack = F.least("most_1", "most_2"), F.least("slack_1", "slack_2")
        sizes = bound.column(small, small, F.greatest("least_1", "least_2", small), slack)
        return pairs.where(sizes & bound.column(overlap("high_1", "high_2"), F.col("least_1"), F.col("least_2"), slack))

    def ordered(a: str, b: str, name: str) -> list:
        return [F.least(a, b).alias(f"{name}_1"), F.greatest(a, b).alias(f"{name}_2")]

    outside = F.bool_or((F.col("low_comp") != F.col("group")) | (F.col("high_comp") != F.col("group")))
    by_node = own.join(heads.select("leaf", "node", "low_comp", "high_comp"), "leaf").groupBy("group", "node").agg(outside.alias("outside"))
    met = by_node.where("outside").select("group", F.col("node").alias("a")).join(by_node.select("group", F.col("node").alias("b")), "group").select(*ordered("a", "b", "node")).distinct()
    down = scratch.save(allowed(met, nodes, "node").select("node_1", "node_2"), "nodes")
    below = down.join(heads.select(F.col("node").alias("node_1"), F.col("leaf").alias("a")), "node_1").join(heads.select(F.col("node").alias("node_2"), F.col("leaf").alias("b")), "node_2")
    both = below.where("node_1 < node_2 or a <= b").select(*ordered("a", "b", "leaf"))
    # a leaf has no more groups than points; most leaves of two nodes share none
    for i in (1, 2):
        both = both.join(leaves.select(F.col("leaf").alias(f"leaf_{i}"), F.col("groups").alias(f"groups_{i}")), f"leaf_{i}")
    near = allowed(both.where(F.arrays_overlap("groups_1", "groups_2")).select("leaf_1", "leaf_2"), heads, "leaf")
    return near.where("low_comp_1 <> high_comp_1 or low_comp_2 <> high_comp_2 or low_comp_1 <> low_comp_2").select("leaf_1", "leaf_2", "block_1", "block_2")


class _Leaf:
    def __init__(self, row: dict):
        self.keys, self.comps, self.ns, self.slacks, ends = (np.array(row[c], dtype=np.int64) for c in ("keys", "comps", "ns", "slacks", "ends"))
        self.vecs = np.frombuffer(row["vecs"], dtype=np.int32).reshape(-1, DIMENSIONS)
        whole, starts = row["payloads"], [0, *ends[:-1].tolist()]
        self.payloads = [whole[s:e] for s, e in zip(starts, ends.tolist())]
        self.leaf, self.others = row["leaf"], set(row["others"])


def _joining(held: list[_Leaf], bound: Bound, verify: Pairwise) -> Iterator[tuple[int, int]]:
    """Links between each leaf and its ``others``; each joins two components of the leaves' points."""
    whole = np.concatenate([x.comps for x in held])
    for x, part in zip(held, np.split(whole, np.cumsum([len(x.comps) for x in held])[:-1])):
        x.comps = part  # a view, so that components are joined in all leaves at once
    for y in held:
        decide = None
        for x in held:
            if y.leaf not in x.others:
                continue
            for i in range(len(x.keys)):
                ok = y.comps != x.comps[i]
                if x is y:
                    ok[: i + 1] = False
                # by size no more overlap is possible than the smaller object has: a cheap test before the coordinates
                need = bound.b * (x.ns[i] + y.ns) - np.minimum(x.slacks[i], y.slacks)
                near = np.flatnonzero(ok & (bound.a * np.minimum(x.ns[i], y.ns) >= need))
                if not len(near):
                    continue
                spare = bound.a * np.minimum(x.vecs[i], y.vecs[near]).sum(axis=1, dtype=np.int64) - need[near]
                decided = None
                for j in near[np.argsort(-spare, kind="stable")][: np.count_nonzero(spare >= 0)].tolist():
                    if y.comps[j] == x.comps[i]:  # joined by now
                        continue
                    decide = decide or verify.over(y.payloads)
                    decided = decided or decide(x.payloads[i])
                    if decided(j):
                        yield int(x.keys[i]), int(y.keys[j])
                        whole[whole == y.comps[j]] = x.comps[i]


def _search(pairs: DataFrame, leaves: DataFrame, bound: Bound, verify: Pairwise) -> DataFrame:
    """Links (a, b) that join the components of the points of leaves: those of a spanning forest for each pair of blocks."""
    columns = ["keys", "comps", "ns", "slacks", "ends", "vecs", "payloads"]
    sides = F.explode(F.array(F.struct(F.col("leaf_1").alias("leaf"), F.col("leaf_2").alias("other")), F.struct(F.col("leaf_2").alias("leaf"), F.lit(None).cast("long").alias("other"))))
    met = pairs.select("block_1", "block_2", sides.alias("side")).groupBy("block_1", "block_2", "side.leaf").agg(F.collect_set("side.other").alias("others"))
    # dealt anew after the join: a join with Python behind it would be cut into as many tasks as leaves meet, as leaves are large
    sent = met.join(leaves.select("leaf", *columns), "leaf").repartition("block_1", "block_2").sortWithinPartitions("block_1", "block_2", "leaf")

    def links(held: list[_Leaf]) -> Iterator[pa.RecordBatch]:
        if found := list(_joining(held, bound, verify)) if held else []:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Leaf] = []
        now = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if now != (now := (row["block_1"], row["block_2"])):
                    yield from links(held)
                    held = []
                held.append(_Leaf(row))
        yield from links(held)

    return sent.select("block_1", "block_2", "leaf", "others", *columns).mapInArrow(search, "a long, b long")


def _verified(pairs: DataFrame, described: DataFrame, verify: Pairwise) -> DataFrame:
    payload = described.select("key", "payload")
    both = pairs.join(payload.withColumnsRenamed({"key": "a", "payload": "pa"}), "a").join(payload.withColumnsRenamed({"key": "b", "payload": "pb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([verify(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(ok)

    return both.select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long")


def linked(cells: DataFrame, describe: Callable[[KeyFilter], DataFrame], bound: Bound, verify: Pairwise, scratch: Scratch) -> DataFrame | None:
    """Components of similar objects: ``key`` and ``comp`` of those with a similar one; None if cells hold no two objects.

    ``cells``: sig, key; rows may repeat. With tag and need, an object of which under ``need`` cells of a tag are shared has no similar one among
    these. ``describe(filter)``: key, n, slack, vec (array of DIMENSIONS counts) and payload of at
    least the objects whose keys the filter has; rows may repeat. ``verify`` decides on two payloads.
    """
    spark = cells.sparkSession
    by_cell = Window.partitionBy("sig").orderBy("key")
    first, after = F.first("key").over(by_cell.rowsBetween(Window.unboundedPreceding, 0)), F.lead("key").over(by_cell)
    counted = "need" in cells.columns
    met = cells.withColumn("hub", first).withColumn("after", after).where("hub <> key or after <> key").drop("hub", "after").distinct()
    if counted:  # members of too few shared cells have no similar object; cells of one are left out then
        with small_batches(spark, TEXTS_AT_ONCE):
            met = every = scratch.save(met, "met")
        enough = met.groupBy("key", "tag").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n >= need").select("key", "tag")
        met = met.join(enough, ["key", "tag"], "left_semi")
    with small_batches(spark, TEXTS_AT_ONCE):
        shared = scratch.save(met.select("sig", "key").withColumn("hub", first).where("hub <> key"), "shared")
    if counted:
        scratch.drop(every)
    if shared.isEmpty():
        return None
    members = shared.select("key").union(shared.select("hub")).distinct()
    wanted = key_filter(members)
    with small_batches(spark, TEXTS_AT_ONCE):
        described = scratch.save(describe(wanted).join(members, "key", "left_semi").dropDuplicates(["key"]), "members")
    point = described.select("key", "n", "slack", "vec")

    star = shared.select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    near = star.join(point.withColumnsRenamed({"key": "a", "n": "n1", "slack": "s1", "vec": "v1"}), "a").join(point.withColumnsRenamed({"key": "b", "n": "n2", "slack": "s2", "vec": "v2"}), "b")
    near = near.where(bound.column(overlap("v1", "v2"), F.col("n1"), F.col("n2"), F.least("s1", "s2")))
    links = scratch.save(_verified(near.select("a", "b"), described, verify), "links")
    comps = scratch.save(connected_components(links, scratch), "comps")

    hubs = comps.select(F.col("key").alias("hub"), F.col("comp").alias("hub_comp"))
    placed = shared.join(comps, "key", "left").join(hubs, "hub", "left").select("sig", "key", F.coalesce("comp", "key").alias("comp"), F.coalesce("hub_comp", "hub").alias("hub_comp"))
    # what is left: cells in which members besides the first are in several components
    left = placed.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("sig")
    opened = scratch.save(placed.join(left, "sig", "left_semi").select(F.col("hub_comp").alias("group"), "key", "comp").distinct(), "open")
    if not opened.isEmpty():
        leaves = scratch.save(_leaves(opened.join(described, "key").select("group", "comp", "n", "key", "slack", "vec", "payload")), "leaves")
        pairs = _leaf_pairs(leaves, bound, scratch)
        with small_batches(spark, LEAVES_AT_ONCE):
            new = scratch.save(_search(pairs, leaves, bound, verify), "links")
        if not new.isEmpty():
            comps = scratch.save(connected_components(links.unionByName(new), scratch), "comps")
        scratch.drop(opened, leaves)
    scratch.drop(shared, described)
    return comps
