"""Prefix trie of conversations as a z-fast trie (operator 12).

A turn is told by 128 bits of SHA-256 of its role and text, and a prefix by a chained 128-bit hash of its turns. Tasks insert
conversations in batches into z-fast tries over these prefix hashes, which find a conversation's exit node by fat binary
search. A batch's edges are then expanded into prefixes with counts; equal prefixes of all batches meet in one exchange.

What a prefix sums up over its subtree comes without a walk down the trie. A conversation owns the prefixes of which it is
the smallest member; these are the last ones on its path. A prefix's subtree then saves, over its members, the bytes from
there to what each owns; has as many leaves as members that own one; and as many children as members that own the next prefix.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WIDTH = 16
ROOT = bytes(WIDTH)
#: Turns that a path's row holds; longer conversations go on in further rows.
PIECE = 1 << 16
#: Turns of a batch that is inserted together.
BATCH = 400_000


def two_fattest(a: int, b: int) -> int:
    """The number in a + 1 to b that is divisible by the greatest power of two."""
    return b & -1 << (a ^ b).bit_length() - 1


class Node:
    """A compacted edge: prefixes of depths top + 1 to end. ``keys`` and ``lows`` are those of a path through it, from
    depth ``base`` on."""

    __slots__ = ("parent", "top", "end", "base", "keys", "lows", "passes", "ends", "least")

    def __init__(self, parent: Node | None, top: int, end: int, base: int, keys: list[bytes], lows: list[int]):
        self.parent, self.top, self.end, self.base, self.keys, self.lows = parent, top, end, base, keys, lows
        self.passes, self.ends, self.least = 0, 0, None

    def key(self, depth: int) -> bytes:
        return self.keys[depth - self.base]


class ZFastTrie:
    """Paths of chained prefix hashes. ``handles`` has each edge by the prefix at its two-fattest depth, ``edges`` by its
    first prefix. Paths may begin below the root (where an earlier row of a conversation ended)."""

    def __init__(self) -> None:
        self.handles: dict[bytes, Node] = {}
        self.edges: dict[bytes, Node] = {}
        self.roots: dict[bytes, Node] = {}
        self.nodes: list[Node] = []
        self.turns = 0

    def locate(self, start: int, keys: list[bytes]) -> tuple[Node, int]:
        """The exit node of a path (its prefixes from depth ``start`` on) and the depth down to which the path follows it."""
        last = start + len(keys) - 1
        node, found = self.roots[keys[0]], None
        a, b = start, last
        key = lambda d: keys[d - start]
        while a < b:
            f = two_fattest(a, b)
            hit = self.handles.get(key(f))
            if hit is None:
                b = f - 1
            elif hit.end <= last and hit.key(hit.end) == key(hit.end):
                node, a = hit, hit.end
            else:
                found = hit
                break
        if found is None and a < last:
            found = self.edges.get(key(a + 1))
        if found is None:
            return node, a
        # equal prefixes come before different ones
        low = max(a, found.top) + 1
        differ = bisect_left(range(low, min(found.end, last) + 1), True, key=lambda d: found.key(d) != key(d))
        return found, low + differ - 1

    def _enter(self, node: Node) -> None:
        self.handles[node.key(two_fattest(node.top, node.end))] = node
        self.edges[node.key(node.top + 1)] = node

    def insert(self, start: int, keys: list[bytes], lows: list[int], conv: int, ends: bool) -> None:
        """Adds a path whose end is the conversation's end, or only its row's."""
        if keys[0] not in self.roots:
            self.roots[keys[0]] = root = Node(None, start, start, start, keys, lows)
            self.nodes.append(root)
        last = start + len(keys) - 1
        node, depth = self.locate(start, keys)
        if depth < node.end:  # inside the edge: its upper part becomes a node of its own
            upper = Node(node.parent, node.top, depth, node.base, node.keys, node.lows)
            node.parent, node.top = upper, depth
            self.nodes.append(upper)
            self._enter(upper)
            self._enter(node)
            node = upper
        if depth < last:
            node = Node(node, depth, last, start, keys, lows)
            self.nodes.append(node)
            self._enter(node)
        node.passes += 1
        node.ends += ends
        node.least = conv if node.least is None else min(conv, node.least)
        self.turns += last - depth

    def expand(self) -> Iterator[tuple[int, bytes, bytes | None, int, int, int, int]]:
        """Of every prefix: depth, hash, hash of the prefix before, bytes before the last text, paths through it, paths
        that end there, smallest conversation. Nothing can be inserted afterwards."""
        for node in sorted(self.nodes, key=lambda n: -n.end):
            above = node.parent
            if above is not None:
                above.passes += node.passes
                above.least = node.least if above.least is None else min(above.least, node.least)
            elif node.end == 0:
                yield 0, ROOT, None, 0, node.passes, node.ends, node.least
            for d in range(node.top + 1, node.end + 1):
                yield d, node.key(d), node.key(d - 1), node.lows[d - node.base], node.passes, node.ends if d == node.end else 0, node.least


def paths(conversations: DataFrame, cross: int = 1, heads: int = 1, piece: int = PIECE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation the hashes of its prefixes, in rows of at most ``piece`` turns: conv_id, start (depth of the row's
    first prefix), keys (from that depth on), lows (bytes of the texts before each prefix's last turn), total (bytes up to
    the row's end) and ends (whether it is the conversation's last row).

    Turns are ordered by number, null first, and of equal number by their hashes, so texts stay out of the exchange;
    null roles and texts are empty; rows without a conversation's id are left out. With cross > 1 conversation c begins
    with the first h turns of conversation c - c % cross and goes on with its own after its first h, h = crc32(c) %
    heads (c % cross is never negative). Conversations that end up without turns have the root only. A task holds heads - 1 turns and a row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.unhex(F.substring(turn, 1, 2 * WIDTH)).alias("digest"), F.octet_length(text).cast("long").alias("size"),
    )
    dealt = rows.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(cross))).repartition("base").sortWithinPartitions("base", "conv_id", "turn", "digest")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "start", "keys", "lows", "total", "ends"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.bool_()]
        out: list[tuple] = []
        held = 0
        base, conv, number, head = None, None, 0, 0
        first: list[tuple[bytes, int]] = []
        start, total, keys, lows = 0, 0, [ROOT], [0]

        def row(ends: bool) -> None:
            nonlocal start, keys, lows, held
            out.append((conv, start, keys, lows, total, ends))
            held += len(keys)
            start, keys, lows = start + len(keys) - 1, keys[-1:], [total]

        def add(digest: bytes, size: int) -> None:
            nonlocal total
            if len(keys) > piece:
                row(False)
            keys.append(hashlib.blake2b(keys[-1] + digest, digest_size=WIDTH).digest())
            lows.append(total)
            total += size

        def made() -> pa.RecordBatch:
            nonlocal out, held
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out, held = [], 0
            return batch

        for batch in batches:
            for b, c, digest, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != conv:
                    if conv is not None:
                        row(True)
                    if b != base:
                        base, first = b, []
                    conv, number = c, 0
                    start, total, keys, lows = 0, 0, [ROOT], [0]
                    head = zlib.crc32(str(c).encode()) % heads
                    if c != base:
                        for turn_ in first[:head]:
                            add(*turn_)
                if c == base:
                    if len(first) < heads - 1:
                        first.append((digest, size))
                    add(digest, size)
                elif number >= head:
                    add(digest, size)
                number += 1
                if held > piece:
                    yield made()
        if conv is not None:
            row(True)
            yield made()

    schema = "conv_id long, start long, keys array<binary>, lows array<long>, total long, ends boolean"
    return dealt.select("base", "conv_id", "digest", "size").mapInArrow(chain, schema)


def _expanded(found: DataFrame, batch_turns: int = BATCH) -> DataFrame:
    """One row for each prefix of each batch of paths."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["depth", "key", "parent", "low", "n", "ends", "conv_id"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
        trie = ZFastTrie()

        def expand() -> Iterator[pa.RecordBatch]:
            rows = []
            for row in trie.expand():
                rows.append(row)
                if len(rows) == 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for conv, start, keys, lows, ends in zip(*(batch.column(i).to_pylist() for i in range(5))):
                trie.insert(start, keys, lows, conv, ends)
                if trie.turns > batch_turns or len(trie.nodes) > batch_turns:
                    yield from expand()
                    trie = ZFastTrie()
        yield from expand()

    return found.select("conv_id", "start", "keys", "lows", "ends").mapInArrow(build, "depth long, key binary, parent binary, low long, n long, ends long, conv_id long")


def _lists_sha256(ends: DataFrame) -> DataFrame:
    """Of (key, conv_id): the SHA-256 of each key's ids, ascending and joined by commas. Ids are joined in pieces of
    65,536 numbers, so that the one pass over a key's ids that the checksum asks for reads few rows."""
    pieces = ends.groupBy("key", F.shiftright("conv_id", 16).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["key", "ends_sha256"])
                done = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(hashed, "key binary, ends_sha256 string")


def prefix_nodes(conversations: DataFrame, cross: int = 1, heads: int = 1, piece: int = PIECE, batch_turns: int = BATCH, **columns: str) -> DataFrame:
    """Per distinct prefix (the textless root too): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256; ``paths`` says what the arguments and unkind rows do. No conversations, no rows.

    Repeated turns of a conversation count as often as they occur. Shuffles carry hashes and counts, no texts: the turns
    once, the prefixes (no more than there are turns) some three times. Of prefixes that a thousandth or more of all
    conversations leave (at most 1,000) the owner is broadcast; the others' are joined.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    path = scratch.save(paths(conversations, cross, heads, piece, **columns), "paths")
    grouped = _expanded(path, batch_turns).groupBy("key").agg(
        *(F.first(c).alias(c) for c in ("depth", "parent", "low")), F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.min("conv_id").alias("conv_id"),
    )
    nodes = scratch.save(grouped, "nodes")
    # the first prefix that a conversation owns, and whether its last one is a leaf
    top = F.min_by(F.struct("depth", "key", "parent", "low"), "depth")
    owners = nodes.groupBy("conv_id").agg(top.alias("top"), F.max_by(F.col("n") == F.col("ends"), "depth").alias("leaf"))
    owners = scratch.save(owners.select("conv_id", "top.*", "leaf"), "owners")

    leaving = owners.where("parent IS NOT NULL").select("key", "parent")
    counts = leaving.groupBy("parent").agg(F.count(F.lit(1)).alias("leave"))
    total = owners.count()
    owner_of = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    busy = scratch.save(counts.where(F.col("leave") * 1000 >= max(total, 1000)).join(owner_of, "parent").select("parent", "parent_conv_id"), "busy")
    often = leaving.join(F.broadcast(busy), "parent")
    seldom = leaving.join(F.broadcast(busy.select("parent")), "parent", "left_anti").join(owner_of, "parent")
    above = often.unionByName(seldom).select("key", "parent_conv_id")

    conv = path.where("ends").select("conv_id", (F.col("start") + F.size("keys") - 1).alias("last"), F.element_at("keys", -1).alias("end_key"), "total")
    own = owners.select("conv_id", F.col("depth").alias("top"), F.col("low").alias("cut"), "leaf")
    # whoever owns nothing begins to own after its end
    info = conv.join(own, "conv_id", "left").select("conv_id", "last", F.coalesce("top", F.col("last") + 1).alias("top"), F.coalesce("cut", "total").alias("cut"), F.coalesce("leaf", F.lit(False)).alias("leaf"))
    steps = path.join(info, "conv_id").select("start", "last", "top", "cut", "leaf", F.posexplode(F.arrays_zip("keys", "lows")).alias("place", "step"))
    depth = F.col("start") + F.col("place")
    sums = steps.where("place > 0 OR start = 0").groupBy(F.col("step.keys").alias("key")).agg(
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(((F.col("top") <= depth + 1) & (depth < F.col("last"))).cast("long")).alias("n_children"),
        F.sum(F.when(depth < F.col("top"), F.col("cut") - F.col("step.lows")).otherwise(0)).alias("saved_tokens"),
    )
    lists = _lists_sha256(conv.select(F.col("end_key").alias("key"), "conv_id"))
    found = nodes.join(sums, "key").join(lists, "key", "left").join(above, "key", "left")
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
