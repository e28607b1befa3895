"""Sharding by histogram sort (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bits by which a pass refines its probes: 1024 candidate boundaries for each boundary that isn't settled.
STEP = 10


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size, checksum and the 128-bit sort key: hash of the text (equal texts stay together), then the id (its hash, if it is no number)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.coalesce(F.col(id_col).cast("string").try_cast("long"), F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.lit(-(1 << 63))).alias("k2"),
    )


def _below(c: str, depth: int) -> Column:
    """The first ``depth`` bits of a signed 64-bit key, as a number that sorts like it."""
    return F.shiftright(F.col(c), 64 - depth).cast("long")


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Keys (k1, k2) at which shards 1, 2, ... begin: bytes below each are as near to its share as ``tolerance`` (of a
    shard) asks, or as near as rows allow.

    Every pass counts, over all rows and exactly, the bytes of each candidate interval inside those intervals that still
    hold an unsettled boundary (2**STEP each); no key leaves its partition. A boundary is settled when the bytes below
    one side of its interval meet the tolerance, or when the key has no more bits. While only k1 is refined, equal texts
    stay in one shard; k2 is refined for a boundary that falls inside copies of more bytes than tolerated.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    slack = tolerance * total / shards
    goal = {i: total * i / shards for i in range(1, shards)}
    #: Of each unsettled boundary: the interval (depth in k1, its bits, depth in k2, its bits) and the bytes below it.
    at: dict[int, tuple[int, int, int, int, int]] = dict.fromkeys(goal, (0, 0, 0, 0, 0))
    found: dict[int, tuple[int, int]] = {}
    low = -(1 << 63)
    while at:
        second = {i for i, x in at.items() if x[0] == 64}
        jobs = []
        for column, own in (("k1", set(at) - second), ("k2", second)):
            groups: dict[int, set[tuple[int, int]]] = {}
            for i in own:
                d1, b1, d2, b2, _ = at[i]
                groups.setdefault(d2 if column == "k2" else d1, set()).add((b1, b2))
            for depth, places in groups.items():
                deeper = min(64, depth + STEP)
                if column == "k1":
                    rows = keys if depth == 0 else keys.where(_below("k1", depth).isin([p[0] for p in places]))
                    parent = F.lit(0).cast("long") if depth == 0 else _below("k1", depth)
                    bins = rows.groupBy(parent.alias("p1"), F.lit(0).cast("long").alias("p2"), _below("k1", deeper).alias("bin"))
                else:
                    rows = keys.where(F.col("k1").isin([p[0] for p in places]))
                    parent = F.lit(0).cast("long") if depth == 0 else _below("k2", depth)
                    bins = rows.where(F.concat_ws(":", F.col("k1").cast("string"), parent.cast("string")).isin([f"{a}:{b}" for a, b in places])).groupBy(F.col("k1").alias("p1"), parent.alias("p2"), _below("k2", deeper).alias("bin"))
                jobs.append((column, depth, deeper, bins.agg(F.sum("size").alias("bytes"))))
        for column, depth, deeper, counted in jobs:
            inside: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for r in counted.collect():  # at most 2**STEP rows for each boundary
                inside.setdefault((r.p1, r.p2), []).append((r.bin, r.bytes))
            for i in list(at):
                d1, b1, d2, b2, under = at[i]
                if (column == "k2") != (d1 == 64) or (d2 if column == "k2" else d1) != depth:
                    continue
                bins = sorted(inside[(b1, b2) if column == "k2" else (b1, 0)])
                for b, n in bins:
                    if under + n >= goal[i]:
                        break
                    under += n
                start, end = b << (64 - deeper), (b + 1) << (64 - deeper)
                last = column == "k2" and deeper == 64
                side = min((abs(under - goal[i]), 0), (abs(under + n - goal[i]), 1))
                if side[0] <= slack or last:
                    edge = (start, end)[side[1]]
                    if column == "k1":
                        found[i] = (edge, low) if edge < 1 << 63 else ((1 << 63) - 1, (1 << 63) - 1)
                    else:
                        found[i] = (b1, edge) if edge < 1 << 63 else (b1, (1 << 63) - 1)
                    del at[i]
                else:
                    at[i] = (64, b1, deeper, b, under) if column == "k2" else (64, b, 0, 0, under) if deeper == 64 else (deeper, b, 0, 0, under)
    return [found[i] for i in sorted(found)]


def byte_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Shards are ranges of the key (hash of the text, id), so equal texts share a shard unless a boundary inside them is
    needed for balance. Rows are exchanged once, without their texts, by ranges of the key: a shard spans as many tasks
    as its size asks for, and slots come from each task's own count and the sums of the tasks before. Null texts count as empty and
    null ids sort first; ids may be of any simple type; repeated rows get slots of their own; an empty table gives an empty one. Other
    columns are ignored, and only a text's length and hashes leave its row, however long it is.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    keys = scratch.save(_keys(docs, id_col, text_col), "keys")
    bounds = splitters(keys, shards, tolerance)
    shard = sum((F.expr(f"int(k1 > {a}L or (k1 = {a}L and k2 >= {_long(b)}))") for a, b in bounds), F.lit(0))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.withColumn("shard", shard).repartitionByRange(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "size")
    # the number of a row: its partition, then its place in it
    rows = scratch.save(placed.withColumn("at", F.monotonically_increasing_id()), "placed")
    counts = rows.groupBy(F.shiftright("at", 33).alias("part"), "shard").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # one row for each task and shard that meet: at most tasks + shards
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    return (
        rows.withColumn("part", F.shiftright("at", 33))
        .join(F.broadcast(starts), ["part", "shard"])
        .select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def _long(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"
