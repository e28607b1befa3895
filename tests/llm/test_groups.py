"""What the search of open cells sends, and the shuffle files that saved tables leave."""

from __future__ import annotations

import glob
import time

import numpy as np
from pyspark.sql import functions as F

from demandlens.llm import similarity
from demandlens.llm.components import connected_components
from demandlens.llm.ngram_join import JaccardAtLeast
from demandlens.llm.scratch import Scratch


def test_points_that_meet_in_cells_are_neighbours_in_the_tree(spark, monkeypatch):
    """Of cells without similar sets a leaf is sent to its neighbours, not to all leaves that hold one of its points' others."""
    sent: list[int] = []
    search = similarity._search

    def counted(pairs, leaves, *more):
        sent.append(pairs.select(F.explode(F.array("leaf_1", "leaf_2")).alias("leaf"), "block_1", "block_2").distinct().count())
        sent.append(leaves.count())
        return search(pairs, leaves, *more)

    monkeypatch.setattr(similarity, "_search", counted)
    monkeypatch.setattr(similarity, "LEAF", 8)
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(1 << 40, 30, replace=False).astype(np.uint64)) for _ in range(1200)]
    for k in range(0, 1200, 100):  # a few that are similar, among members that aren't their cells' first ones
        sets[k + 1] = np.sort(np.concatenate([sets[k][:-1], [np.uint64(k)]]))
    cells = [(c, int(k)) for c in range(900) for k in rng.choice(np.arange(2, 1200), 4, replace=False)]
    cells += [(1000 + k, m) for k in range(0, 1200, 100) for m in (-1 - k, k, k + 1)]
    alone = {-1 - k: np.sort(rng.choice(1 << 40, 30, replace=False).astype(np.uint64)) for k in range(0, 1200, 100)}
    whole = dict(enumerate(sets)) | alone
    rows = [(k, len(s), 0, np.bincount((s % similarity.DIMENSIONS).astype(int), minlength=similarity.DIMENSIONS).tolist(), s.tobytes()) for k, s in whole.items()]
    described = spark.createDataFrame(rows, "key long, n long, slack long, vec array<int>, payload binary")
    found = similarity.linked(spark.createDataFrame(cells, "sig long, key long"), lambda wanted: described, similarity.Bound(180, 80), JaccardAtLeast(80), Scratch(spark, "groups"))

    assert sorted(map(tuple, found.select("key", "comp").collect())) == sorted((m, k) for k in range(0, 1200, 100) for m in (k, k + 1))
    # before, leaves mixed their points' cells, and each met nearly all others: over five times as many sendings as leaves
    assert sent[0] <= 2 * sent[1]


def test_saved_tables_leave_no_shuffle_files(spark):
    def files() -> int:
        local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return sum(len(glob.glob(f"{d}/*/shuffle_*.data")) for d in local)

    before, scratch = files(), Scratch(spark, "files")
    spark._jvm.System.gc()
    found = scratch.save(spark.range(50_000).selectExpr("id % 7 AS a", "id").groupBy("a").agg(F.sum("id").alias("b")).orderBy("a"), "sums")
    for _ in range(20):
        if (left := files()) <= before:
            break
        time.sleep(0.1)
    assert left <= before
    assert [r.a for r in found.collect()] == list(range(7))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_components_after_their_shuffles_are_gone(spark):
    edges = spark.range(300).where("id % 10 <> 9").selectExpr("id AS a", "id + 1 AS b").repartition(6)
    found = connected_components(edges, Scratch(spark, "chains"))
    assert sorted(map(tuple, found.collect())) == [(i, i - i % 10) for i in range(300)] == sorted(map(tuple, found.collect()))
