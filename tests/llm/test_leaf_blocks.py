"""The search of pairs of leaves: what it finds, and into how many tasks it is cut."""

from __future__ import annotations

import numpy as np
import pytest

from demandlens.llm.ngram_join import JaccardAtLeast
from demandlens.llm.similarity import BLOCK, DIMENSIONS, Bound, _leaves, _search

SKEW = {
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "31",
}


@pytest.fixture
def skewed(spark):
    before = {k: spark.conf.get(k) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_large_leaves_are_searched_whole_in_as_many_tasks_as_partitions(skewed, tmp_path):
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(20):  # chains of sets, each similar to the next
        s = rng.choice(1 << 40, 1000, replace=False).astype(np.uint64)
        for _ in range(8):
            sets.append(np.sort(s))
            s = np.concatenate([s[50:], rng.choice(1 << 40, 50).astype(np.uint64)])
    rows = [(int(rng.integers(3)), k, len(s), k, 0, np.bincount((s % DIMENSIONS).astype(int), minlength=DIMENSIONS).tolist(), s.tobytes()) for k, s in enumerate(sets)]
    members = skewed.createDataFrame(rows, "group long, comp long, n long, key long, slack long, vec array<int>, payload binary")
    _leaves(members).write.parquet(str(tmp_path / "leaves"))
    leaves = skewed.read.parquet(str(tmp_path / "leaves"))
    numbers = {x.leaf: i for i, x in enumerate(sorted(leaves.select("leaf").collect()))}
    met = [(a, b, i // BLOCK, j // BLOCK) for a, i in numbers.items() for b, j in numbers.items() if i <= j]
    pairs = skewed.createDataFrame(met, "leaf_1 long, leaf_2 long, block_1 long, block_2 long").repartition(20)
    verify = JaccardAtLeast(80)
    found = _search(pairs, leaves, Bound(180, 80), verify)

    own = list(range(len(sets)))
    for a, b in found.collect():
        assert verify(sets[a].tobytes(), sets[b].tobytes())
        own = [own[a] if x == own[b] else x for x in own]
    assert [own[k] == own[k + 1] for k in range(len(sets) - 1)] == [k % 8 < 7 for k in range(len(sets) - 1)]
    assert len(set(own)) == 20
    assert found.rdd.getNumPartitions() == 31
