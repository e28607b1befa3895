"""Exact nearest neighbours through the index of balls, against all pairs."""

import numpy as np
import pytest

from demandlens.operators.ball_index import BallIndex
from demandlens.operators.vectors import top_k


def vectors(seed, n, dim=8, clusters=12, spread=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, dim))
    out = middles[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))
    return [(int(i), [float(np.float32(x)) for x in v], int(rng.integers(0, 5))) for i, v in enumerate(out)]


def all_pairs(queries, chunks, k, boost=0.0, skills=None):
    out = set()
    for qid, q, skill in queries:
        scored = []
        for cid, c, *_ in chunks:
            norm = np.linalg.norm(q) * np.linalg.norm(c)
            far = round(1 - float(np.dot(q, c)) / norm, 9) if np.isfinite(norm) and norm > 0 else 1.0
            tagged = skills is not None and skill in skills.get(cid, ())
            scored.append((round(far - boost * tagged, 9), cid, tagged))
        for place, (adjusted, cid, tagged) in enumerate(sorted(scored)[:k], 1):
            out.add((qid, cid, round(adjusted, 6), tagged, place))
    return out


SCHEMA = "id long, embedding array<float>, skill_id long"


@pytest.mark.parametrize("boost", [0.0, 0.15])
def test_equals_all_pairs(spark, boost):
    chunks = vectors(1, 900) + [(1000, [0.0] * 8, 1), (1001, [1.0] * 8, 1), (1002, [1.0] * 8, 2), (1003, [float("nan")] * 8, 2)]
    queries = vectors(2, 60) + [(900, [0.0] * 8, 3), (901, [2.0] * 8, 1), (902, [1.0] * 8, None)]
    skills = {cid: {s, (s + 1) % 5} for cid, _, s in chunks if s}
    tags = spark.createDataFrame([(c, s) for c, own in skills.items() for s in own], "chunk_id long, skill_id int")
    df = spark.createDataFrame(chunks + [(5000, None, 1)], SCHEMA)
    got = top_k(spark.createDataFrame(queries + [(999, None, 1)], SCHEMA), df, 5, tags if boost else None, boost).collect()
    assert {(r.query_id, r.chunk_id, round(r.adjusted, 6), r.tagged, r.place) for r in got} == all_pairs(queries, chunks, 5, boost, skills if boost else None)


def test_far_rings_are_not_read(spark):
    chunks, queries = vectors(3, 4000), vectors(3, 40)
    index = BallIndex.build(spark.createDataFrame(chunks, SCHEMA))
    found, read = index.search(spark.createDataFrame(queries, SCHEMA), 3)
    assert {(r.query_id, r.chunk_id, round(r.adjusted, 6), r.tagged, r.place) for r in found.collect()} == all_pairs(queries, chunks, 3)
    sizes = {int(r[0]): int(r[2]) for r in index.rings}
    pairs = [0, 0, 0]
    for r in read.collect():
        pairs[r["round"]] += r.queries * sizes[r.ring]
    assert sum(pairs) < 0.25 * len(chunks) * len(queries)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_few_or_no_vectors(spark):
    none, two = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], SCHEMA)
    assert top_k(two, none, 2).count() == 0 and top_k(none, two, 2).count() == 0
    assert [(r.query_id, r.chunk_id) for r in top_k(two, two, 5).orderBy("query_id", "place").collect()] == [(1, 1), (1, 2), (2, 2), (2, 1)]
    nowhere = spark.createDataFrame([(3, [0.0, 0.0], 1)], SCHEMA)
    assert [(r.chunk_id, r.distance) for r in top_k(nowhere, two, 1).collect()] == [(1, 1.0)]
    assert [(r.chunk_id, r.distance) for r in top_k(two.where("id = 1"), nowhere, 1).collect()] == [(3, 1.0)]


def test_a_query_is_sent_once_to_a_slot(spark, monkeypatch):
    """Vectors without structure and a large group of copies, over many slots: as many copies of a query as slots, not as rings."""
    monkeypatch.setattr("demandlens.operators.ball_index.PAGE_BYTES", 64 * 8 * 8)
    rng = np.random.default_rng(7)
    chunks = [(i, [float(np.float32(x)) for x in (rng.normal(size=8) if i % 3 else np.ones(8))], i % 5) for i in range(900)]
    queries = [(i, v, s) for i, v, s in chunks if i % 20 == 0]
    df = spark.createDataFrame(chunks, SCHEMA)
    index = BallIndex.build(df, df.selectExpr("id AS chunk_id", "skill_id"))
    found, read = index.search(spark.createDataFrame(queries, SCHEMA), 5, 0.15)
    assert {(r.query_id, r.chunk_id, round(r.adjusted, 6), r.tagged, r.place) for r in found.collect()} == all_pairs(queries, chunks, 5, 0.15, {i: {s} for i, _, s in chunks})
    slots = int(index.rings[:, 6].max()) + 1
    assert 10 < slots < len(index.rings) / 2 and (index.rings[:, 6] - index.rings[:, 5]).max() > 1
    asked = index._chosen(
        spark.createDataFrame([(i, np.array(v).tobytes(), s, None, None) for i, v, s in queries], "id long, vector binary, skill long, limit double, done array<int>"), 5, 0.15, True
    ).selectExpr("id", "vector", "skill", "limit", "now AS done", "cast(null AS array<int>) AS now")
    sent = sum(len(r.queries) for r in index._packs(asked, 0.15).collect())
    assert len(queries) < sent <= len(queries) * slots
    assert read.where("round = 2").selectExpr("sum(queries)").first()[0] > 2 * sent
