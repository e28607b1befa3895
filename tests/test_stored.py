"""Published versions, tables in buckets, and budgets of whole runs."""

import decimal
import glob
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from demandlens.operators import changes
from demandlens.sources.buckets import BucketedTable
from demandlens.sources.versions import VersionConflict, VersionedTables, bump_evidence


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_of_two_writers_one_fails_and_readers_keep_their_version(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path))
    assert tables.current().number == 0
    first = tables.publish({"a": spark.range(3), "b": spark.range(1)}, tables.current())
    one, other = tables.current(), tables.current()
    tables.publish({"a": spark.range(5)}, one, "one")
    assert ids(first.read("a")) == ids(other.read("a")) == [0, 1, 2]
    with pytest.raises(VersionConflict):
        tables.publish({"a": spark.range(9)}, other)
    last = tables.current()
    assert (last.number, last.reason, ids(last.read("a")), ids(last.read("b"))) == (2, "one", [0, 1, 2, 3, 4], [0])
    # a writer that is beaten after it has written
    stale = tables.version(2)
    tables._create(tables._manifest(3), '{"version": 3, "tables": {}}')
    tables.current = lambda: stale
    with pytest.raises(VersionConflict):
        tables.publish({"a": spark.range(9)}, stale)
    del tables.current
    assert tables.current().number == 3


def test_a_failed_writer_leaves_the_version(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path))
    first = tables.publish({"a": spark.range(3), "b": spark.range(3)}, tables.current())
    broken = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        tables.publish({"a": spark.range(7), "b": broken}, first)
    now = tables.current()
    assert now.number == 1 and ids(now.read("a")) == ids(now.read("b")) == [0, 1, 2]
    assert tables.publish({"a": spark.range(7)}, now).number == 2


def test_evidence_and_matches_change_together(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path))
    matches = spark.createDataFrame([(1, 10, False), (2, 11, False), (3, 10, True)], "id int, posting_id int, is_stale boolean")
    postings = spark.createDataFrame([(10, None), (11, "2026")], "id int, inactive_at string")
    first = tables.publish({"evidence": spark.range(1).selectExpr("4L AS version", "'x' AS reason"), "matches": matches}, tables.current())
    same = spark.createDataFrame([("unchanged",)], "action string")
    assert bump_evidence(tables, first, same, postings, "none") is first
    next_ = bump_evidence(tables, first, same.union(spark.createDataFrame([("update",)], "action string")), postings, "new")
    assert next_.read("evidence").first() == (5, "new")
    assert sorted(map(tuple, next_.read("matches").collect())) == [(1, 10, True), (2, 11, False), (3, 10, True)]


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS key", "id % 3 AS v")
    made = BucketedTable(spark, f"t_{uuid.uuid4().hex}", ["key"], 8).create(rows, f"{tmp_path}/t")
    yield made
    spark.sql(f"DROP TABLE {made.name}")


def files(tmp_path):
    return {os.path.relpath(f, tmp_path): os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/t/bucket=*/*.parquet")}


def upsert(old, new):
    both = old.alias("o").join(new.alias("n"), "key", "full_outer")
    return both.select("key", F.coalesce("n.v", "o.v").alias("v"))


def test_only_touched_buckets_are_rewritten(spark, tmp_path, table):
    before = files(tmp_path)
    assert len(before) == 8
    new = spark.createDataFrame([(7, 100), (1000, 101)], "key long, v long")
    touched = table.merge(new, upsert)
    assert 1 <= len(touched) <= 2
    after = files(tmp_path)
    kept = {f for f in before if after.get(f) == before[f]}
    assert {f.split("bucket=")[1].split("/")[0] for f in before if f not in kept} == set(map(str, touched)) and len(kept) == 8 - len(touched)
    got = {r.key: r.v for r in table.read().collect()}
    assert got == {**{i: i % 3 for i in range(400)}, 7: 100, 1000: 101}
    assert table.merge(new.limit(0), upsert) == []
    assert table.merge(new.limit(1), lambda old, n: old.where("key < 200"), every=True) == list(range(8))
    assert ids(table.read().select("key")) == list(range(200))


def test_the_stored_side_is_not_shuffled(spark, table):
    new = spark.range(5).selectExpr("id AS key", "9L AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = upsert(table.read(table.touched(new)).drop("bucket"), new)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    stored = plan[plan.index("FileScan") - 400 : plan.index("FileScan")]
    assert "Exchange" not in stored


def in_order(rows, budget):
    """A plain loop over each run."""
    kept, spent = [], {}
    for run, place, cost in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        before = spent.get(run, decimal.Decimal(0))
        if before <= budget:
            kept.append((run, place, before))
        spent[run] = before + decimal.Decimal(repr(cost or 0))
    return sorted(kept, key=str)


def test_run_budget_is_a_plain_loop(spark):
    rng = random.Random(3)
    for run in (["run"], []):
        rows = [(rng.choice(["a", "a", "a", None]) if run else "a", i, rng.choice([0.1, 0.25, 0.0, None, 3.5])) for i in range(3000)]
        df = spark.createDataFrame(rows, "run string, place int, cost double").repartition(7)
        for budget in (0, 0.3, 40, 5000):
            got = changes.run_budget(df, budget, ["place"], "cost", run).collect()
            assert sorted(((r.run, r.place, r.spent) for r in got), key=lambda r: str((r[0], r[1], decimal.Decimal(0)))) == sorted(in_order(rows, decimal.Decimal(repr(budget))), key=lambda r: str((r[0], r[1], decimal.Decimal(0))))
    plan = changes.run_budget(df, 5, ["place"], "cost")
    assert plan.columns == ["run", "place", "cost", "spent"]
