"""The spool: exactly one copy of every message, and nothing of a failed write."""

import os

import pytest
from pyspark.sql import functions as F

from demandlens.sources import spool
from demandlens.streaming import work


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(spool.SpoolSource)
    return str(tmp_path / "spool")


def read(spark, folder):
    return spark.read.format("spool").load(folder)


def test_messages_come_back_once(spark, folder):
    rows = spark.range(3000).select("id", F.concat(F.lit('{"posting_id": 1, "x": "é\n'), F.repeat(F.lit("y"), (F.col("id") % 50).cast("int")), F.lit('"}')).alias("payload"))
    rows.repartition(7).write.format("spool").mode("append").save(folder)
    rows.limit(5).write.format("spool").mode("append").save(folder)
    got = read(spark, folder)
    assert got.count() == 3005 and got.select("payload").exceptAll(rows.unionByName(rows.limit(5)).select("payload")).count() == 0
    rows.where("id < 3").write.format("spool").mode("overwrite").save(folder)
    assert sorted(r.id for r in read(spark, folder).collect()) == [0, 1, 2]
    rows.limit(0).write.format("spool").mode("append").save(folder)
    assert read(spark, folder).count() == read(spark, f"file:{folder}").count() == read(spark, f"file://{folder}").count() == 3


def test_parts_are_cut_at_lines(spark, folder):
    rows = spark.range(500).selectExpr("id", "repeat('z', cast(id % 9 AS int)) AS payload").coalesce(1)
    rows.write.format("spool").mode("append").save(folder)
    before = spool.PART
    try:
        for size in (1, 7, 64, 1000):
            spool.PART = size
            reader = spool.SpoolReader(folder, rows.schema)
            got = [r for p in reader.partitions() for r in reader.read(p)]
            assert sorted(got) == sorted(map(tuple, rows.collect()))
    finally:
        spool.PART = before


def test_a_failed_task_leaves_nothing(spark, folder):
    good = spark.range(10).selectExpr("id", "'a' AS payload")
    good.write.format("spool").mode("append").save(folder)
    files = sorted(os.listdir(f"{folder}/data"))
    bad = spark.range(400).select("id", F.when(F.col("id") < 390, F.lit("b")).otherwise(F.raise_error(F.lit("lost")).cast("string")).alias("payload"))
    with pytest.raises(Exception, match="lost"):
        bad.coalesce(1).write.format("spool").mode("append").save(folder)
    assert read(spark, folder).count() == 10 and sorted(os.listdir(f"{folder}/data")) == files
    with pytest.raises(Exception, match="lost"):  # other tasks may have ended before, or be killed
        bad.repartition(4).write.format("spool").mode("append").save(folder)
    assert read(spark, folder).count() == 10 and len(os.listdir(f"{folder}/_published")) == 1


def test_dead_letters_and_payloads_pass_through(spark, folder):
    messages = spark.createDataFrame([(1, '{"posting_id": 5}'), (2, "nope"), (3, '{"url": "x"}')], "id long, payload string")
    messages.write.format("spool").mode("append").save(folder)
    good, bad = work.decoded(read(spark, folder))
    bad.write.format("spool").mode("append").save(f"{folder}-dead")
    dead = spark.read.format("spool").schema("id bigint, payload string, reason string").load(f"{folder}-dead")
    assert [r.id for r in good.collect()] == [1] and sorted((r.id, r.reason) for r in dead.collect()) == [(2, "undecodable"), (3, "undecodable")]
