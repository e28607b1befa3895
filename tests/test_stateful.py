"""Retries with typed state: order of arrival, restarts, and health from the state."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from demandlens.streaming import stateful, work

SCHEMA = "message_id long, at timestamp, id long, outcome string"


def rows(seed, n=400):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(rng.randint(0, 79), start + dt.timedelta(seconds=rng.randint(0, 5000)), i, rng.choice(["failed", "failed", "failed", "ok", "permanent"])) for i in range(n)]


def shown(df):
    return sorted((r.message_id, r.state, r.attempts, r.reason) for r in df.select("message_id", "state", "attempts", "reason").collect())


def test_any_order_and_a_restart_in_between(spark, tmp_path):
    made = rows(1)
    folder, source = str(tmp_path / "query"), str(tmp_path / "in")
    written = []
    stop = lambda df, batch: written.append((batch, df.count()))
    for part in (made[200:], made[:200], made[:50]):  # late ones, and some again
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = work.table_stream(spark, source)
        stateful.run_retries(stream, folder, stop).awaitTermination()
    assert len(written) >= 3
    want = work.retry_split(spark.createDataFrame(made, SCHEMA))
    assert shown(stateful.state_of(spark, folder)) == shown(want)
    health = stateful.state_health(spark, folder).first()
    counts = {r.state: r["count"] for r in want.groupBy("state").count().collect()}
    assert (health.depth, health.pending, health.done, health.dead_letters) == (want.count(), counts.get("pending", 0), counts.get("done", 0), counts.get("dead", 0))
    pending = {r.message_id for r in want.where("state = 'pending'").collect()}
    assert health.oldest_pending == min((max(at for m, at, *_ in made if m == p) for p in pending), default=None)


def test_incomplete_attempts_are_left_out(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, None, 1, "ok"), (None, dt.datetime(2024, 1, 1), 2, "ok"), (2, dt.datetime(2024, 1, 1), 3, "failed")], SCHEMA).write.parquet(source)
    stateful.run_retries(work.table_stream(spark, source), str(tmp_path / "q"), work.batch_folder(str(tmp_path / "out"))).awaitTermination()
    assert shown(stateful.state_of(spark, str(tmp_path / "q"))) == [(2, "pending", 1, None)]
    assert spark.read.parquet(str(tmp_path / "out")).select(F.count("*")).first()[0] == 1


def in_parts(spark, tmp_path, made, run):
    """Three runs over attempts in order of time; what the batch form has for them."""
    source = str(tmp_path / "in")
    made = sorted(made, key=lambda r: (r[1], r[2]))
    for part in (made[:150], made[150:151], made[151:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run(work.table_stream(spark, source))
    return work.retry_split(spark.createDataFrame(made, SCHEMA))


def test_neighbouring_messages_share_a_key_of_state(spark, tmp_path):
    made = rows(2) + [(-5, dt.datetime(2024, 1, 1), 9001, "ok"), (-5, dt.datetime(2024, 1, 2), 9002, "ok"), (1 << 60, dt.datetime(2024, 1, 1), 9003, "failed")]
    folder, out = str(tmp_path / "typed"), str(tmp_path / "out")
    want = in_parts(spark, tmp_path / "a", made, lambda s: stateful.run_retries(s, folder, work.batch_folder(out)).awaitTermination())
    assert shown(stateful.state_of(spark, folder)) == shown(want)
    read = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "progress").load()
    assert read.count() == 3  # ids below 0, the 80 from 0, the large one: before, one key a message
    assert spark.read.parquet(f"{out}/batch=1").count() == 1


def test_stream_of_retries_by_ranges(spark, tmp_path):
    made = rows(3) + [(None, dt.datetime(2024, 1, 1), 9001, "failed"), (None, dt.datetime(2024, 1, 2), 9002, "ok"), (-5, dt.datetime(2024, 1, 1), 9003, "ok"), (1 << 60, dt.datetime(2024, 1, 1), 9004, "failed")]
    folder, out = str(tmp_path / "keyed"), str(tmp_path / "out")
    want = in_parts(spark, tmp_path / "a", made, lambda s: work.run_once(work.retry_stream(s, width=16), folder, work.batch_folder(out), "update").awaitTermination())
    last = spark.read.parquet(out).groupBy("message_id").agg(F.max_by(F.struct("state", "attempts", "reason"), "batch").alias("s")).select("message_id", "s.*")
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, last.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    ranges = spark.read.format("statestore").option("path", f"{folder}/checkpoint").load().count()
    assert ranges == 8  # 5 of 16 ids, that below 0, the large one and the null


def test_typed_state_goes_after_its_time(spark, tmp_path):
    source, folder, seen = str(tmp_path / "in"), str(tmp_path / "q"), []
    start = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, start, 1, "failed"), (2, start, 2, "ok")], SCHEMA).coalesce(1).write.parquet(source)
    with stateful.state_store(spark):
        states = stateful.retry_states(work.table_stream(spark, source), keep_seconds=2)
        query = states.writeStream.outputMode("update").foreachBatch(lambda d, b: seen.extend(d.collect())).option("checkpointLocation", f"{folder}/checkpoint").start()
    end = time.time() + 60
    while len(seen) < 2 and time.time() < end:
        time.sleep(0.5)
    time.sleep(3)
    query.stop()
    assert sorted(map(tuple, seen)) == [(1, "pending", 1, None), (2, "done", 1, None)]
    assert shown(stateful.state_of(spark, folder)) == []
