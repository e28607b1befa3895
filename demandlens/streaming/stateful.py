"""Retries with typed state: out-of-order attempts, time to live, and the health of a queue read from the running query's own state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .work import RANGE, RETRY_OUT, first_attempts, message_range, outcomes, run_once

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_PROGRESS = ("message_id", "state", "attempts", "reason", "last", "until")
_FIRST = ("message_id", "at", "id", "outcome")


class Retries(StatefulProcessor):
    """Of each message of a range of ids its first ``most`` attempts by (at, id), whatever order they come in, and what follows
    from them, in one value state: an attempt that arrives late takes its place among them and may change the outcome.

    The arrays of ``of`` have an entry a message, those of ``first`` one an attempt; times are microseconds. A message that nothing
    has changed for ``keep_seconds`` counts no more; it leaves the state when its range is touched, or with it.
    """

    def __init__(self, most: int, keep_seconds: int | None):
        self.most, self.keep = most, keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        of = "struct<message_id: array<bigint>, state: array<string>, attempts: array<bigint>, reason: array<string>, last: array<bigint>, until: array<bigint>>"
        first = "struct<message_id: array<bigint>, at: array<bigint>, id: array<bigint>, outcome: array<string>>"
        self.progress = handle.getValueState("progress", f"of {of}, first {first}", ttlDurationMs=self.keep * 1000 if self.keep else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentProcessingTimeInMs()) if self.keep else 0
        of, first = self.progress.get() if self.progress.exists() else (([],) * 6, ([],) * 4)
        of, first = pd.DataFrame(dict(zip(_PROGRESS, of))), pd.DataFrame(dict(zip(_FIRST, first)))
        if self.keep:
            of = of[of["until"] > now]
            first = first[first["message_id"].isin(of["message_id"])]
        latest = [of[["message_id", "last"]]] if len(of) else []
        touched = []
        for part in rows:  # a part at a time, so that any number of rows takes bounded memory
            own = part[list(_FIRST)]
            # a batch that is given again repeats attempts: ids tell them apart
            every = (pd.concat([first, own]) if len(first) else own).drop_duplicates(["message_id", "id"], keep="last")
            first = first_attempts(every, self.most)
            latest = [pd.concat([*latest, own.rename(columns={"at": "last"})[["message_id", "last"]]]).groupby("message_id", as_index=False)["last"].max()]
            touched = pd.unique(pd.concat([pd.Series(touched, dtype="int64"), own["message_id"]]))
        made = outcomes(first, pd.Series(0, first.index), self.most).merge(latest[0], on="message_id")
        given = made["message_id"].isin(touched)
        until = made["message_id"].map(of.set_index("message_id")["until"]).mask(given, now + self.keep * 1000) if self.keep else pd.Series(0, made.index)
        columns = [made["message_id"].tolist(), made["state"].tolist(), made["attempts"].tolist(), [r if isinstance(r, str) else None for r in made["reason"]], made["last"].tolist(), until.astype("int64").tolist()]
        self.progress.update((tuple(columns), tuple(first[c].tolist() for c in _FIRST)))
        yield made.loc[given, ["message_id", "state", "attempts", "reason"]]

    def close(self) -> None:
        pass


def retry_states(attempts: DataFrame, most: int = 3, keep_seconds: int | None = None, width: int = RANGE) -> DataFrame:
    """Attempts (message_id, at, id, outcome: ok, failed or permanent) as the state of each message that changed in a batch.

    As ``work.retry_split``, for attempts in any order. State keeps ``most`` attempts a message and, with
    ``keep_seconds``, goes so long after the last change; ``width`` neighbouring ids share a key. Null ids, times and outcomes are left out.
    """
    known = attempts.where("message_id IS NOT NULL AND at IS NOT NULL AND id IS NOT NULL AND outcome IS NOT NULL").select(message_range(width), "message_id", F.unix_micros("at").alias("at"), F.col("id").cast("long").alias("id"), "outcome")
    return known.groupBy("message_range").transformWithStateInPandas(Retries(most, keep_seconds), RETRY_OUT, "Update", "ProcessingTime" if keep_seconds else "None")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Starts queries with the state store that typed state needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_retries(attempts: DataFrame, folder: str, write: Callable[[DataFrame, int], None], most: int = 3, keep_seconds: int | None = None) -> StreamingQuery:
    """Processes what is there of a stream of attempts and ends; the state stays in ``folder`` for the next run."""
    with state_store(attempts.sparkSession):
        return run_once(retry_states(attempts, most, keep_seconds), folder, write, "update")


def state_of(spark: SparkSession, folder: str) -> DataFrame:
    """message_id, state, attempts, reason and last (attempt's time) of every message, from the query's last committed state;
    the query may be running."""
    read = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "progress").load()
    value = "value.value" if "ttlExpirationMs" in read.schema["value"].dataType.names else "value"  # with a time to live it has one more level
    own = read.select(F.inline(F.arrays_zip(*(F.col(f"{value}.of.{c}").alias(c) for c in _PROGRESS))))
    kept = own.where("until = 0 OR until > unix_millis(current_timestamp())")
    return kept.select("message_id", "state", "attempts", "reason", F.timestamp_micros("last").alias("last"))


def state_health(spark: SparkSession, folder: str) -> DataFrame:
    """One row, from the state: messages, pending, done and dead ones, and the time of the oldest pending one's last attempt."""
    own = state_of(spark, folder)
    of = lambda s: F.count_if(F.col("state") == s)
    return own.agg(F.count(F.lit(1)).alias("depth"), of("pending").alias("pending"), of("done").alias("done"), of("dead").alias("dead_letters"), F.min(F.when(F.col("state") == "pending", F.col("last"))).alias("oldest_pending"))
