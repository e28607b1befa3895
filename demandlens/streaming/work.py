"""Work messages: decoding, retries, dead letters, reclaiming, failure runs and incremental counts.

Each job has a batch form over a table of the same rows; the streaming forms keep their state in Spark's state store and write idempotently.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

JOB = "posting_id bigint, canonical_key string, url string, company string, title string, jd_sha256 string, adapter string, char_count bigint"


def decoded(messages: DataFrame, schema: str = JOB, required: str = "posting_id") -> tuple[DataFrame, DataFrame]:
    """Messages (id, payload) with their fields, and those that can't be read or lack the required one, with a reason. Works on streams and tables."""
    read = messages.withColumn("job", F.from_json("payload", schema))
    ok = F.col(f"job.{required}").isNotNull()
    bad = read.where(~F.coalesce(ok, F.lit(False))).select("id", "payload", F.lit("undecodable").alias("reason"))
    return read.where(ok).select("id", "job.*"), bad


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream of files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(path.rpartition("/")[0])
    return reader.parquet(path)


def run_once(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Processes what is there and ends. A batch is acknowledged after ``write`` returned; a repeated one gets the same number."""
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that replaces its batch's folder: processing a batch again changes nothing."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def retry_split(attempts: DataFrame, most: int = 3) -> DataFrame:
    """State of each message after its attempts (message_id, at, id, outcome: ok, failed or permanent): done, pending or dead with
    number of attempts and reason. A success ends it, a permanent failure kills it at once, ``most`` failures do as well; what comes after counts for nothing."""
    order = Window.partitionBy("message_id").orderBy("at", "id")
    numbered = attempts.withColumn("n", F.row_number().over(order))
    ends = F.when(F.col("outcome") == "ok", "done").when(F.col("outcome") == "permanent", "dead").when(F.col("n") >= most, "dead")
    first = F.min(F.when(ends.isNotNull(), F.struct("n", ends.alias("state"), "outcome")))
    folded = numbered.groupBy("message_id").agg(first.alias("end"), F.max("n").alias("all"))
    reason = F.when(F.col("end.state") == "dead", F.when(F.col("end.outcome") == "permanent", "permanent").otherwise("attempts"))
    return folded.select("message_id", F.coalesce("end.state", F.lit("pending")).alias("state"), F.coalesce("end.n", "all").cast("long").alias("attempts"), reason.alias("reason"))


def _timeout(keep_seconds: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if keep_seconds else GroupStateTimeout.NoTimeout


RETRY_OUT = "message_id bigint, state string, attempts bigint, reason string"

#: Messages whose ids lie in one range of this many share a key of state: Python is entered once a range, not once a message.
RANGE = 1024


def message_range(width: int = RANGE) -> Column:
    return F.expr(f"message_id div {width} - if(message_id % {width} < 0, 1, 0)").alias("message_range")


def first_attempts(attempts: pd.DataFrame, most: int) -> pd.DataFrame:
    """Each message's first ``most`` attempts (message_id, at, id, outcome) by (at, id), nulls first."""
    ordered = attempts.sort_values(["message_id", "at", "id"], na_position="first")
    return ordered[ordered.groupby("message_id").cumcount() < most]


def outcomes(ordered: pd.DataFrame, before: pd.Series, most: int) -> pd.DataFrame:
    """message_id, state, attempts and reason after attempts in order, as ``retry_split`` has them; ``before``: attempts that went before each row's message's own."""
    n = before.to_numpy() + ordered.groupby("message_id").cumcount().to_numpy() + 1
    rows = pd.DataFrame({"message_id": ordered["message_id"].to_numpy(), "attempts": n, "outcome": ordered["outcome"].to_numpy()})
    ends = rows["outcome"].isin(["ok", "permanent"]) | (rows["attempts"] >= most)
    rows["state"] = ends.map({True: "dead", False: "pending"}).mask(rows["outcome"] == "ok", "done")
    rows["reason"] = pd.Series(None, rows.index, dtype=object).mask(rows["state"] == "dead", "attempts").mask(rows["outcome"] == "permanent", "permanent")
    # the first that ends a message, else its last
    rest = rows[~rows["message_id"].isin(rows.loc[ends, "message_id"])]
    out = pd.concat([rows[ends].drop_duplicates("message_id"), rest.drop_duplicates("message_id", keep="last")])
    return out[["message_id", "state", "attempts", "reason"]]


def _texts(values: pd.Series) -> list[str | None]:
    return [v if isinstance(v, str) else None for v in values]


def retry_stream(attempts: DataFrame, most: int = 3, keep_seconds: int | None = None, width: int = RANGE) -> DataFrame:
    """The same with keyed state (attempts so far; whether it has ended), one row for each message that changed in a batch.

    A stream without end needs ``keep_seconds``: a message's state goes that long after its last attempt (of processing time), and an
    attempt that comes later still starts anew. Without it state stays, as for a stream that is read once (timers would
    keep such a run from ending). The state of ``width`` neighbouring ids is one row, and of a batch no more than ``most`` attempts a message are held.
    """
    schema = "ids array<bigint>, n array<bigint>, state array<string>, reason array<string>, until array<bigint>"

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # untouched for so long, hence every message of the range
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        known = pd.DataFrame(dict(zip(("message_id", "attempts", "state", "reason", "until"), state.get if state.exists else ([],) * 5)))
        known = known[known["until"] > now] if keep_seconds else known
        new = None
        for part in rows:
            own = part[["message_id", "at", "id", "outcome"]]
            own = own.assign(message_id=0) if pd.isna(key[0]) else own  # messages without an id are one
            new = first_attempts(own if new is None else pd.concat([new, own]), most)
        touched = new["message_id"].unique()
        fixed = known[(known["state"] != "pending") | ~known["message_id"].isin(touched)]
        open_ = new[~new["message_id"].isin(known.loc[known["state"] != "pending", "message_id"])]
        before = open_["message_id"].map(known.set_index("message_id")["attempts"]).fillna(0).astype("int64")
        now_known = pd.concat([fixed, outcomes(open_, before, most)]) if len(fixed) else outcomes(open_, before, most)
        given = now_known["message_id"].isin(touched)
        until = now_known["until"].mask(given, now + keep_seconds * 1000).tolist() if keep_seconds and len(fixed) else [now + (keep_seconds or 0) * 1000] * len(now_known)
        state.update((now_known["message_id"].tolist(), now_known["attempts"].tolist(), now_known["state"].tolist(), _texts(now_known["reason"]), [int(u) for u in until]))
        if keep_seconds:
            state.setTimeoutDuration(keep_seconds * 1000)
        out = now_known.loc[given, ["message_id", "state", "attempts", "reason"]]
        yield out.assign(message_id=pd.array([None], "Int64")) if pd.isna(key[0]) else out

    return attempts.withColumn("message_range", message_range(width)).groupBy("message_range").applyInPandasWithState(step, RETRY_OUT, schema, "update", _timeout(keep_seconds))


RECLAIM_OUT = "message_id bigint, claims bigint"


def reclaim_stream(messages: DataFrame, timeout_seconds: float, late: str = "0 seconds") -> DataFrame:
    """message_id and number of claims of messages that were claimed and neither finished nor claimed again for as long as the
    visibility timeout, by the time of the log.

    messages: message_id, at, finished. A claim sets the message's timer, an end removes its state; when the stream's time has
    passed the timer, the message is given out once and its state goes, so that state holds only what is being worked on.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        claims, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], claims)], columns=["message_id", "claims"])
            return
        ended = False
        for part in rows:
            done = part["finished"].astype(bool)
            claims += int((~done).sum())
            ended |= bool(done.any())
            last = max(last, int(part["at"].max().value // 1_000_000))
        if not ended:
            state.update((claims, last))
            state.setTimeoutTimestamp(max(last + int(timeout_seconds * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    timed = messages.withWatermark("at", late)
    return timed.groupBy("message_id").applyInPandasWithState(step, RECLAIM_OUT, "claims bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def reclaimable(claims: DataFrame, finished: DataFrame, now: Column, timeout_seconds: int) -> DataFrame:
    """Messages claimed longer ago than the visibility timeout and not finished, by their last claim."""
    last = claims.groupBy("message_id").agg(F.max("at").alias("claimed_at"), F.count(F.lit(1)).alias("claims"))
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("claimed_at").cast("timestamp"))
    return last.join(finished.select("message_id").distinct(), "message_id", "left_anti").where(idle > timeout_seconds * 1_000_000)


def queue_health(states: DataFrame, now: Column) -> DataFrame:
    """One row: messages, pending and dead ones, consumers, and seconds since the oldest pending one."""
    oldest = F.min(F.when(F.col("state") == "pending", F.col("at")))
    return states.agg(
        F.count(F.lit(1)).alias("depth"), F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(F.col("state") == "dead").alias("dead_letters"), F.countDistinct("consumer").alias("consumers"),
        F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(oldest.cast("timestamp"))) / 1e6).alias("oldest_pending_seconds"),
    )


def failure_islands(log: DataFrame, key: str, least: int = 5) -> DataFrame:
    """Runs of at least ``least`` failures of a key in a row: start, end and length."""
    order = Window.partitionBy(key).orderBy("at", "id")
    runs = log.withColumn("run", F.sum(F.when(~F.col("failed"), 1).otherwise(0)).over(order)).where("failed")
    return runs.groupBy(key, "run").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("run")


class Breaker:
    """closed; open after ``most`` failures in a row; after ``cooldown`` seconds one trial, whose failure opens it again."""

    def __init__(self, most: int = 5, cooldown: float = 300.0, state: tuple = ("closed", 0, 0.0)):
        self.most, self.cooldown = most, cooldown
        self.kind, self.failures, self.opened = state

    @property
    def state(self) -> tuple:
        return self.kind, self.failures, self.opened

    def see(self, at: float, failed: bool) -> str:
        """What becomes of a request: 'refused' while open, else the breaker's state after it."""
        if self.kind == "open":
            if at - self.opened < self.cooldown:
                return "refused"
            self.kind = "trial"
        if not failed:
            self.kind, self.failures = "closed", 0
        else:
            self.failures += 1
            if self.kind == "trial" or self.failures >= self.most:
                self.kind, self.opened = "open", at
        return self.kind


def breaker_states(log: DataFrame, key: str, most: int = 5, cooldown: float = 300.0) -> DataFrame:
    """id, key and result of each logged request (at in seconds). A key's rows come in order of time; a task holds one breaker at a time, no group of rows."""
    kind = log.schema[key].dataType.simpleString()
    ordered = log.select("id", key, F.col("at").cast("double").alias("at"), "failed").repartition(key).sortWithinPartitions(key, "at", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, breaker = None, None
        for batch in batches:
            out = []
            for k, at, failed in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if breaker is None or k != now:
                    now, breaker = k, Breaker(most, cooldown)
                out.append(breaker.see(at, failed))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", key, "result"])

    return ordered.mapInArrow(run, f"id long, `{key}` {kind}, result string")


def breaker_stream(log: DataFrame, key: str, most: int = 5, cooldown: float = 300.0, keep_seconds: int | None = None) -> DataFrame:
    """The same over a stream, the breaker being the key's state, which goes ``keep_seconds`` after its last request where
    that is given (see retry_stream). A breaker is a sequence: the requests that a batch has for one host are sorted and seen in one place."""
    kind = log.schema[key].dataType.simpleString()

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        breaker = Breaker(most, cooldown, state.get if state.exists else ("closed", 0, 0.0))
        own = pd.concat(list(rows)).sort_values(["at", "id"])
        results = [breaker.see(float(a), bool(f)) for a, f in zip(own["at"], own["failed"])]
        state.update(breaker.state)
        if keep_seconds:
            state.setTimeoutDuration(keep_seconds * 1000)
        yield pd.DataFrame({"id": own["id"].to_numpy(), key: k[0], "result": results})

    return log.groupBy(key).applyInPandasWithState(step, f"id long, `{key}` {kind}, result string", "kind string, failures bigint, opened double", "append", _timeout(keep_seconds))


def hand_off(resolved: DataFrame, done: DataFrame) -> DataFrame:
    """Payloads for the next stage of what isn't done yet; ``resolved`` may be a stream, ``done`` is a table."""
    return resolved.join(done.select("posting_id").distinct(), "posting_id", "left_anti").select(F.to_json(F.struct("posting_id", "jd_sha256", "adapter", "char_count")).alias("payload"))


def weekly_counts(events: DataFrame, at: str, key: str, late: str = "7 days") -> DataFrame:
    """Tumbling weekly counts by key; on a stream rows later than ``late`` are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, "7 days").alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("week"), key, "n")
