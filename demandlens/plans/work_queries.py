"""Scans, sinks, work queues and streams (A, I, J3, L13)."""

import datetime as dt

from pyspark.sql import functions as F

from ..config import ReportConfig
from ..operators import demand, joins, ranking
from ..shared import shared_folder
from ..sources import documents as docs
from ..sources import feed, json_array, sinks, spool
from ..streaming import stateful, work
from .registry import query

_RAW = "to_json(named_struct('id', CASE WHEN c_custkey % 5 <> 0 THEN concat('k', c_custkey) ELSE '' END, 'company_name', c_name, 'title', CASE WHEN c_custkey % 17 <> 0 THEN 'Engineer, Summer 2027' ELSE '' END, 'url', concat('https://www.x.example.com/', c_custkey, '/'), 'category', 'Software', 'active', c_custkey % 3 <> 0, 'date_posted', 1700000000 + c_custkey, 'locations', array('Remote in USA', ' ')))"


@query("a1_feed_scan", "SELECT 'file' || (c_custkey // 64) AS path, count(*) AS n, CAST(max(c_custkey % 64) AS INT) AS last FROM customer GROUP BY 1")
def a1(t):
    """The customers as JSON arrays of 64, read as feed files."""
    row = t.read("customer").selectExpr("c_custkey", f"{_RAW} AS raw")
    files = row.groupBy((F.floor(F.col("c_custkey") / 64)).alias("g")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "raw"))), lambda x: x["raw"]), ","), F.lit("]")).alias("body"))
    elements = feed.feed_elements(files.select(F.concat(F.lit("file"), "g").alias("path"), F.col("body").cast("binary").alias("content")))
    return elements.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))


@query(
    "a1_split_scan",
    "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey // 4096 ORDER BY c_custkey) - 1 AS BIGINT) AS pos, 'Engineer, [\"{' || c_name AS title FROM customer",
)
def a1_split(t):
    """The customers as files of one array of up to 4,096 each, written out and read back in byte ranges."""
    title = "concat('Engineer, [\"{', c_name)"
    row = t.read("customer").selectExpr("c_custkey", "floor(c_custkey / 4096) AS g", f"to_json(named_struct('key', c_custkey, 'title', {title}, 'locations', array('a, b', '}}]'), 'more', named_struct('x', array(1, 2)))) AS raw")
    body = F.concat(F.lit(" [\n "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "raw"))), lambda x: x["raw"]), " ,\n "), F.lit("\n]\n"))
    folder = shared_folder(t.spark, "feeds")
    row.groupBy("g").agg(body.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return json_array.read_json_array(t.spark, folder).select(F.expr("variant_get(element, '$.key', 'bigint')").alias("c_custkey"), "pos", F.expr("variant_get(element, '$.title', 'string')").alias("title"))


def _elements(t):
    return feed.lines_as_elements(t.read("customer").selectExpr("c_custkey AS pos", f"CASE WHEN c_custkey % 23 = 0 THEN '\"no object\"' ELSE {_RAW} END AS line"), "line")


@query(
    "a2_feed_records",
    """SELECT c_custkey AS pos, CASE WHEN c_custkey % 5 <> 0 THEN 'k' || c_custkey ELSE sha256(trim(regexp_replace(lower(c_name), '[^0-9a-z]+', ' ', 'g')) || 'engineer summer 2027' || 'x.example.com' || '/' || c_custkey) END AS canonical_key,
         'x.example.com' AS url_host, 'swe' AS role_type, 'Summer 2027' AS start_season, true AS is_remote, c_custkey % 3 <> 0 AS active FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 23 <> 0""",
)
def a2(t):
    return feed.map_feed_records(_elements(t), ascii_only=True)[0].select("pos", "canonical_key", "url_host", "role_type", "start_season", "is_remote", "active")


@query("a2_feed_quarantine", "SELECT c_custkey AS pos FROM customer WHERE c_custkey % 17 = 0 OR c_custkey % 23 = 0")
def a2_bad(t):
    return feed.map_feed_records(_elements(t), ascii_only=True)[1].select("pos")


def _files(t):
    path = "concat('file:/corpus/', CASE doc_id % 5 WHEN 0 THEN '.git/' WHEN 1 THEN 'vendor/' ELSE '' END, source, '/', doc_id, CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.MDX' ELSE '.txt' END)"
    return t.read("documents").select(F.expr(path).alias("path"), F.col("text").cast("binary").alias("content"))


_MARKDOWN = "SELECT 'markdown' AS source_type, source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' ELSE '.MDX' END AS source_ref, length(text) AS n FROM documents WHERE doc_id % 5 > 1 AND doc_id % 3 < 2 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''"


@query("a3_markdown_scan", _MARKDOWN)
def a3(t):
    return docs.markdown_records(_files(t), "/corpus").select("source_type", "source_ref", F.length("text").cast("long").alias("n"))


@query("a4_source_union", f"SELECT source_type, count(*) AS n FROM ({_MARKDOWN} UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), 1 FROM pages) GROUP BY source_type")
def a4(t):
    pages = t.read("pages").select(F.lit("page").alias("source_type"), F.col("page_id").cast("string").alias("source_ref"), F.col("html").alias("text"))
    every, scanned = docs.union_sources(docs.markdown_records(_files(t), "/corpus"), pages)
    return every.groupBy("source_type").agg(F.count(F.lit(1)).alias("n")).join(scanned, "source_type", "left_semi")


@query("a7_metric_rows", "SELECT 'run-9' AS run_id, 'ingest' AS stage, metric, value FROM (SELECT host, count(*) AS n, count(*) FILTER (error IS NOT NULL) AS timeouts FROM fetch_log GROUP BY host) UNPIVOT (value FOR metric IN (n, timeouts))")
def a7(t):
    per_host = t.fetch_log.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("timeouts"))
    return sinks.metric_rows(per_host, "run-9", "ingest", ["n", "timeouts"], {"source": "log"}).select("run_id", "stage", "metric", F.col("value").cast("long").alias("value"))


@query("a7_metrics_appended", "SELECT event_type AS stage, count(*) AS value FROM events GROUP BY 1")
def a7_written(t):
    """Metrics written in two runs and read back."""
    folder = shared_folder(t.spark, "metrics")
    counts = t.read("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    for run, own in (("run-1", "event_type < 'm'"), ("run-2", "event_type >= 'm'")):
        sinks.append_metrics(sinks.metric_rows(counts.where(own), run, F.col("event_type"), ["n"]), folder)
    return t.spark.read.parquet(folder).select("stage", F.col("value").cast("long").alias("value"))


@query("a8_report_json", """SELECT CAST(to_json({'skill_id': skill_id, 'n': n, 'share': round(n / 7.0, 4)}) AS VARCHAR) AS value FROM (SELECT skill_id, count(*) AS n FROM requirement WHERE skill_id IS NOT NULL GROUP BY 1) WHERE n % 7 = 0""")
def a8(t):
    counts = t.requirement.where("skill_id is not null").groupBy("skill_id").agg(F.count(F.lit(1)).alias("n")).where("n % 7 = 0").withColumn("share", F.col("n") / 7)
    return sinks.report_json(counts, ["skill_id", "n", "share"])


@query("a8_markdown_table", """SELECT '| name | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || name || ' | ' || n || ' |', chr(10) ORDER BY n DESC, name) AS markdown FROM (SELECT name, count(*) AS n FROM requirement JOIN skill s ON s.id = skill_id GROUP BY name ORDER BY n DESC, name LIMIT 20)""")
def a8_markdown(t):
    counts = t.requirement.join(t.skill.select(F.col("id").alias("skill_id"), "name"), "skill_id").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return sinks.markdown_table(counts, ["name", "n"], [F.desc("n"), F.asc("name")], 20)


@query("a9_job_payload", "SELECT CAST(to_json({'posting_id': p.id, 'company': company, 'title': title}) AS VARCHAR) AS payload FROM posting p LEFT JOIN jd ON jd.posting_id = p.id WHERE inactive_at IS NULL AND fetch_status IS NULL")
def a9(t):
    todo = joins.needs_fetch(t.posting, t.jd).where("fetch_status is null")
    return sinks.to_payload(todo.select(F.col("id").alias("posting_id"), "company", "title"))


@query("a9_spooled_payloads", "SELECT event_id AS id, user_id AS posting_id FROM events WHERE event_type <> 'error'")
def a9_spooled(t):
    """Messages of all events through the spool; those that can't be decoded go on into a second one, as dead letters."""
    folder = shared_folder(t.spark, "spool")
    t.spark.dataSource.register(spool.SpoolSource)
    messages = t.read("events").selectExpr("event_id AS id", "CASE event_type WHEN 'error' THEN 'broken' ELSE to_json(named_struct('posting_id', user_id, 'title', event_type)) END AS payload")
    messages.write.format("spool").mode("append").save(f"{folder}/jobs")
    good, bad = work.decoded(t.spark.read.format("spool").load(f"{folder}/jobs"))
    bad.write.format("spool").mode("append").save(f"{folder}/dead")
    return good.select("id", "posting_id")


@query("j3_adapter_registry", "SELECT CASE WHEN adapter IS NULL THEN 'unknown' ELSE adapter END AS adapter, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(url, '^https?://[^/]*building') THEN 'board_a' WHEN regexp_matches(url, '^https?://[^/]*machinery') THEN 'board_b' ELSE 'fallback' END AS adapter FROM posting) GROUP BY 1")
def j3(t):
    """Another domain is another row of rules, here made from the postings' own hosts."""
    hosts = t.posting.select(F.expr("try_parse_url(url, 'HOST')").alias("domain")).distinct()
    rules = hosts.selectExpr("domain", "CASE WHEN domain like '%building%' THEN 'board_a' WHEN domain like '%machinery%' THEN 'board_b' END AS adapter", "1 AS priority").where("adapter is not null")
    return joins.dispatch(t.posting.select("id", "url"), rules).groupBy("adapter").agg(F.count(F.lit(1)).alias("n"))


def _messages(t):
    return t.read("events").selectExpr("event_id AS id", "CASE WHEN event_id % 19 = 0 THEN 'broken{' WHEN event_id % 23 = 0 THEN '{}' ELSE concat('{\"posting_id\": ', user_id, ', \"adapter\": \"', event_type, '\"}') END AS payload")


@query("i1_decoded", "SELECT event_id AS id, user_id AS posting_id, event_type AS adapter FROM events WHERE event_id % 19 <> 0 AND event_id % 23 <> 0")
def i1(t):
    return work.decoded(_messages(t))[0].select("id", "posting_id", "adapter")


@query("i1_quarantine", "SELECT event_id AS id, 'undecodable' AS reason FROM events WHERE event_id % 19 = 0 OR event_id % 23 = 0")
def i1_bad(t):
    return work.decoded(_messages(t))[1].select("id", "reason")


def _stream(t, name):
    return work.table_stream(t.spark, f"{t.sf_dir}/{name}.parquet")


@query("i2_idempotent_sink", "SELECT event_id AS id, user_id AS posting_id FROM events WHERE event_id % 19 <> 0 AND event_id % 23 <> 0")
def i2(t):
    """The decoded stream in an idempotent sink; the last batch is written twice, as after a lost acknowledgement."""
    folder = shared_folder(t.spark, "decoded")
    stream = _stream(t, "events").selectExpr("event_id AS id", "CASE WHEN event_id % 19 = 0 THEN 'broken{' WHEN event_id % 23 = 0 THEN '{}' ELSE concat('{\"posting_id\": ', user_id, '}') END AS payload")
    sink = work.batch_folder(f"{folder}/out")

    def twice(df, batch):
        sink(df, batch)
        sink(df, batch)

    work.run_once(work.decoded(stream)[0], folder, twice).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("id", "posting_id")


def _attempts(df):
    return df.selectExpr("user_id * 100 + event_id % 100 AS message_id", "event_id AS id", "unix_micros(cast(ts AS timestamp)) AS at", "CASE event_type WHEN 'signup' THEN 'ok' WHEN 'click' THEN 'permanent' ELSE 'failed' END AS outcome")


_RETRY = """SELECT message_id, CASE WHEN stop IS NULL THEN 'pending' WHEN o = 'ok' THEN 'done' ELSE 'dead' END AS state, coalesce(stop, n) AS attempts, CASE WHEN stop IS NOT NULL AND o <> 'ok' THEN CASE WHEN o = 'permanent' THEN 'permanent' ELSE 'attempts' END END AS reason
  FROM (SELECT message_id, min(k) FILTER (o <> 'failed' OR k >= 3) AS stop, arg_min(o, k) FILTER (o <> 'failed' OR k >= 3) AS o, max(k) AS n FROM (
    SELECT user_id * 100 + event_id % 100 AS message_id, CASE event_type WHEN 'signup' THEN 'ok' WHEN 'click' THEN 'permanent' ELSE 'failed' END AS o, row_number() OVER (PARTITION BY user_id * 100 + event_id % 100 ORDER BY ts, event_id) AS k FROM events) GROUP BY message_id)"""


@query("i3_retry_split", _RETRY)
def i3(t):
    return work.retry_split(_attempts(t.read("events")))


@query("i3_retry_stream", _RETRY)
def i3_stream(t):
    folder = shared_folder(t.spark, "retries")
    work.run_once(work.retry_stream(_attempts(_stream(t, "events"))), folder, work.batch_folder(f"{folder}/out"), "update").awaitTermination()
    every = t.spark.read.parquet(f"{folder}/out")
    return every.groupBy("message_id").agg(F.max_by(F.struct("state", "attempts", "reason"), "batch").alias("s")).select("message_id", "s.*")


def _run_states(t):
    """The attempts of all events through typed state; the folder of the query."""
    folder = shared_folder(t.spark, "states")
    stream = _stream(t, "events").selectExpr("user_id * 100 + event_id % 100 AS message_id", "event_id AS id", "cast(ts AS timestamp) AS at", "CASE event_type WHEN 'signup' THEN 'ok' WHEN 'click' THEN 'permanent' ELSE 'failed' END AS outcome")
    stateful.run_retries(stream, folder, work.batch_folder(f"{folder}/out")).awaitTermination()
    return folder


@query("i3_retry_state", _RETRY)
def i3_state(t):
    """The state that a stream with typed state has come to, read from its state store."""
    return stateful.state_of(t.spark, _run_states(t)).drop("last")


@query("i5_state_health", f"SELECT count(*) AS depth, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'dead') AS dead_letters FROM ({_RETRY})")
def i5_state(t):
    return stateful.state_health(t.spark, _run_states(t)).drop("oldest_pending")


@query("i4_reclaim_idle", "SELECT user_id AS message_id, count(*) AS claims FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 5 = 0) GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-29 12:00:00'")
def i4(t):
    e = t.read("events")
    claims = e.where("event_type = 'view'").selectExpr("user_id AS message_id", "ts AS at")
    done = e.where("event_type = 'signup' and event_id % 5 = 0").selectExpr("user_id AS message_id")
    return work.reclaimable(claims, done, F.lit(dt.datetime(2024, 1, 30)), 43200).select("message_id", "claims")


@query("i4_reclaim_stream", """SELECT user_id AS message_id, count(*) AS claims FROM events WHERE event_type IN ('view', 'signup') GROUP BY user_id
  HAVING bool_and(event_type = 'view') AND epoch_ms(max(ts)) + 43200000 < (SELECT epoch_ms(max(ts)) FROM events WHERE event_type IN ('view', 'signup'))""")
def i4_stream(t):
    """Views are claims and signups ends; what is only claimed is given out when the log's time has passed its timer."""
    folder = shared_folder(t.spark, "reclaimed")
    messages = _stream(t, "events").where("event_type in ('view', 'signup')").selectExpr("user_id AS message_id", "cast(ts AS timestamp) AS at", "event_type = 'signup' AS finished")
    work.run_once(work.reclaim_stream(messages, 43200), folder, work.batch_folder(f"{folder}/out")).awaitTermination()
    return t.spark.read.schema(work.RECLAIM_OUT).parquet(f"{folder}/out").select("message_id", "claims")


@query("i5_queue_health", """SELECT count(*) AS depth, count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type = 'error') AS dead_letters, count(DISTINCT user_id % 20) AS consumers,
  CAST(floor(epoch(TIMESTAMP '2024-02-01' - min(ts) FILTER (event_type = 'view'))) AS BIGINT) AS oldest_pending_seconds FROM events""")
def i5(t):
    states = t.read("events").selectExpr("CASE event_type WHEN 'view' THEN 'pending' WHEN 'error' THEN 'dead' ELSE 'done' END AS state", "ts AS at", "user_id % 20 AS consumer")
    return work.queue_health(states, F.lit(dt.datetime(2024, 2, 1)))


@query("i6_failure_islands", """SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) WHERE event_type = 'error' GROUP BY user_id, run HAVING count(*) >= 2""")
def i6(t):
    log = t.read("events").selectExpr("event_id AS id", "user_id", "ts AS at", "event_type = 'error' AS failed")
    return work.failure_islands(log, "user_id", 2)


def _requests(df):
    return df.selectExpr("event_id AS id", "user_id % 20 AS host", "unix_micros(cast(ts AS timestamp)) / 1e6 AS at", "event_type <> 'signup' AS failed")


@query("i6_breaker")
def i6_breaker(t):
    return work.breaker_states(_requests(t.read("events")), "host")


@query("i6_breaker_stream")
def i6_stream(t):
    folder = shared_folder(t.spark, "breaker")
    work.run_once(work.breaker_stream(_requests(_stream(t, "events")), "host"), folder, work.batch_folder(f"{folder}/out")).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("id", "host", "result")


_HANDED = "SELECT CAST(to_json({'posting_id': event_id, 'jd_sha256': sha256(props), 'adapter': event_type, 'char_count': length(props)}) AS VARCHAR) AS payload FROM events WHERE event_id % 3 <> 0"


@query("i7_hand_off", _HANDED)
def i7(t):
    folder = shared_folder(t.spark, "handed")
    resolved = _stream(t, "events").selectExpr("event_id AS posting_id", "sha2(props, 256) AS jd_sha256", "event_type AS adapter", "cast(length(props) AS bigint) AS char_count")
    done = t.read("events").where("event_id % 3 = 0").selectExpr("event_id AS posting_id")
    work.run_once(work.hand_off(resolved, done), folder, work.batch_folder(f"{folder}/out")).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("payload")


@query("i8_weekly_counts", "SELECT strftime(TIMESTAMP '1970-01-01' + to_days(CAST(7 * floor(epoch(ts) / 604800) AS INT)), '%Y-%m-%d') AS week, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def i8(t):
    folder = shared_folder(t.spark, "weekly")
    counted = work.weekly_counts(_stream(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id"), "ts", "user_id")
    work.run_once(counted, folder, work.batch_folder(f"{folder}/out"), "update").awaitTermination()
    last = t.spark.read.parquet(f"{folder}/out")
    newest = last.groupBy("week", "user_id").agg(F.max_by("n", "batch").alias("n"))
    return newest.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "user_id", "n")


@query(
    "l13_digest",
    """SELECT posting_id, rank, company, n_citations, evidenced FROM (SELECT posting_id, row_number() OVER (ORDER BY coarse_score DESC, posting_id) AS rank FROM shortlist WHERE run_id = 'run-0' QUALIFY rank <= 100) s JOIN posting p ON p.id = s.posting_id
       LEFT JOIN (SELECT m.posting_id, count(c.id) AS n_citations, count(*) FILTER (c.status = 'evidenced') AS evidenced FROM (SELECT posting_id, arg_max(id, (computed_at, id)) AS id FROM matches GROUP BY posting_id) m LEFT JOIN citation c ON c.match_id = m.id GROUP BY 1) k USING (posting_id)""",
)
def l13(t):
    top = ranking.shortlist(t.shortlist.where("run_id = 'run-0'").withColumnRenamed("coarse_score", "score"), "run-0", 100)
    last = ranking.latest_matches(t.matches).select("posting_id", F.col("id").alias("match_id"))
    cited = last.join(t.citation, "match_id", "left").groupBy("posting_id").agg(F.count("id").alias("n_citations"), F.count_if(F.col("status") == "evidenced").alias("evidenced"))
    rows = joins.shortlist_detail(top, t.posting, "run-0").join(cited, "posting_id", "left")
    return rows.select("posting_id", F.col("rank").cast("long").alias("rank"), "company", "n_citations", "evidenced")


@query("l13_gap_digest", "SELECT count(*) AS rows FROM (SELECT skill_id FROM importance i JOIN skill s ON s.id = i.skill_id WHERE s.is_actionable)")
def l13_gaps(t):
    report = demand.gap_report(t.posting, t.requirement, t.skill, t.matches, t.citation, ReportConfig())
    return sinks.report_json(report, ["skill", "status", "required_count"]).agg(F.count(F.lit(1)).alias("rows"))
