"""Aggregations, ranking and ordering (C1 to C4, D, F)."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import ReportConfig
from ..functions import columns as fn
from ..operators import demand, sketches
from .registry import query

REPORT = ReportConfig()
NOW = dt.datetime(2024, 1, 31)


@query("c1_eligible_requirements", "SELECT id, posting_id, skill_id, importance FROM req")
def c1(t):
    return demand.eligible_requirements(t.posting, t.requirement, REPORT).select("id", "posting_id", "skill_id", "importance")


@query("c2_fresh_citations", "SELECT id, match_id, skill_id, status FROM fresh")
def c2(t):
    return demand.fresh_citations(t.citation, t.matches).select("id", "match_id", "skill_id", "status")


_LISTED = """SELECT i.skill_id, s.name AS skill, s.category, required_count, preferred_count, mentioned_count, posting_count,
  CASE coalesce(best_rank, 1) WHEN 3 THEN 'evidenced' WHEN 2 THEN 'weak' ELSE 'absent' END AS status, coalesce(evidenced_citations, 0) AS evidenced_citations,
  coalesce(weak_citations, 0) AS weak_citations, coalesce(absent_citations, 0) AS absent_citations, coalesce(matches_considered, 0) AS matches_considered
  FROM importance i JOIN skill s ON s.id = i.skill_id LEFT JOIN status st USING (skill_id) WHERE s.is_actionable"""
_TOTALS = """SELECT (SELECT count(*) FROM eligible) AS eligible_posting_count, (SELECT count(*) FROM req) AS total_requirement_count,
  (SELECT count(skill_id) FROM req) AS mapped_requirement_count, (SELECT count(*) FROM req WHERE skill_id IS NULL) AS unmapped_requirement_count, CAST(1 AS BIGINT) AS evidence_version"""


def _listed(t):
    histogram = demand.importance_histogram(demand.eligible_requirements(t.posting, demand.spread_requirements(t.requirement), REPORT))
    return demand.with_skill_status(histogram, t.skill, demand.status_fold(demand.fresh_citations(demand.spread_citations(t.citation), t.matches)))


def _version(t):
    return t.matches.select(F.lit(1).cast("long").alias("version"))


@query("c3_skill_status", _LISTED)
def c3(t):
    return _listed(t)


@query("c4_totals_kept", f"SELECT t.*, CAST(NULL AS BIGINT) AS skill_id FROM ({_TOTALS}) t")
def c4(t):
    nothing = _listed(t).where("required_count < 0").select("skill_id")
    return demand.with_totals(nothing, demand.gap_totals(t.posting, t.requirement, REPORT, _version(t)))


@query("d1_importance_histogram", "SELECT * FROM importance")
def d1(t):
    return demand.importance_histogram(demand.eligible_requirements(t.posting, demand.spread_requirements(t.requirement), REPORT))


@query("d2_status_fold", "SELECT * FROM status")
def d2(t):
    return demand.status_fold(demand.fresh_citations(demand.spread_citations(t.citation), t.matches))


@query("d3_gap_totals", _TOTALS)
def d3(t):
    return demand.gap_totals(t.posting, t.requirement, REPORT, _version(t))


@query("d4_gap_report", f"SELECT t.*, l.*, status IN ('absent', 'weak') AS is_gap FROM ({_TOTALS}) t LEFT JOIN ({_LISTED}) l ON true")
def d4(t):
    return demand.gap_report(t.posting, t.requirement, t.skill, t.matches, t.citation, REPORT, _version(t)).orderBy(*demand.gap_order())


@query("f1_gap_order", f"SELECT skill, row_number() OVER (ORDER BY required_count DESC, preferred_count DESC, mentioned_count DESC, posting_count DESC, skill) AS place FROM ({_LISTED}) QUALIFY place <= 50")
def f1(t):
    top = _listed(t).orderBy(*demand.gap_order()).limit(50)
    return top.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*demand.gap_order())).cast("long")).select("skill", "place")


@query("d5_taxonomy_coverage", f"SELECT total_requirement_count, mapped_requirement_count, mapped_requirement_count / total_requirement_count AS coverage FROM ({_TOTALS})")
def d5(t):
    return demand.taxonomy_coverage(demand.gap_totals(t.posting, t.requirement, REPORT, _version(t)))


_LIVE = "(SELECT id AS posting_id FROM posting WHERE inactive_at IS NULL) p LEFT JOIN jd USING (posting_id)"


@query("d8_adapter_coverage", f"SELECT coalesce(adapter, '(none)') AS adapter, count(*) AS total, count(*) FILTER (fetch_status = 'ok' AND raw_text IS NOT NULL AND char_count > 0) AS resolved FROM {_LIVE} GROUP BY 1")
def d8(t):
    return demand.adapter_coverage(t.posting, t.jd)


@query("d9_worker_coverage", f"SELECT coalesce(adapter, 'unattempted') AS adapter, count(*) AS total, count(*) FILTER (fetch_status = 'ok') AS resolved FROM {_LIVE} GROUP BY 1")
def d9(t):
    return demand.adapter_coverage(t.posting, t.jd, "worker")


@query("d10_fetch_status_counts", f"SELECT coalesce(fetch_status, '(no row)') AS fetch_status, count(*) AS n FROM {_LIVE} GROUP BY 1")
def d10(t):
    return demand.fetch_status_counts(t.posting, t.jd)


def _mentions(t):
    return t.read("events").selectExpr(
        "user_id AS skill_id", "event_id AS posting_id", "ts AS first_seen_at", "ts + INTERVAL 3 DAYS AS last_seen_at", "CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 4 DAYS END AS inactive_at",
        "CASE WHEN event_type = 'click' THEN 'required' ELSE 'mentioned' END AS importance",
    )


@query(
    "d11_trend_report",
    """SELECT m.*, recent_count - prior_count AS delta, CASE WHEN recent_count > prior_count THEN 'rising' WHEN recent_count < prior_count THEN 'falling' ELSE 'flat' END AS direction, CAST(coalesce(dropped_count, 0) AS BIGINT) AS dropped_count
       FROM (SELECT user_id AS skill_id, count(*) AS total_count, count(*) FILTER (a < 15) AS recent_count, count(*) FILTER (a >= 15) AS prior_count, count(*) FILTER (event_type = 'click') AS required_count,
               concat_ws(',', count(*) FILTER (a >= 28), count(*) FILTER (a // 7 = 3), count(*) FILTER (a // 7 = 2), count(*) FILTER (a // 7 = 1), count(*) FILTER (a // 7 = 0)) AS weekly_counts
             FROM (SELECT *, CAST(floor(epoch(TIMESTAMP '2024-01-31' - ts) / 86400) AS INT) AS a FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31') GROUP BY user_id) m
       LEFT JOIN (SELECT user_id AS skill_id, count(DISTINCT event_id) AS dropped_count FROM events WHERE event_id % 5 = 0 AND ts + INTERVAL 3 DAY >= TIMESTAMP '2024-01-16' GROUP BY user_id) USING (skill_id)""",
)
def d11(t):
    return demand.trend_report(_mentions(t), NOW).withColumn("weekly_counts", F.array_join(F.col("weekly_counts").cast("array<string>"), ","))


@query("d11_posting_trend", """SELECT skill_id, count(DISTINCT posting_id) AS total_count FROM requirement r JOIN posting p ON p.id = r.posting_id WHERE skill_id IS NOT NULL AND (role_type IS NULL OR lower(role_type) = 'swe')
  AND (sponsorship IS NULL OR sponsorship ILIKE 'offers%') AND (is_remote OR len(locations) = 0 OR locations[2] IN ('ASIA', 'AMERICA')) AND first_seen_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-01-01' GROUP BY skill_id""")
def d11_postings(t):
    return demand.trend_report(demand.trend_mentions(t.posting, t.requirement, REPORT), dt.datetime(1998, 1, 1), days=365).select("skill_id", "total_count")


@query("d12_window_trustworthy", "SELECT min(ts) <= TIMESTAMP '2024-01-02' AS trustworthy FROM events")
def d12(t):
    return demand.window_trustworthy(t.read("events").withColumnRenamed("ts", "first_seen_at"), dt.datetime(2024, 1, 2))


@query("f5_trend_order", """SELECT skill_id, row_number() OVER (ORDER BY delta DESC, n DESC, skill_id) AS place FROM (SELECT user_id AS skill_id, count(*) AS n, 2 * count(*) FILTER (ts > TIMESTAMP '2024-01-16') - count(*) AS delta FROM events
  WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' GROUP BY user_id) QUALIFY place <= 40""")
def f5(t):
    order = [F.desc("delta"), F.desc("total_count"), F.asc("skill_id")]
    top = demand.trend_report(_mentions(t), NOW).orderBy(*order).limit(40)
    return top.select("skill_id", F.row_number().over(Window.partitionBy().orderBy(*order)).cast("long").alias("place"))


@query(
    "e9_bucket_starts",
    """SELECT b.i AS bucket, strftime(greatest(now - INTERVAL 30 DAY, now - to_days(CAST(7 * (5 - b.i) AS INT))), '%Y-%m-%d') AS starts_at
       FROM (SELECT date_trunc('day', max(ts)) AS now FROM events), (SELECT unnest(range(5)) AS i) b""",
)
def e9(t):
    now = t.read("events").agg(F.date_trunc("day", F.max("ts")).alias("now")).first()["now"]
    return demand.bucket_starts(t.spark, now).select("bucket", F.date_format("starts_at", "yyyy-MM-dd").alias("starts_at"))


@query(
    "d13_skill_demand",
    """SELECT s.id AS skill_id, s.name, CAST(coalesce(a.n, 0) AS BIGINT) AS alias_count, CAST(coalesce(r.n, 0) AS BIGINT) AS requirement_count, CAST(coalesce(r.p, 0) AS BIGINT) AS posting_count, CAST(coalesce(r.q, 0) AS BIGINT) AS required_count
       FROM skill s LEFT JOIN (SELECT skill_id, count(*) AS n FROM skill_alias GROUP BY 1) a ON a.skill_id = s.id
       LEFT JOIN (SELECT skill_id, count(*) AS n, count(DISTINCT posting_id) AS p, count(*) FILTER (importance = 'required') AS q FROM requirement
         WHERE posting_id IN (SELECT id FROM posting WHERE inactive_at IS NULL) GROUP BY 1) r ON r.skill_id = s.id""",
)
def d13(t):
    return demand.skill_demand(t.skill, t.skill_alias, t.requirement, t.posting)


_W = "CASE importance WHEN 'required' THEN 1.0 WHEN 'preferred' THEN 0.5 ELSE 0.25 END"
_C = "CASE status WHEN 'evidenced' THEN 1.0 WHEN 'weak' THEN 0.5 ELSE 0.0 END"


@query("d15_match_score", f"SELECT match_id, round(CAST(sum({_W} * {_C}) AS DOUBLE) / CAST(sum({_W}) AS DOUBLE), 4) AS score, count(*) AS n FROM citation GROUP BY match_id")
def d15(t):
    return demand.match_scores(t.citation)


@query(
    "d16_stage_costs",
    """SELECT coalesce(run_id, '(all)') AS run_id, round(sum(value) FILTER (metric = 'cost_usd'), 4) AS cost_usd_sum, count(*) FILTER (metric = 'cost_usd') AS cost_usd_n,
         round(sum(value) FILTER (metric = 'tokens'), 4) AS tokens_sum, count(*) FILTER (metric = 'tokens') AS tokens_n FROM run_metric WHERE stage = 'click' GROUP BY ROLLUP (run_id)""",
)
def d16(t):
    return demand.stage_costs(t.run_metric.where("stage = 'click'"), ["cost_usd", "tokens"]).withColumns({c: F.round(c, 4) for c in ("cost_usd_sum", "tokens_sum")})


@query(
    "d17_cost_summary",
    """SELECT round(cost, 4) AS cost, round(tokens, 4) AS tokens, round(hits / tries, 6) AS hit_rate, calls, stale_matches, all_matches, round(cost / all_matches, 6) AS cost_per_match
       FROM (SELECT sum(value) FILTER (metric = 'cost_usd') AS cost, sum(value) FILTER (metric = 'tokens') AS tokens, sum(value) FILTER (metric = 'cache_hit') AS hits, count(*) FILTER (metric = 'cache_hit') AS tries,
               count(*) FILTER (metric = 'calls') AS calls FROM run_metric WHERE stage = 'view'), (SELECT count(*) FILTER (is_stale) AS stale_matches, count(*) AS all_matches FROM matches)""",
)
def d17(t):
    out = demand.cost_summary(t.run_metric, t.matches, "view")
    return out.withColumns({"cost": F.round("cost", 4), "tokens": F.round("tokens", 4), "hit_rate": F.round("hit_rate", 6), "cost_per_match": F.round("cost_per_match", 6)})


@query("d18_taxonomy_stats", "SELECT category, count(*) AS n, CAST(sum(CAST(is_actionable AS INT)) AS BIGINT) AS actionable FROM skill GROUP BY category")
def d18(t):
    return t.skill.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_actionable").cast("long")).alias("actionable"))


@query("d19_latest_run", "SELECT run_id FROM shortlist GROUP BY run_id ORDER BY max(created_at) DESC, run_id DESC LIMIT 1")
def d19(t):
    return demand.latest_run(t.shortlist, "created_at")


@query("d20_corpus_counts", "SELECT count(*) AS live, count(*) FILTER (text ILIKE '%license%') AS flagged FROM documents WHERE doc_id % 9 <> 0")
def d20(t):
    return t.read("documents").where("doc_id % 9 <> 0").agg(F.count(F.lit(1)).alias("live"), F.count_if(F.col("text").ilike("%license%")).alias("flagged"))


@query("d21_strongest_spans", """SELECT posting_id, raw_text, CASE max(CASE importance WHEN 'required' THEN 3 WHEN 'preferred' THEN 2 ELSE 1 END) WHEN 3 THEN 'required' WHEN 2 THEN 'preferred' ELSE 'mentioned' END AS importance,
  max(confidence) AS confidence FROM requirement GROUP BY posting_id, raw_text""")
def d21(t):
    return demand.strongest_spans(t.requirement)


@query("d24_latency_percentiles", "SELECT host, round(quantile_cont(seconds, 0.5), 6) AS p50, round(quantile_cont(seconds, 0.99), 6) AS p99, count(*) AS n FROM fetch_log GROUP BY host")
def d24(t):
    return demand.percentiles(t.fetch_log).withColumns({"p50": F.round("p50", 6), "p99": F.round("p99", 6)})


@query("d24_latency_sketch", "SELECT host, count(*) AS n, round(min(seconds), 6) AS least, round(max(seconds), 6) AS most, true AS p50_near, true AS p99_near FROM fetch_log f WHERE f.at >= TIMESTAMP '2024-01-03' AND f.at < TIMESTAMP '2024-01-20' AND seconds IS NOT NULL GROUP BY host")
def d24_sketch(t):
    """A window's percentiles from daily sketches; whether their true ranks are within the stated error is counted over all rows."""
    at = {"p50": 0.5, "p99": 0.99}
    found = sketches.quantiles(sketches.daily_quantiles(t.fetch_log, "host", "seconds", "at"), "host", at, "2024-01-03", "2024-01-20")
    own = t.fetch_log.where("at >= timestamp'2024-01-03' AND at < timestamp'2024-01-20' AND seconds IS NOT NULL").join(F.broadcast(found), "host")
    far = [(F.abs(F.count_if(F.col("seconds") <= F.col(name)) / F.count(F.lit(1)) - q) <= sketches.rank_error() + 1 / F.count(F.lit(1))).alias(f"{name}_near") for name, q in at.items()]
    return own.groupBy("host").agg(F.first("n").alias("n"), F.round(F.first("least"), 6).alias("least"), F.round(F.first("most"), 6).alias("most"), *far)


@query("d11_window_sketch", "SELECT user_id AS skill_id, count(*) AS n, true AS near FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY user_id")
def d11_sketch(t):
    """Distinct postings of a skill in a window, from daily sketches, against an exact count."""
    mentions = _mentions(t)
    daily = sketches.daily_distinct(mentions, "skill_id", "posting_id", "first_seen_at", {"required": F.col("importance") == "required"})
    exact = mentions.where("first_seen_at >= timestamp'2024-01-01' AND first_seen_at < timestamp'2024-01-31'").groupBy("skill_id").agg(F.countDistinct("posting_id").alias("exact"))
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1), F.col("exact") * 4 * sketches.relative_error())
    return sketches.distinct_counts(daily, "skill_id", "2024-01-01", "2024-01-31").join(exact, "skill_id").select("skill_id", "n", near.alias("near"))


@query(
    "d25_funnel_readback",
    """SELECT row_number() OVER (ORDER BY coalesce(ord, 2), metric) AS place, metric, value FROM (SELECT metric, arg_max(value, (recorded_at, id)) AS value FROM run_metric GROUP BY metric)
       LEFT JOIN (VALUES ('tokens', 0), ('calls', 1)) o(metric, ord) USING (metric)""",
)
def d25(t):
    return demand.funnel_readback(t.run_metric, ["tokens", "calls"]).withColumn("place", F.col("place").cast("long"))


@query("d26_tags_per_chunk", "SELECT chunk_id, string_agg(name, ', ' ORDER BY name) AS tags FROM (SELECT DISTINCT chunk_id, name FROM citation c JOIN skill s ON s.id = c.skill_id WHERE chunk_id IS NOT NULL) GROUP BY chunk_id")
def d26(t):
    return demand.tags_per_chunk(t.citation.where("chunk_id is not null").select("chunk_id", "skill_id"), t.skill)


@query(
    "d27_batch_outcomes",
    """SELECT count(*) AS total, count(*) FILTER (o = 'matched') AS matched, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (c) AS from_cache,
         round(sum(value), 3) AS cost, round(sum(CASE WHEN c THEN 0 ELSE value END), 3) AS new_cost
       FROM (SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'matched' END AS o, event_id % 3 = 0 AS c, value FROM events)""",
)
def d27(t):
    rows = t.read("events").selectExpr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'matched' END AS outcome", "event_id % 3 = 0 AS from_cache", "value AS cost")
    return demand.batch_outcomes(rows).withColumns({"cost": F.round("cost", 3), "new_cost": F.round("new_cost", 3)})


@query("d22_candidate_review", """SELECT raw_norm, CAST(sum(n) AS BIGINT) AS seen_count, min(example) AS example_posting_id, max(status) AS status FROM (
    SELECT 'experience with part ' || (l_partkey % 500) AS raw_norm, 1 AS n, l_orderkey AS example, NULL AS status FROM lineitem WHERE l_partkey % 8 = 0
    UNION ALL SELECT 'experience with part ' || p_partkey, p_size, NULL, 'rejected' FROM part WHERE p_partkey < 300 AND p_partkey % 3 = 0) GROUP BY raw_norm""")
def d22(t):
    from ..operators import changes

    seen = t.requirement.where("skill_id is null").select(fn.taxonomy_folded(F.col("raw_text")).alias("raw_norm"), "posting_id")
    stored = t.read("part").where("p_partkey < 300 and p_partkey % 3 = 0").selectExpr("concat('experience with part ', p_partkey) AS raw_norm", "p_size AS seen_count", "cast(null AS bigint) AS example_posting_id", "'rejected' AS status")
    return changes.candidate_counts(stored, seen)


@query("f2_pagination", "SELECT id, (SELECT count(*) FROM posting) AS total FROM posting ORDER BY posted_at DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100")
def f2(t):
    total = t.posting.agg(F.count(F.lit(1)).alias("total"))
    return t.posting.select("id", "posted_at").orderBy(F.desc_nulls_last("posted_at"), F.desc("id")).offset(100).limit(50).select("id").crossJoin(total)


@query("f3_review_queue", "SELECT raw_text, count(*) AS seen_count FROM requirement WHERE skill_id IS NULL GROUP BY raw_text ORDER BY seen_count DESC, raw_text LIMIT 25")
def f3(t):
    return t.requirement.where("skill_id is null").groupBy("raw_text").agg(F.count(F.lit(1)).alias("seen_count")).orderBy(F.desc("seen_count"), "raw_text").limit(25)


@query("f4_recent_runs", "SELECT run_id, CAST(epoch(max(recorded_at)) - epoch(min(recorded_at)) AS BIGINT) AS elapsed, count(*) AS n FROM (SELECT run_id, date_trunc('second', recorded_at) AS recorded_at FROM run_metric) GROUP BY run_id ORDER BY max(recorded_at) DESC, run_id LIMIT 5")
def f4(t):
    at = F.date_trunc("second", "recorded_at")
    runs = t.run_metric.groupBy("run_id").agg(F.max(at).alias("last"), F.expr("timestampdiff(SECOND, min(date_trunc('second', recorded_at)), max(date_trunc('second', recorded_at)))").alias("elapsed"), F.count(F.lit(1)).alias("n"))
    return runs.orderBy(F.desc("last"), "run_id").limit(5).select("run_id", "elapsed", "n")
