"""Filters and projections (B)."""

from pyspark.sql import functions as F

from ..config import RankConfig, ReportConfig
from ..operators import demand, filters
from .registry import query

RANK, REPORT = RankConfig(), ReportConfig()


@query("b1_active_feed", "SELECT id, company, role_type FROM posting WHERE inactive_at IS NULL")
def b1(t):
    return t.posting.where(filters.active()).select("id", "company", "role_type")


@query("b2_report_eligibility", "SELECT id FROM eligible")
def b2(t):
    return filters.eligible(t.posting, REPORT).select("id")


@query("b2_eligibility_bypassed", "SELECT id FROM posting WHERE inactive_at IS NULL")
def b2_off(t):
    return filters.eligible(t.posting, ReportConfig(apply=False)).select("id")


def _state(name, *columns):
    query(name, f"SELECT id, {', '.join(columns)} FROM classified")(lambda t: filters.classified(t.posting, RANK).withColumn("flags", F.array_join("flags", ",")).select("id", *columns))


_state("b3_sponsorship_class", "sponsorship_class")
_state("b4_location_allowlist", "location_ok")
_state("b5_role_state", "role_state")
_state("b6_start_state", "start_state")
_state("b7_drop_attribution", "drop_reason")


@query("b8_survivor_flags", "SELECT id, flags FROM classified WHERE drop_reason IS NULL")
def b8(t):
    return filters.survivors(t.posting, RANK).select("id", F.array_join("flags", ",").alias("flags"))


@query("b9_survivors", "SELECT id, company, title, role_state, start_state, sponsorship_class, array_to_string(locations, '|') AS places FROM classified WHERE drop_reason IS NULL")
def b9(t):
    return filters.survivors(t.posting, RANK).orderBy("id").select("id", "company", "title", "role_state", "start_state", "sponsorship_class", F.array_join("locations", "|").alias("places"))


@query(
    "b10_classify_postings",
    """SELECT a.posting_id, CASE WHEN p.id IS NULL THEN 'not_found' WHEN p.inactive_at IS NOT NULL THEN 'inactive' ELSE coalesce(c.drop_reason, 'kept') END AS outcome
       FROM (SELECT event_id * 3 AS posting_id FROM events) a LEFT JOIN posting p ON p.id = a.posting_id LEFT JOIN classified c ON c.id = a.posting_id""",
)
def b10(t):
    return filters.classify(t.posting, t.read("events").select((F.col("event_id") * 3).alias("posting_id")), RANK)


@query(
    "b11_posting_search",
    """SELECT id, company, title FROM posting WHERE inactive_at IS NULL AND company ILIKE '%0001%' AND lower(role_type) = 'swe' AND title ILIKE '%engineer%'
       AND id IN (SELECT posting_id FROM jd WHERE raw_text IS NOT NULL AND raw_text <> '')""",
)
def b11(t):
    return filters.search_postings(t.posting, t.jd, active_only=True, company="0001", role="SWE", has_jd=True, q="engineer").select("id", "company", "title")


def _chunks(t):
    return t.read("documents").selectExpr(
        "source AS source_type", "cast(doc_id AS string) AS source_ref", "0 AS ordinal", "n_chars", "CASE WHEN doc_id % 9 = 0 THEN 'gone' END AS deleted_at",
        "CASE WHEN doc_id % 4 <> 0 THEN 1 END AS embedding", "CASE WHEN doc_id % 4 <> 0 THEN concat('m', doc_id % 3) END AS embedding_model",
    )


@query("b12_live_chunks", "SELECT source AS source_type, CAST(doc_id AS VARCHAR) AS source_ref, n_chars FROM documents WHERE doc_id % 9 <> 0 AND source = 'src3'")
def b12(t):
    return filters.live_chunks(_chunks(t), source_type="src3").orderBy("source_type", "source_ref", "ordinal").select("source_type", "source_ref", "n_chars")


@query("b13_needs_embedding", "SELECT CAST(doc_id AS VARCHAR) AS source_ref FROM documents WHERE doc_id % 9 <> 0 AND (doc_id % 4 = 0 OR doc_id % 3 <> 1)")
def b13(t):
    return filters.needs_embedding(_chunks(t), "m1").select("source_ref")


@query("b14_skill_search", "SELECT id, name, category FROM skill WHERE is_actionable AND name ILIKE '%ring%' AND category = 'ECONOMY'")
def b14(t):
    return filters.search_skills(t.skill, actionable=True, q="ring", category="ECONOMY").select("id", "name", "category")


@query("b15_metric_search", "SELECT id, run_id, metric FROM run_metric WHERE stage = 'error' AND metric = 'tokens' ORDER BY recorded_at DESC, id DESC LIMIT 100")
def b15(t):
    return filters.search_metrics(t.run_metric, 100, stage="error", metric="tokens").select("id", "run_id", "metric")


@query("b16_width_clipping", "SELECT id, left(company, 12) AS company, left(title, 8) AS title FROM posting")
def b16(t):
    return filters.clip(t.posting.select("id", "company", "title"), {"company": 12, "title": 8})


@query(
    "b17_fetch_outcome",
    """SELECT id, s AS fetch_status, s IN ('rate_limited', 'transient_error') AS retryable FROM (SELECT id, CASE WHEN error IS NOT NULL OR http_status >= 500 THEN 'transient_error'
       WHEN http_status = 200 THEN 'ok' WHEN http_status = 404 THEN 'not_found' WHEN http_status = 429 THEN 'rate_limited' ELSE 'permanent_error' END AS s FROM fetch_log)""",
)
def b17(t):
    kind, retry = filters.fetch_status(F.col("http_status"), F.col("error"))
    return t.fetch_log.select("id", kind.alias("fetch_status"), retry.alias("retryable"))


@query(
    "d6_filter_funnel",
    """SELECT o.ord, o.reason, CAST(CASE o.reason WHEN 'inactive' THEN (SELECT count(*) FROM posting WHERE inactive_at IS NOT NULL) ELSE coalesce(c.n, 0) END AS BIGINT) AS n
       FROM (VALUES (0, 'inactive'), (1, 'sponsorship_offshore'), (2, 'sponsorship_citizenship'), (3, 'sponsorship_not_offered'), (4, 'location'), (5, 'role_type'), (6, 'start_season'), (7, 'kept')) o(ord, reason)
       LEFT JOIN (SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM classified GROUP BY 1) c USING (reason)""",
)
def d6(t):
    return demand.funnel(t.posting, filters.classified(t.posting, RANK))


@query(
    "d7_flag_counts",
    """SELECT flag, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES ('sponsorship_unknown'), ('role_type_unknown'), ('start_season_unknown'), ('start_season_partial')) f(flag)
       LEFT JOIN (SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM classified WHERE drop_reason IS NULL AND flags <> '') GROUP BY flag) USING (flag)""",
)
def d7(t):
    return demand.flag_counts(filters.survivors(t.posting, RANK))


