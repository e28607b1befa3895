"""Joins, vectors and ranking (C5 to C19, D14, E, F6, K11)."""

from pyspark.sql import functions as F

from ..config import RankConfig
from ..operators import fuzzy, joins, ranking, vectors
from .registry import query

RANK = RankConfig()


@query("c5_posting_text", "SELECT p.id, company, adapter, fetch_status, char_count FROM posting p LEFT JOIN jd ON jd.posting_id = p.id")
def c5(t):
    return joins.with_text(t.posting, t.jd).select("id", "company", "adapter", "fetch_status", "char_count")


@query("c6_needs_fetch", "SELECT p.id FROM posting p LEFT JOIN jd ON jd.posting_id = p.id WHERE inactive_at IS NULL AND (fetch_status IS NULL OR fetch_status IN ('pending', 'rate_limited', 'transient_error'))")
def c6(t):
    return joins.needs_fetch(t.posting, t.jd).orderBy("id").select("id")


@query("c7_extraction_backlog", """SELECT p.id FROM posting p JOIN jd ON jd.posting_id = p.id WHERE inactive_at IS NULL AND raw_text IS NOT NULL AND fetch_status = 'ok'
  AND NOT EXISTS (SELECT 1 FROM requirement r WHERE r.posting_id = p.id AND r.importance = 'required') ORDER BY posted_at DESC NULLS LAST, p.id DESC LIMIT 200""")
def c7(t):
    return joins.extraction_backlog(t.posting, t.jd, t.requirement.where("importance = 'required'"), 200).select("id")


@query("c8_mark_stale", """SELECT m.id, is_stale OR live AS is_stale, live AND NOT is_stale AS changed FROM (SELECT m.id, m.is_stale, EXISTS (SELECT 1 FROM posting p WHERE p.id = m.posting_id AND inactive_at IS NULL) AS live FROM matches m) m""")
def c8(t):
    from ..operators.changes import mark_stale

    return mark_stale(t.matches, t.posting).select("id", "is_stale", "changed")


_SIM = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"


@query("c9_nearest_chunk", f"SELECT query_id, chunk_id, round(s, 6) AS similarity FROM (SELECT q.id AS query_id, c.id AS chunk_id, {_SIM} AS s FROM query_vec q, chunk c WHERE NOT deleted) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(1 - s, 9), chunk_id) = 1")
def c9(t):
    return vectors.nearest(t.query_vec, t.chunk.where("not deleted")).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


_HITS = f"""SELECT query_id, posting_id, chunk_id, distance, tagged, round(distance - CASE WHEN tagged THEN 0.15 ELSE 0 END, 9) AS adjusted FROM (
  SELECT q.id AS query_id, q.posting_id, c.id AS chunk_id, round(1 - {_SIM}, 9) AS distance, q.label = c.label AS tagged FROM query_vec q, chunk c WHERE NOT deleted)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY adjusted, chunk_id) <= 5"""


def _hits(t):
    queries = t.query_vec.withColumnRenamed("label", "skill_id")
    tags = t.chunk.select(F.col("id").alias("chunk_id"), F.col("label").alias("skill_id"))
    return queries, vectors.top_k(queries, t.chunk.where("not deleted"), 5, tags, 0.15)


@query("c10_tagged_top_k", f"SELECT query_id, chunk_id, round(adjusted, 6) AS adjusted, tagged FROM ({_HITS})")
def c10(t):
    return _hits(t)[1].select("query_id", "chunk_id", F.round("adjusted", 6).alias("adjusted"), "tagged")


@query("e3_candidate_set", f"SELECT posting_id, chunk_id, round(min(adjusted), 6) AS effective, count(*) AS n_requirements FROM ({_HITS}) GROUP BY posting_id, chunk_id")
def e3(t):
    queries, hits = _hits(t)
    return vectors.candidate_set(hits, queries, 0.15).select("posting_id", "chunk_id", F.round("effective", 6).alias("effective"), "n_requirements")


_SCORED = f"""SELECT query_id, posting_id, importance, CASE importance WHEN 'required' THEN 1.0 WHEN 'preferred' THEN 0.5 ELSE 0.2 END * greatest(0.0, least(1.0, s)) AS contribution FROM (
  SELECT q.id AS query_id, q.posting_id, q.importance, round(1 - (1 - {_SIM}), 9) AS s, c.id AS chunk_id FROM query_vec q, chunk c WHERE NOT deleted) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) = 1"""


def _contributions(t):
    return vectors.contributions(vectors.nearest(t.query_vec, t.chunk.where("not deleted")), t.query_vec, RANK)


@query(
    "d14_coarse_score",
    f"""SELECT p.id AS posting_id, round(0.9 * CASE WHEN base IS NULL THEN 0.85 * (p.id % 100) / 100.0 ELSE least(1.0, base) END + CASE WHEN len(locations) = 2 AND locations[2] IN ('ASIA', 'AMERICA') THEN 0.1 ELSE 0 END, 5) AS score,
         CAST(coalesce(n, 0) AS BIGINT) AS n_requirements, base IS NULL AS low_confidence
       FROM posting p LEFT JOIN (SELECT posting_id, sum(contribution) / count(*) AS base, count(*) AS n FROM ({_SCORED}) GROUP BY posting_id) s ON s.posting_id = p.id""",
)
def d14(t):
    spare = t.posting.select(F.col("id").alias("posting_id"), (F.col("id") % 100 / 100).alias("similarity"))
    return vectors.coarse_scores(_contributions(t), t.posting, spare, RANK)


@query("f6_contribution_explain", f"SELECT query_id, importance, round(contribution, 6) AS contribution FROM ({_SCORED}) WHERE posting_id = 5 ORDER BY contribution DESC, query_id")
def f6(t):
    return _contributions(t).where("posting_id = 5").orderBy(F.desc("contribution"), "query_id").select("query_id", "importance", F.round("contribution", 6).alias("contribution"))


@query(
    "c11_citation_detail",
    "SELECT c.id, coalesce(s.name, '(unmapped)') AS skill, k.label AS chunk_label, status FROM citation c LEFT JOIN skill s ON s.id = c.skill_id LEFT JOIN chunk k ON k.id = c.chunk_id",
)
def c11(t):
    return joins.citation_detail(t.citation, t.skill, t.chunk).select("id", "skill", "chunk_label", "status")


_RANKED = "SELECT run_id, posting_id, row_number() OVER (PARTITION BY run_id ORDER BY coarse_score DESC, posting_id) AS rank, coarse_score FROM shortlist"


@query("c12_shortlist_detail", f"SELECT posting_id, rank, company, title FROM ({_RANKED}) JOIN posting p ON p.id = posting_id WHERE run_id = 'run-1' AND rank <= 100")
def c12(t):
    top = ranking.shortlist(t.shortlist.where("run_id = 'run-1'").withColumnRenamed("coarse_score", "score"), "run-1", 100)
    return joins.shortlist_detail(top, t.posting, "run-1").select("posting_id", F.col("rank").cast("long").alias("rank"), "company", "title")


@query("e1_shortlist", f"SELECT run_id, posting_id, rank, coarse_score AS score FROM ({_RANKED}) WHERE run_id = 'run-2' AND rank <= 50")
def e1(t):
    top = ranking.shortlist(t.shortlist.where("run_id = 'run-2'").withColumnRenamed("coarse_score", "score"), "run-2", 50)
    return top.select("run_id", "posting_id", F.col("rank").cast("long").alias("rank"), "score")


@query("c13_requirement_view", """SELECT r.id, r.posting_id, s.name AS skill, row_number() OVER (PARTITION BY r.posting_id ORDER BY CASE importance WHEN 'required' THEN 0 WHEN 'preferred' THEN 1 ELSE 2 END, r.id) AS place
  FROM requirement r LEFT JOIN skill s ON s.id = r.skill_id""")
def c13(t):
    return joins.requirement_view(t.requirement, t.skill).select("id", "posting_id", "skill", F.col("place").cast("long").alias("place"))


@query("k11_query_text", "SELECT r.id, CASE WHEN s.name IS NOT NULL AND NOT contains(lower(raw_text), lower(s.name)) THEN raw_text || ' ' || s.name ELSE raw_text END AS query_text FROM requirement r LEFT JOIN skill s ON s.id = r.skill_id")
def k11(t):
    return joins.requirement_view(t.requirement, t.skill).select("id", joins.query_text(F.col("raw_text"), F.col("skill")).alias("query_text"))


def _domain_rules(t):
    """Rules from the pages' own hosts: a domain for each of the last two labels, and one subdomain that goes first."""
    hosts = t.read("pages").select(F.substring_index(F.lower(F.expr("try_parse_url(url, 'HOST')")), ".", -2).alias("domain")).distinct()
    return hosts.selectExpr("domain", "CASE domain WHEN 'example.com' THEN 'board_a' WHEN 'example.net' THEN 'board_b' END AS adapter", "length(domain) AS priority").where("adapter is not null").unionByName(
        hosts.selectExpr("concat('tionsh.', domain) AS domain", "'board_c' AS adapter", "1 AS priority")
    )


@query("c14_host_dispatch", r"""SELECT page_id, CASE WHEN h = '' THEN 'rejected' WHEN regexp_matches(h, '(^|\.)tionsh\.example\.(com|net|org)$') THEN 'board_c' WHEN ends_with(h, '.example.com') THEN 'board_a' WHEN ends_with(h, '.example.net') THEN 'board_b' ELSE 'fallback' END AS adapter
  FROM (SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS h FROM pages)""")
def c14(t):
    return joins.dispatch(t.read("pages").select("page_id", "url"), _domain_rules(t)).select("page_id", "adapter")


@query("c15_posting_ids", r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'acme' || (page_id % 7) ELSE regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) END AS owner,
  CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE regexp_extract(url, '^https?://[^/]+/[a-z]+/(\d+)', 1) END AS job_id FROM pages""")
def c15(t):
    shaped = t.read("pages").selectExpr("page_id", "CASE WHEN page_id % 2 = 0 THEN 'board_a' ELSE 'board_d' END AS adapter", "CASE WHEN page_id % 4 = 0 THEN concat('https://x.example/v1/boards/acme', page_id % 7, '/jobs/', page_id, '?a=1') WHEN page_id % 4 = 2 THEN concat('https://x.example/embed/job_app?for=acme', page_id % 7, '&token=', page_id) ELSE regexp_replace(url, '[.]html|/$', '') END AS url")
    return joins.posting_ids(shaped).select("page_id", "owner", "job_id")


@query("c16_robots", r"""SELECT page_id, CASE WHEN crc THEN CASE WHEN path LIKE '/en/1%' THEN path LIKE '/en/12%' WHEN regexp_matches(path, '\.html$') THEN false ELSE true END ELSE path NOT LIKE '/de/%' END AS allowed
  FROM (SELECT page_id, length(h) % 2 = 0 AS crc, '/' || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages))""")
def c16(t):
    pages = t.read("pages").select(F.col("page_id").alias("url_id"), F.expr("try_parse_url(url, 'HOST')").alias("host"), F.expr("try_parse_url(url, 'PATH')").alias("path"))
    body = "CASE WHEN length(host) % 2 = 0 THEN 'User-agent: *\nDisallow: /\n\nUser-agent: collector # ours\nDisallow: /en/1\nAllow: /en/12*\nDisallow: /*.html$' ELSE 'User-agent: *\nDisallow: /de/\nUser-agent: other\nDisallow: /' END AS body"
    rules = joins.robots_rules(pages.select("host").distinct().selectExpr("host", body), "collector-bot")
    return joins.robots_allow(pages, rules).select(F.col("url_id").alias("page_id"), "allowed")


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "c17_fuzzy_best_match",
    f"""SELECT target_id, arg_min(place, (-score, place)) AS place, max(score) AS score FROM (SELECT target_id, place, CASE WHEN a = b THEN 1000.0 WHEN starts_with(a, b) OR starts_with(b, a) THEN 800.0 - abs(length(a) - length(b))
         WHEN contains(a, b) OR contains(b, a) THEN 600.0 - abs(length(a) - length(b)) ELSE floor(400.0 * len(list_filter(string_split(b, ' '), lambda w: list_contains(string_split(a, ' '), w))) / len(string_split(b, ' ')) + 0.5) - abs(length(a) - length(b)) / 10.0 END AS score,
         len(list_intersect(string_split(a, ' '), string_split(b, ' '))) AS shared
       FROM (SELECT p_partkey AS place, {_NORM.format("p_name || ' ' || p_type")} AS a FROM part), (SELECT p_partkey AS target_id, {_NORM.format("CASE p_partkey % 3 WHEN 0 THEN p_name || ', ' || p_type WHEN 1 THEN p_name ELSE p_type || ' ' || p_name END")} AS b FROM part))
       WHERE score > 300 GROUP BY target_id""",
)
def c17(t):
    part = t.read("part")
    options = t.read("part").select(F.col("p_partkey").alias("place"), F.concat_ws(" ", "p_name", "p_type").alias("option"))
    targets = part.select(F.col("p_partkey").alias("target_id"), F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ', ', p_type) WHEN 1 THEN p_name ELSE concat(p_type, ' ', p_name) END").alias("target"))
    return fuzzy.best_match(options, targets)


@query("c18_posting_detail", """SELECT p.id AS posting_id, adapter, CAST(coalesce(n, 0) AS BIGINT) AS n_requirements, m.id AS match_id, CAST(coalesce(k, 0) AS BIGINT) AS n_citations, first_skill FROM posting p LEFT JOIN jd ON jd.posting_id = p.id
  LEFT JOIN (SELECT posting_id, count(*) AS n, arg_min(coalesce(skill_id, -1), (CASE importance WHEN 'required' THEN 0 WHEN 'preferred' THEN 1 ELSE 2 END, id)) AS first_skill FROM requirement GROUP BY 1) r ON r.posting_id = p.id
  LEFT JOIN (SELECT posting_id, arg_max(id, (computed_at, id)) AS id FROM matches GROUP BY posting_id) m ON m.posting_id = p.id LEFT JOIN (SELECT match_id, count(*) AS k FROM citation GROUP BY 1) c ON c.match_id = m.id""")
def c18(t):
    out = joins.posting_detail(t.posting, t.jd, t.requirement, t.matches, t.citation)
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    first = F.when(F.col("requirements").isNotNull(), F.coalesce(F.col("requirements")[0]["skill_id"], F.lit(-1)))
    return out.select("posting_id", "adapter", size("requirements").alias("n_requirements"), F.col("match.id").alias("match_id"), size("match.citations").alias("n_citations"), first.alias("first_skill"))


@query("c19_posting_meta", "SELECT p.id AS posting_id, company, title, CAST(coalesce(n, 0) AS BIGINT) AS requirement_count FROM posting p LEFT JOIN (SELECT posting_id, count(*) AS n FROM requirement GROUP BY 1) r ON r.posting_id = p.id")
def c19(t):
    return joins.posting_meta(t.posting, t.requirement)


@query("e2_latest_match", "SELECT posting_id, id, verdict, score FROM matches QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY computed_at DESC, id DESC) = 1")
def e2(t):
    return ranking.latest_matches(t.matches).select("posting_id", "id", "verdict", "score")


@query("e4_last_write_wins", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def e4(t):
    from ..operators.changes import last_by_key

    return last_by_key(t.read("events"), "user_id", "event_id").select("user_id", "event_id", "value")


@query("e5_stale_sweep", "SELECT posting_id FROM (SELECT posting_id, min((computed_at, id)) AS since FROM matches WHERE is_stale AND posting_id IN (SELECT id FROM posting WHERE inactive_at IS NULL) GROUP BY posting_id) ORDER BY since, posting_id LIMIT 40")
def e5(t):
    return ranking.stale_sweep(t.matches, t.posting, 40)


def _content(t):
    texts = t.read("documents").select(F.col("doc_id").alias("text_id"), "text")
    words = "array('the', 'of', 'and', 'to', 'in', 'die', 'der', 'und', 'de', 'la', 'que', 'les', 'for', 'with')"
    # a library of content is as small as the nations are many
    bullets = t.read("nation").selectExpr("n_nationkey % 8 AS entry_id", "n_nationkey AS bullet_id", f"array(element_at({words}, cast(1 + n_nationkey % 14 AS int)), element_at({words}, cast(1 + (n_nationkey * 3 + 1) % 14 AS int))) AS tags")
    return texts, bullets


_TAGS = "(SELECT n_nationkey % 8 AS entry_id, n_nationkey AS bullet_id, unnest(list_distinct([w[1 + n_nationkey % 14], w[1 + (n_nationkey * 3 + 1) % 14]])) AS tag FROM nation, (SELECT ['the', 'of', 'and', 'to', 'in', 'die', 'der', 'und', 'de', 'la', 'que', 'les', 'for', 'with'] AS w))"
_TAG_HITS = f"(SELECT d.text_id, b.entry_id, b.bullet_id, b.tag FROM (SELECT DISTINCT doc_id AS text_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9+#./-]+')) AS tag FROM documents) d JOIN {_TAGS} b USING (tag))"


@query(
    "e6_content_selection",
    f"""WITH points AS (SELECT text_id, entry_id, bullet_id, 4 * count(*) AS points FROM {_TAG_HITS} GROUP BY ALL),
       best AS (SELECT text_id, entry_id, row_number() OVER (PARTITION BY text_id ORDER BY sum(points) DESC, entry_id) AS entry_place FROM points GROUP BY text_id, entry_id QUALIFY entry_place <= 3),
       own AS (SELECT b.text_id, b.entry_id, k.bullet_id, coalesce(points, 0) AS points, entry_place, row_number() OVER (PARTITION BY b.text_id, b.entry_id ORDER BY coalesce(points, 0) DESC, k.bullet_id) AS bullet_place
         FROM best b JOIN (SELECT DISTINCT entry_id, bullet_id FROM {_TAGS}) k USING (entry_id) LEFT JOIN points USING (text_id, entry_id, bullet_id) QUALIFY bullet_place <= 2)
       SELECT text_id, entry_id, bullet_id, points, entry_place, bullet_place FROM own QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY entry_place, bullet_place) <= 5""",
)
def e6(t):
    out = ranking.select_content(*_content(t))
    return out.withColumns({c: F.col(c).cast("long") for c in ("points", "entry_place", "bullet_place")})


@query("e7_matched_tags", f"SELECT text_id, string_agg(tag, ',' ORDER BY n DESC, tag) AS tags FROM (SELECT text_id, tag, count(*) AS n FROM {_TAG_HITS} GROUP BY ALL) GROUP BY text_id")
def e7(t):
    return ranking.matched_tags(ranking.tag_hits(*_content(t)))


@query(
    "e8_role_detection",
    """SELECT d.doc_id AS text_id, coalesce(role, 'swe') AS role FROM documents d LEFT JOIN (SELECT text_id, arg_min(role, (-n, role <> 'swe', role)) AS role FROM (
         SELECT text_id, role, count(*) AS n FROM (SELECT DISTINCT doc_id AS text_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS signal FROM documents)
         JOIN (SELECT unnest(['the', 'of', 'die', 'und', 'la', 'que']) AS signal, unnest(['swe', 'swe', 'cloud', 'cloud', 'apm', 'apm']) AS role) USING (signal) GROUP BY ALL) GROUP BY text_id) r ON r.text_id = d.doc_id""",
)
def e8(t):
    signals = t.spark.createDataFrame([("swe", "the"), ("swe", "of"), ("cloud", "die"), ("cloud", "und"), ("apm", "la"), ("apm", "que")], "role string, signal string")
    return ranking.detect_role(_content(t)[0], signals)
