"""Set operations and change data (G, L)."""

import uuid

from pyspark.sql import functions as F

from ..operators import changes
from ..shared import shared_folder
from ..sources import buckets, versions
from .registry import query

KEY = "canonical_key"


def _stored(t):
    """Run 1 saw nine tenths of the customers; some are dead already."""
    return t.read("customer").where("c_custkey % 10 <> 0").selectExpr(
        "c_custkey AS canonical_key", "c_name AS company", "c_mktsegment AS title", "cast(null AS timestamp) AS posted_at", "timestamp'2026-01-01 00:00:00' AS first_seen_at", "timestamp'2026-01-01 00:00:00' AS last_seen_at",
        "CASE WHEN c_custkey % 4 = 0 THEN timestamp'2026-01-02 00:00:00' END AS inactive_at", "cast(c_custkey % 3 AS int) AS repost_count",
    )


def _feed(t):
    return t.read("customer").where("c_custkey % 7 <> 0").selectExpr("c_custkey AS canonical_key", "c_name AS company", "concat(c_mktsegment, '!') AS title", "cast(null AS timestamp) AS posted_at", "c_custkey % 11 <> 0 AS active")


def _upserted(t):
    return changes.lifecycle_upsert(_stored(t), _feed(t), F.lit("2026-02-01").cast("timestamp"), ["company", "title"])


_CHANGE = """SELECT c_custkey AS canonical_key, CASE WHEN NOT s THEN 'new' WHEN NOT f AND alive THEN 'deactivated' WHEN NOT f THEN 'kept' WHEN NOT alive AND live THEN 'reactivated' WHEN alive AND NOT live THEN 'deactivated' ELSE 'updated' END AS change,
  CASE WHEN f THEN c_mktsegment || '!' ELSE c_mktsegment END AS title, CAST(CASE WHEN s THEN c_custkey % 3 ELSE 0 END + CASE WHEN s AND f AND NOT alive AND live THEN 1 ELSE 0 END AS INT) AS repost_count,
  CASE WHEN s AND NOT alive AND NOT (f AND live) THEN '2026-01-02' WHEN (f AND NOT live) OR (s AND NOT f) THEN '2026-02-01' END AS inactive_at
  FROM (SELECT *, c_custkey % 10 <> 0 AS s, c_custkey % 7 <> 0 AS f, c_custkey % 4 <> 0 AS alive, c_custkey % 11 <> 0 AS live FROM customer) WHERE s OR f"""


@query("l1_lifecycle_upsert", _CHANGE)
def l1(t):
    return _upserted(t).select(KEY, "change", "title", "repost_count", F.date_format("inactive_at", "yyyy-MM-dd").alias("inactive_at"))


@query("l1_bucketed_upsert", _CHANGE.replace("c_custkey % 7 <> 0 AS f", "c_custkey % 7 = 3 AND c_custkey % 64 < 9 AS f").replace("NOT f AND alive THEN 'deactivated'", "NOT f AND alive THEN 'kept'").replace("(s AND NOT f) THEN", "false THEN"))
def l1_bucketed(t):
    """A part of the feed merged into the stored table, which is in buckets: only those that it touches are rewritten."""
    stored = _stored(t).withColumn("change", F.lit("kept"))
    table = buckets.BucketedTable(t.spark, f"postings_{uuid.uuid4().hex}", [KEY], 16).create(stored, shared_folder(t.spark, "buckets"))
    feed = _feed(t).where("canonical_key % 7 = 3 AND canonical_key % 64 < 9")
    table.merge(feed, lambda old, new: changes.lifecycle_upsert(old, new, F.lit("2026-02-01").cast("timestamp"), ["company", "title"], sweep=False))
    return table.read().select(KEY, "change", "title", "repost_count", F.date_format("inactive_at", "yyyy-MM-dd").alias("inactive_at"))


@query("l2_ingest_counts", f"SELECT count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'reactivated') AS reactivated, count(*) FILTER (change = 'deactivated') AS deactivated FROM ({_CHANGE})")
def l2(t):
    return changes.change_counts(_upserted(t), ["new", "updated", "reactivated", "deactivated"])


@query("g1_orphan_names", "SELECT name FROM skill WHERE id % 5 = 0")
def g1(t):
    return t.skill.select("name").join(t.skill.where("id % 5 <> 0").select("name"), "name", "left_anti")


@query("g2_absent_keys", "SELECT c_custkey AS canonical_key FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 7 = 0")
def g2(t):
    return changes.absent_keys(_stored(t), _feed(t), KEY).select(KEY)


def _plan(t):
    d = t.read("documents")
    stored = d.where("doc_id % 10 <> 0").selectExpr("CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS source_type", "doc_id AS source_ref", "0 AS ordinal", "sha2(text, 256) AS text_sha256", "CASE WHEN doc_id % 9 = 0 THEN 'gone' END AS deleted_at")
    new = d.where("doc_id % 7 <> 0 and doc_id % 2 = 0").selectExpr("'a' AS source_type", "doc_id AS source_ref", "0 AS ordinal", "sha2(CASE WHEN doc_id % 4 = 0 THEN concat(text, ' edited') ELSE text END, 256) AS text_sha256")
    return changes.chunk_plan(stored, new)


_PLAN = """SELECT doc_id AS source_ref, CASE WHEN doc_id % 10 = 0 THEN 'insert' WHEN doc_id % 7 = 0 THEN 'delete' WHEN doc_id % 9 = 0 THEN 'revive' WHEN doc_id % 4 = 0 THEN 'update' ELSE 'unchanged' END AS action FROM documents
  WHERE doc_id % 2 = 0 AND (doc_id % 10 <> 0 OR doc_id % 7 <> 0) AND NOT (doc_id % 7 = 0 AND doc_id % 9 = 0)"""


@query("l3_chunk_plan", _PLAN)
def l3(t):
    return _plan(t).select("source_ref", "action")


@query("l4_chunks_to_embed", f"SELECT source_ref, action FROM ({_PLAN}) WHERE action IN ('insert', 'update') OR (action = 'revive' AND source_ref % 4 = 0)")
def l4(t):
    return changes.chunks_to_embed(_plan(t)).select("source_ref", "action")


@query("l6_version_bump", f"SELECT CAST(7 + max(CASE WHEN action <> 'unchanged' THEN 1 ELSE 0 END) AS BIGINT) AS version FROM ({_PLAN})")
def l6(t):
    return changes.bumped_version(_plan(t), 7)


@query("l6_version_publish", f"SELECT m.id, is_stale OR EXISTS (SELECT 1 FROM posting p WHERE p.id = m.posting_id AND inactive_at IS NULL) AS is_stale, CAST(8 AS BIGINT) AS version FROM matches m WHERE EXISTS (SELECT 1 FROM ({_PLAN}) WHERE action <> 'unchanged')")
def l6_published(t):
    """The evidence version and the stale matches, published together and read back."""
    tables = versions.VersionedTables(t.spark, shared_folder(t.spark, "versions"))
    first = tables.publish({"evidence": t.spark.range(1).selectExpr("7L AS version", "'first' AS reason"), "matches": t.matches}, tables.current())
    versions.bump_evidence(tables, first, _plan(t), t.posting, "new documents")
    last = tables.current()
    return last.read("matches").select("id", "is_stale").crossJoin(F.broadcast(last.read("evidence").select("version")))


@query("l5_reconcile_names", "SELECT name, CASE WHEN id % 6 = 0 THEN 'created' WHEN id % 7 = 0 THEN 'orphan' WHEN id % 4 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM skill WHERE NOT (id % 6 = 0 AND id % 7 = 0)")
def l5(t):
    s = t.skill
    return changes.reconcile_names(s.where("id % 6 <> 0"), s.where("id % 7 <> 0").withColumn("category", F.when(F.col("id") % 4 == 0, "moved").otherwise(F.col("category"))))


@query("l5_reconcile_aliases", """SELECT lower(name) AS alias_norm, CASE WHEN id % 6 = 0 THEN 'added' WHEN id % 7 = 0 THEN 'removed' WHEN id % 4 = 0 THEN 'moved' WHEN id % 3 = 0 THEN 'retitled' ELSE 'unchanged' END AS change FROM skill WHERE NOT (id % 6 = 0 AND id % 7 = 0)""")
def l5_aliases(t):
    base = t.skill.select("id", F.lower("name").alias("alias_norm"), F.col("name").alias("alias"), F.lit("x").alias("owner"))
    new = base.where("id % 7 <> 0").withColumn("owner", F.when(F.col("id") % 4 == 0, "y").otherwise(F.col("owner"))).withColumn("alias", F.when(F.col("id") % 3 == 0, F.upper("alias")).otherwise(F.col("alias")))
    return changes.reconcile_aliases(base.where("id % 6 <> 0").drop("id"), new.drop("id"))


def _requests(t):
    return t.matches.selectExpr("posting_id + cast(id % 3 = 0 AS int) AS posting_id", "evidence_version", "prompt_version")


@query("l7_cache_work", "SELECT r.posting_id, r.evidence_version FROM (SELECT posting_id + CAST(id % 3 = 0 AS INT) AS posting_id, evidence_version, prompt_version FROM matches) r WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE NOT is_stale AND m.posting_id = r.posting_id AND m.evidence_version = r.evidence_version AND m.prompt_version = r.prompt_version)")
def l7(t):
    return changes.cache_work(_requests(t), t.matches, ["posting_id", "evidence_version", "prompt_version"]).select("posting_id", "evidence_version")


@query("l8_supersede", "SELECT m.id, is_stale AND NOT coalesce(evidence_version < v, false) AS is_stale FROM matches m LEFT JOIN (SELECT posting_id, max(evidence_version) AS v FROM matches WHERE NOT is_stale GROUP BY posting_id) n USING (posting_id)")
def l8(t):
    return changes.supersede(t.matches, t.matches.where("not is_stale")).select("id", "is_stale")


@query("l9_cache_split", "SELECT id, skill_id % 3 = 0 AND skill_id IS NOT NULL AS hit FROM requirement")
def l9(t):
    from ..functions.columns import cache_key

    cache = t.skill.where("id % 3 = 0").select(cache_key(F.lit("skill"), F.col("id").cast("string")).alias("cache_key"), F.lit("{}").alias("payload"))
    return changes.cache_split(t.requirement.select("id", cache_key(F.lit("skill"), F.coalesce(F.col("skill_id").cast("string"), F.lit("none"))).alias("cache_key")), cache).select("id", "hit")


@query("l10_run_budget", "SELECT id FROM (SELECT id, sum(quantity) OVER (PARTITION BY skill_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM requirement WHERE skill_id IS NOT NULL) WHERE coalesce(before, 0) <= 500")
def l10(t):
    return changes.within_budget(t.requirement.where("skill_id is not null"), 500, "skill_id", [F.asc("id")], "quantity").select("id")


@query("l10_whole_run", "SELECT id, spent FROM (SELECT id, coalesce(CAST(sum(quantity) OVER (ORDER BY id, quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS spent FROM requirement) WHERE spent <= 60000")
def l10_whole(t):
    """All requirements as one run."""
    return changes.run_budget(t.requirement, 60_000, ["id", "quantity"], "quantity").select("id", F.col("spent").cast("double").alias("spent"))


@query("l11_candidate_triage", """SELECT raw_norm, decision, CASE WHEN NOT known THEN 'unknown' WHEN decision = 'reject' THEN 'rejected' WHEN length(raw_norm) > 128 THEN 'too_long' WHEN taken THEN 'alias_taken' ELSE 'accepted' END AS result
  FROM (SELECT CASE WHEN p_partkey % 13 = 0 THEN repeat('x', 129) || p_partkey ELSE lower(p_name) || ' ' || p_partkey END AS raw_norm, CASE WHEN p_partkey % 4 = 0 THEN 'reject' ELSE 'approve' END AS decision, p_partkey % 9 <> 0 AS known, p_partkey % 13 <> 0 AS taken FROM part)""")
def l11(t):
    part = t.read("part").withColumn("raw_norm", F.when(F.col("p_partkey") % 13 == 0, F.concat(F.lit("x" * 129), "p_partkey")).otherwise(F.concat(F.lower("p_name"), F.lit(" "), "p_partkey")))
    return changes.triage(part.selectExpr("raw_norm", "CASE WHEN p_partkey % 4 = 0 THEN 'reject' ELSE 'approve' END AS decision"), part.where("p_partkey % 9 <> 0"), t.skill_alias.select(F.lower("alias").alias("alias_norm")))


@query("l12_tags", """SELECT chunk_id, low, CASE WHEN c % 5 = 0 THEN 'unknown_skill' WHEN EXISTS (SELECT 1 FROM citation k WHERE k.chunk_id = a.chunk_id AND k.skill_id = a.skill_id AND k.status = 'evidenced') THEN 'present' ELSE 'added' END AS result
  FROM (SELECT DISTINCT chunk_id, skill_id, skill_id AS c, CASE WHEN skill_id % 5 = 0 THEN 'no such ' || skill_id ELSE lower(name) END AS low FROM citation JOIN skill s ON s.id = skill_id WHERE chunk_id IS NOT NULL) a""")
def l12(t):
    own = t.citation.where("chunk_id is not null and skill_id is not null")
    asked = own.join(t.skill.select(F.col("id").alias("skill_id"), "name"), "skill_id").select("chunk_id", F.when(F.col("skill_id") % 5 == 0, F.concat(F.lit("NO such "), "skill_id")).otherwise(F.upper("name")).alias("name"))
    return changes.apply_tags(own.where("status = 'evidenced'").select("chunk_id", "skill_id").distinct(), asked, t.skill)


@query("l14_text_rows", """SELECT posting_id, count(*) AS attempts, arg_max(outcome, (f.at, f.id)) AS fetch_status, arg_max(id, (f.at, f.id)) FILTER (outcome = 'ok') AS text_from FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'ok' WHEN 'error' THEN 'transient_error' ELSE 'not_found' END AS outcome FROM fetch_log) f GROUP BY posting_id""")
def l14(t):
    return changes.text_rows(t.fetch_log.withColumn("outcome", F.expr("CASE event_type WHEN 'signup' THEN 'ok' WHEN 'error' THEN 'transient_error' ELSE 'not_found' END")))
