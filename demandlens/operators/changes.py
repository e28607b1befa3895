"""Change-data operators: one full join of stored and new rows on their key, then columns that say what changes.

None of these writes a table: the caller does, as a new version (``sources.versions``) or bucket by bucket
(``sources.buckets``), so a lost executor repeats a job and readers never see half of it. A dry run aggregates ``change`` instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_folder


def last_by_key(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key in file order."""
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def lifecycle_upsert(stored: DataFrame, feed: DataFrame, now: Column, mutable: Sequence[str], key: str = "canonical_key", sweep: bool = True) -> DataFrame:
    """New state of all rows with ``change``: new, updated, reactivated, deactivated or kept.

    stored: key, mutable columns, posted_at, first_seen_at, last_seen_at, inactive_at, repost_count. feed: key, mutable columns, posted_at, active.
    A row that returns loses inactive_at and counts a repost; one still dead keeps its first inactive_at; with ``sweep``
    live rows that the feed no longer has are deactivated.
    """
    s, f = stored.alias("s"), feed.alias("f")
    both = s.join(f, F.col(f"s.{key}") == F.col(f"f.{key}"), "full_outer")
    is_new, absent = F.col(f"s.{key}").isNull(), F.col(f"f.{key}").isNull()
    alive, listed = F.col("s.inactive_at").isNull(), F.coalesce("f.active", F.lit(False))
    gone = absent & alive & F.lit(sweep)
    change = F.when(is_new, "new").when(gone, "deactivated").when(absent, "kept").when(~alive & listed, "reactivated").when(alive & ~listed, "deactivated").otherwise("updated")
    return both.select(
        F.coalesce(f"s.{key}", f"f.{key}").alias(key),
        *(F.when(absent, F.col(f"s.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in mutable),
        F.coalesce("s.posted_at", "f.posted_at").alias("posted_at"),
        F.coalesce("s.first_seen_at", now).alias("first_seen_at"),
        F.when(absent, F.col("s.last_seen_at")).otherwise(now).alias("last_seen_at"),
        F.when(gone, now).when(absent, F.col("s.inactive_at")).when(~listed, F.coalesce("s.inactive_at", now)).alias("inactive_at"),
        (F.coalesce("s.repost_count", F.lit(0)) + F.when(change == "reactivated", 1).otherwise(0)).alias("repost_count"),
        change.alias("change"),
    )


def change_counts(changed: DataFrame, names: Sequence[str]) -> DataFrame:
    return changed.agg(*(F.count_if(F.col("change") == n).alias(n) for n in names))


def absent_keys(stored: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    return stored.where("inactive_at is null").join(feed, key, "left_anti")


def chunk_plan(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Action for each (source_type, source_ref, ordinal): insert, update, revive, unchanged or delete.

    Rows are deleted only for source types from which something came; already deleted ones that don't return have no action.
    """
    key = ["source_type", "source_ref", "ordinal"]
    s = stored.select(*key, F.col("text_sha256").alias("old_sha"), "deleted_at", F.lit(True).alias("had"))
    n = new.select(*key, F.col("text_sha256").alias("new_sha"), F.lit(True).alias("has"))
    scanned = new.select("source_type").distinct().withColumn("scanned", F.lit(True))
    both = s.join(n, key, "full_outer").join(scanned, "source_type", "left")
    action = (
        F.when(F.col("had").isNull(), "insert").when(F.col("has").isNull(), F.when(F.col("deleted_at").isNull() & F.col("scanned"), "delete")).when(F.col("deleted_at").isNotNull(), "revive").when(F.col("old_sha") != F.col("new_sha"), "update").otherwise("unchanged")
    )
    return both.select(*key, "old_sha", "new_sha", action.alias("action")).where("action is not null")


def chunks_to_embed(plan: DataFrame) -> DataFrame:
    """Inserted and updated chunks, and revived ones whose text changed."""
    return plan.where("action in ('insert', 'update') or (action = 'revive' and old_sha <> new_sha)")


def bumped_version(plan: DataFrame, version: int) -> DataFrame:
    """The corpus version: one more if anything but 'unchanged' happened."""
    return plan.agg((F.lit(version) + F.coalesce(F.max((F.col("action") != "unchanged").cast("int")), F.lit(0))).cast("long").alias("version"))


def mark_stale(matches: DataFrame, postings: DataFrame) -> DataFrame:
    """Matches of active postings become stale; ``changed`` tells those that weren't."""
    live = postings.where("inactive_at is null").select(F.col("id").alias("posting_id"), F.lit(True).alias("live"))
    out = matches.join(live, "posting_id", "left")
    hit = F.coalesce("live", F.lit(False)) & ~F.col("is_stale")
    return out.withColumn("changed", hit).withColumn("is_stale", F.col("is_stale") | hit).drop("live")


def supersede(matches: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stale rows of recomputed postings (posting_id, evidence_version) at lower versions aren't stale any more."""
    own = recomputed.groupBy("posting_id").agg(F.max("evidence_version").alias("new_version"))
    out = matches.join(own, "posting_id", "left")
    return out.withColumn("is_stale", F.col("is_stale") & ~F.coalesce(F.col("evidence_version") < F.col("new_version"), F.lit(False))).drop("new_version")


def reconcile_names(stored: DataFrame, spec: DataFrame) -> DataFrame:
    """Per name: created, updated, unchanged or orphan (left alone)."""
    s, n = stored.alias("s"), spec.alias("n")
    same = (F.col("s.category") == F.col("n.category")) & (F.col("s.is_actionable") == F.col("n.is_actionable"))
    change = F.when(F.col("s.name").isNull(), "created").when(F.col("n.name").isNull(), "orphan").when(same, "unchanged").otherwise("updated")
    return s.join(n, F.col("s.name") == F.col("n.name"), "full_outer").select(F.coalesce("s.name", "n.name").alias("name"), change.alias("change"))


def reconcile_aliases(stored: DataFrame, spec: DataFrame) -> DataFrame:
    """Per normalised alias: added, removed, moved (another owner), retitled (another spelling) or unchanged. Aliases of
    owners that the spec doesn't name stay."""
    s, n = stored.alias("s"), spec.alias("n")
    owners = spec.select(F.col("owner").alias("known")).distinct()
    change = F.when(F.col("s.alias_norm").isNull(), "added").when(F.col("n.alias_norm").isNull(), "removed").when(F.col("s.owner") != F.col("n.owner"), "moved").when(F.col("s.alias") != F.col("n.alias"), "retitled").otherwise("unchanged")
    joined = s.join(n, F.col("s.alias_norm") == F.col("n.alias_norm"), "full_outer").join(owners, F.col("s.owner") == F.col("known"), "left")
    return joined.where("n.alias_norm is not null or known is not null").select(F.coalesce("s.alias_norm", "n.alias_norm").alias("alias_norm"), change.alias("change"))


def candidate_counts(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored candidates with the new sightings added: first example and status kept, the smallest posting as a new example."""
    new = seen.groupBy("raw_norm").agg(F.count(F.lit(1)).alias("n"), F.min("posting_id").alias("first"))
    return stored.join(new, "raw_norm", "full_outer").select("raw_norm", (F.coalesce("seen_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("seen_count"), F.coalesce("example_posting_id", "first").alias("example_posting_id"), "status")


def triage(decisions: DataFrame, candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """Decisions (raw_norm, decision) on candidates: accepted, rejected, or refused as unknown, too_long or alias_taken."""
    taken = aliases.select(F.col("alias_norm").alias("raw_norm"), F.lit(True).alias("taken")).distinct()
    known = candidates.select("raw_norm", F.lit(True).alias("known"))
    out = decisions.join(known, "raw_norm", "left").join(taken, "raw_norm", "left")
    result = F.when(F.col("known").isNull(), "unknown").when(F.col("decision") == "reject", "rejected").when(F.length("raw_norm") > 128, "too_long").when(F.col("taken"), "alias_taken").otherwise("accepted")
    return out.select("raw_norm", "decision", result.alias("result"))


def apply_tags(existing: DataFrame, asked: DataFrame, skills: DataFrame) -> DataFrame:
    """Tags asked for by skill name in any case (chunk_id, name): added, present or unknown_skill."""
    wanted = asked.select("chunk_id", F.lower("name").alias("low")).distinct()
    found = wanted.join(skills.select(F.lower("name").alias("low"), F.col("id").alias("skill_id")), "low", "left").join(existing.select("chunk_id", "skill_id", F.lit(True).alias("has")), ["chunk_id", "skill_id"], "left")
    return found.select("chunk_id", "low", F.when(F.col("skill_id").isNull(), "unknown_skill").when(F.col("has"), "present").otherwise("added").alias("result"))


def cache_work(requests: DataFrame, matches: DataFrame, key: Sequence[str]) -> DataFrame:
    """Requests that no fresh match answers under the whole key."""
    return requests.join(matches.where("not is_stale").select(*key), list(key), "left_anti")


def cache_split(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("cache_key", "payload"), "cache_key", "left").withColumn("hit", F.col("payload").isNotNull())


def within_budget(rows: DataFrame, budget: float, group: str, order: Sequence[Column], cost: str) -> DataFrame:
    """Rows of each group in order for as long as the cost before them is within the budget."""
    before = F.sum(cost).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_spent", F.coalesce(before, F.lit(0))).where(F.col("_spent") <= budget).drop("_spent")


def run_budget(rows: DataFrame, budget: float, order: Sequence[str], cost: str, run: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Rows of each run, in order, until its spending exceeds the budget, with ``spent``, the exact sum of the costs before
    them: the row that overspends is kept and the rest dropped. Without ``run`` all rows are one run.

    A distributed prefix sum, so one run may be as large as a table: rows are dealt by ranges of (run, order) and written
    in that order below the shared folder (or to ``path``); each range adds up its own costs; sums of the ranges before (one row a range and run) are added
    to running sums inside each. Costs are added as decimals with nine places; null ones count as 0 and none may be negative. Rows that are
    equal in ``order`` come in any order.
    """
    spark, run = rows.sparkSession, list(run)
    path = path or shared_folder(spark, "budget")
    dealt = rows.repartitionByRange(*run, *order).sortWithinPartitions(*run, *order)
    dealt.withColumns({"_cost": F.coalesce(F.col(cost).cast("decimal(28,9)"), F.lit(0)), "_at": F.monotonically_increasing_id()}).write.parquet(path)
    kept = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    sums = kept.groupBy(*run, "_part").agg(F.sum("_cost").alias("_sum"))
    earlier = Window.partitionBy(*run).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).where(F.col("_start") <= budget).drop("_sum")
    own = Window.partitionBy(*run, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    if run:
        same = reduce(and_, (F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*run, "_part"]))
        met = kept.alias("k").join(starts.alias("s"), same).select("k.*", "s._start")
    else:
        met = kept.join(starts, "_part")
    spent = F.col("_start") + F.coalesce(F.sum("_cost").over(own), F.lit(0))
    return met.withColumn("spent", spent).where(F.col("spent") <= budget).drop("_cost", "_at", "_part", "_start")


def text_rows(log: DataFrame) -> DataFrame:
    """State of each posting's text after its attempts: number, last outcome, and the last success's text place."""
    ok = F.col("outcome") == "ok"
    order = F.struct("at", "id")
    return log.groupBy("posting_id").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("outcome", order).alias("fetch_status"), F.max_by(F.when(ok, F.col("id")), F.when(ok, order)).alias("text_from"))
