"""Demand reports: gap, trend, coverage, costs. Aggregations with map-side combine; dimensions join afterwards."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CREDIT, DROP_REASONS, FLAGS, MATCH_WEIGHTS, ReportConfig
from ..functions.columns import ranked
from ..shared import shared_folder
from .filters import active, eligible, report_eligible


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key into twice as many tasks as the session shuffles into, none of which are merged: at that number itself
    the deal would give way to a join's own, whose tasks are merged until they are large.

    Distinct pairs of skill and ``key`` are then counted in a share of the rows each, not in one hash table of a whole split, few of whose pairs are equal. A join by the key keeps this partitioning.
    """
    return rows.repartition(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def eligible_requirements(postings: DataFrame, requirements: DataFrame, cfg: ReportConfig) -> DataFrame:
    return requirements.join(eligible(postings, cfg).select(F.col("id").alias("posting_id")), "posting_id", "left_semi")


def fresh_citations(citations: DataFrame, matches: DataFrame) -> DataFrame:
    fresh = matches.where("not is_stale").select(F.col("id").alias("match_id"))
    return citations.where("skill_id is not null").join(fresh, "match_id")


def spread_citations(citations: DataFrame) -> DataFrame:
    """What ``status_fold`` counts, dealt by match."""
    return spread(citations.where("skill_id is not null").select("match_id", "skill_id", "status"), "match_id")


def spread_requirements(requirements: DataFrame) -> DataFrame:
    """What ``importance_histogram`` counts, dealt by posting."""
    return spread(requirements.where("skill_id is not null").select("posting_id", "skill_id", "importance"), "posting_id")


def importance_histogram(req: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("importance") == i).alias(f"{i}_count") for i in ("required", "preferred", "mentioned")]
    return req.where("skill_id is not null").groupBy("skill_id").agg(*counts, F.countDistinct("posting_id").alias("posting_count"))


def status_fold(citations: DataFrame) -> DataFrame:
    rank = F.coalesce(ranked(F.col("status"), {"evidenced": 3, "weak": 2}), F.lit(1))
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_citations") for s in ("evidenced", "weak", "absent")]
    return citations.groupBy("skill_id").agg(F.max(rank).alias("best_rank"), *counts, F.countDistinct("match_id").alias("matches_considered"))


def with_skill_status(histogram: DataFrame, skills: DataFrame, status: DataFrame) -> DataFrame:
    """Counts of actionable skills with the best status ever seen; 'absent' and zeros where there is no citation."""
    named = F.when(F.col("best_rank") == 3, "evidenced").when(F.col("best_rank") == 2, "weak").otherwise("absent")
    zero = ["evidenced_citations", "weak_citations", "absent_citations", "matches_considered"]
    joined = histogram.join(skills.where("is_actionable").select(F.col("id").alias("skill_id"), F.col("name").alias("skill"), "category"), "skill_id").join(status, "skill_id", "left")
    return joined.withColumn("status", named).withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zero}).drop("best_rank")


def gap_totals(postings: DataFrame, requirements: DataFrame, cfg: ReportConfig, version: DataFrame | None = None) -> DataFrame:
    """One row: eligible postings, their requirements, mapped and unmapped, and the evidence version (0 if none)."""
    # requirements are counted by posting first, so that one pass over the eligible postings gives both numbers
    per_posting = requirements.groupBy("posting_id").agg(F.count(F.lit(1)).alias("n"), F.count("skill_id").alias("mapped"))
    counted = eligible(postings, cfg).select(F.col("id").alias("posting_id")).join(per_posting, "posting_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = counted.agg(
        F.count(F.lit(1)).alias("eligible_posting_count"), total("n").alias("total_requirement_count"), total("mapped").alias("mapped_requirement_count"), (total("n") - total("mapped")).alias("unmapped_requirement_count")
    )
    return counts.crossJoin(_version(postings.sparkSession, version))  # one row each


def _version(spark: SparkSession, version: DataFrame | None) -> DataFrame:
    known = version if version is not None else spark.range(0).withColumnRenamed("id", "version")
    return known.agg(F.coalesce(F.max("version"), F.lit(0)).cast("long").alias("evidence_version"))


def gap_order() -> list[Column]:
    return [F.desc_nulls_last(c) for c in ("required_count", "preferred_count", "mentioned_count", "posting_count")] + [F.asc_nulls_last("skill")]


def with_totals(listed: DataFrame, totals: DataFrame) -> DataFrame:
    """The totals before every row; one row with them alone if nothing is listed."""
    return totals.join(listed, F.lit(True), "left")


def demand_by_skill(postings: DataFrame, requirements: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Per skill (null for unmapped requirements and for postings without any): the histogram of its requirements among eligible
    postings, all of these requirements (n), and ``postings``, in which each eligible posting counts for one of its skills.

    Postings are judged and joined once; what follows keeps their partitioning until it is one row a skill.
    """
    names = ("required", "preferred", "mentioned")
    asked = requirements.select("posting_id", "skill_id", "importance", F.lit(1).alias("asked"))
    own = eligible(postings, cfg).select(F.col("id").alias("posting_id")).join(asked, "posting_id", "left")
    pairs = own.groupBy("posting_id", "skill_id").agg(F.count("asked").alias("n"), *(F.count_if(F.col("importance") == i).alias(f"{i}_count") for i in names))
    first = F.row_number().over(Window.partitionBy("posting_id").orderBy("skill_id")) == 1
    return pairs.withColumn("first", first).groupBy("skill_id").agg(
        *(F.sum(f"{i}_count").alias(f"{i}_count") for i in names), F.count_if(F.col("n") > 0).alias("posting_count"), F.sum("n").alias("n"), F.count_if("first").alias("postings")
    )


def gap_report(postings: DataFrame, requirements: DataFrame, skills: DataFrame, matches: DataFrame, citations: DataFrame, cfg: ReportConfig, version: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Demand for each actionable skill among eligible postings with its evidence status; gaps are 'absent' or 'weak'.

    The demand by skill is written below the shared folder (or to ``path``), as the totals and the list both read it.
    """
    spark, path = postings.sparkSession, path or shared_folder(postings.sparkSession, "demand")
    counted = demand_by_skill(postings, requirements, cfg)
    counted.write.parquet(path)
    by_skill = spark.read.schema(counted.schema).parquet(path)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    mapped = F.when(F.col("skill_id").isNotNull(), F.col("n"))
    totals = by_skill.agg(
        total("postings").alias("eligible_posting_count"), total("n").alias("total_requirement_count"), total(mapped).alias("mapped_requirement_count"), (total("n") - total(mapped)).alias("unmapped_requirement_count")
    ).crossJoin(_version(spark, version))  # one row each
    histogram = by_skill.where("skill_id is not null").drop("n", "postings")
    listed = with_skill_status(histogram, skills, status_fold(fresh_citations(spread_citations(citations), matches)))
    return with_totals(listed, totals).withColumn("is_gap", F.col("status").isin("absent", "weak"))


def taxonomy_coverage(totals: DataFrame) -> DataFrame:
    share = F.when(F.col("total_requirement_count") > 0, F.col("mapped_requirement_count") / F.col("total_requirement_count")).otherwise(0.0)
    return totals.select("total_requirement_count", "mapped_requirement_count", share.alias("coverage"))


def funnel(postings: DataFrame, judged: DataFrame) -> DataFrame:
    """Count for every drop reason in order, zeros included, then 'kept'; inactive postings are those not judged."""
    spark = postings.sparkSession
    order = spark.createDataFrame([(i, r) for i, r in enumerate((*DROP_REASONS, "kept"))], "ord int, reason string")
    counts = judged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).count()
    dead = postings.agg(F.count_if(~active()).alias("count")).select(F.lit("inactive").alias("reason"), "count")
    return order.join(counts.unionByName(dead), "reason", "left").select("ord", "reason", F.coalesce("count", F.lit(0).cast("long")).alias("n"))


def flag_counts(kept: DataFrame) -> DataFrame:
    names = kept.sparkSession.createDataFrame([(f,) for f in FLAGS], "flag string")
    counts = kept.select(F.explode("flags").alias("flag")).groupBy("flag").count()
    return names.join(counts, "flag", "left").select("flag", F.coalesce("count", F.lit(0).cast("long")).alias("n"))


def adapter_coverage(postings: DataFrame, jd: DataFrame, variant: str = "report") -> DataFrame:
    """Active postings by adapter. 'report' wants a text for 'resolved', 'worker' only the status 'ok'."""
    if variant == "report":
        none, resolved = "(none)", (F.col("fetch_status") == "ok") & F.col("raw_text").isNotNull() & (F.col("char_count") > 0)
    else:
        none, resolved = "unattempted", F.col("fetch_status") == "ok"
    joined = postings.where(active()).select(F.col("id").alias("posting_id")).join(jd, "posting_id", "left")
    return joined.groupBy(F.coalesce("adapter", F.lit(none)).alias("adapter")).agg(F.count(F.lit(1)).alias("total"), F.count_if(resolved).alias("resolved"))


def fetch_status_counts(postings: DataFrame, jd: DataFrame) -> DataFrame:
    joined = postings.where(active()).select(F.col("id").alias("posting_id")).join(jd, "posting_id", "left")
    return joined.groupBy(F.coalesce("fetch_status", F.lit("(no row)")).alias("fetch_status")).agg(F.count(F.lit(1)).alias("n"))


def trend_report(mentions: DataFrame, now: dt.datetime, days: int = 30, bucket_days: int = 7) -> DataFrame:
    """Per skill: mentions in the window, in its recent half and before, weekly counts (oldest first), direction, distinct
    required postings and postings dropped since the half.

    ``mentions``: skill_id, posting_id, first_seen_at, last_seen_at, inactive_at, importance. For odd windows the older half is a day longer; the oldest bucket
    takes what is left over. Distinct postings are made before anything is counted, so a bucket is a plain sum.
    """
    half, buckets = days // 2, max(1, math.ceil(days / bucket_days))
    start, half_start = now - dt.timedelta(days=days), now - dt.timedelta(days=half)
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("first_seen_at").cast("timestamp"))) / 86_400_000_000).cast("int")
    named = mentions.where("skill_id is not null")
    seen = named.where(F.col("first_seen_at").between(F.lit(start), F.lit(now))).groupBy("skill_id", "posting_id").agg(F.min(age).alias("days_ago"), F.max((F.col("importance") == "required").cast("int")).alias("required"))
    slot = F.least(F.floor(F.col("days_ago") / bucket_days), F.lit(buckets - 1))
    counted = seen.groupBy("skill_id").agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("days_ago") < half).alias("recent_count"), F.count_if(F.col("days_ago") >= half).alias("prior_count"),
        F.sum("required").alias("required_count"), F.array(*(F.count_if(slot == i) for i in reversed(range(buckets)))).alias("weekly_counts"),
    )
    dropped = named.where(F.col("inactive_at").isNotNull() & (F.col("last_seen_at") >= F.lit(half_start))).groupBy("skill_id").agg(F.countDistinct("posting_id").alias("dropped_count"))
    delta = F.col("recent_count") - F.col("prior_count")
    return counted.join(dropped, "skill_id", "left").withColumns({"dropped_count": F.coalesce("dropped_count", F.lit(0).cast("long")), "delta": delta, "direction": F.when(delta > 0, "rising").when(delta < 0, "falling").otherwise("flat")})


def trend_mentions(postings: DataFrame, requirements: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Requirements with the dates of their postings, inactive ones included."""
    dates = postings.where(report_eligible(cfg)).select(F.col("id").alias("posting_id"), "first_seen_at", "last_seen_at", "inactive_at")
    return requirements.select("posting_id", "skill_id", "importance").join(dates, "posting_id")


def bucket_starts(spark, now: dt.datetime, days: int = 30, bucket_days: int = 7) -> DataFrame:
    n = max(1, math.ceil(days / bucket_days))
    at = F.greatest(F.lit(now - dt.timedelta(days=days)), F.lit(now) - F.make_dt_interval((F.lit(n) - F.col("id")).cast("int") * bucket_days))
    return spark.range(n).select(F.col("id").alias("bucket"), at.alias("starts_at"))


def window_trustworthy(postings: DataFrame, start: dt.datetime) -> DataFrame:
    return postings.agg(F.coalesce(F.min("first_seen_at") <= F.lit(start), F.lit(False)).alias("trustworthy"))


def skill_demand(skills: DataFrame, aliases: DataFrame, requirements: DataFrame, postings: DataFrame) -> DataFrame:
    """Per skill: aliases, and requirements, postings and required ones over active postings; zeros included."""
    # the join moves below the requirements' deal, so its other side is dealt alike
    live = spread_requirements(requirements).join(spread(postings.where(active()).select(F.col("id").alias("posting_id")), "posting_id"), "posting_id", "left_semi")
    demand = live.groupBy("skill_id").agg(F.count(F.lit(1)).alias("requirement_count"), F.countDistinct("posting_id").alias("posting_count"), F.count_if(F.col("importance") == "required").alias("required_count"))
    names = aliases.groupBy("skill_id").agg(F.count(F.lit(1)).alias("alias_count"))
    out = skills.select(F.col("id").alias("skill_id"), "name").join(names, "skill_id", "left").join(demand, "skill_id", "left")
    return out.na.fill(0, ["alias_count", "requirement_count", "posting_count", "required_count"])


def match_scores(citations: DataFrame) -> DataFrame:
    weight, credit = ranked(F.col("importance"), MATCH_WEIGHTS), ranked(F.col("status"), CREDIT)
    score = F.sum(weight * credit) / F.sum(weight)
    return citations.groupBy("match_id").agg(F.round(F.coalesce(score, F.lit(0.0)), 4).alias("score"), F.count(F.lit(1)).alias("n"))


def stage_costs(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row a run with the sum and number of each metric, and a row '(all)' for all runs."""
    sums = [f(F.when(F.col("metric") == m, F.col("value"))).alias(f"{m}_{n}") for m in names for f, n in ((F.sum, "sum"), (F.count, "n"))]
    return metrics.rollup("run_id").agg(*sums).withColumn("run_id", F.coalesce("run_id", F.lit("(all)")))


def cost_summary(metrics: DataFrame, matches: DataFrame, stage: str) -> DataFrame:
    own = metrics.where(F.col("stage") == stage)
    of = lambda m: F.col("metric") == m
    sums = own.agg(
        F.sum(F.when(of("cost_usd"), F.col("value"))).alias("cost"), F.sum(F.when(of("tokens"), F.col("value"))).alias("tokens"),
        F.try_divide(F.sum(F.when(of("cache_hit"), F.col("value"))), F.count_if(of("cache_hit"))).alias("hit_rate"), F.count_if(of("calls")).alias("calls"),
    )
    stale = matches.agg(F.count_if("is_stale").alias("stale_matches"), F.count(F.lit(1)).alias("all_matches"))
    return sums.crossJoin(stale).withColumn("cost_per_match", F.try_divide("cost", "all_matches"))  # one row each


def latest_run(runs: DataFrame, at: str) -> DataFrame:
    return runs.agg(F.max_by("run_id", F.struct(at, "run_id")).alias("run_id"))


def percentiles(log: DataFrame) -> DataFrame:
    return log.groupBy("host").agg(F.percentile("seconds", 0.5).alias("p50"), F.percentile("seconds", 0.99).alias("p99"), F.count(F.lit(1)).alias("n"))


def strongest_spans(requirements: DataFrame) -> DataFrame:
    """One row a posting and span: strongest importance, highest confidence."""
    rank = ranked(F.col("importance"), {"required": 3, "preferred": 2, "mentioned": 1})
    return requirements.groupBy("posting_id", "raw_text").agg(F.max_by("importance", rank).alias("importance"), F.max("confidence").alias("confidence"))


def funnel_readback(metrics: DataFrame, order: list[str]) -> DataFrame:
    """Latest value of each metric, the known ones in their order, others after them by name."""
    known = metrics.sparkSession.createDataFrame([(m, i) for i, m in enumerate(order)], "metric string, ord int")
    last = metrics.groupBy("metric").agg(F.max_by("value", F.struct("recorded_at", "id")).alias("value"))
    placed = last.join(known, "metric", "left").withColumn("ord", F.coalesce("ord", F.lit(len(order))))
    return placed.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("ord", "metric"))).select("place", "metric", "value")


def tags_per_chunk(tags: DataFrame, skills: DataFrame) -> DataFrame:
    named = tags.join(skills.select(F.col("id").alias("skill_id"), "name"), "skill_id")
    return named.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("tags"))


def batch_outcomes(outcomes: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("matched", "failed", "skipped")]
    return outcomes.agg(F.count(F.lit(1)).alias("total"), *counts, F.count_if("from_cache").alias("from_cache"), F.sum("cost").alias("cost"), F.sum(F.when(~F.col("from_cache"), F.col("cost")).otherwise(0.0)).alias("new_cost"))
