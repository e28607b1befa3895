"""Eligibility and filter rules: boolean and state columns, applied in one pass over the postings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KNOWN_ROLE_TYPES, RankConfig, ReportConfig
from ..functions.columns import ilike_any


def active() -> Column:
    return F.col("inactive_at").isNull()


def report_eligible(cfg: ReportConfig) -> Column:
    """Role in the list or unknown, sponsorship not blocked, remote or a listed location or none given."""
    if not cfg.apply:
        return F.lit(True)
    ok = F.lit(True)
    if cfg.role_types:
        ok = F.col("role_type").isNull() | F.lower("role_type").isin(list(cfg.role_types))
    if not cfg.allow_sponsorship_required:
        ok = ok & (F.col("sponsorship").isNull() | ~ilike_any(F.col("sponsorship"), cfg.sponsorship_blocklist))
    if cfg.location_patterns:
        ok = ok & (F.col("is_remote") | F.col("locations").isNull() | (F.size("locations") == 0) | F.exists("locations", lambda x: ilike_any(x, cfg.location_patterns)))
    return F.coalesce(ok, F.lit(False))


def eligible(postings: DataFrame, cfg: ReportConfig) -> DataFrame:
    return postings.where(active() & report_eligible(cfg))


def sponsorship_class(c: Column) -> Column:
    # The phrases of each class.
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    return (
        F.when(norm == "", "unknown")
        .when(norm.rlike("offshore|outside the us|non us only"), "offshore")
        .when(norm.rlike("citizen|clearance|green card|permanent resid"), "citizenship")
        .when(norm.rlike("does not offer|no sponsorship|not offer sponsorship|sponsorship not (offered|available)|without sponsorship"), "not_offered")
        .when(norm.rlike("offers sponsorship"), "offers")
        .otherwise("unknown")
    )


def location_ok(cfg: RankConfig) -> Column:
    """Null locations count as none."""
    patterns = {f"%{x}%" for x in (*cfg.allowlist, "remote")}
    return F.coalesce(F.col("is_remote"), F.lit(False)) | F.coalesce(F.exists("locations", lambda x: ilike_any(x, sorted(patterns))), F.lit(False))


def role_state(cfg: RankConfig) -> Column:
    role = F.lower(F.trim("role_type"))
    return F.when(F.coalesce(role, F.lit("")) == "", "unknown").when(role.isin(list(cfg.role_types)), "allowed").when(role.isin(list(KNOWN_ROLE_TYPES)), "excluded").otherwise("unknown")


def start_state(cfg: RankConfig) -> Column:
    season = F.lower("start_season")
    month = F.when(season.contains("spring"), 3).when(season.contains("summer"), 6).when(season.rlike("fall|autumn"), 9).when(season.contains("winter"), 1).otherwise(12)
    year = F.regexp_extract("start_season", "(20[0-9]{2})", 1).try_cast("int")
    earliest = F.lit(cfg.grad_date - dt.timedelta(days=cfg.slack_days))
    named = season.rlike("spring|summer|fall|autumn|winter")
    return F.when(year.isNull(), "unknown").when(F.make_date(year, month, F.lit(1)) >= earliest, F.when(named, "eligible").otherwise("partial")).otherwise("too_early")


def classified(postings: DataFrame, cfg: RankConfig) -> DataFrame:
    """Active postings with their states, the first rule that drops them and the flags of kept ones."""
    out = postings.where(active()).withColumns({"sponsorship_class": sponsorship_class(F.col("sponsorship")), "location_ok": location_ok(cfg), "role_state": role_state(cfg), "start_state": start_state(cfg)})
    blocked = F.lit(not cfg.allow_sponsorship_required)
    reason = F.lit(None).cast("string")
    for test, name in reversed(
        [
            (blocked & (F.col("sponsorship_class") == "offshore"), "sponsorship_offshore"),
            (blocked & (F.col("sponsorship_class") == "citizenship"), "sponsorship_citizenship"),
            (blocked & (F.col("sponsorship_class") == "not_offered"), "sponsorship_not_offered"),
            (~F.col("location_ok"), "location"),
            (F.col("role_state") == "excluded", "role_type"),
            (F.col("start_state") == "too_early", "start_season"),
        ]
    ):
        reason = F.when(test, name).otherwise(reason)
    flags = F.array_compact(
        F.array(
            F.when(F.col("sponsorship_class") == "unknown", F.lit("sponsorship_unknown")),
            F.when(F.col("role_state") == "unknown", F.lit("role_type_unknown")),
            F.when(F.col("start_state") == "unknown", F.lit("start_season_unknown")),
            F.when(F.col("start_state") == "partial", F.lit("start_season_partial")),
        )
    )
    return out.withColumn("drop_reason", reason).withColumn("flags", flags)


def survivors(postings: DataFrame, cfg: RankConfig) -> DataFrame:
    return classified(postings, cfg).where("drop_reason is null").drop("drop_reason", "location_ok")


def classify(postings: DataFrame, ids: DataFrame, cfg: RankConfig) -> DataFrame:
    """Of asked ids (posting_id): outcome 'kept', a drop reason, 'inactive' or 'not_found'."""
    asked = ids.select("posting_id").distinct()
    own = postings.join(asked, postings.id == asked.posting_id, "left_semi")
    judged = classified(own, cfg).select(F.col("id").alias("posting_id"), F.coalesce("drop_reason", F.lit("kept")).alias("outcome"))
    dead = own.where(~active()).select(F.col("id").alias("posting_id"), F.lit("inactive").alias("outcome"))
    return asked.join(judged.unionByName(dead), "posting_id", "left").select("posting_id", F.coalesce("outcome", F.lit("not_found")).alias("outcome"))


def search_postings(postings: DataFrame, jd: DataFrame, active_only: bool | None = None, company: str | None = None, role: str | None = None, has_jd: bool | None = None, q: str | None = None) -> DataFrame:
    """Only given arguments become predicates."""
    out = postings
    if active_only is not None:
        out = out.where(active() if active_only else ~active())
    if company:
        out = out.where(F.col("company").ilike(f"%{company}%"))
    if role:
        out = out.where(F.lower("role_type") == role.lower())
    if q:
        out = out.where(F.col("title").ilike(f"%{q}%") | F.col("company").ilike(f"%{q}%"))
    if has_jd is not None:
        own = jd.where("raw_text is not null and raw_text <> ''").select(F.col("posting_id").alias("id"))
        out = out.join(own, "id", "left_semi" if has_jd else "left_anti")
    return out


def search_skills(skills: DataFrame, actionable: bool | None = None, q: str | None = None, category: str | None = None) -> DataFrame:
    out = skills
    if actionable is not None:
        out = out.where(F.col("is_actionable") == actionable)
    if q:
        out = out.where(F.col("name").ilike(f"%{q}%"))
    return out.where(F.col("category") == category) if category else out


def search_metrics(metrics: DataFrame, limit: int, **equal: str | None) -> DataFrame:
    for name, value in equal.items():
        if value is not None:
            metrics = metrics.where(F.col(name) == value)
    return metrics.orderBy(F.desc("recorded_at"), F.desc("id")).limit(limit)


def live_chunks(chunks: DataFrame, source_type: str | None = None, source_ref: str | None = None) -> DataFrame:
    out = chunks.where("deleted_at is null")
    if source_type:
        out = out.where(F.col("source_type") == source_type)
    return out.where(F.col("source_ref") == source_ref) if source_ref else out


def needs_embedding(chunks: DataFrame, model: str, force: bool = False) -> DataFrame:
    live = live_chunks(chunks)
    return live if force else live.where(F.col("embedding").isNull() | F.coalesce(F.col("embedding_model") != model, F.lit(True)))


def clip(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.substring(c, 1, n) for c, n in widths.items()})


def fetch_status(status: Column, error: Column) -> tuple[Column, Column]:
    """Outcome of a request by HTTP status or transport error, and whether it is worth another try."""
    kind = (
        F.when(error.isNotNull(), "transient_error").when(status.between(200, 299), "ok").when(status.isin(404, 410), "not_found").when(status == 429, "rate_limited").when(status >= 500, "transient_error").otherwise("permanent_error")
    )
    return kind, kind.isin("rate_limited", "transient_error")
