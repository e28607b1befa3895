"""Exact nearest neighbours and relevance scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RankConfig
from ..functions.columns import clamped, has_boost_location, ranked
from .ball_index import BallIndex


def top_k(queries: DataFrame, chunks: DataFrame, k: int, tags: DataFrame | None = None, boost: float = 0.0) -> DataFrame:
    """query_id, chunk_id, distance, adjusted, tagged and place of the k nearest chunks of each query by cosine.

    queries: id, embedding, skill_id (may be missing); chunks: id, embedding; tags: chunk_id, skill_id. Chunks and queries
    without a vector take no part. Builds a ``BallIndex`` and searches it once; build one yourself to search it often.
    """
    return BallIndex.build(chunks, tags).search(queries, k, boost)[0]


def nearest(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """The nearest chunk of each query with its similarity."""
    return top_k(queries, chunks, 1).select("query_id", "chunk_id", (1 - F.col("distance")).alias("similarity"))


def candidate_set(hits: DataFrame, queries: DataFrame, merge_boost: float) -> DataFrame:
    """Chunks found for each posting with their smallest distance after the fixed merge boost, and their place."""
    owned = hits.join(queries.select(F.col("id").alias("query_id"), "posting_id"), "query_id")
    effective = F.round(F.col("distance") - F.when(F.col("tagged"), merge_boost).otherwise(0.0), 9)
    best = owned.groupBy("posting_id", "chunk_id").agg(F.min(effective).alias("effective"), F.count(F.lit(1)).alias("n_requirements"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("posting_id").orderBy("effective", "chunk_id")))


def contributions(near: DataFrame, queries: DataFrame, cfg: RankConfig) -> DataFrame:
    """Weight times clamped similarity of each requirement."""
    owned = queries.select(F.col("id").alias("query_id"), "posting_id", "importance").join(near, "query_id", "left")
    return owned.withColumn("contribution", ranked(F.col("importance"), cfg.weights) * clamped(F.coalesce("similarity", F.lit(0.0))))


def coarse_scores(scored: DataFrame, postings: DataFrame, fallback: DataFrame | None, cfg: RankConfig) -> DataFrame:
    """Per posting: score (5 places), n_requirements, low_confidence.

    The mean contribution of its requirements, or, of postings without any, the fallback similarity (posting_id, similarity) times a factor;
    nine tenths of it and one tenth for a preferred location.
    """
    base = scored.groupBy("posting_id").agg((F.sum("contribution") / F.count(F.lit(1))).alias("base"), F.count(F.lit(1)).alias("n_requirements"))
    out = postings.select(F.col("id").alias("posting_id"), has_boost_location(F.col("locations"), cfg.boost_terms).alias("boosted")).join(base, "posting_id", "left")
    spare = F.lit(0.0)
    if fallback is not None:
        out = out.join(fallback.select("posting_id", F.col("similarity").alias("_similarity")), "posting_id", "left")
        spare = clamped(F.coalesce("_similarity", F.lit(0.0))) * cfg.fallback_factor
    value = clamped(F.coalesce("base", spare))
    score = F.round((1 - cfg.boost_weight) * value + cfg.boost_weight * F.col("boosted").cast("double"), 5)
    return out.select("posting_id", score.alias("score"), F.coalesce("n_requirements", F.lit(0)).cast("long").alias("n_requirements"), F.col("base").isNull().alias("low_confidence"))
