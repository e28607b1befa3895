"""Domain tables over the driver's tables: each as a DataFrame and as the SQL of its twin."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazily read tables of one folder, all rows of them; columns are pruned by the queries that use them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def posting(self) -> DataFrame:
        orders, customer, nation, region = (self.read(n) for n in ("orders", "customer", "nation", "region"))
        joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.selectExpr(
            "o_orderkey AS id",
            "c_name AS company",
            "concat('Engineer ', substring(o_orderpriority, 3), ' ', cast(o_orderkey % 100 AS string)) AS title",
            "concat('https://www.', lower(c_mktsegment), '.example.com/jobs/', o_orderkey, '/?src=feed') AS url",
            "CASE c_mktsegment WHEN 'BUILDING' THEN 'swe' WHEN 'MACHINERY' THEN ' SWE ' WHEN 'HOUSEHOLD' THEN 'quant' WHEN 'AUTOMOBILE' THEN 'wizardry' END AS role_type",
            "CASE left(o_orderpriority, 1) WHEN '1' THEN 'Offers Sponsorship' WHEN '2' THEN 'Does Not Offer Sponsorship' WHEN '3' THEN 'U.S. Citizenship is Required' WHEN '5' THEN 'Offshore Only' END AS sponsorship",
            "CASE WHEN o_orderkey % 17 = 0 THEN cast(array() AS array<string>) ELSE array(n_name, r_name) END AS locations",
            "o_orderkey % 10 = 0 AS is_remote",
            "CASE o_orderkey % 6 WHEN 1 THEN 'Summer 2027' WHEN 2 THEN 'Spring 2027' WHEN 3 THEN '2027' WHEN 4 THEN 'Fall 2027' WHEN 5 THEN 'ASAP' END AS start_season",
            "CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS posted_at",
            "o_orderdate AS first_seen_at",
            "o_orderdate + INTERVAL 20 DAYS AS last_seen_at",
            "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAYS END AS inactive_at",
        )

    @cached_property
    def jd(self) -> DataFrame:
        return (
            self.read("orders")
            .where("o_orderkey % 7 <> 0")
            .selectExpr(
                "o_orderkey AS posting_id",
                "CASE o_orderkey % 5 WHEN 1 THEN 'board_a' WHEN 2 THEN 'board_b' WHEN 3 THEN 'board_c' WHEN 4 THEN 'fallback' END AS adapter",
                "CASE o_orderkey % 6 WHEN 3 THEN 'pending' WHEN 4 THEN 'rate_limited' WHEN 5 THEN 'not_found' ELSE 'ok' END AS fetch_status",
                "CASE WHEN o_orderkey % 6 < 3 THEN o_orderkey % 900 ELSE 0 END AS char_count",
                "CASE WHEN o_orderkey % 6 < 3 AND o_orderkey % 900 > 0 THEN concat('Text of posting ', o_orderkey) END AS raw_text",
            )
        )

    @cached_property
    def requirement(self) -> DataFrame:
        return self.read("lineitem").selectExpr(
            "((l_orderkey * 20011 + l_partkey) * 1009 + l_suppkey) * 8 + l_linenumber AS id",
            "l_orderkey AS posting_id",
            "CASE WHEN l_partkey % 8 <> 0 THEN l_partkey END AS skill_id",
            "concat('Experience with part ', l_partkey % 500) AS raw_text",
            "CASE l_returnflag WHEN 'R' THEN 'required' WHEN 'A' THEN 'preferred' ELSE 'mentioned' END AS importance",
            "round(1 - l_discount, 3) AS confidence",
            "l_quantity AS quantity",
        )

    @cached_property
    def skill(self) -> DataFrame:
        return self.read("part").selectExpr("p_partkey AS id", "concat(p_name, ' ', p_partkey) AS name", "p_type AS category", "p_size % 7 <> 0 AS is_actionable")

    @cached_property
    def skill_alias(self) -> DataFrame:
        part = self.read("part")
        return part.selectExpr("p_partkey AS skill_id", "concat(p_name, ' ', p_partkey) AS alias").union(part.selectExpr("p_partkey", "concat(p_brand, ' ', p_partkey % 200)"))

    @cached_property
    def matches(self) -> DataFrame:
        return (
            self.read("orders")
            .selectExpr(
                "o_orderkey AS id", "o_orderkey - o_orderkey % 100 AS posting_id", "o_orderkey % 4 = 0 AS is_stale", "o_orderdate AS computed_at", "1 + o_orderkey % 3 AS evidence_version",
                "concat('v', o_orderkey % 2) AS prompt_version", "round(o_totalprice / 500000, 4) AS score", "CASE WHEN o_orderkey % 3 = 0 THEN 'strong' ELSE 'stretch' END AS verdict",
            )
        )

    @cached_property
    def citation(self) -> DataFrame:
        status = "CASE WHEN l_quantity >= 49 THEN 'evidenced' WHEN l_quantity >= 45 THEN 'weak' ELSE 'absent' END"
        return (
            self.read("lineitem")
            .selectExpr(
                "((l_orderkey * 20011 + l_partkey) * 1009 + l_suppkey) * 8 + l_linenumber AS id", "l_orderkey AS match_id", "CASE WHEN l_partkey % 8 <> 0 THEN l_partkey END AS skill_id",
                f"{status} AS status", f"CASE WHEN {status} <> 'absent' THEN l_partkey % 500 END AS chunk_id",
                "CASE l_returnflag WHEN 'R' THEN 'required' WHEN 'A' THEN 'preferred' ELSE 'mentioned' END AS importance",
            )
        )

    @cached_property
    def chunk(self) -> DataFrame:
        return self.read("embeddings").selectExpr("vec_id AS id", "embedding", "label", "vec_id % 11 = 0 AS deleted")

    @cached_property
    def query_vec(self) -> DataFrame:
        """Ids divisible by 20: the stated query set against all rows."""
        return self.read("embeddings").where("vec_id % 20 = 0").selectExpr(
            "vec_id AS id", "vec_id div 20 % 40 AS posting_id", "embedding", "label", "CASE vec_id % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'preferred' ELSE 'mentioned' END AS importance"
        )

    @cached_property
    def run_metric(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id AS id", "concat('run-', user_id % 7) AS run_id", "event_type AS stage", "CASE event_id % 4 WHEN 0 THEN 'cost_usd' WHEN 1 THEN 'tokens' WHEN 2 THEN 'cache_hit' ELSE 'calls' END AS metric",
            "CASE WHEN event_id % 4 = 2 THEN cast(event_id % 3 = 0 AS int) ELSE value END AS value", "ts AS recorded_at", "props AS labels",
        )

    @cached_property
    def shortlist(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "concat('run-', cast(o_orderkey / 40 AS long) % 3) AS run_id", "o_orderkey AS posting_id", "round(o_totalprice / 600000, 5) AS coarse_score", "o_orderdate AS created_at"
        )

    @cached_property
    def fetch_log(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id AS id", "user_id AS posting_id", "concat('host', user_id % 20, '.example.com') AS host", "ts AS at", "value AS seconds",
            "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 200 WHEN 'click' THEN 404 WHEN 'view' THEN 429 ELSE 403 END AS http_status",
            "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'timeout' END AS error", "event_type",
        )


_STATUS = "CASE WHEN l_quantity >= 49 THEN 'evidenced' WHEN l_quantity >= 45 THEN 'weak' ELSE 'absent' END"
_ROW = "((l_orderkey * 20011 + l_partkey) * 1009 + l_suppkey) * 8 + l_linenumber"
_IMPORTANCE = "CASE l_returnflag WHEN 'R' THEN 'required' WHEN 'A' THEN 'preferred' ELSE 'mentioned' END"

#: The same tables for DuckDB. A query names those that it needs; they become its first common table expressions.
VIEWS = {
    "posting": """
      SELECT o_orderkey AS id, c_name AS company, 'Engineer ' || substr(o_orderpriority, 3) || ' ' || (o_orderkey % 100) AS title,
        'https://www.' || lower(c_mktsegment) || '.example.com/jobs/' || o_orderkey || '/?src=feed' AS url,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'swe' WHEN 'MACHINERY' THEN ' SWE ' WHEN 'HOUSEHOLD' THEN 'quant' WHEN 'AUTOMOBILE' THEN 'wizardry' END AS role_type,
        CASE left(o_orderpriority, 1) WHEN '1' THEN 'Offers Sponsorship' WHEN '2' THEN 'Does Not Offer Sponsorship' WHEN '3' THEN 'U.S. Citizenship is Required' WHEN '5' THEN 'Offshore Only' END AS sponsorship,
        CASE WHEN o_orderkey % 17 = 0 THEN CAST([] AS VARCHAR[]) ELSE [n_name, r_name] END AS locations, o_orderkey % 10 = 0 AS is_remote,
        CASE o_orderkey % 6 WHEN 1 THEN 'Summer 2027' WHEN 2 THEN 'Spring 2027' WHEN 3 THEN '2027' WHEN 4 THEN 'Fall 2027' WHEN 5 THEN 'ASAP' END AS start_season,
        CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS posted_at, o_orderdate AS first_seen_at, o_orderdate + INTERVAL 20 DAY AS last_seen_at,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END AS inactive_at
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "jd": """
      SELECT o_orderkey AS posting_id, CASE o_orderkey % 5 WHEN 1 THEN 'board_a' WHEN 2 THEN 'board_b' WHEN 3 THEN 'board_c' WHEN 4 THEN 'fallback' END AS adapter,
        CASE o_orderkey % 6 WHEN 3 THEN 'pending' WHEN 4 THEN 'rate_limited' WHEN 5 THEN 'not_found' ELSE 'ok' END AS fetch_status,
        CASE WHEN o_orderkey % 6 < 3 THEN o_orderkey % 900 ELSE 0 END AS char_count,
        CASE WHEN o_orderkey % 6 < 3 AND o_orderkey % 900 > 0 THEN 'Text of posting ' || o_orderkey END AS raw_text
      FROM orders WHERE o_orderkey % 7 <> 0""",
    "requirement": f"""
      SELECT {_ROW} AS id, l_orderkey AS posting_id, CASE WHEN l_partkey % 8 <> 0 THEN l_partkey END AS skill_id,
        'Experience with part ' || (l_partkey % 500) AS raw_text, {_IMPORTANCE} AS importance, round(1 - l_discount, 3) AS confidence, l_quantity AS quantity FROM lineitem""",
    "skill": "SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name, p_type AS category, p_size % 7 <> 0 AS is_actionable FROM part",
    "skill_alias": """
      SELECT p_partkey AS skill_id, p_name || ' ' || p_partkey AS alias FROM part
      UNION ALL SELECT p_partkey, p_brand || ' ' || (p_partkey % 200) FROM part""",
    "matches": """
      SELECT o_orderkey AS id, o_orderkey - o_orderkey % 100 AS posting_id, o_orderkey % 4 = 0 AS is_stale, o_orderdate AS computed_at, 1 + o_orderkey % 3 AS evidence_version,
        'v' || (o_orderkey % 2) AS prompt_version, round(o_totalprice / 500000, 4) AS score, CASE WHEN o_orderkey % 3 = 0 THEN 'strong' ELSE 'stretch' END AS verdict
      FROM orders""",
    "citation": f"""
      SELECT {_ROW} AS id, l_orderkey AS match_id, CASE WHEN l_partkey % 8 <> 0 THEN l_partkey END AS skill_id, {_STATUS} AS status,
        CASE WHEN {_STATUS} <> 'absent' THEN l_partkey % 500 END AS chunk_id, {_IMPORTANCE} AS importance FROM lineitem""",
    "chunk": "SELECT vec_id AS id, embedding, label, vec_id % 11 = 0 AS deleted FROM embeddings",
    "query_vec": "SELECT vec_id AS id, vec_id // 20 % 40 AS posting_id, embedding, label, CASE vec_id % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'preferred' ELSE 'mentioned' END AS importance FROM embeddings WHERE vec_id % 20 = 0",
    "run_metric": """
      SELECT event_id AS id, 'run-' || (user_id % 7) AS run_id, event_type AS stage, CASE event_id % 4 WHEN 0 THEN 'cost_usd' WHEN 1 THEN 'tokens' WHEN 2 THEN 'cache_hit' ELSE 'calls' END AS metric,
        CASE WHEN event_id % 4 = 2 THEN CAST(event_id % 3 = 0 AS INT) ELSE value END AS value, ts AS recorded_at, props AS labels FROM events""",
    "shortlist": "SELECT 'run-' || ((o_orderkey // 40) % 3) AS run_id, o_orderkey AS posting_id, round(o_totalprice / 600000, 5) AS coarse_score, o_orderdate AS created_at FROM orders",
    "fetch_log": """
      SELECT event_id AS id, user_id AS posting_id, 'host' || (user_id % 20) || '.example.com' AS host, ts AS at, value AS seconds,
        CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 200 WHEN 'click' THEN 404 WHEN 'view' THEN 429 ELSE 403 END AS http_status,
        CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'timeout' END AS error, event_type FROM events""",
    # derived from the views above
    "eligible": """
      SELECT * FROM posting WHERE inactive_at IS NULL AND (role_type IS NULL OR lower(role_type) = 'swe')
        AND (sponsorship IS NULL OR NOT (sponsorship ILIKE '%does not offer%' OR sponsorship ILIKE '%no sponsorship%' OR sponsorship ILIKE '%not provide sponsorship%'
          OR sponsorship ILIKE '%citizen%' OR sponsorship ILIKE '%clearance%' OR sponsorship ILIKE '%offshore%'))
        AND (is_remote OR locations IS NULL OR len(locations) = 0 OR list_bool_or(list_transform(locations, lambda x: x ILIKE '%ASIA%' OR x ILIKE '%AMERICA%')))""",
    "classified": r"""
      SELECT *, CASE WHEN sponsorship_class = 'offshore' THEN 'sponsorship_offshore' WHEN sponsorship_class = 'citizenship' THEN 'sponsorship_citizenship'
          WHEN sponsorship_class = 'not_offered' THEN 'sponsorship_not_offered' WHEN NOT location_ok THEN 'location' WHEN role_state = 'excluded' THEN 'role_type'
          WHEN start_state = 'too_early' THEN 'start_season' END AS drop_reason,
        array_to_string(list_filter([CASE WHEN sponsorship_class = 'unknown' THEN 'sponsorship_unknown' END, CASE WHEN role_state = 'unknown' THEN 'role_type_unknown' END,
          CASE WHEN start_state = 'unknown' THEN 'start_season_unknown' END, CASE WHEN start_state = 'partial' THEN 'start_season_partial' END], lambda x: x IS NOT NULL), ',') AS flags
      FROM (SELECT *,
        CASE WHEN sponsorship IS NULL THEN 'unknown' WHEN sponsorship ILIKE '%offshore%' THEN 'offshore' WHEN sponsorship ILIKE '%citizen%' THEN 'citizenship'
          WHEN sponsorship ILIKE '%does not offer%' THEN 'not_offered' WHEN sponsorship ILIKE '%offers sponsorship%' THEN 'offers' ELSE 'unknown' END AS sponsorship_class,
        is_remote OR coalesce(list_bool_or(list_transform(locations, lambda x: x ILIKE '%remote%' OR x ILIKE '%asia%' OR x ILIKE '%america%' OR x ILIKE '%europe%')), false) AS location_ok,
        CASE WHEN role_type IS NULL THEN 'unknown' WHEN lower(trim(role_type)) = 'swe' THEN 'allowed' WHEN lower(trim(role_type)) = 'quant' THEN 'excluded' ELSE 'unknown' END AS role_state,
        CASE WHEN start_season IS NULL OR start_season = 'ASAP' THEN 'unknown' WHEN start_season = '2027' THEN 'partial' WHEN start_season = 'Spring 2027' THEN 'too_early' ELSE 'eligible' END AS start_state
        FROM posting WHERE inactive_at IS NULL)""",
    "req": "SELECT r.* FROM requirement r WHERE posting_id IN (SELECT id FROM eligible)",
    "fresh": "SELECT c.* FROM citation c JOIN matches m ON m.id = c.match_id WHERE NOT m.is_stale AND c.skill_id IS NOT NULL",
    "importance": """
      SELECT skill_id, count(*) FILTER (importance = 'required') AS required_count, count(*) FILTER (importance = 'preferred') AS preferred_count,
        count(*) FILTER (importance = 'mentioned') AS mentioned_count, count(DISTINCT posting_id) AS posting_count FROM req WHERE skill_id IS NOT NULL GROUP BY skill_id""",
    "status": """
      SELECT skill_id, max(CASE status WHEN 'evidenced' THEN 3 WHEN 'weak' THEN 2 ELSE 1 END) AS best_rank, count(*) FILTER (status = 'evidenced') AS evidenced_citations,
        count(*) FILTER (status = 'weak') AS weak_citations, count(*) FILTER (status = 'absent') AS absent_citations, count(DISTINCT match_id) AS matches_considered FROM fresh GROUP BY skill_id""",
}
