"""Scalar functions (H)."""

from pyspark.sql import functions as F

from ..functions import columns as fn
from .registry import query

@query("h1_identity_normalize", "SELECT doc_id, trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^0-9a-z]+', ' ', 'g')) AS norm FROM documents")
def h1(t):
    return t.read("documents").select("doc_id", fn.identity_normalized(F.col("text")).alias("norm"))


@query("h1_accents_folded", "SELECT doc_id, length(text) - length(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')) AS n_left FROM documents")
def h1_accents(t):
    """Characters that have no ASCII form after their accents are folded."""
    return t.read("documents").select("doc_id", (F.length("text") - F.length(F.regexp_replace(fn.accents_folded(F.col("text")), r"[^\x00-\x7F]", ""))).cast("long").alias("n_left"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '')"
_PATH = r"(CASE WHEN length(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)) > 1 THEN rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END)"


@query("h2_url_parts", f"SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages")
def h2(t):
    return t.read("pages").select("page_id", fn.url_host(F.col("url")).alias("host"), fn.url_path(F.col("url")).alias("path"))


@query("h3_canonical_key", f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'id-' || page_id ELSE sha256('acme co' || 'engineer ' || page_id || {_HOST} || {_PATH}) END AS key FROM pages")
def h3(t):
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" id-"), "page_id", F.lit(" "))).otherwise(F.lit("  "))
    company, title = fn.ascii_identity(F.lit("ACME, Co.")), fn.ascii_identity(F.concat(F.lit("Engineer - "), "page_id"))
    return t.read("pages").select("page_id", fn.canonical_key(given, company, title, F.col("url")).alias("key"))


_CATEGORY = "CASE p_size % 6 WHEN 0 THEN 'Software' WHEN 1 THEN ' AI/ML/Data ' WHEN 2 THEN 'Quantitative Finance' WHEN 3 THEN 'Gardening' WHEN 4 THEN '' END"


@query("h4_role_type", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'swe' WHEN 1 THEN 'ai_ml_data' WHEN 2 THEN 'quant' WHEN 3 THEN 'other' END AS role_type FROM part")
def h4(t):
    return t.read("part").select("p_partkey", fn.role_type(F.expr(_CATEGORY)).alias("role_type"))


@query("h5_remote_detector", r"SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE c_mktsegment = 'BUILDING' END AS is_remote FROM customer")
def h5(t):
    places = "CASE c_custkey % 5 WHEN 0 THEN array('Remote in USA (FL)') WHEN 1 THEN array('Remoteville') WHEN 2 THEN array('Paris', 'WFH ok') WHEN 3 THEN cast(array() as array<string>) ELSE array(CASE WHEN c_mktsegment = 'BUILDING' THEN 'Work From Home' END) END"
    return t.read("customer").select("c_custkey", fn.is_remote(F.expr(places)).alias("is_remote"))


@query("h6_start_season", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Summer ' || year(o_orderdate + INTERVAL 28 YEAR) WHEN 1 THEN 'Fall ' || year(o_orderdate + INTERVAL 28 YEAR) WHEN 2 THEN CAST(year(o_orderdate + INTERVAL 28 YEAR) AS VARCHAR) END AS season FROM orders")
def h6(t):
    year = "year(o_orderdate + INTERVAL 28 YEARS)"
    title = f"CASE o_orderkey % 5 WHEN 0 THEN concat('Engineer, summer ', {year}, ' (new)') WHEN 1 THEN concat('Engineer ', {year}, ' - AUTUMN') WHEN 2 THEN concat('Grad ', {year}) WHEN 3 THEN 'Java / Spring Boot Developer' END"
    return t.read("orders").select("o_orderkey", fn.start_season(F.expr(title)).alias("season"))


@query("h7_epoch_timestamp", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN strftime(make_timestamp(CAST(event_id * 100003000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS at FROM events WHERE event_id > 0")
def h7(t):
    raw = F.expr("CASE event_id % 8 WHEN 0 THEN '0' WHEN 4 THEN 'soon' ELSE cast(event_id * 100003 as string) END")
    return t.read("events").where("event_id > 0").select("event_id", F.date_format(fn.epoch_timestamp(raw), "y-MM-dd HH:mm:ss").alias("at"))


@query("h10_text_collapse", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x0B\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS collapsed FROM documents")
def h10(t):
    return t.read("documents").select("doc_id", fn.collapsed(F.col("text")).alias("collapsed"))


@query("h11_token_estimate", "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END AS INT) AS tokens FROM documents")
def h11(t):
    return t.read("documents").select("doc_id", fn.token_estimate(F.col("text")).alias("tokens"))


@query("h12_cache_key", "SELECT p_partkey, sha256(p_name || chr(31) || p_brand || chr(31) || p_type) AS key FROM part")
def h12(t):
    return t.read("part").select("p_partkey", fn.cache_key(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("key"))


@query("h13_cost_estimate", "SELECT p_partkey, round((p_size * 1000 * coalesce(i, 3.0) + p_partkey * coalesce(o, 15.0)) / 1e6, 8) AS cost FROM part LEFT JOIN (VALUES ('ECONOMY', 1.0, 5.0), ('SMALL', 0.25, 1.25)) r(m, i, o) ON m = p_type")
def h13(t):
    rates = t.spark.createDataFrame([("ECONOMY", 1.0, 5.0), ("SMALL", 0.25, 1.25)], "p_type string, i double, o double")
    priced = t.read("part").join(F.broadcast(rates), "p_type", "left")  # a price list: one row a model
    return priced.select("p_partkey", F.round(fn.cost(F.col("p_size") * 1000, F.col("p_partkey"), F.coalesce("i", F.lit(3.0)), F.coalesce("o", F.lit(15.0))), 8).alias("cost"))


@query("h14_boost_location", "SELECT id, len(locations) = 2 AND locations[2] IN ('ASIA', 'EUROPE') AS boosted FROM posting")
def h14(t):
    return t.posting.select("id", fn.has_boost_location(F.col("locations"), [" asia", "Europe"]).alias("boosted"))


@query("h15_cosine", "SELECT a.vec_id, round(greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def h15(t):
    e = t.read("embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(fn.clamped(fn.cosine("a", "b")), 6).alias("similarity"))


@query("h16_whole_phrase", r"SELECT doc_id, regexp_matches(text, '(?i)(^|[^a-z0-9])of the($|[^a-z0-9])') AS found FROM documents")
def h16(t):
    return t.read("documents").select("doc_id", fn.has_phrase(F.col("text"), "of the").alias("found"))


@query("h17_truncation", r"SELECT doc_id, CASE WHEN length(s) > 60 THEN rtrim(left(s, 59)) || '…' ELSE s END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)")
def h17(t):
    return t.read("documents").select("doc_id", fn.shortened(F.col("text"), 60).alias("short"))


@query("h18_title_chrome", r"SELECT page_id, 'Page ' || page_id AS title, string_split(h, '.')[-2] AS company FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS h FROM pages)")
def h18(t):
    title = F.concat(F.lit(" Page "), "page_id", F.lit(" - Careers at Acme"))
    shown, company = fn.title_parts(F.trim(title), F.lower(F.expr("try_parse_url(url, 'HOST')")))
    return t.read("pages").select("page_id", shown.alias("title"), company.alias("company"))


@query("h19_flexible_dates", """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(CASE WHEN o_orderkey % 4 < 3 THEN month(o_orderdate) END AS INT) AS m, CAST(CASE WHEN o_orderkey % 4 < 2 THEN day(o_orderdate) END AS INT) AS d, o_orderkey % 4 = 2 AS ranged FROM orders""")
def h19(t):
    raw = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'M/d/yyyy') WHEN 2 THEN concat('Jan. 1990 – ', date_format(o_orderdate, 'MMM yyyy')) ELSE date_format(o_orderdate, 'yyyy') END")
    start, end = fn.date_range(raw)
    return t.read("orders").select("o_orderkey", end["year"].alias("y"), end["month"].alias("m"), end["day"].alias("d"), start.isNotNull().alias("ranged"))


@query("h20_json_access", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN event_id % 2 = 0 THEN 'text ' || event_id ELSE 'summary' END AS label FROM events""")
def h20(t):
    rationale = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("text "), "event_id").alias("text"), F.lit("summary").alias("summary")))).otherwise(F.to_json(F.struct(F.lit("summary").alias("summary"))))
    return t.read("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), fn.label_text(rationale).alias("label"))


@query("h21_text_or_fallback", "SELECT p.id, CASE WHEN raw_text IS NOT NULL THEN raw_text ELSE company || chr(10) || title END AS text, raw_text IS NOT NULL AS present FROM posting p LEFT JOIN jd ON jd.posting_id = p.id")
def h21(t):
    text, present = fn.text_or_fallback(F.col("raw_text"), F.col("company"), F.col("title"))
    return t.posting.join(t.jd.withColumnRenamed("posting_id", "id"), "id", "left").select("id", text.alias("text"), present.alias("present"))
