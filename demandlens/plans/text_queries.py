"""Text jobs, payloads and validation (A5, A6, D23, G4, H8, K, J)."""

from pyspark.sql import functions as F

from ..functions.columns import taxonomy_normalized
from ..operators import html_text, resolution, text_jobs
from ..sources import documents as docs
from ..sources import payloads
from .registry import query


def _paragraphs(t):
    return t.read("documents").select(F.lit("corpus").alias("source_type"), F.col("doc_id").cast("string").alias("source_ref"), "text")


@query("k1_markdown_chunks")
def k1(t):
    """Chunks of all documents with some structure put in: headings, lists and code, at places that the texts themselves give."""
    marked = F.regexp_replace(F.regexp_replace("text", r"\n([A-Z][a-z]+ [a-z]+ )", "\n\n## $1\n\n"), r"\n([^\n#]{10,60})\n", "\n\n- $1\n  - below\n\n```\ncode\n```\n\n")
    return text_jobs.chunk_documents(_paragraphs(t).withColumn("text", marked))


@query("k1_short_documents")
def k1_short(t):
    """Chunks of all documents as they stand: one for a short text, many for a long one."""
    return text_jobs.chunk_documents(_paragraphs(t)).select("source_ref", "ordinal", "text", "text_sha256", "token_estimate")


@query(
    "k2_sparse_embedding",
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9+#.]+') AS w FROM documents),
       terms AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
       sums AS (SELECT doc_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 1536 AS slot, sum(CASE WHEN CAST('0x' || substr(h, 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM (SELECT doc_id, md5(term) AS h FROM terms) GROUP BY ALL HAVING v <> 0)
       SELECT doc_id, slot, round(v / sqrt(CAST(sum(v * v) OVER (PARTITION BY doc_id) AS DOUBLE)), 9) AS weight FROM sums""",
)
def k2(t):
    return text_jobs.sparse_embeddings(t.read("documents"), "doc_id", "text").withColumn("weight", F.round("weight", 9))


@query("k2_hashed_embedding")
def k2_dense(t):
    out = text_jobs.embed(t.read("documents").select(F.col("doc_id").alias("id"), "text"), "text")
    return out.select("id", F.expr("aggregate(embedding, 0d, (s, x) -> s + x * x)").alias("square"))


@query("j1_fitted_vectors", "SELECT vec_id, CAST(80 AS INT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS square FROM embeddings")
def j1(t):
    out = t.read("embeddings").select("vec_id", text_jobs.fitted(F.col("embedding").cast("array<double>"), 80).alias("v"))
    return out.select("vec_id", F.size("v").alias("n"), F.round(F.expr("aggregate(v, 0d, (s, x) -> s + x * x)"), 6).alias("square"))


_PHRASES = ["the", "of", "and the", "of the", "in", "die", "und", "der die", "de la", "que", "la"]
_GUARDS = ["in the", "und der"]


def _vocabulary(t):
    """Aliases: common phrases, which belong to skills 0 to 10, and the names of all parts. Guards: two phrases."""
    names = t.read("part").select(taxonomy_normalized(F.concat_ws(" ", "p_name", "p_partkey")).alias("alias_norm"), F.col("p_partkey").cast("long").alias("skill_id"))
    phrases = t.spark.createDataFrame(list(zip(_PHRASES, range(len(_PHRASES)))), "alias_norm string, skill_id long")
    return phrases.unionByName(names), t.spark.createDataFrame([(g,) for g in _GUARDS], "phrase string")


def _spans(t):
    return t.read("documents").select(F.col("doc_id").alias("span_id"), "text")


# dots after what is neither a letter, a digit nor a blank, then dots before what is neither a letter nor a digit
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(coalesce(text, '')), '&', ' and '), '''', ''), '([^\p{L}\p{N}\s])\.+', '\1 ', 'g'), '\.([^\p{L}\p{N}]|$)', ' \1', 'g'), '[^\p{L}\p{N}+#.]+', ' ', 'g'))"
_ALIASES = f"""(SELECT alias, min(skill_id) AS skill_id FROM (SELECT unnest({_PHRASES}) AS alias, unnest(range({len(_PHRASES)})) AS skill_id UNION ALL SELECT p_name || ' ' || p_partkey, p_partkey FROM part) GROUP BY alias)"""
#: Candidates that overlap form chains, in which the leftmost longest ones are found one after the other.
_FIRST = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id AS span_id, string_split({_NORM}, ' ') AS w FROM documents),
  grams AS MATERIALIZED (SELECT span_id, g.i, g.n, g.g FROM (SELECT span_id, unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(len(w) - n + 1), lambda i: {{'i': i, 'n': n, 'g': array_to_string(w[i + 1:i + n], ' ')}})))) AS g FROM w)),
  masks AS MATERIALIZED (SELECT span_id, i AS a, i + n AS b FROM grams WHERE n = 2 AND g IN ('in the', 'und der')),
  cand AS MATERIALIZED (SELECT c.span_id, c.i, c.n, s.skill_id FROM grams c JOIN {_ALIASES} s ON s.alias = c.g WHERE NOT EXISTS (SELECT 1 FROM masks m WHERE m.span_id = c.span_id AND m.a < c.i + c.n AND c.i < m.b)),
  best AS MATERIALIZED (SELECT span_id, i, max(n) AS n, arg_max(skill_id, n) AS skill_id FROM cand GROUP BY span_id, i),
  chains AS MATERIALIZED (SELECT *, sum(fresh) OVER (PARTITION BY span_id ORDER BY i) AS chain FROM (SELECT *, CASE WHEN i >= coalesce(max(i + n) OVER (PARTITION BY span_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS fresh FROM best)),
  hits(span_id, chain, i, n, skill_id) AS (SELECT span_id, chain, i, n, skill_id FROM chains WHERE fresh = 1
    UNION ALL SELECT h.span_id, h.chain, min(c.i), arg_min(c.n, c.i), arg_min(c.skill_id, c.i) FROM hits h JOIN chains c ON c.span_id = h.span_id AND c.chain = h.chain AND c.i >= h.i + h.n GROUP BY h.span_id, h.chain)"""


@query("k3_vocabulary_hits", f"{_FIRST} SELECT span_id, string_agg(i || ':' || (i + n) || ':' || skill_id, ',' ORDER BY i) AS hits FROM hits GROUP BY span_id")
def k3(t):
    out = resolution.vocabulary_hits(_spans(t), *_vocabulary(t))
    return out.select("span_id", F.expr("array_join(transform(hits, x -> concat(x.start, ':', x.stop, ':', x.skill_id)), ',')").alias("hits"))


@query("j2_resolver", f"{_FIRST} SELECT w.span_id, h.skill_id FROM w LEFT JOIN (SELECT span_id, arg_min(skill_id, i) AS skill_id FROM hits GROUP BY span_id) h USING (span_id)")
def j2(t):
    return resolution.resolve(_spans(t), *_vocabulary(t))


def _asked_spans(t):
    """Three spans a document: one as it stands, one in capitals with other blanks, one from elsewhere."""
    d = t.read("documents")
    cut = F.trim(F.substring("text", 11, 30))
    own = d.select("doc_id", F.lit(0).alias("n"), cut.alias("raw_text"))
    loud = d.select("doc_id", F.lit(1).alias("n"), F.regexp_replace(F.upper(cut), " ", "  ").alias("raw_text"))
    return own.union(loud).union(d.select("doc_id", F.lit(2).alias("n"), F.concat(F.lit("zqx "), cut)))


@query("k4_verbatim_spans")
def k4(t):
    d = t.read("documents").select("doc_id", "text")
    return text_jobs.verify_spans(_asked_spans(t), d, "doc_id")


_FROM = " || ".join(f"chr({c})" for c in (8216, 8217, 8219, 8242, 8220, 8221, 8223, 8243, 8208, 8209, 8210, 8211, 8212, 8722))
_TO = "'" + "''" * 4 + '"' * 4 + "-" * 6 + "'"


def _plain(x):
    """The plain form in SQL: typographic characters, then what counts for nothing, then blanks."""
    return rf"trim(regexp_replace(regexp_replace(replace(translate({x}, {_FROM}, {_TO}), chr(8230), '...'), '[\x{{200B}}-\x{{200D}}\x{{FEFF}}\x{{AD}}]', '', 'g'), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ' ', 'g'))"


@query("k4_verbatim_found", f"""SELECT doc_id, n, coalesce(s <> '' AND (contains(p, s) OR contains(lower(p), lower(s))), false) AS found FROM (SELECT doc_id, n, {_plain('text')} AS p, {_plain("raw")} AS s
  FROM (SELECT doc_id, text, unnest([0, 1, 2]) AS n, unnest([trim(substr(text, 11, 30), ' '), replace(upper(replace(trim(substr(text, 11, 30), ' '), 'ß', 'SS')), ' ', '  '), 'zqx ' || trim(substr(text, 11, 30), ' ')]) AS raw FROM documents))""")
def k4_found(t):
    d = t.read("documents").select("doc_id", "text")
    return text_jobs.verify_spans(_asked_spans(t), d, "doc_id").select("doc_id", "n", F.col("verbatim").isNotNull().alias("found"))


@query("k5_html_text")
def k5(t):
    return html_text.html_text(t.read("pages"), "html").drop("html")


@query("k6_main_content")
def k6(t):
    return html_text.main_text(t.read("pages"), "html").drop("html")


@query("a6_vendor_payloads")
def a6(t):
    """The pages as payloads of the four boards, parsed back."""
    pages = t.read("pages").withColumn("title", F.concat(F.lit("Page "), "page_id"))
    shapes = {
        "board_a": F.struct("title", F.col("html").alias("content"), F.lit("Acme").alias("company_name"), F.struct(F.lit("Here").alias("name")).alias("location")),
        "board_b": F.struct(F.col("title").alias("text"), F.col("html").alias("description"), F.struct(F.array(F.lit("A"), F.lit("B")).alias("allLocations")).alias("categories")),
        "board_c": F.struct(F.lit("Acme").alias("organizationName"), F.array(F.struct(F.col("page_id").cast("string").alias("id"), "title", F.lit("There").alias("location"), F.lit(True).alias("isRemote"), F.col("html").alias("descriptionHtml"))).alias("jobs")),
        "board_d": F.struct(F.col("title").alias("name"), F.struct(F.lit("Acme").alias("name")).alias("company"), F.struct(F.lit("X").alias("city"), F.lit("Y").alias("country")).alias("location"), F.struct(F.struct(F.struct(F.lit("About").alias("title"), F.col("html").alias("text")).alias("jobDescription")).alias("sections")).alias("jobAd")),
    }
    out = None
    for i, (board, shape) in enumerate(shapes.items()):
        own = payloads.parse_payloads(pages.where(f"page_id % 4 = {i}").select(F.col("page_id").alias("id"), F.to_json(shape).alias("payload")), board).withColumn("board", F.lit(board))
        out = own if out is None else out.unionByName(own)
    return out




@query("k7_candidate_parsing", """SELECT l_orderkey AS response_id, 'part ' || l_partkey AS raw_text, CASE l_returnflag WHEN 'R' THEN 'required' ELSE 'preferred' END AS importance, round(CASE WHEN l_linenumber = 2 THEN 0 ELSE greatest(0, least(1, (l_quantity - 4) / 40)) END, 3) AS confidence
  FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <> 3""")
def k7(t):
    item = F.struct(
        F.when(F.col("l_linenumber") == 3, "  ").otherwise(F.concat(F.lit("part "), "l_partkey")).alias("raw_text"), F.expr("CASE l_returnflag WHEN 'R' THEN 'required' WHEN 'A' THEN 'preferred' ELSE 'other' END").alias("importance"),
        F.when(F.col("l_linenumber") == 2, "n/a").otherwise(((F.col("l_quantity") - 4) / 40).cast("string")).alias("confidence"),
    )
    responses = t.read("lineitem").groupBy(F.col("l_orderkey").alias("response_id")).agg(F.to_json(F.struct(F.collect_list(item).alias("requirements"))).alias("payload"))
    return text_jobs.parse_candidates(responses)


def _match_responses(t):
    """A response for each match: every 97th citation cites what wasn't supplied, every 89th evidenced one nothing."""
    rows = t.citation.withColumn("posting_id", F.col("match_id")).withColumn("cited", F.when(F.col("id") % 97 == 0, 999999).when((F.col("id") % 89 == 0) & (F.col("status") == "evidenced"), F.lit(None)).otherwise(F.coalesce("chunk_id", F.lit(7))))
    payload = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string").alias("requirement_id"), "status", F.col("cited").cast("string").alias("evidence_chunk_id")))).alias("requirements"), F.lit("plausible").alias("verdict")))
    responses = rows.where("id % 5 <> 0").groupBy(F.col("match_id").alias("response_id"), "posting_id").agg(payload.alias("payload"))
    return responses, rows.select("posting_id", "id", "skill_id"), rows.where("chunk_id is not null").select("posting_id", "chunk_id")


_VALID = """WITH rows AS (SELECT *, CASE WHEN id % 97 = 0 THEN 999999 WHEN id % 89 = 0 AND status = 'evidenced' THEN NULL ELSE coalesce(chunk_id, 7) END AS cited FROM citation),
  asked AS (SELECT match_id, id, min(importance) AS importance FROM rows GROUP BY match_id, id),
  judged AS (SELECT r.*, EXISTS (SELECT 1 FROM rows c WHERE c.match_id = r.match_id AND c.chunk_id = r.cited) AS ok, row_number() OVER (PARTITION BY match_id, id ORDER BY status, CAST(cited AS VARCHAR) NULLS FIRST) > 1 AS again FROM rows r WHERE id % 5 <> 0),
  outcome AS (SELECT match_id AS response_id, CASE WHEN bool_or(NOT again AND status = 'evidenced' AND cited IS NOT NULL AND NOT ok) THEN 'fabricated' WHEN bool_or(NOT again AND status = 'evidenced' AND cited IS NULL) THEN 'missing'
    WHEN bool_or(again) THEN 'malformed' ELSE 'accepted' END AS outcome FROM judged GROUP BY match_id)"""


@query("k8_response_outcomes", f"{_VALID} SELECT response_id, outcome FROM outcome")
def k8(t):
    return text_jobs.validate_citations(*_match_responses(t))[1].select("response_id", "outcome")


@query("k8_accepted_citations", f"""{_VALID} SELECT o.response_id, r.id AS requirement_id, coalesce(j.status, 'absent') AS status, CASE WHEN j.ok THEN j.cited END AS chunk_id, j.id IS NOT NULL AS answered
  FROM outcome o JOIN asked r ON r.match_id = o.response_id LEFT JOIN judged j ON j.match_id = r.match_id AND j.id = r.id WHERE outcome = 'accepted'""")
def k8_accepted(t):
    return text_jobs.validate_citations(*_match_responses(t))[0].select("response_id", "requirement_id", "status", "chunk_id", "answered")


@query("g3_unanswered_requirements", f"{_VALID} SELECT o.response_id, r.id AS requirement_id FROM outcome o JOIN asked r ON r.match_id = o.response_id WHERE outcome = 'accepted' AND r.id % 5 = 0")
def g3(t):
    return text_jobs.validate_citations(*_match_responses(t))[0].where("not answered").select("response_id", "requirement_id")


@query("k13_match_assembly", f"""{_VALID}, cited AS (SELECT o.response_id, r.importance, coalesce(j.status, 'absent') AS status FROM outcome o JOIN asked r ON r.match_id = o.response_id LEFT JOIN judged j ON j.match_id = r.match_id AND j.id = r.id WHERE outcome = 'accepted')
  SELECT response_id AS match_id, count(*) AS n, round(CAST(sum(w * c) AS DOUBLE) / CAST(sum(w) AS DOUBLE), 4) AS score FROM (SELECT *, CASE importance WHEN 'required' THEN 1.0 WHEN 'preferred' THEN 0.5 ELSE 0.25 END AS w, CASE status WHEN 'evidenced' THEN 1.0 WHEN 'weak' THEN 0.5 ELSE 0.0 END AS c FROM cited) GROUP BY response_id""")
def k13(t):
    from ..operators.demand import match_scores

    accepted = text_jobs.validate_citations(*_match_responses(t))[0]
    asked = t.citation.groupBy(F.col("match_id").alias("posting_id"), F.col("id").alias("requirement_id")).agg(F.min("importance").alias("importance"))
    return match_scores(accepted.join(asked, ["posting_id", "requirement_id"]).withColumnRenamed("response_id", "match_id"))


@query("k9_rewrite_validation", r"""SELECT p_partkey AS source_id, text FROM (SELECT p_partkey, 'Built the ' || p_name || ' pipeline in ' || p_size || ' weeks and kept it running' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' END AS text, p_partkey % 5 = 0 AS bad FROM part) WHERE p_partkey % 3 <> 0 AND NOT bad AND length(text) >= 40""")
def k9(t):
    part = t.read("part")
    sources = part.selectExpr("p_partkey AS source_id", "concat('Wrote a ', p_name, ' tool over ', p_size, ' weeks that the whole team came to use every day.') AS original", "array(p_name, 'tool') AS tags", "'Initech' AS company", "'Engineer' AS title")
    text = "concat('Built the ', p_name, ' pipeline in ', p_size, ' weeks and kept it running', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' END)"
    good = part.selectExpr("p_partkey AS source_id", "2 AS pos", f"{text} AS text", "CASE WHEN p_partkey % 5 = 0 THEN array('unheard') ELSE array(p_name) END AS keywords")
    worse = part.selectExpr("p_partkey AS source_id", "1 AS pos", "concat('Led the ', p_name, ' work at Initech and saved 99999 hours for everyone.') AS text", "array(p_name) AS keywords")
    return text_jobs.validate_rewrites(good.union(worse), sources)


@query("k10_requirement_upsert", """SELECT posting_id, raw_text, CASE coalesce(max(r) FILTER (quantity > 20), max(r)) WHEN 3 THEN 'required' WHEN 2 THEN 'preferred' ELSE 'mentioned' END AS importance,
  CASE WHEN bool_and(quantity <= 20) THEN 'kept' WHEN bool_and(quantity > 20) THEN 'inserted' ELSE 'updated' END AS change
  FROM (SELECT *, CASE importance WHEN 'required' THEN 3 WHEN 'preferred' THEN 2 ELSE 1 END AS r FROM requirement) GROUP BY posting_id, raw_text""")
def k10(t):
    key = ["posting_id", "raw_text"]
    stored = text_jobs.strongest(t.requirement.where("quantity <= 20"), key).withColumnRenamed("importance", "old")
    new = text_jobs.strongest(t.requirement.where("quantity > 20"), key)
    both = stored.select(*key, "old").join(new.select(*key, "importance"), key, "full_outer")
    change = F.when(F.col("importance").isNull(), "kept").when(F.col("old").isNull(), "inserted").otherwise("updated")
    return both.select(*key, F.coalesce("importance", "old").alias("importance"), change.alias("change"))


def _extraction(t):
    """Two attempts of a response for each document: the first has a span that isn't in the text wherever doc_id % 3 = 0."""
    d = t.read("documents")
    cut = lambda a: F.trim(F.substring("text", a, 12))
    item = lambda span, importance: F.struct(span.alias("raw_text"), F.lit(importance).alias("importance"), F.lit("0.9").alias("confidence"))
    wrong = F.when(F.col("doc_id") % 3 == 0, F.lit("zqx not there")).otherwise(cut(14))
    first = d.select((F.col("doc_id") * 2).alias("response_id"), F.col("doc_id").alias("posting_id"), F.lit(1).alias("attempt"), F.to_json(F.struct(F.array(item(cut(1), "required"), item(cut(1), "mentioned"), item(wrong, "preferred")).alias("requirements"))).alias("payload"))
    second = d.where("doc_id % 6 = 0").select((F.col("doc_id") * 2 + 1).alias("response_id"), F.col("doc_id").alias("posting_id"), F.lit(2).alias("attempt"), F.to_json(F.struct(F.array(item(cut(1), "required")).alias("requirements"))).alias("payload"))
    return d, first.union(second)


@query("k12_requirement_extraction", f"""SELECT doc_id AS posting_id, CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 1 END AS attempt,
  CAST(CASE WHEN a = '' THEN 0 ELSE 1 END + CASE WHEN doc_id % 3 = 0 OR b = '' OR a = b THEN 0 ELSE 1 END AS BIGINT) AS found, CAST(CASE WHEN doc_id % 3 = 0 AND doc_id % 6 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS rejected
  FROM (SELECT doc_id, coalesce({_plain("substr(text, 1, 12)")}, '') AS a, coalesce({_plain("substr(text, 14, 12)")}, '') AS b FROM documents)""")
def k12(t):
    d, responses = _extraction(t)
    texts = d.select(F.col("doc_id").alias("posting_id"), "text")
    spans = text_jobs.parse_candidates(responses).join(responses.select("response_id", "posting_id", "attempt"), "response_id")
    checked = text_jobs.verify_spans(spans, texts, "posting_id")
    chosen = text_jobs.best_attempt(responses.select("response_id", "posting_id", "attempt"), checked.where("verbatim is null").select("response_id"))
    kept = checked.join(chosen.select("response_id"), "response_id", "left_semi")
    good = text_jobs.strongest(kept.where("verbatim is not null").select("posting_id", F.col("verbatim").alias("raw_text"), "importance", "confidence"), ["posting_id", "raw_text"]).groupBy("posting_id").agg(F.count(F.lit(1)).alias("found"))
    bad = kept.groupBy("posting_id").agg(F.count_if(F.col("verbatim").isNull()).alias("rejected"))
    return chosen.select("posting_id", "attempt").join(good, "posting_id", "left").join(bad, "posting_id", "left").na.fill(0, ["found", "rejected"])


@query("d23_extraction_quality", """SELECT doc_id, CAST(2 AS BIGINT) AS labels, CAST(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END AS BIGINT) AS found, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS agreed FROM documents""")
def d23(t):
    d = t.read("documents").select("doc_id")
    name = lambda x: F.concat(F.lit(f"{x} span of "), F.col("doc_id").cast("string"), F.lit(" end"))
    labels = d.select("doc_id", name("first").alias("raw_text"), F.lit("required").alias("importance")).union(d.select("doc_id", name("second"), F.lit("preferred")))
    rows = d.where("doc_id % 4 <> 0").select("doc_id", F.upper(name("first")).alias("raw_text"), F.lit("required").alias("importance")).union(d.select("doc_id", F.regexp_replace(name("second"), " ", "  "), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'mentioned' ELSE 'preferred' END")))
    return text_jobs.extraction_quality(labels, rows, "doc_id")


def _specs(t):
    return t.read("part").selectExpr(
        "concat(p_name, ' ', p_partkey % 1500) AS name", "CASE WHEN p_partkey % 50 = 0 THEN 'nonsense' ELSE 'framework' END AS category", "p_size % 7 <> 0 AS is_actionable", "array(concat(p_brand, ' ', p_partkey)) AS aliases"
    )


@query("a5_taxonomy_load", "SELECT owner, alias_norm FROM (SELECT DISTINCT p_name || ' ' || (p_partkey % 1500) AS owner, p_name || ' ' || (p_partkey % 1500) AS alias_norm FROM part UNION SELECT p_name || ' ' || (p_partkey % 1500), lower(p_brand) || ' ' || p_partkey FROM part)")
def a5(t):
    return docs.check_taxonomy(_specs(t))[1].select("owner", "alias_norm").distinct()


@query("g4_taxonomy_problems", """SELECT name, problem FROM (SELECT p_name || ' ' || (p_partkey % 1500) AS name, CASE WHEN p_partkey % 50 = 0 THEN 'bad category' END AS problem FROM part) WHERE problem IS NOT NULL
  UNION ALL SELECT p_name || ' ' || (p_partkey % 1500), 'name twice' FROM part GROUP BY 1 HAVING count(*) > 1""")
def g4(t):
    return docs.check_taxonomy(_specs(t))[2]


@query("h8_taxonomy_normalize", f"SELECT doc_id, {_NORM} AS norm FROM documents")
def h8(t):
    return t.read("documents").select("doc_id", taxonomy_normalized(F.col("text")).alias("norm"))
