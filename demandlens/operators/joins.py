"""Joins: texts, citations, details, dispatch by host, rule matching and fuzzy lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ranked
from .filters import active

IMPORTANCE_ORDER = {"required": 0, "preferred": 1, "mentioned": 2}


def with_text(postings: DataFrame, jd: DataFrame) -> DataFrame:
    return postings.join(jd.withColumnRenamed("posting_id", "id"), "id", "left")


def needs_fetch(postings: DataFrame, jd: DataFrame) -> DataFrame:
    """Active postings without a text row or with one worth another try."""
    retry = F.col("fetch_status").isNull() | F.col("fetch_status").isin("pending", "rate_limited", "transient_error")
    return with_text(postings.where(active()), jd.select("posting_id", "fetch_status")).where(retry)


def extraction_backlog(postings: DataFrame, jd: DataFrame, requirements: DataFrame, limit: int) -> DataFrame:
    """Newest active postings with a text and no requirement yet."""
    texts = jd.where("raw_text is not null and fetch_status = 'ok'").select(F.col("posting_id").alias("id"), "raw_text")
    todo = postings.where(active()).join(texts, "id").join(requirements.select(F.col("posting_id").alias("id")), "id", "left_anti")
    return todo.orderBy(F.desc_nulls_last("posted_at"), F.desc("id")).limit(limit)


def citation_detail(citations: DataFrame, skills: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations with the skill's name and the chunk's label, or what stands for them."""
    out = citations.join(skills.select(F.col("id").alias("skill_id"), F.col("name").alias("skill")), "skill_id", "left").join(chunks.select(F.col("id").alias("chunk_id"), F.col("label").alias("chunk_label")), "chunk_id", "left")
    return out.withColumn("skill", F.coalesce("skill", F.lit("(unmapped)")))


def shortlist_detail(shortlist: DataFrame, postings: DataFrame, run_id: str) -> DataFrame:
    return shortlist.where(F.col("run_id") == run_id).join(postings.select(F.col("id").alias("posting_id"), "company", "title"), "posting_id").orderBy("rank", "posting_id")


def requirement_view(requirements: DataFrame, skills: DataFrame) -> DataFrame:
    """Requirements with skill names and their order in a posting: required, preferred, mentioned, then by id."""
    named = requirements.join(skills.select(F.col("id").alias("skill_id"), F.col("name").alias("skill")), "skill_id", "left")
    order = [ranked(F.col("importance"), IMPORTANCE_ORDER), F.col("id")]
    return named.withColumn("place", F.row_number().over(Window.partitionBy("posting_id").orderBy(*order)))


def query_text(raw_text: Column, skill: Column) -> Column:
    """The span with its skill's name after it, unless it names it already."""
    missing = skill.isNotNull() & ~F.contains(F.lower(raw_text), F.lower(skill))
    return F.when(missing, F.concat_ws(" ", raw_text, skill)).otherwise(raw_text)


def dispatch(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Adapter of each http(s) URL: the first rule (domain, adapter, priority) whose domain is the host or a suffix of it,
    else 'fallback'; 'rejected' for other URLs. Hosts look up their suffixes by equality, distinct hosts only."""
    host = F.lower(F.try_parse_url(F.trim(url_col), F.lit("HOST")))
    web = urls.withColumn("_host", F.when(F.lower(F.trim(url_col)).rlike("^https?://"), host))
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    hosts = web.where("_host is not null").select("_host").distinct().select("_host", F.explode(suffixes).alias("domain"))
    found = hosts.join(rules, "domain").groupBy("_host").agg(F.min_by("adapter", "priority").alias("adapter"))
    adapter = F.when(F.col("_host").isNull(), "rejected").otherwise(F.coalesce("adapter", F.lit("fallback")))
    return web.join(found, "_host", "left").withColumn("adapter", adapter).drop("_host")


_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def posting_ids(urls: DataFrame) -> DataFrame:
    """Owner and job id of posting URLs (url, adapter in board_a to board_d); both null for shapes that no adapter has.

    board_a: ?for= and ?token=, /{owner}/jobs/{n}, or {owner} with ?gh_jid=. board_b: {owner}/{uuid}, also below v0/postings.
    board_c: {owner}/{id} or {owner} with an id in the query. board_d: {owner}/{n}-{slug}, company/{owner}/job|publication/{id}, and two API shapes.
    """
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    param = lambda k: F.nullif(F.coalesce(F.try_parse_url(F.col("url"), F.lit("QUERY"), F.lit(k)), F.lit("")), F.lit(""))
    part = lambda pattern, i: F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))
    first = part("^/+([^/]+)", 1)
    nothing = F.lit(None).cast("string")
    own = F.when(first != "embed", first)

    def pick(*shapes: tuple[Column, Column]) -> tuple[Column, Column]:
        whole = [a.isNotNull() & b.isNotNull() for a, b in shapes]
        out = [nothing, nothing]
        for ok, pair in zip(reversed(whole), reversed(shapes)):
            out = [F.when(ok, pair[i]).otherwise(out[i]) for i in (0, 1)]
        return out[0], out[1]

    jobs = r"^/(?:v1/boards/)?([A-Za-z0-9._-]+)/jobs/(\d+)"
    listed = part(jobs, 1)
    board_a = pick((param("for"), param("token")), (F.when(listed != "embed", listed), part(jobs, 2)), (own, param("gh_jid")))
    pair = rf"^/+(?:v0/+postings/+)?([^/]+)/+({_UUID})(?:/|$)"
    board_b = pick((part(pair, 1), part(pair, 2)))
    second = part("^/+[^/]+/+([^/]+)", 1)
    board_c = pick((first, F.when(second != "application", second)), (first, F.coalesce(param("jobPostingId"), param("jobId"), param("posting"))))
    api = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))).startswith("api.")
    tail = rf"/company/([^/]+)/(?:publication|job)/(?:({_UUID})(?:/|$)|(\d+)(?:-|/|$))"
    web = ((part(tail, 1), F.coalesce(part(tail, 2), part(tail, 3))), (part(r"^/+([^/]+)/+(\d+)(?:-|/|$)", 1), part(r"^/+[^/]+/+(\d+)(?:-|/|$)", 1)))
    service = ((part("/companies/([^/]+)/postings/([^/]+)", 1), part("/companies/([^/]+)/postings/([^/]+)", 2)), (part("^/+v1/+([^/]+)/+postings/+([^/]+)", 1), part("^/+v1/+([^/]+)/+postings/+([^/]+)", 2)))
    at_web, at_service = pick(*web), pick(*service)
    board_d = [F.when(api, at_service[i]).otherwise(at_web[i]) for i in (0, 1)]
    of = {"board_a": board_a, "board_b": board_b, "board_c": board_c, "board_d": board_d}
    choose = lambda i: F.coalesce(*(F.when(F.col("adapter") == k, v[i]) for k, v in of.items()))
    return urls.withColumns({"owner": choose(0), "job_id": choose(1)})


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """Rules (host, pattern, allow) that hold for an agent, from files (host, body).

    A group is a run of user-agent lines and the rules after it. Of groups whose agent name begins ours the longest name counts, else '*'.
    """
    lines = files.select("host", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    clean = F.trim(F.regexp_replace("line", "#.*$", ""))
    pairs = lines.select("host", "n", F.lower(F.trim(F.substring_index(clean, ":", 1))).alias("field"), F.trim(F.regexp_extract(clean, "^[^:]*:(.*)$", 1)).alias("value")).where("field in ('user-agent', 'allow', 'disallow')")
    by_host = Window.partitionBy("host").orderBy("n")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(by_host), F.lit("")) != "user-agent")
    grouped = pairs.withColumn("_start", starts.cast("int")).withColumn("group", F.sum("_start").over(by_host)).where("group > 0")
    agents = grouped.where("field = 'user-agent'").select("host", "group", F.lower("value").alias("name"))
    fits = agents.where((F.col("name") == "*") | ((F.col("name") != "") & F.lit(agent.lower()).startswith(F.col("name"))))
    weight = F.when(F.col("name") == "*", -1).otherwise(F.length("name"))
    chosen = fits.groupBy("host").agg(F.min_by("group", F.struct(-weight, "group")).alias("group"))
    return grouped.where("field <> 'user-agent' and value <> ''").join(chosen, ["host", "group"], "left_semi").select("host", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow"))


def robots_candidates(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url_id, host, path) with each rule of their host (pattern, allow) whose literal beginning begins the path.

    A pattern's text up to its first '*' (or final '$') is its key; a path is looked up by its beginnings of the lengths
    that the host's keys have. Only patterns with a leading '*' meet every path of their host.
    """
    key = F.regexp_replace(F.substring_index("pattern", "*", 1), r"\$$", "")
    keyed = rules.distinct().withColumn("key", key)
    lengths = keyed.groupBy("host").agg(F.collect_set(F.length("key")).alias("lengths"))
    begun = urls.join(lengths, "host").withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path")))).withColumn("key", F.expr("left(path, n)"))
    return begun.select("url_id", "host", "path", "key").join(keyed, ["host", "key"]).drop("key")


def robots_allow(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url_id, host, path) with ``allowed``: the longest matching pattern decides, allow on ties, true without any.

    '*' stands for any characters and a final '$' for the end. Rules are found by ``robots_candidates``; the whole pattern
    is a residual test. An empty path is '/'; url_id must be unique; urls without a host are allowed.
    """
    bare = F.regexp_replace("pattern", r"\$$", "")
    regex = F.concat(F.lit("(?s)^"), F.array_join(F.transform(F.split(bare, r"\*"), lambda p: F.when(p == "", p).otherwise(F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))), ".*"), F.when(F.endswith("pattern", F.lit("$")), F.lit("\\z")).otherwise(F.lit("")))
    asked = urls.withColumn("path", F.when(F.coalesce("path", F.lit("")) == "", "/").otherwise(F.col("path")))
    hits = robots_candidates(asked, rules).withColumn("regex", regex).where("path rlike regex")
    verdict = hits.groupBy("url_id").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow")).alias("best"))
    return asked.join(verdict, "url_id", "left").withColumn("allowed", F.coalesce("best.allow", F.lit(True))).drop("best")


def posting_detail(postings: DataFrame, jd: DataFrame, requirements: DataFrame, matches: DataFrame, citations: DataFrame) -> DataFrame:
    """One nested record a posting: text row, requirements in order, latest match and its citations."""
    from .ranking import latest_matches

    reqs = requirements.groupBy("posting_id").agg(F.array_sort(F.collect_list(F.struct(ranked(F.col("importance"), IMPORTANCE_ORDER).alias("ord"), "id", "raw_text", "skill_id"))).alias("requirements"))
    cited = citations.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("id", "skill_id", "status"))).alias("citations"))
    last = latest_matches(matches).join(cited.withColumnRenamed("match_id", "id"), "id", "left").select("posting_id", F.struct("id", "score", "verdict", "citations").alias("match"))
    out = postings.withColumnRenamed("id", "posting_id")
    return out.join(jd, "posting_id", "left").join(reqs, "posting_id", "left").join(last, "posting_id", "left")


def posting_meta(postings: DataFrame, requirements: DataFrame) -> DataFrame:
    counts = requirements.groupBy("posting_id").agg(F.count(F.lit(1)).alias("requirement_count"))
    return postings.select(F.col("id").alias("posting_id"), "company", "title").join(counts, "posting_id", "left").na.fill(0, ["requirement_count"])
