"""Hand-made cases: the fixtures of the survey, row-only jobs and batch forms of streams."""

import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demandlens.config import RankConfig, ReportConfig
from demandlens.functions import columns as fn
from demandlens.operators import changes, demand, filters, html_text, joins, resolution, text_jobs
from demandlens.sources import documents, feed, payloads, sinks
from demandlens.streaming import work


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_identity_and_urls(spark):
    assert values(spark, fn.identity_normalized, ["AT&T", "Booz Allen Hamilton, Inc.", "!!!", "L’Oréal", None, "ﬁn Ⅳ"]) == ["at t", "booz allen hamilton inc", "", "l oreal", "", "fin iv"]
    assert values(spark, fn.url_host, ["https://www.acme.com/careers/1/", "https://acme.com:8080", None, "junk"]) == ["acme.com", "acme.com", "", ""]
    assert values(spark, fn.url_path, ["https://www.acme.com/careers/1/?q=1", "https://acme.com", "https://acme.com/"]) == ["/careers/1", "", "/"]


def test_seasons_and_times(spark):
    assert values(spark, fn.start_season, ["New Grad 2026 Full-time", "Autumn 2026", "Java / Spring Boot Developer", "2027, winter start", None, "in 1999"]) == ["2026", "Fall 2026", None, "Winter 2027", None, None]
    df = spark.createDataFrame([(None, "Summer\u00a02027"), ("no year", "2026 - fall"), ("2025", "Winter 2024"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(fn.start_season(F.col("a"), F.col("b"))).collect()] == ["Summer 2027", "Fall 2026", "2025", None]
    got = values(spark, fn.epoch_timestamp, ["1765365281", "0", "", "-5", "not a number", None])
    assert str(got[0]) == "2025-12-10 11:14:41" and got[1:] == [None] * 5


def test_taxonomy_form(spark):
    cases = {
        "Node.js, ASP.NET & .NET.": "node.js asp.net and .net", "C++/C#": "c++ c#", "bachelor\u2019s degree": "bachelors degree", "a..b ...c !.d": "a b c d", "\u0001": "", "\u0001.x": "x", "x.\u0001y": "x y",
        "\u201cQuoted\u201d \u2013 dash\u2014ed\u00a0x\u200by": "quoted dash ed xy", "We use Go.": "we use go", "1.5 .5": "1.5 .5", None: "", "\u02bc\u201b\u2018'\u2010\u2011\u2012\u2015\u2212": "",
    }
    assert values(spark, fn.taxonomy_normalized, list(cases)) == list(cases.values())


def test_literal_patterns(spark):
    assert values(spark, lambda c: fn.has_phrase(c, r"a\E.b"), [r"x a\E.b y", "a.b", "axb"]) == [True, False, False]
    rules = joins.robots_rules(spark.createDataFrame([("h", "User-agent: *\nDisallow: /a\\E*c\n")], "host string, body string"), "bot")
    urls = spark.createDataFrame([(0, "h", "/a\\Ebc"), (1, "h", "/abc")], "url_id int, host string, path string")
    assert [r.allowed for r in joins.robots_allow(urls, rules).orderBy("url_id").collect()] == [False, True]


def test_remote_and_phrases(spark):
    assert values(spark, fn.is_remote, [["NYC", "Remote in USA (FL)"], ["Remoteville"], [], None, ["WFH"]], "array<string>") == [True, False, False, False, True]
    assert values(spark, lambda c: fn.has_phrase(c, "c++"), ["uses C++ daily", "c++11", "abc++", None]) == [True, False, False, False]


def test_dates(spark):
    got = values(spark, lambda c: fn.flexible_date(c), ["2026-05-03", "5/3/2026", "May 2026", "2026", "soon", None])
    assert [tuple(g) if g else None for g in got] == [(2026, 5, 3), (2026, 5, 3), (2026, 5, None), (2026, None, None), None, None]
    df = spark.createDataFrame([("Jun. 2026 – Aug. 2026",), ("2025",)], "x string")
    rows = df.select(*fn.date_range(F.col("x"))).collect()
    assert (rows[0][0].month, rows[0][1].month, rows[1][0], rows[1][1].year) == (6, 8, None, 2025)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\0"), max_size=30), min_size=1, max_size=8))
def test_normalisers_are_idempotent(spark, texts):
    once = values(spark, fn.taxonomy_normalized, texts)
    assert values(spark, fn.taxonomy_normalized, once) == once
    once = values(spark, fn.identity_normalized, texts)
    assert values(spark, fn.identity_normalized, once) == once
    once = values(spark, fn.collapsed, texts)
    assert values(spark, fn.collapsed, once) == once


def test_filter_rules(spark):
    cfg = RankConfig(grad_date=dt.date(2027, 5, 1), allowlist=("Remote", "Detroit", "Chicago"))
    said = ["Offers Sponsorship", "Does Not Offer Sponsorship", "U.S. Citizenship is Required", "Active Security Clearance Required", "Offshore Only", "Requires U.S. Permanent Residency", None, "", "TBD"]
    assert values(spark, filters.sponsorship_class, said) == ["offers", "not_offered", "citizenship", "citizenship", "offshore", "citizenship", "unknown", "unknown", "unknown"]
    rows = [
        (1, None, ["San Francisco"], True, "SWE", "Summer 2027"), (2, None, ["San Francisco"], False, "swe", "Fall 2027"), (3, None, ["NYC", "Detroit"], False, " swe ", "2027"), (4, None, [], False, "swe", None),
        (5, None, None, False, "swe", None), (6, "Offshore Only", ["London"], False, "quant", "Spring 2027"), (7, None, ["Chicago"], False, "quant", None), (8, None, ["Chicago"], False, "alchemy", "ASAP"), (9, "x", ["chicago"], False, "", "Spring 2027"), (10, "x", ["remote"], False, None, "2026"),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], "id int, sponsorship string, locations array<string>, is_remote boolean, role_type string, start_season string, inactive_at string")
    got = {r.id: r for r in filters.classified(df, cfg).collect()}
    assert [got[i].drop_reason for i in range(1, 11)] == [None, "location", None, "location", "location", "sponsorship_offshore", "role_type", None, "start_season", "start_season"]
    assert got[3].flags == ["sponsorship_unknown", "start_season_partial"] and got[8].flags == ["sponsorship_unknown", "role_type_unknown", "start_season_unknown"]
    counts = {r.reason: r.n for r in demand.funnel(df, filters.classified(df, cfg)).collect()}
    assert sum(counts.values()) == 10 and counts["inactive"] == 0
    report = {r.id for r in filters.eligible(df, ReportConfig(location_patterns=("%detroit%",))).collect()}
    assert report == {1, 4, 5}


def test_feed_files(spark, tmp_path):
    rows = [
        {"id": "", "company_name": "Acme", "title": "T", "url": "https://a.com/x", "active": True}, {"id": "b", "company_name": "B", "title": "T", "url": ""}, {"id": "c", "company_name": "C", "title": "T", "url": "u", "active": True, "is_visible": False, "date_posted": 0},
        {"id": "d", "company_name": "D1", "title": "T", "url": "u", "active": True}, {"id": "d", "company_name": "D2", "title": "T", "url": "u", "active": True}, "a string",
    ]
    (tmp_path / "feed.json").write_text(json.dumps(rows))
    good, bad = feed.map_feed_records(feed.read_feed(spark, str(tmp_path)))
    assert bad.count() == 2
    last = {r.canonical_key: r for r in changes.last_by_key(good, "canonical_key", "pos").collect()}
    assert len(last) == 3 and last["d"].company == "D2" and not last["c"].active and last["c"].posted_at is None
    (tmp_path / "broken.json").write_text("[{")
    with pytest.raises(Exception, match="not a JSON array"):
        feed.read_feed(spark, str(tmp_path)).collect()


def test_snapshots(spark):
    kinds = "canonical_key string, company string, posted_at timestamp, active boolean"
    empty = spark.createDataFrame([], "canonical_key string, company string, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp, inactive_at timestamp, repost_count int")
    runs = [[("a", True), ("b", True), ("c", True), ("d", False)], [("a", True), ("c", True), ("d", False), ("e", True)], [("a", True), ("b", True), ("c", True), ("d", False), ("e", True)]]
    state, counts = empty, []
    for day, run in enumerate(runs, 1):
        new = changes.lifecycle_upsert(state, spark.createDataFrame([(k, k.upper(), None, a) for k, a in run], kinds), F.lit(f"2026-01-0{day}").cast("timestamp"), ["company"])
        counts.append(changes.change_counts(new, ["new", "updated", "reactivated", "deactivated"]).first().asDict())
        state = spark.createDataFrame(new.drop("change").collect(), empty.schema)
    assert counts[0]["new"] == 4 and counts[1] == {"new": 1, "updated": 3, "reactivated": 0, "deactivated": 1} and counts[2]["reactivated"] == 1
    rows = {r.canonical_key: r for r in state.collect()}
    assert rows["b"].repost_count == 1 and rows["b"].inactive_at is None and str(rows["d"].inactive_at)[:10] == "2026-01-01"


def test_markdown_files(spark, tmp_path):
    for name, body in {"a.md": "# A", "sub/b.MDX": "b", ".git/c.md": "c", "vendor/d.md": "d", "e.txt": "e", "blank.md": " \n"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    assert {(r.source_ref, r.text) for r in documents.read_markdown(spark, str(tmp_path)).collect()} == {("a.md", "# A"), ("sub/b.MDX", "b")}


def test_chunks():
    chunk = text_jobs.markdown_chunks
    assert chunk("") == [] and chunk("# Only\n\n## Headings\n") == []
    got = chunk("# One\nfirst\n\n- a\n  - b\n\n- c\n\n## Two\nsecond\n")
    assert [h for h, _ in got] == ["One", "Two"] and got[0][1] == "# One\n\nfirst\n\n- a\n  - b\n- c"
    assert chunk("a\r\n\r\nb") == chunk("a\n\nb")
    code = "```\n# no heading\n- no item\n" + "x" * 4000 + "\n```"
    assert chunk(code, 1, 10) == [(None, code)]
    long = " ".join(f"Sentence number {i} is here." for i in range(200))
    parts = chunk(long, 10, 50)
    assert len(parts) > 5 and all(len(t) <= 200 for _, t in parts) and " ".join(t for _, t in parts) == long
    with pytest.raises(ValueError, match="exceed"):
        chunk("a", 5, 4)


def test_chunks_of_structured_text():
    chunk = text_jobs.markdown_chunks
    # a heading begins at the margin, an indented one is text; one without a title has none
    assert chunk(" # not one\n# One #\nx\n##  \ny") == [(None, " # not one"), ("One", "# One #\n\nx"), (None, "##\n\ny")]
    # an item owns the lines below it up to an empty one; what is indented after that stands alone
    assert chunk("- a\nlazy\n  more\n\n  - nested\n- b\n1. c\ntext") == [(None, "- a\nlazy\n  more\n  - nested\n- b\n1. c\ntext")]
    kinds = [k for k, _ in text_jobs.markdown_blocks("- a\n  - b\n\n    c\n\n- d\n  ```\n  x\n  ```\n~~~\n- code\n~~~~\np\n- e\n# h\nq")]
    assert kinds == ["bullet", "paragraph", "bullet", "code", "paragraph", "bullet", "heading", "paragraph"]
    # 300 + 190 tokens pack into one, the next 490 don't; 100 and 390 do by their sizes
    unit = lambda n, c: c * (4 * n)
    got = chunk("\n\n".join(unit(n, c) for n, c in ((300, "a"), (190, "b"), (490, "c"), (100, "d"), (390, "e"))), 200, 500)
    assert [len(t) for _, t in got] == [4 * 490 + 2, 4 * 490, 4 * 490 + 2]
    # pieces of a character count a token each: 500 fill a chunk, but the text is shorter, so that 100 more still join it
    assert [len(t) for _, t in chunk("\n\n".join("x" * 600), 200, 500)] == [600 + 2 * 599]
    assert [len(t) for _, t in chunk("\n\n".join("x" * 700), 200, 500)] == [500 + 2 * 499, 200 + 2 * 199]


def test_hashed_vectors(spark):
    """Literal slots and signs."""
    rows = spark.createDataFrame([(1, "Go, go and C++"), (2, None), (3, "!!"), (4, "kafka")], "id int, text string")
    got = {r.id: {i: x for i, x in enumerate(r.embedding) if x} for r in text_jobs.embed(rows, "text").collect()}
    assert got[2] == got[3] == {} and got[4] == {656: -1.0}
    counts = {1500: 2, 122: 1, 757: -1, 144: 1, 996: -1, 157: -1}  # go twice, then and, c++, gogo, goand, andc++
    assert got[1] == pytest.approx({i: v / 3 for i, v in counts.items()})
    short = text_jobs.embed(rows, "text", lambda: lambda t: [1.0, 2.0], 3).first()
    assert short.embedding == [1.0, 2.0, 0.0]


def test_payloads_of_all_boards(spark):
    def parsed(board, body, **kw):
        row = payloads.parse_payloads(spark.createDataFrame([(1, json.dumps(body), "j2")], "id int, payload string, job string"), board, **kw).first()
        return row.title, row.place, row.company, row.text, row.ok

    assert parsed("board_b", {"text": "Dev ", "description": "<p>We <b>build</b></p>", "lists": [{"text": "You", "content": "<li>ship<li>test"}], "additional": "<p>Bye</p>", "categories": {"location": "X", "allLocations": ["A", "B"]}}) == ("Dev", "A; B", None, "We build\n\nYou\n\n- ship\n- test\n\nBye", True)
    assert parsed("board_b", {"text": "Dev", "descriptionPlain": "plain", "additionalPlain": "more", "categories": {"location": "X"}}) == ("Dev", "X", None, "plain\n\nmore", True)
    jobs = [{"id": "j1", "title": "No"}, {"id": "j2", "title": "Yes", "location": "Here", "secondaryLocations": [{"location": "There"}], "isRemote": True, "descriptionHtml": "<p>x</p>"}]
    assert parsed("board_c", {"organizationName": "Acme", "jobs": jobs}, job_col="job") == ("Yes", "Here; There; Remote", "Acme", "x", True)
    assert parsed("board_c", {"data": {"jobPosting": {"title": "T", "locationName": "L", "descriptionPlainText": "p", "organization": {"name": "O"}}}}) == ("T", "L", "O", "p", True)
    body = {"name": "N", "company": {"name": "C"}, "location": {"city": "Q", "country": "Z", "remote": True}, "jobAd": {"sections": {"jobDescription": {"title": "Job", "text": "<p>do</p>"}, "qualifications": {"title": "Q", "text": " "}}}}
    assert parsed("board_d", body) == ("N", "Q, Z, Remote", "C", "Job\n\ndo", True)
    assert not parsed("board_d", {"name": "N"})[-1]


def test_main_content_by_hand():
    prose = "Some words of prose, and more of them."  # one comma
    n = len(prose)
    points = 1 + 1 + n / 100
    inner = f"<div id=in><p>{prose}</p><p>{prose}</p></div>"
    text, score = html_text.main_content(f"<body><main><div id=out>{inner}<p>short</p></div></main></body>")
    assert text == f"{prose}\n\n{prose}" and score == pytest.approx(2 * points)
    # half of the inner text is a link; the outer div has half the points but no more link text of its own
    linked = f"<div><p>{prose}</p><p><a href=x>{prose}</a></p></div>"
    text, score = html_text.main_content(f"<body>{linked}</body>")
    assert score == pytest.approx(2 * points * (1 - n / (2 * n + 2))) and text.count(prose) == 2
    # nothing scores: the body, else everything
    assert html_text.main_content("<head><title>t</title></head><body>few <i>words</i></body>") == ("few words", 0.0)
    assert html_text.main_content("") == ("", 0.0)
    deep = "<div>" * 3000 + f"<p>{prose}</p>" + "</div>" * 3000
    assert html_text.main_content(deep)[0] == prose


def test_html(spark):
    text = html_text.fragment_text
    assert text("<p>a</p><p>b</p>") == "a\n\nb" and text("<ul><li>x<li>y</ul>") == "- x\n- y" and text("a<br>b") == "a\nb"
    assert text("a<script>x</script><style>y</style>&amp;") == "a&" and text("&lt;p&gt;Hi&lt;/p&gt;") == "Hi" and text("<p>open <b>text") == "open text"
    page = "<body><nav><a href=x>menu</a></nav><div id=a><p>" + "Real prose, with commas, and words. " * 12 + "</p></div><div><a href=y>" + "link, link, " * 30 + "</a></div></body>"
    main, score = html_text.main_content(page)
    assert main.startswith("Real prose") and "link" not in main and score > 1
    rows = html_text.main_text(spark.createDataFrame([(1, page), (2, "<body><div id=root></div></body>"), (3, None)], "page_id int, html string"), "html").collect()
    assert [r.status for r in rows] == ["ok", "too_short", "too_short"]


def test_verbatim(spark):
    texts = spark.createDataFrame([(1, "You’ll  need\nfive years of  Go — really."), (2, None)], "doc_id int, text string")
    spans = spark.createDataFrame([(1, "you'll need five YEARS"), (1, "of Go - really"), (1, "ten years"), (1, ""), (2, "x")], "doc_id int, raw_text string")
    got = {(r.doc_id, r.raw_text): r.verbatim for r in text_jobs.verify_spans(spans, texts, "doc_id").collect()}
    assert got == {(1, "you'll need five YEARS"): "You’ll  need\nfive years", (1, "of Go - really"): "of  Go — really", (1, "ten years"): None, (1, ""): None, (2, "x"): None}


def test_resolver(spark):
    aliases = spark.createDataFrame([("go", 1), ("kubernetes", 2), ("c++", 3), ("c", 4), ("react", 5), ("react native", 6), ("sql server", 7), ("java", 8), ("backend", 9)], "alias_norm string, skill_id long")
    guards = spark.createDataFrame([("go to market",), ("lambda expressions",), ("c suite",), ("r and d",)], "phrase string")
    cases = {"Experience with Go and Kubernetes preferred": 1, "Django ongoing work": None, "Go-to-market strategy": None, "C/C++": 4, "C-Suite exposure": None, "React Native": 6, "SQL Server.": 7, "lambda expressions in Java": 8, "Backend services written in Go.": 9, "R&D": None, "": None}
    spans = spark.createDataFrame(list(enumerate(cases)), "span_id int, text string")
    got = {r.span_id: r.skill_id for r in resolution.resolve(spans, aliases, guards).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_board_ids_and_payloads(spark):
    urls = [
        ("board_a", "https://b.x/embed/job_app?for=acme&token=12", "acme", "12"), ("board_a", "https://b.x/acme/jobs/34?q=1", "acme", "34"), ("board_a", "https://b.x/embed/jobs/5", None, None), ("board_a", "https://b.x/acme/careers?gh_jid=9", "acme", "9"),
        ("board_b", "https://j.x/acme/01234567-89ab-cdef-0123-456789abcdef/apply", "acme", "01234567-89ab-cdef-0123-456789abcdef"), ("board_b", "https://j.x/acme/nope", None, None), ("board_c", "https://c.x/acme/application?jobId=7", "acme", "7"), ("board_c", "https://c.x/acme/abc", "acme", "abc"),
        ("board_d", "https://d.x/Acme/74400-title-here", "Acme", "74400"), ("board_d", "https://api.d.x/v1/companies/Acme/postings/55", "Acme", "55"), ("board_d", "https://d.x/ui/company/Acme/publication/66-x", "Acme", "66"), ("board_d", None, None, None),
    ]
    got = joins.posting_ids(spark.createDataFrame([(a, u) for a, u, _, _ in urls], "adapter string, url string")).collect()
    assert [(r.owner, r.job_id) for r in got] == [(o, j) for _, _, o, j in urls]
    body = {"title": " Dev ", "content": "&lt;p&gt;Do things&lt;/p&gt;", "company_name": "Acme", "offices": [{"name": "X"}, {"name": "Y"}]}
    row = payloads.parse_payloads(spark.createDataFrame([(1, json.dumps(body)), (2, "{")], "id int, payload string"), "board_a").orderBy("id").collect()
    assert tuple(row[0]) == (1, "Dev", "X; Y", "Acme", "Do things", True) and not row[1].ok


def test_robots(spark):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: collector # us\nUser-agent: other\nDisallow: /private\nAllow: /private/open$\nDisallow: /*.pdf$\nDisallow:\n"
    rules = joins.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"), "collector-bot")
    urls = spark.createDataFrame([(i, h, p) for i, (h, p) in enumerate([("h", "/private/x"), ("h", "/private/open"), ("h", "/private/open2"), ("h", "/a.pdf"), ("h", "/a.pdfx"), ("h", ""), ("g", "/private")])], "url_id int, host string, path string")
    assert [r.allowed for r in joins.robots_allow(urls, rules).orderBy("url_id").collect()] == [False, True, False, False, True, True, True]


def test_breaker_and_retries(spark):
    seen = work.Breaker(most=3, cooldown=10)
    log = [(0, True), (1, True), (2, True), (3, True), (11, False), (13, True), (25, False), (26, True)]
    assert [seen.see(t, f) for t, f in log] == ["closed", "closed", "open", "refused", "refused", "open", "closed", "closed"]
    df = spark.createDataFrame([(i, "h", float(t), f) for i, (t, f) in enumerate(log)], "id long, host string, at double, failed boolean")
    assert [r.result for r in work.breaker_states(df, "host", 3, 10).orderBy("id").collect()] == ["closed", "closed", "open", "refused", "refused", "open", "closed", "closed"]
    tries = spark.createDataFrame([(1, i, i, o) for i, o in enumerate(["failed", "ok", "failed"])] + [(2, 0, 9, "permanent")] + [(3, i, 20 + i, "failed") for i in range(5)] + [(4, 0, 30, "failed")], "message_id long, at long, id long, outcome string")
    got = {r.message_id: (r.state, r.attempts, r.reason) for r in work.retry_split(tries).collect()}
    assert got == {1: ("done", 2, None), 2: ("dead", 1, "permanent"), 3: ("dead", 3, "attempts"), 4: ("pending", 1, None)}


def test_breaker_stream_is_the_batch(spark):
    from demandlens.plans import registry

    stream, batch = (registry.queries()[n](spark, "/root/testdata/sf0.001") for n in ("i6_breaker_stream", "i6_breaker"))
    assert sorted(map(tuple, stream.select("id", "host", "result").collect())) == sorted(map(tuple, batch.select("id", "host", "result").collect()))


def test_late_rows_and_timers(spark, tmp_path):
    def put(name, rows, kinds):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run(stream, name, mode):
        work.run_once(stream, str(tmp_path / f"{name}-state"), work.batch_folder(str(tmp_path / f"{name}-out")), mode).awaitTermination(60)
        return spark.read.parquet(str(tmp_path / f"{name}-out"))

    kinds = "ts timestamp, user_id long"
    for rows in ([(dt.datetime(2024, 3, 1), 1), (dt.datetime(2024, 2, 26), 1)], [(dt.datetime(2024, 3, 2), 1)], [(dt.datetime(2024, 1, 1), 1), (dt.datetime(2024, 3, 3), 1)]):
        put("events", rows, kinds)
        stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "events"))
        out = run(work.weekly_counts(stream, "ts", "user_id"), "weeks", "update")
    newest = {str(r.week)[:10]: r.n for r in out.groupBy("week").agg(F.max_by("n", "batch").alias("n")).collect()}
    assert newest == {"2024-02-22": 1, "2024-02-29": 3}  # the row of January came after its week was closed
    kinds, at = "message_id long, at timestamp, finished boolean", lambda m: dt.datetime(2024, 1, 1, 12, m)
    for rows in ([(1, at(0), False), (2, at(0), False), (3, at(0), False), (3, at(1), True)], [(2, at(5), True), (1, at(6), False), (4, at(7), False)], [(9, at(50), True)]):
        put("claims", rows, kinds)
        out = run(work.reclaim_stream(spark.readStream.schema(kinds).parquet(str(tmp_path / "claims")), 600), "claims", "append")
    assert {(r.message_id, r.claims) for r in out.collect()} == {(1, 2), (4, 1)}


def test_state_goes_after_its_time(spark, tmp_path):
    import time

    kinds = "message_id long, id long, at long, outcome string"

    def put(rows):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([(1, 1, 1, "failed"), (2, 2, 2, "failed")])
    stream = work.retry_stream(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")), 3, keep_seconds=1)
    query = stream.writeStream.outputMode("update").foreachBatch(work.batch_folder(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and not (query.lastProgress and query.lastProgress["batchId"] >= 2 and query.lastProgress["stateOperators"] and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0):
            time.sleep(0.3)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        query.stop()
    assert {(r.message_id, r.state, r.attempts) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "pending", 1), (2, "pending", 1)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, posting_id int")
    sinks.write_shortlist(rows, str(tmp_path / "s"))
    sinks.write_shortlist(spark.createDataFrame([("r2", 9)], rows.schema), str(tmp_path / "s"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "s")).select("run_id", "posting_id").collect()} == {("r1", 1), ("r2", 9)}
    table = sinks.markdown_table(spark.createDataFrame([("a|b", 2), ("c\nd", 1)], "x string, n int"), ["x", "n"], [F.desc("n")]).first().markdown
    assert table == "| x | n |\n|---|---|\n| a\\|b | 2 |\n| c d | 1 |"


def test_citations_of_every_outcome(spark):
    ask = [(1, 10, 100), (1, 11, None), (1, 12, 102), (1, 12, 101)]
    row = lambda i, status, chunk=None: {"requirement_id": i, "status": status, "evidence_chunk_id": chunk}
    good = [row(10, "evidenced", 7), row("11", "weak", "99")]
    cases = {
        "accepted": [(good, "strong"), ([], "no")],
        "fabricated": [([row(10, "evidenced", 8), row(11, "evidenced")], "strong"), ([row(10, "evidenced", 8), row(10, "absent")], "?")],
        "missing": [([*good, row(12, "evidenced")], "strong")],
        # what repeats an answer or answers what wasn't asked isn't looked at any further
        "malformed": [(None, "strong"), ([row(10, "absent"), row(10, "evidenced", 8)], "no"), ([row(13, "evidenced", 8)], "no"), ([row(10, "maybe")], "no"), ([row(10, "evidenced", "x")], "no"), (good, "perhaps"), ([row(None, "absent")], "no")],
    }
    rows, wanted = [], {}
    for outcome, given in cases.items():
        for requirements, verdict in given:
            wanted[len(rows)] = outcome
            rows.append((len(rows), 1, json.dumps({"requirements": requirements, "verdict": verdict})))
    wanted[len(rows)] = "malformed"
    rows.append((len(rows), 1, None))
    rows.append((len(rows), 2, json.dumps({"requirements": [], "verdict": "no"})))
    wanted[len(rows) - 1] = "accepted"
    accepted, verdicts = text_jobs.validate_citations(
        spark.createDataFrame(rows, "response_id int, posting_id int, payload string"), spark.createDataFrame(ask, "posting_id int, id long, skill_id long"), spark.createDataFrame([(1, 7), (1, 7), (2, 8)], "posting_id int, chunk_id long")
    )
    assert {r.response_id: r.outcome for r in verdicts.collect()} == wanted
    got = {tuple(r) for r in accepted.select("response_id", "requirement_id", "skill_id", "status", "chunk_id", "answered").collect()}
    assert got == {(0, 10, 100, "evidenced", 7, True), (0, 11, None, "weak", None, True), (0, 12, 101, "absent", None, False)} | {(1, i, s, "absent", None, False) for i, s in ((10, 100), (11, None), (12, 101))}


def test_tags_meet_words_either_way(spark):
    from demandlens.operators import ranking

    texts = spark.createDataFrame([(1, "Go and C++ and go"), (2, "java"), (3, None)], "text_id int, text string")
    bullets = spark.createDataFrame([(1, 1, ["go", "Go", "java"]), (1, 2, ["c++"])], "entry_id int, bullet_id int, tags array<string>")
    both = [sorted((r.text_id, r.bullet_id, r.tag) for r in ranking.tag_hits(texts, bullets, most).collect()) for most in (100, 0)]
    assert both[0] == both[1] and set(both[0]) == {(1, 1, "go"), (1, 2, "c++"), (2, 1, "java")}


def test_content_reads_texts_once(spark, tmp_path):
    from demandlens.operators import ranking

    rows = [(1, "Go, C++ and go. " * 9 + "\u00e9java"), (1, "go rust"), (2, None), (3, ""), (4, "JAVA/rust java"), (5, "\u212aafka")]
    spark.createDataFrame(rows, "text_id int, text string").write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    bullets = spark.createDataFrame([(1, 1, ["go"]), (1, 2, ["none"]), (1, 3, ["go", "c++"]), (1, 4, ["x"]), (2, 5, ["java", "rust"]), (3, 6, ["kafka"])], "entry_id int, bullet_id int, tags array<string>")
    found = ranking.select_content(texts, bullets, entries=2, per_entry=3, total=4)
    # rows that repeat an id are one text, whose words count once
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 4, 1, 2), (1, 1, 2, 0, 1, 3), (1, 1, 3, 8, 1, 1), (1, 2, 5, 8, 2, 1), (4, 2, 5, 4, 1, 1), (5, 3, 6, 4, 1, 1)]
    assert found._jdf.queryExecution().sparkPlan().toString().count("/texts") == 1
    words = bullets.select(F.explode("tags").alias("word"))
    every = [sorted(map(tuple, ranking.text_words(texts, words, "[^a-z0-9+#./-]", most, at_once).collect())) for most, at_once in ((100, 1 << 20), (100, 1), (0, 1))]
    assert every[0] == every[1] == every[2] == [(1, "c++"), (1, "go"), (1, "java"), (1, "rust"), (4, "java"), (5, "kafka")]


def test_equal_labels_count_each(spark):
    labels = spark.createDataFrame([(1, "Use Go", "required"), (1, "Use Go", "required"), (1, "Rust", "preferred"), (2, "x", "required")], "doc int, raw_text string, importance string").repartition(3)
    rows = spark.createDataFrame([(1, "use  go daily", "required"), (1, "rust", "required")], "doc int, raw_text string, importance string")
    got = {tuple(r) for r in text_jobs.extraction_quality(labels, rows, "doc").collect()}
    assert got == {(1, 3, 3, 2), (2, 1, 0, 0)}


def test_epoch_seconds_of_far_years(spark):
    far = ["576460752303", "576460852457", "599999899997", "1700000000.25", "1.7e9", " 1700000000 ", "1e300", "NaN", "9223372036855"]
    got = values(spark, lambda c: F.date_format(fn.epoch_timestamp(c), "y-MM-dd HH:mm:ss.SS"), far)
    assert got == ["20237-04-25 10:45:03.00", "20237-04-26 14:34:17.00", "20983-03-29 06:53:17.00", "2023-11-14 22:13:20.25", "2023-11-14 22:13:20.00", "2023-11-14 22:13:20.00", None, None, None]


def test_epoch_query_equals_its_sql_beyond_year_9999(spark, tmp_path):
    import duckdb

    from demandlens.plans import registry

    spark.sql("SELECT 2523650 + id * 1157 AS event_id FROM range(3000)").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()["h7_epoch_timestamp"]).fetchall()
    assert sorted(map(tuple, registry.queries()["h7_epoch_timestamp"](spark, str(tmp_path)).collect())) == sorted(want)


def test_chunks_are_passed_on_before_a_batch_ends():
    import pyarrow as pa

    texts = ["Words of a text. " * 1177] * 300 + ["", None]
    batch = pa.RecordBatch.from_pydict({"source_type": ["t"] * 302, "source_ref": [str(i) for i in range(302)], "text": pa.array(texts, pa.string())})
    made = list(text_jobs.chunk_batches(iter([batch]), 200, 500))
    assert len(made) >= 6 and all(sum(map(len, m.column(4).to_pylist())) <= 1_100_000 for m in made)
    rows = [r for m in made for r in zip(m.column(1).to_pylist(), m.column(2).to_pylist(), m.column(4).to_pylist())]
    assert rows == [(str(i), n, x) for i, t in enumerate(texts) for n, (_, x) in enumerate(text_jobs.markdown_chunks(t or "", 200, 500))]


def test_pages_are_passed_on_before_a_batch_ends():
    import pyarrow as pa

    pages = ["é" * 300, None, "", "x" * 900, "y", "z" * 500]
    batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "html": pa.array(pages, pa.string())})
    made = list(html_text.batches_of(iter([batch, batch.slice(0, 0)]), 1, 600))
    assert [m.column(0).to_pylist() for m in made] == [[0], [1, 2, 3], [4, 5]]
    assert [x for m in made for x in m.column(1).to_pylist()] == pages
