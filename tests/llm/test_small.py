"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator; results against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.llm import decontamination, language_id, line_dedup, ngram_join, personal_data, quality, sentence_pieces, sharding, token_counts, url_filters
from demandlens.llm.queries import PIECES
from demandlens.llm.unigram import ForwardTrie, UnigramModel

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key long, ids string"


def prose(seed, n, words="the of and to in a that it was for on are with as his they be at one have".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "ing", "er", ","]) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def docs(spark):
    base = prose(1, 60)
    edited = base.replace(base.split()[10], "changed", 1)
    rows = [
        (1, base), (2, base), (3, edited), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, "日本語 テキスト 🎉 ünïcödé"), (10, prose(2, 30_000)),
        (11, base.upper()), (12, "\n".join([prose(3, 12)] * 3 + [prose(4, 12)])), (12, "\n".join([prose(3, 12)] * 3 + [prose(4, 12)])), (None, prose(5, 40)), (14, "x" * 50_000),
        (15, prose(3, 12)[:-2] + "!."), (16, "### *** $$$ %%% " * 40), (17, "▁ under▁bar"), (18, "a\0b c"),
    ]
    return spark.createDataFrame([(i, t, "en" if i != 9 else None, "s", 0, 7, 8, "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def model():
    return UnigramModel(PIECES)


@pytest.fixture(scope="session")
def library():
    """The library's own unigram encoder over the same pieces and scores: the file with its model type and scores replaced."""
    import struct

    import sentencepiece

    m, out, data, at = UnigramModel(PIECES), b"", open(PIECES, "rb").read(), 0

    def varint(buf, i):
        n = shift = 0
        while True:
            n |= (buf[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if buf[i - 1] < 128:
                return n, i

    def length(n):
        b = b""
        while n > 127:
            b, n = b + bytes([n & 127 | 128]), n >> 7
        return b + bytes([n])

    piece = 0
    while at < len(data):
        tag, i = varint(data, at)
        size, i = varint(data, i)
        body = data[i : i + size]
        if tag >> 3 == 1:  # a piece: its text, its score (field 2) and its kind (field 3)
            j, fields = 0, b""
            while j < len(body):
                t, k = varint(body, j)
                if t & 7 == 2:
                    n, k = varint(body, k)
                    fields, j = fields + body[j : k + n], k + n
                elif t & 7 == 5:
                    j = k + 4
                else:
                    _, k = varint(body, k)
                    fields, j = fields + body[j:k], k
            body = fields + b"\x15" + struct.pack("<f", m.score[piece])
            piece += 1
        elif tag >> 3 == 2:
            body = body.replace(b"\x18\x02\x20", b"\x18\x01\x20", 1)  # of the trainer's settings: kind BPE to unigram
        out += data[at : at + len(length(tag))] + length(len(body)) + body
        at = i + size
    return sentencepiece.SentencePieceProcessor(model_proto=out)


SAMPLES = ["Hello world, this is a test.", "  two  spaces\nand lines ", "ünïcödé 日本語 🎉", "internationalization of tokenizers", "aaaaaaaaaaaaaaaa", "x1y2z3 ==> {}", "\t", "zzzzqqqq xxjj"]


def test_encoding_is_that_of_the_library(model, library):
    for text in [*SAMPLES, *(prose(i, 40) for i in range(5))]:
        own = [i for c in model.chunks(text) for i in model.segment(c)]
        score = sum(model.score[i] for i in own)
        theirs = library.encode(text)
        assert own == theirs or math.isclose(score, sum(model.score[i] for i in theirs), abs_tol=1e-3), text
        assert model.decode(own) == text


def test_trie_counts_are_those_of_the_encoder(model):
    trie = ForwardTrie(model, nodes=40, words=30)  # small enough to be emptied on the way
    for text in [*SAMPLES, prose(9, 200)]:
        for c in model.chunks(text):
            trie.add({c})
            assert trie.counts[c] == len(model.segment(c)), c


def test_double_array_has_just_the_pieces(model):
    trie = model.trie

    def find(word):
        state = 0
        for c in word:
            to = trie.base[state] + trie.codes.get(c, 0)
            if not trie.codes.get(c) or trie.check[to] != state:
                return -1
            state = to
        return trie.value[state]

    assert all(find(t) == i for t, i in model.ids.items())
    assert all((find(t[:-1] + "q") >= 0) == (t[:-1] + "q" in model.ids) for t in list(model.ids)[:3000])


def test_token_counts_and_round_trip(docs, model):
    counts = Counter(token_counts.token_counts(docs, PIECES).collect())
    texts = docs.select("doc_id", "text").collect()
    for i, t in texts:
        pieces = [model.segment(c) for c in model.chunks(t)] if t else []
        assert counts[(i, len(pieces), sum(map(len, pieces)))] >= 1
    encoded = sentence_pieces.encode(docs, PIECES)
    back = {(r.doc_id, r.text) for r in sentence_pieces.decode(encoded, PIECES).collect()}
    assert back == {(i, t if t is None else t.replace("▁", " ")) for i, t in texts}
    trip = {r.doc_id: r for r in sentence_pieces.round_trip(docs, PIECES).collect()}
    assert trip[4].restored is None and trip[5].n_ids == 0 and trip[10].restored and not trip[17].restored


def test_empty_tables(docs, spark):
    none, bench = docs.limit(0), spark.createDataFrame([], "item_id long, text string")
    for out in (
        token_counts.token_counts(none, PIECES), sentence_pieces.encode(none, PIECES), personal_data.personal_data(none), ngram_join.ngram_components(none), language_id.language_id(none), decontamination.contamination(none, bench),
        sharding.byte_shards(none), quality.quality(none), line_dedup.drop_repeated_lines(none),
    ):
        assert out.count() == 0
    assert decontamination.digest(decontamination.contamination(docs, bench)).where("contaminated").count() == 0


def pii_base(text):
    found = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub(r"\D", "", m[0])
            total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and total % 10 == 0) or (kind == "phone" and 9 <= len(digits) <= 15):
                found.append((m.start(), ("email", "ip", "card", "phone").index(kind), kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_personal_data_base_spans(spark):
    r = random.Random(3)
    alphabet = ["a.b@c.d_e@f.g", "x@y", "@", "1.2.3.4.5", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "12345", " ", "é", ".", "-", "a@b@c.de.f", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "  "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(400)] + [None, "", "mail me@example.com now " * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in personal_data.digest(personal_data.personal_data(df)).collect():
        base = pii_base(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), texts[row.doc_id]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(x.startswith(k) for x in base) for k in ("email", "ip", "card", "phone"))
        assert not set(base) - set(row.spans.split(","))


def test_votes_are_weighed():
    votes = np.array([[1, 1, 0, 1, 1, 0], [2, 0, 2, 0, 2, 2], [1, 0, 0, 0, 1, 0]])
    p = personal_data.fit_votes(votes, np.array([50.0, 40.0, 20.0]))
    assert p[0] > 0.9 and p[1] < 0.1 and p[2] > 0.5


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {(i, len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_is_exact(spark, docs, n, percent):
    r, rows = random.Random(n), [(i, t) for i, t in docs.select("doc_id", "text").where("doc_id is not null").distinct().collect()]
    for g in range(12):
        base = prose(100 + g, r.choice([3, 5, 9, 20, 60, 150])).split()
        for k in range(8):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"w{r.random()}"
            rows.append((1000 + 10 * g + k, " ".join(w)))
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n_shingles long, key string")
    found = {tuple(x) for x in ngram_join.ngram_components(df, n, percent).collect()}
    assert found == brute_components(rows, n, percent)


def test_cells_meet_whatever_differs():
    r = np.random.default_rng(1)
    for percent in (80, 85):
        plan = ngram_join.Partition(percent)
        for n in (2, 7, 8, 13, 30, 61, 200, 1000):
            for _ in range(40):
                a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
                cut = int(r.integers(0, n * (100 - percent) // 100 + 1))
                b = np.unique(np.concatenate([a[r.permutation(len(a))[cut:]], r.integers(0, 1 << 63, int(r.integers(0, cut + 1)), dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if common * (100 + percent) >= percent * (len(a) + len(b)) and len(a) != common:
                    own, other = ({(j, c) for cells, j, _ in plan.cells(x) for c in cells.tolist()} for x in (a, b))
                    need = {j: m for _, j, m in plan.cells(a)} | {}
                    shared = Counter(j for j, _ in own & other)
                    assert any(shared[j] >= max(m, next((x for _, k, x in plan.cells(b) if k == j), 1 << 30)) for j, m in need.items())


@pytest.mark.parametrize("percent", [80, 85])
def test_cells_needed_follow_the_size_of_a_set(percent):
    """Of the cells of any size's sets chance shares few: no set of random elements has cells for empty intervals, and similar ones share the cells needed."""
    r = np.random.default_rng(7)
    new = lambda k: r.integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1)
    for n in range(100, 400, 7):
        plan, a = ngram_join.Partition(percent), np.unique(new(n))
        mine = {tag: (cells, need) for cells, tag, need in plan.cells(a)}
        for tag, (cells, need) in mine.items():
            d = plan.own_differ(n, plan.upper[tag])
            assert need == len(cells) - d > 0  # all cells are of intervals that hold elements
        for m in {100 * n // percent, n, n * percent // 100 + 1}:  # as much as may differ: elements more, less and others
            common = -(-percent * (n + m) // (100 + percent))
            if common <= min(n, m):
                b = np.unique(np.concatenate([r.permutation(a)[:common], new(m - common)]))
                for cells, tag, need in plan.cells(b):
                    if tag == plan.range_of(max(n, m)):
                        assert len(np.intersect1d(cells, mine[tag][0])) >= max(need, mine[tag][1])


def test_language_is_found(spark):
    tongues = {"aa": "ba bo bi nu na ne".split(), "bb": "kra kro kri sku ska ske".split(), "cc": "läm löm lüm fäß föß füß".split()}
    rows = [(i, prose(i, 30, tongues[lang]), lang) for i, lang in enumerate(list(tongues) * 60)] + [(500, None, "aa"), (501, "123 !!", "bb"), (502, prose(1, 9, tongues["bb"]), None), (None, prose(2, 9, tongues["cc"]), "cc")]
    out = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[500].lang_pred == out[501].lang_pred == "und" and out[502].lang_pred == "bb" and out[None].lang_pred == "cc" and out[None].held_out
    held = [(i, lang) for i, _, lang in rows[:180] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(out[i].held_out for i, _ in held)
    assert all(out[i].lang_pred == lang and 0 <= out[i].score <= 1 for i, lang in held)


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    w, hit, own = words(text), set(), set()
    for item, t in items:
        v = words(t)
        m = min(window, len(v))
        for i in range(len(v) - m + 1 if v else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == v[i : i + m]:
                    hit.update(range(p, p + m))
                    own.add(str(item))
    return len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [200_000, 20])
def test_decontamination_is_exact(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", block)
    base = prose(1, 60).split()
    items = [(1, " ".join(base[5:25])), (2, "one, TWO"), (10, ""), (11, None), (12, " ".join(base[20:34]) + " unseen"), (13, "日本語"), (14, "the"), (15, prose(77, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.digest(decontamination.contamination(docs, bench)).collect()
    wanted = Counter((i, *brute_hits(t, items)) for i, t in docs.select("doc_id", "text").collect())
    assert Counter(map(tuple, out)) == wanted


def test_shards_are_even_and_gapless(spark, docs):
    out = sharding.byte_shards(docs, shards=4, tolerance=0.05).collect()
    assert len(out) == docs.count()
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == texts
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text " * 5)).otherwise(F.concat(F.lit("t"), F.repeat(F.lit("x"), F.col("id").cast("int") % 90))).alias("text"))
    found = sharding.byte_shards(many, shards=40)
    sums = [r.b for r in found.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 40 and max(sums) - min(sums) <= 0.05 * sum(sums) / 40 + 220
    small = found.where("size < 60").groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert small <= 39


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def test_quality_base_rules(docs):
    out = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect())
    assert out == Counter((i, *brute_quality(t)) for i, t in docs.select("doc_id", "text").collect())


def test_quality_distances(spark):
    rows = [(i, prose(i, 120), "en") for i in range(40)] + [(90, " ".join(f"{w}###" for w in prose(7, 120).split()), "en"), (91, " ".join(f"q{i * 7919 % 1000}z" for i in range(120)), None)]
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].kept for i in range(40)) and not out[90].kept and not out[91].kept
    p, q = np.array([0.5, 0.5, 0.0]), np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])
    assert quality.js_distance(p, q).round(9).tolist() == [0.0, 1.0]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(r, s, most, alphabet):
    s = list(s)
    for _ in range(r.randint(0, most)):
        i, kind = r.randint(0, len(s)), r.random()
        if kind < 0.4:
            s.insert(i, r.choice(alphabet))
        elif s and kind < 0.7:
            s.pop(i - 1)
        elif s:
            s[i - 1] = r.choice(alphabet)
    return "".join(s)


def test_banded_distance():
    r = random.Random(5)
    for _ in range(8000):
        a = "".join(r.choice("abé") for _ in range(r.randint(0, 14)))
        b, k = changed(r, a, 5, "abé"), r.randint(0, 4)
        assert line_dedup.within(a, b, k) == (edit_distance(a, b) <= k), (a, b, k)


def test_lines_that_are_near_share_a_cell():
    r = random.Random(6)
    for _ in range(300):
        a = "".join(r.choice("abcdefgh ") for _ in range(r.randint(24, 60)))
        b = changed(r, a, 2, "abcdefgh ")
        if "\n" not in b and edit_distance(a, b) <= 2:
            lines = line_dedup.Lines([a, b])
            own = {0: set(), 1: set()}
            for rows, cell in line_dedup.cells(line_dedup.Run(lines.codes.astype(np.uint64)), lines.starts, lines.size, line_dedup.LineConfig(near_chars=0, full_chars=0).char_edits):
                for i, c in zip(rows.tolist(), cell.tolist()):
                    own[i].add(c)
            assert own[0] & own[1], (a, b)


def test_line_dedup_is_exact(spark):
    r, rows = random.Random(8), []
    bases = [prose(300 + i, 8) for i in range(25)]
    for i in range(60):
        rows.append((i, "\n".join(changed(r, r.choice(bases), r.choice([0, 0, 1, 2, 3]), "xyz") if r.random() < 0.8 else r.choice(["short", "", prose(1000 + i, 9)]) for _ in range(r.randint(0, 6)))))
    rows += [(61, None), (62, rows[3][1]), (62, rows[3][1]), (None, bases[0])]
    cfg = line_dedup.LineConfig()
    places = [(i is None, i or 0, n, x) for i, t in dict.fromkeys(rows) if t is not None for n, x in enumerate(t.split("\n")) if len(x) >= cfg.min_chars]
    distinct = list(dict.fromkeys(x for *_, x in places))
    group = {x: x for x in distinct}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= cfg.char_edits(np.array([min(len(a), len(b))]))[0]:
            group[root(a)] = root(b)
    dropped, seen = {}, set()
    for last, i, n, x in sorted(places):
        if root(x) in seen:
            dropped.setdefault(None if last else i, []).append(n)
        seen.add(root(x))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, dropped int, n_lines int")
    out = line_dedup.drop_repeated_lines(df).collect()
    assert len(out) == len(rows)
    for x in out:
        assert x.dropped == sorted(dropped.get(x.doc_id, [])), x.doc_id
    whole = dict(rows)
    for x in out:
        t = whole[x.doc_id]
        assert x.text == (t if t is None else "\n".join(y for n, y in enumerate(t.split("\n")) if n not in x.dropped))


def test_urls_as_of_fetch_time(spark):
    urls = ["http://Sub.Bad.example.com:80/x", "https://user@bad.example.com./", "ftp://bad.example.com", None, "", "http://notbad.example.com", "http://bad.example.com/p"]
    captures = spark.createDataFrame([(i, u, d, "z") for d in ("2024-01-01", "2024-01-05", "2024-01-10") for i, u in enumerate(urls)] + [(9, urls[0], None, "z")], "page_id long, url string, d string, action string").withColumn("fetched_at", F.to_timestamp("d"))
    entries = spark.createDataFrame([("l", "bad.example.com", "block", "2024-01-03"), ("l", "bad.example.com", "block", "2024-01-03"), ("l", "bad.example.com", "remove", "2024-01-08"), ("m", "sub.bad.example.com", "allow", "2024-01-04"), ("m", None, "block", "2024-01-01")], "list_name string, pattern string, action string, d string").withColumn("dated", F.to_timestamp("d"))
    out = {(r.page_id, str(r.fetched_at)[:10]): r for r in url_filters.evaluate(captures, entries).collect()}
    assert [out[(i, "2024-01-05")].kept for i in range(7)] == [True, False, False, False, False, True, False]
    assert out[(0, "2024-01-05")].n_active == 2 and out[(0, "2024-01-05")].action == "allow"
    assert out[(6, "2024-01-01")].kept and out[(6, "2024-01-10")].kept and out[(9, "None")].n_active == 0
    assert url_filters.evaluate(captures.limit(0), entries).count() == 0 and url_filters.evaluate(captures, entries.limit(0)).count() == 22


def test_urls_of_many_labels(spark):
    """Hosts of 1 to 130 labels against entries of every length, by brute force: whole hosts, suffixes and empty labels."""
    hosts = [".".join(f"l{n - i}" for i in range(n)) for n in (1, 2, 8, 9, 10, 31, 127, 130)] + ["a..b.l1", "x.l9.l8.l7.l6.l5.l4.l3.l2.l1"]
    patterns = [".".join(f"l{n - i}" for i in range(n)) for n in (8, 9, 10, 30, 127)] + [hosts[-2], ".b.l1", "9.l8.l7.l6.l5.l4.l3.l2.l1"]
    captures = spark.createDataFrame([(i, f"https://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string").withColumn("fetched_at", F.to_timestamp(F.lit("2024-01-05")))
    entries = spark.createDataFrame([("l", p, "allow" if p.count(".") == 9 else "block") for p in patterns], "list_name string, pattern string, action string").withColumn("dated", F.to_timestamp(F.lit("2024-01-01")))
    for r in url_filters.evaluate(captures, entries).collect():
        held = [p for p in patterns if r.host == p or r.host.endswith("." + p)]
        longest = max(held, key=len, default=None)
        assert (r.host, r.n_active, r.pattern) == (hosts[r.page_id], len(held), longest)
        assert r.kept == (longest is None or longest.count(".") == 9)


def test_the_trie_of_long_words_is_bounded(model):
    rng = random.Random(3)
    trie = ForwardTrie(model, nodes=1000)
    for _ in range(300):
        word = "".join(rng.choice("abcdef") for _ in range(80))
        assert trie.count([word]) == len(model.segment(word))
        assert len(trie.kids) <= 1000 + trie.depth + 1
