"""Language identification, quality distances and shard boundaries recomputed in plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from demandlens.llm import language_id, quality, sharding


def prose(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


def trigrams(text):
    """Letters of the lower-cased text with their neighbours, all other characters being one boundary."""
    padded = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
    return [padded[i - 1 : i + 2] for i in range(1, len(padded) - 1) if padded[i] != "\0"]


def test_languages_by_count_tables(spark):
    r, cfg = random.Random(3), language_id.LanguageConfig()
    tongues = {"aa": "bana bolo bima nulo nate neko lira".split(), "bb": "krato krelo kritz skuma skalo nate lira".split(), "cc": "lämpe löffel lüge fäßchen füße nate".split()}
    rows = [(i, prose(r, tongues[lang], r.randint(1, 12)), lang) for i, lang in enumerate(list(tongues) * 70)]
    counts = {lang: Counter() for lang in tongues}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % cfg.folds:
            counts[lang].update(trigrams(text))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items() if n >= cfg.min_count} for lang, c in counts.items()}
    top = Counter()
    for s in share.values():
        for g, x in s.items():
            top[g] = max(top[g], x)
    members = {lang: {g for g, x in s.items() if x >= cfg.relative_share * top[g]} for lang, s in share.items()}

    def predicted(text):
        hits = {lang: sum(g in m for g in trigrams(text)) for lang, m in members.items()}
        best = min(sorted(hits), key=lambda lang: -hits[lang])
        return best, hits[best] / sum(hits.values()) if sum(hits.values()) else 0.0

    out = {x.doc_id: x for x in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, text, _ in rows:
        lang, score = predicted(text)
        assert out[i].lang_pred == lang and out[i].score == pytest.approx(score, abs=2e-3), (text, out[i])


def distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def classes(text):
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\v\f", ".,;:!?'\"()-", "#*$%&|<>"]
    n = Counter(next((i for i, g in enumerate(groups) if c in g), 7 if ord(c) > 127 else 6) for c in text)
    return [n[i] for i in range(8)]


def test_quality_distances_by_hand(spark):
    r, cfg = random.Random(9), quality.QualityConfig()
    vocabulary = {"en": [f"word{chr(97 + i)}" for i in range(26)] + ["internationalization", "The"], "fr": [f"mot{chr(97 + i)}é" for i in range(20)] + ["a_b"]}
    rows = [(i, prose(r, vocabulary[lang], r.choice([25, 79, 80, 200])) + r.choice(["", ".", "\n###", "é"]), lang) for i, lang in enumerate(["en", "fr"] * 25)] + [(99, prose(r, [f"x{i}" for i in range(300)], 150), None), (100, "short text", "en")]
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    chars, words = {}, {}
    for _, text, lang in rows:
        if lang:
            chars[lang] = [a + b for a, b in zip(chars.get(lang, [0] * 8), classes(text))]
            words.setdefault(lang, Counter()).update(re.findall(r"[^\x20\x09-\x0D]+", lower(text)))
    assert all(len(w) <= cfg.common_words + 40 for w in words.values())
    common = {lang: dict(sorted(w.items(), key=lambda x: -x[1])[: cfg.common_words]) for lang, w in words.items()}
    assert all(sorted(w.values())[-cfg.common_words :][0] != (sorted(w.values())[: -cfg.common_words] or [0])[-1] or len(w) <= cfg.common_words for w in words.values())
    vocab = sorted({w for c in common.values() for w in c})
    out = {x.doc_id: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        own = classes(text)
        failed = out[i].base_failed
        far = [None, None]
        if not failed and sum(own) >= cfg.min_chars:
            far[0] = min(distance([x / sum(own) for x in own], [x / sum(c) for x in c]) for c in chars.values())
        if not failed and len(w) >= cfg.min_words:
            n = Counter(w)
            hist = [n[v] for v in vocab]
            p = [x / len(w) for x in [*hist, len(w) - sum(hist)]]
            far[1] = min(distance(p, [x / sum(words[lang].values()) for x in [*(c.get(v, 0) for v in vocab), sum(words[lang].values()) - sum(c.values())]]) for lang, c in common.items())
        assert [out[i].char_distance, out[i].word_distance] == [x if x is None else pytest.approx(x, abs=1e-9) for x in far], text
        assert out[i].kept == (not failed and not (far[0] or 0) > cfg.max_char_distance and not (far[1] or 0) > cfg.max_word_distance)
    assert not out[99].kept and not out[100].kept and sum(x.kept for x in out.values()) > 40


def test_boundaries_by_a_full_sort(spark):
    """Bytes below each boundary against its share: within the tolerance, or as near as a row of that size allows."""
    docs = spark.range(3000).select(F.concat(F.lit("id-"), F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 9)).otherwise(F.concat(F.col("id").cast("string"), F.repeat(F.lit("y"), F.col("id").cast("int") % 70))).alias("text"))
    keys = sorted((r.k1, r.k2, r.size) for r in sharding._keys(docs, "doc_id", "text").collect())
    total, largest = sum(s for *_, s in keys), max(s for *_, s in keys)
    bounds = sharding.splitters(sharding._keys(docs, "doc_id", "text"), 40, 0.01)
    assert len(bounds) == 39 and bounds == sorted(bounds)
    for i, bound in enumerate(bounds, 1):
        below = sum(s for a, b, s in keys if (a, b) < bound)
        assert abs(below - total * i / 40) <= max(0.01 * total / 40, largest)
    assert sharding.byte_shards(docs).groupBy("shard").count().count() == 40
