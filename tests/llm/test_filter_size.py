"""More n-grams than a filter of the least size can hold."""

import random

from demandlens.llm import language_id


def prose(seed, n, words):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def test_filters_grow_with_their_members(spark):
    """With 8 slots for dozens of n-grams every filter would be full, and no language told from another."""
    tongues = {"aa": "ba bo bi nu na ne".split(), "bb": "kra kro kri sku ska ske".split(), "cc": "läm löm lüm fäß föß füß".split()}
    rows = [(i, prose(i, 30, tongues[lang]), lang) for i, lang in enumerate(list(tongues) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    cfg = language_id.LanguageConfig(slots=8)
    model = language_id.train(df, cfg)
    assert len(model.slots) > 8 and (model.false_positive < 0.1).all()
    out = {r.doc_id: r.lang_pred for r in language_id.language_id(df, cfg).collect()}
    assert [out[i] for i, _, _ in rows] == [lang for _, _, lang in rows]
    assert language_id.slots_for(0, cfg) == 8 and language_id.slots_for(10_000_000, language_id.LanguageConfig()) == 1 << 27
    many = spark.createDataFrame([(i, prose(i, 30, [chr(97 + lang % 26) * 2 + chr(97 + lang // 26)]), f"l{lang:02}") for i, lang in enumerate(list(range(70)) * 4)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == r.lang for r in language_id.identify(many, language_id.train(many, cfg), keep=["lang"]).collect())
