import re

import corpus_pipeline
from demandlens.llm import decontamination, line_dedup, ngram_join, quality
from demandlens.llm.queries import PIECES
from demandlens.llm.unigram import UnigramModel

SF = "/root/testdata/sf0.001"


def test_stages_act_on_what_came_before(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]

    first = stages["quality rules"](spark, docs, SF)
    judged = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert {r.doc_id for r in first.collect()} == {i for i, k in judged.items() if k} and first.columns == columns

    second = stages["line dedup"](spark, first, SF)
    lines = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(first).collect()}
    assert {r.doc_id: r.text for r in second.collect()} == {i: t for i, t in lines.items() if re.search(r"[^\x20\x09-\x0D]", t)}

    third = stages["n-gram Jaccard join"](spark, second, SF)
    assert {r.doc_id for r in third.collect()} == {r.component_id for r in ngram_join.ngram_components(second, 5, 80).collect()}

    fourth = stages["benchmark decontamination"](spark, third, SF)
    found = decontamination.contamination(third, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in found if not r.hits} and fourth.columns == columns

    model, texts = UnigramModel(PIECES), {r.doc_id: r.text for r in fourth.collect()}
    last = stages["SentencePiece encoding"](spark, fourth, SF).collect()
    assert {r.doc_id: model.decode(r.ids) for r in last} == texts
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(texts)


def test_stages_take_unkind_rows(spark):
    """Nulls, empty texts, repeated rows and ids, extra columns with the operators' own names, tables without languages; empty tables."""
    text = " ".join(f"w{i} and of the" for i in range(60))
    rows = [(1, text), (2, text), (2, text), (None, text), (3, None), (4, ""), (5, "short\nshort"), (None, None)]
    names = ["_row", "kept", "n_lines", "dropped", "doc_key", "_marks", "component_id", "n_shingles", "hits", "items", "key", "_number"]
    kinds = ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, t, *(f"own {n}" for n in names)) for i, t in rows], f"doc_id long, text string, {kinds}")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name != "SentencePiece encoding":
            assert all(r[n] == f"own {n}" for r in out for n in names) and (not out or out[0].__fields__ == docs.columns), name
        else:
            assert len(out) == len(rows) and [len(r.ids or ()) for r in out if r.doc_id in (3, 4)] == [0, 0]
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out)
        if name == "n-gram Jaccard join":
            assert ids == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0), (True, 0)]
        if name == "line dedup":
            assert ids == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]
        if name == "benchmark decontamination":
            assert len(out) == len(rows)
