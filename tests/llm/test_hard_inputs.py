"""Inputs that are legal but unkind: regular patterns, megabytes without a blank, null item ids, chains of near copies."""

import random
import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from demandlens.llm import decontamination, line_dedup, ngram_join, personal_data, scratch
from demandlens.llm.queries import PIECES
from demandlens.llm.unigram import ForwardTrie, UnigramModel

SF = "/root/testdata/sf0.001"


def thue_morse(n, pair):
    return "".join(pair[i.bit_count() & 1] for i in range(n))


TWINS = [(thue_morse(4096, "ab"), thue_morse(4096, "ba")), (thue_morse(1024, "xy"), thue_morse(1024, "yx"))]


def test_regular_words_are_told_apart(spark):
    """Two-letter Thue-Morse words of 2^k letters have equal polynomial hashes modulo 2^64, whatever the base."""
    rows = [(2 * i + k, f"one two {t} three four") for i, twins in enumerate(TWINS) for k, t in enumerate(twins)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for _ in range(3):
        found = {r.doc_id: r.component_id for r in ngram_join.ngram_components(df, 4, 85).collect()}
        assert found == {i: i for i, _ in rows}
    out = {r.doc_id: r.dropped for r in line_dedup.drop_repeated_lines(df).collect()}
    assert out == {i: [] for i, _ in rows}
    bench = spark.createDataFrame([(1, rows[0][1]), (2, rows[2][1])], "item_id long, text string")
    hits = {r.doc_id: r.items for r in decontamination.contamination(df, bench).collect()}
    assert hits == {0: ["1"], 1: [], 2: ["2"], 3: []}


def test_personal_data_in_long_runs():
    begun = time.time()
    texts = ["1.2.3." + "0" * 5000, "1" * 300_000, "x (at)" + "a" * 300_000, "1." * 100_000, "a@" * 100_000, "+1 " * 100_000, "4111111111111111  " * 10_000 + "ab12 x" * 10_000]
    found = [personal_data.candidates(t) for t in texts]
    assert found[0][0] == [("ip", 0, 5006)] and len(found[3][0]) == 25_000 and len(found[6][0]) == 10_000
    assert time.time() - begun < 20


def test_tokens_of_a_word_without_end():
    model = UnigramModel(PIECES)
    trie, r = ForwardTrie(model), random.Random(4)
    for n in (1, 63, 64, 65, 66, 80, 300):
        for alphabet in (["a", "b", "the", "ing"], ["é", "日", "🎉", "x", "="]):
            word = "".join(r.choice(alphabet) for _ in range(n))
            assert trie.insert(word) == len(model.segment(word)), word
    before = len(trie.kids)
    assert trie.count(["ab" * 50_000, "ab"]) == len(model.segment("ab" * 50_000)) + len(model.segment("ab")) and len(trie.kids) <= before + trie.depth


@pytest.mark.parametrize("block", [200_000, 3])
def test_items_without_an_id_count(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", block)
    bench = spark.createDataFrame([(None, "alpha beta"), (None, "gamma delta"), (7, "alpha beta"), (8, "nowhere")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so alpha beta and gamma delta"), (2, "only gamma delta"), (3, None)], "_number long, text string")
    out = {r._number: r for r in decontamination.digest(decontamination.contamination(docs, bench, id_col="_number"), "_number").collect()}
    assert [(out[i].n_hit, out[i].n_items) for i in (1, 2, 3)] == [(4, 2), (2, 1), (0, 0)]


def test_pipeline_stage_over_blocks(spark, monkeypatch):
    docs, stage = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)["benchmark decontamination"]
    whole = {r.doc_id for r in stage(spark, docs, SF).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 2_000)
    assert {r.doc_id for r in stage(spark, docs, SF).collect()} == whole


def test_chain_of_near_copies(spark, monkeypatch):
    """A large group in which each text is close to its neighbours only, searched in leaves of a few points."""
    from demandlens.llm import similarity

    monkeypatch.setattr(similarity, "LEAF", 6)
    monkeypatch.setattr(similarity, "FANOUT", 3)
    words = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 120])) for i in range(250)]  # neighbours share 114 of 120 shingles
    lone = [(1000 + i, " ".join(words[3 * i : 3 * i + 120 - 24] + [f"x{i}_{j}" for j in range(24)])) for i in range(0, 250, 5)]
    df = spark.createDataFrame([x for x in rows + lone], "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(117)} for i, t in rows + lone}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 185 * len(sets[a] & sets[b]) >= 85 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    assert len({root(i) for i in sets}) > 1
    assert {(r.doc_id, r.component_id) for r in ngram_join.ngram_components(df, 4, 85).collect()} == {(i, root(i)) for i in sets}


def test_no_machine_local_tables_on_a_cluster(spark):
    class Remote:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        scratch.shared_dir(Remote)
    assert spark.range(1).select(F.lit(1)).count() == 1
