"""Aliases in texts: both searches against a plain reading from left to right."""

import random

import pytest

from demandlens.config import GUARD_PHRASES
from demandlens.operators import resolution
from demandlens.sources import documents

TOKENS = ["a", "b", "c", "d"]


def read(tokens, aliases, guards):
    masked, most = set(), max(map(len, [*aliases, *guards, ()]))
    for i in range(len(tokens)):
        for n in range(1, most + 1):
            if tuple(tokens[i : i + n]) in guards and i + n <= len(tokens):
                masked.update(range(i, i + n))
    out, i = [], 0
    while i < len(tokens):
        for n in range(min(most, len(tokens) - i), 0, -1):
            if not masked & set(range(i, i + n)) and tuple(tokens[i : i + n]) in aliases:
                out.append((i, i + n, aliases[tuple(tokens[i : i + n])]))
                i += n
                break
        else:
            i += 1
    return out


def phrases(rng, n):
    return {tuple(rng.choice(TOKENS) for _ in range(rng.randint(1, 4))) for _ in range(n)}


@pytest.mark.parametrize("seed", range(40))
def test_automaton_equals_a_plain_reading(seed):
    rng = random.Random(seed)
    aliases = {p: i for i, p in enumerate(sorted(phrases(rng, rng.randint(1, 12))))}
    guards = phrases(rng, rng.randint(0, 3))
    automaton = resolution.TokenAutomaton([(" ".join(p), s, False) for p, s in aliases.items()] + [(" ".join(p), None, True) for p in guards])
    for _ in range(30):
        tokens = [rng.choice(TOKENS + ["x"]) for _ in range(rng.randint(1, 40))]
        assert resolution.leftmost_longest(automaton.occurrences(tokens)) == read(tokens, aliases, guards)


@pytest.mark.parametrize("most", [resolution.AUTOMATON_PHRASES, 3])
def test_both_ways_on_a_table(spark, most):
    rng = random.Random(1)
    aliases = {p: i for i, p in enumerate(sorted(phrases(rng, 14)))}
    guards = phrases(rng, 3)
    texts = [[rng.choice(TOKENS + ["x"]) for _ in range(rng.randint(1, 60))] for _ in range(80)]
    spans = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "?!")], "span_id long, text string")
    # of two owners the smaller counts; null owners and empty aliases count for nothing
    known = [(" ".join(p), s) for p, s in aliases.items()] + [(" ".join(p), s + 1000) for p, s in aliases.items()] + [("", 1), ("x", None), (None, 2)]
    found = resolution.vocabulary_hits(spans, spark.createDataFrame(known, "alias_norm string, skill_id long"), spark.createDataFrame([(" ".join(g),) for g in guards] * 2, "phrase string"), most=most)
    got = {r.span_id: [tuple(h) for h in r.hits] for r in found.collect()}
    assert got == {i: hits for i, t in enumerate(texts) if (hits := read(t, aliases, guards))}


@pytest.mark.parametrize("most", [resolution.AUTOMATON_PHRASES, 1])
def test_compatibility_forms_and_default_guards(spark, most):
    aliases = spark.createDataFrame([("python", 1), ("fine tuning", 2), ("go", 3), ("spring", 4), ("c++", 5)], "alias_norm string, skill_id long")
    cases = {"Ｐｙｔｈｏｎ dev": 1, "ﬁne tuning": 2, "We go to market": None, "Go services": 3, "Spring 2026 start": None, "spring boot": 4, "Ｃ＋＋": 5, "a scale of the go": 3}
    spans = spark.createDataFrame(list(enumerate(cases)), "span_id int, text string")
    hits = resolution.vocabulary_hits(spans, aliases, most=most)
    got = {r.span_id: r.hits[0].skill_id for r in hits.collect()}
    assert [got.get(i) for i in range(len(cases))] == list(cases.values())
    assert len(set(GUARD_PHRASES)) == len(GUARD_PHRASES)


def test_vocabulary_aliases_are_folded_alike(spark):
    specs = spark.createDataFrame([("Ｐｙｔｈｏｎ", "language", True, ["ﬁne tuning"])], "name string, category string, is_actionable boolean, aliases array<string>")
    assert {r.alias_norm for r in documents.check_taxonomy(specs)[1].collect()} == {"python", "fine tuning"}


def test_nothing_is_shuffled_for_a_small_vocabulary(spark):
    spans = spark.createDataFrame([(1, "go")], "span_id int, text string")
    plan = resolution.vocabulary_hits(spans, spark.createDataFrame([("go", 1)], "alias_norm string, skill_id long"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_first_tokens_sift_the_texts_before_a_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = spark.createDataFrame([(f"go {i}", i) for i in range(9)], "alias_norm string, skill_id long")
        spans = spark.createDataFrame([(i, f"we like go {i} and rust") for i in range(12)], "span_id int, text string")
        hits = resolution.vocabulary_hits(spans, known, spark.createDataFrame([("in the",)], "phrase string"), most=5)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [token" in plan
        assert {r.span_id: tuple(r.hits[0]) for r in hits.collect()} == {i: (2, 4, i) for i in range(9)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
