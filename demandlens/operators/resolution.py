"""Skills named in texts: leftmost longest aliases outside guard phrases."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GUARD_PHRASES
from ..functions.columns import taxonomy_normalized

#: A vocabulary of no more phrases becomes one automaton in every task; a larger one meets the tokens by a shuffle, after as many first tokens have sifted them.
AUTOMATON_PHRASES = 200_000

#: Of a span: (start, stop, skill; None for a guard) in tokens.
Found = tuple[int, int, "int | None"]


class TokenAutomaton:
    """Aho-Corasick over tokens: one step a token finds every phrase that ends there.

    States are prefixes of phrases. ``fail`` leads to the longest other state that ends alike, ``shorter`` to the next one
    on that way where a phrase ends.
    """

    def __init__(self, phrases: list[tuple[str, int | None, bool]]):
        self.next: list[dict[str, int]] = [{}]
        self.skill: list[int | None] = [None]
        self.alias, self.guard, self.depth = [False], [False], [0]
        for phrase, skill, guard in phrases:
            state = 0
            for token in phrase.split(" "):
                after = self.next[state].get(token)
                if after is None:
                    after = self.next[state][token] = len(self.next)
                    self.next.append({})
                    self.skill.append(None)
                    self.alias.append(False)
                    self.guard.append(False)
                    self.depth.append(self.depth[state] + 1)
                state = after
            if guard:
                self.guard[state] = True
            else:
                self.skill[state], self.alias[state] = skill, True
        self.fail, self.shorter = [0] * len(self.next), [0] * len(self.next)
        todo = list(self.next[0].values())
        for state in todo:
            for token, after in self.next[state].items():
                todo.append(after)
                back = self.fail[state]
                while back and token not in self.next[back]:
                    back = self.fail[back]
                self.fail[after] = back = self.next[back].get(token, 0)
                self.shorter[after] = back if self.alias[back] or self.guard[back] else self.shorter[back]

    def occurrences(self, tokens: list[str]) -> list[Found]:
        """Every alias and guard phrase in the tokens, overlapping ones too."""
        out: list[Found] = []
        state, steps, fail, shorter = 0, self.next, self.fail, self.shorter
        for stop, token in enumerate(tokens, 1):
            after = steps[state].get(token)
            while after is None and state:
                state = fail[state]
                after = steps[state].get(token)
            state = after or 0
            at = state if self.alias[state] or self.guard[state] else shorter[state]
            while at:
                start = stop - self.depth[at]
                if self.alias[at]:
                    out.append((start, stop, self.skill[at]))
                if self.guard[at]:
                    out.append((start, stop, None))
                at = shorter[at]
        return out


def leftmost_longest(found: list[Found]) -> list[tuple[int, int, int]]:
    """The aliases that a reader from left to right takes, the longest at each place, none of whose tokens a guard covers."""
    covered: list[list[int]] = []
    for start, stop, skill in sorted((f for f in found if f[2] is None), key=lambda f: f[:2]):
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], stop)
        else:
            covered.append([start, stop])
    taken, upto, guard = [], 0, 0
    for start, stop, skill in sorted((f for f in found if f[2] is not None), key=lambda f: (f[0], -f[1])):
        while guard < len(covered) and covered[guard][1] <= start:
            guard += 1
        if start >= upto and not (guard < len(covered) and covered[guard][0] < stop):
            taken.append((start, stop, skill))
            upto = stop
    return taken


_HITS = "array<struct<start: int, stop: int, skill_id: bigint>>"
_BUILT: dict[str, TokenAutomaton] = {}


def _hits_batch(ids: pa.Array, rows: list[int], hits: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("skill_id", pa.int64())]))
    made = pa.array([[{"start": a, "stop": b, "skill_id": s} for a, b, s in h] for h in hits], kind)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), made], ["span_id", "hits"])


def vocabulary_hits(
    spans: DataFrame, aliases: DataFrame, guards: DataFrame | None = None, normalize: Callable[[Column], Column] = taxonomy_normalized, most: int = AUTOMATON_PHRASES
) -> DataFrame:
    """span_id, hits: the leftmost longest aliases that don't overlap (start, stop, skill_id) in a span's tokens; spans
    without one are left out.

    spans: span_id, text; aliases: alias_norm, skill_id; guards: phrase, by default GUARD_PHRASES (both in the form that ``normalize``
    gives, which is also applied to the texts). Tokens under a guard phrase match nothing. Of several owners of an alias the smallest counts. The
    phrases are counted when the plan is built. Up to ``most`` of them go to every task and nothing is shuffled; with
    more, runs of tokens whose first begins a phrase meet it by a shuffle (all tokens do if more than ``most`` tokens begin phrases), and a span's occurrences come together by its id, which
    must then be unique.
    """
    if guards is None:
        guards = spans.sparkSession.createDataFrame([(g,) for g in GUARD_PHRASES], "phrase string")
    known = aliases.groupBy(F.col("alias_norm").alias("phrase")).agg(F.min(F.col("skill_id").cast("long")).alias("skill_id")).withColumn("guard", F.lit(False))
    marked = known.unionByName(guards.select("phrase", F.lit(None).cast("long").alias("skill_id"), F.lit(True).alias("guard")).distinct()).where("phrase <> ''")
    marked = marked.where("guard OR skill_id IS NOT NULL")
    read = marked.select("phrase", "skill_id", "guard").limit(most + 1).toPandas()
    texts = spans.select("span_id", F.coalesce(normalize(F.col("text")), F.lit("")).alias("norm"))
    kind = spans.schema["span_id"].dataType.simpleString()
    if len(read) > most:
        return _by_shuffle(texts, marked, kind, most)
    rows = [(p, None if g else int(s), bool(g)) for p, s, g in zip(read["phrase"], read["skill_id"], read["guard"])]
    sent = spans.sparkSession.sparkContext.broadcast(rows)
    number = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _BUILT:  # once a worker
            _BUILT.clear()
            _BUILT[number] = TokenAutomaton(sent.value)
        automaton = _BUILT[number]
        for batch in batches:
            rows, hits = [], []
            for i, norm in enumerate(batch.column(1)):
                if own := leftmost_longest(automaton.occurrences(norm.as_py().split(" "))):
                    rows.append(i)
                    hits.append(own)
            if rows:
                yield _hits_batch(batch.column(0), rows, hits)

    return texts.mapInArrow(scan, f"span_id {kind}, hits {_HITS}")


def _by_shuffle(texts: DataFrame, marked: DataFrame, kind: str, most: int) -> DataFrame:
    """Starts of phrases first: a token meets the lengths of the phrases that it begins, then each such run its phrase.

    Up to ``most`` distinct first tokens go to every task, so that of the texts only runs that begin a phrase are shuffled.
    """
    first = F.substring_index("phrase", " ", 1).alias("token")
    lengths = marked.groupBy(first).agg(F.collect_set(F.size(F.split("phrase", " "))).alias("lengths"))
    starts = lengths.limit(most + 1).collect()
    if len(starts) <= most:
        longest = max(n for s in starts for n in s["lengths"])
        lengths = F.broadcast(marked.sparkSession.createDataFrame(starts, lengths.schema))
    else:
        longest = marked.agg(F.max(F.size(F.split("phrase", " ")))).first()[0]
    tokens = texts.select("span_id", F.split("norm", " ").alias("w"))
    windows = tokens.select("span_id", F.posexplode(F.expr(f"transform(w, (x, i) -> slice(w, i + 1, {longest}))")).alias("start", "w"))
    begun = windows.withColumn("token", F.col("w")[0]).join(lengths, "token")
    runs = begun.select("span_id", "start", "w", F.explode(F.expr("filter(lengths, n -> n <= size(w))")).alias("n")).select("span_id", "start", (F.col("start") + F.col("n")).alias("stop"), F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("phrase"))
    met = runs.join(marked, "phrase").select("span_id", "start", "stop", F.when(~F.col("guard"), F.col("skill_id")).alias("skill_id"))
    found = met.groupBy("span_id").agg(F.collect_list(F.struct("start", "stop", "skill_id")).alias("found"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits = [], []
            for i, own in enumerate(batch.column(1)):
                if taken := leftmost_longest([(f["start"], f["stop"], f["skill_id"]) for f in own.as_py()]):
                    rows.append(i)
                    hits.append(taken)
            if rows:
                yield _hits_batch(batch.column(0), rows, hits)

    return found.mapInArrow(choose, f"span_id {kind}, hits {_HITS}")


def resolve(spans: DataFrame, aliases: DataFrame, guards: DataFrame | None = None) -> DataFrame:
    """span_id and the skill of its first hit, null without one. Any function of this shape can take its place (J2)."""
    hits = vocabulary_hits(spans, aliases, guards)
    return spans.select("span_id").join(hits.select("span_id", F.col("hits")[0]["skill_id"].alias("skill_id")), "span_id", "left")
