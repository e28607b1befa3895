"""Personal data by weak supervision (operator 2).

Base spans come from four patterns. Further candidates are found by loose patterns; labelers (patterns, word lists,
context) vote on all candidates; expectation-maximisation over the counted vote patterns estimates how reliable each
labeler is, and a logistic classifier trained on the resulting probabilities decides which candidates become spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = KINDS[:4]

# The patterns of the contract, made to run in linear time. A run of digits is looked at from its start only
# (a match inside it would also start there) and never given back, so that no text makes them try a run again and again.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Loose patterns of further candidates.
_AT = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]++)++", re.I)
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+")
_LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9])")
_PERSON_NUMBER = re.compile(r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
_DIGIT = re.compile("[0-9]")

# Word lists of the labelers.
_ENDINGS = frozenset("com org net edu gov io info de fr es uk eu".split())
_NOT_PERSONAL = frozenset("version v chapter page section figure table license release build issue rfc iso isbn".split())
_CUES = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "host", "server", "address", "ping"),
    "card": ("card", "visa", "payment", "account", "iban"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "secret": ("token", "key", "secret", "password", "passwd", "bearer", "credential"),
    "number": ("ssn", "social", "passport", "tax", "insurance", "id"),
}
LABELERS = 6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: what stands before each @ can only start where its run of characters starts."""
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            pos = m.end()
        at = text.find("@", max(at + 1, pos))


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in s.split("."))
    digits = re.sub("[^0-9]", "", s)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and other candidates that overlap none of them: (kind, start, end)."""
    base: list[tuple[str, int, int]] = []
    loose: list[tuple[str, int, int]] = []
    if "@" in text:
        base += [("email", *x) for x in _emails(text)]
    low = text.lower()
    if "at)" in low or "at]" in low:
        loose += [("email", *m.span()) for m in _AT.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            for m in pattern.finditer(text):
                if _valid(kind, m[0]):
                    base.append((kind, *m.span()))
                elif kind != "card" or sum(c.isdigit() for c in m[0]) >= 12:
                    loose.append((kind, *m.span()))
        for kind, pattern in (("secret", _TOKEN), ("phone", _LOCAL_PHONE), ("number", _PERSON_NUMBER)):
            for m in pattern.finditer(text):
                if kind != "secret" or (re.search("[A-Za-z]", m[0]) and _DIGIT.search(m[0])):
                    loose.append((kind, *m.span()))
    taken = sorted((s, e) for _, s, e in base)
    ends, starts, top = [], [s for s, _ in taken], 0
    for _, e in taken:
        top = max(top, e)
        ends.append(top)
    free, last = [], {}
    for kind, s, e in sorted(loose, key=lambda x: (x[1], KINDS.index(x[0]))):
        i = bisect_left(starts, e) - 1  # the last base span that starts before this ends
        if (i < 0 or ends[i] <= s) and last.get(kind, 0) <= s:
            free.append((kind, s, e))
            last[kind] = e
    return base, free


def votes_and_features(text: str, kind: str, start: int, end: int) -> tuple[int, int]:
    """Votes (2 bits a labeler: 0 abstains, 1 for, 2 against) and feature bits of a candidate."""
    s = text[start:end]
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 2]
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    word = re.findall(r"[a-z]+", before)[-1:] or [""]
    strict = kind in BASE and (kind == "email" and "@" in s or kind != "email" and _valid(kind, s) and (kind != "phone" or s[0] == "+"))
    cue = any(c in before for c in _CUES[kind])
    listed = kind == "email" and s.rpartition(".")[2].lower() in _ENDINGS
    refused = word[0] in _NOT_PERSONAL
    varied = len(set(s)) >= (8 if kind == "secret" else 4)
    long = len(s) >= (24 if kind == "secret" else 10)
    set_off = before[-1:] in "\"'=:" and before[-1:] != ""
    inside = (before[-1:].isalnum() or after[:1].isalnum()) and before[-1:] not in "\"'=:"
    say = (
        1 if strict else 2 if kind in ("ip", "card") else 0,
        1 if listed else 0,
        2 if refused else 0,
        1 if cue else 0,
        1 if varied and long and (kind != "secret" or digits >= 4 and letters >= 4) else 2,
        2 if inside else 1 if set_off else 0,
    )
    features = [kind == k for k in KINDS] + [strict, listed, refused, cue, varied, long, inside, set_off, digits >= 9, letters >= 4]
    return sum(v << (2 * i) for i, v in enumerate(say)), sum(int(f) << i for i, f in enumerate(features))


FEATURES = len(KINDS) + 10


def fit_votes(votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation over distinct vote patterns (rows of LABELERS votes) and their counts: the probability
    that candidates of each pattern are personal data. Votes are taken as independent given the truth."""
    own = (votes[:, :, None] == np.arange(3)).astype(float)
    p = 1 / (1 + np.exp(-1.5 * (own[:, :, 1].sum(axis=1) - own[:, :, 2].sum(axis=1))))  # majority to begin with
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 0.01, 0.99)
        like = []
        for w in (n * p, n * (1 - p)):
            table = np.einsum("i,ijk->jk", w, own) + 1.0
            like.append(np.einsum("ijk,jk->i", own, np.log(table / table.sum(axis=1, keepdims=True))))
        p = 1 / (1 + np.exp(np.clip(np.log((1 - prior) / prior) + like[1] - like[0], -500, 500)))
    return p


def fit_classifier(features: np.ndarray, target: np.ndarray, n: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on distinct feature rows with probabilities as targets and counts as weights (Newton steps)."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (n * (target - p)) - ridge * w)
    return w


@dataclass(frozen=True)
class SpanModel:
    weights: np.ndarray

    def accepts(self, features: int) -> bool:
        bits = (features >> np.arange(FEATURES)) & 1
        return bool(bits @ self.weights[:-1] + self.weights[-1] >= 0)


def train(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Learns from the candidates of all documents. Only counts of distinct (votes, features) come to the driver: these
    are bits of fixed number, so that their combinations don't grow with the data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], int] = {}
            for t in batch.column(0):
                text = t.as_py() or ""
                base, loose = candidates(text)
                for c in base + loose:
                    key = votes_and_features(text, *c)
                    found[key] = found.get(key, 0) + 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["votes", "features", "n"])

    rows = docs.select(text_col).mapInArrow(count, "votes int, features int, n long").groupBy("votes", "features").agg(F.sum("n").alias("n")).orderBy("votes", "features").toArrow()
    if not rows.num_rows:
        return SpanModel(np.append(np.zeros(FEATURES), -1.0))
    votes = (rows.column("votes").to_numpy()[:, None] >> (2 * np.arange(LABELERS))) & 3
    features = (rows.column("features").to_numpy()[:, None] >> np.arange(FEATURES)) & 1
    n = rows.column("n").to_numpy().astype(float)
    return SpanModel(fit_classifier(features.astype(float), fit_votes(votes, n), n))



def find_spans(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``found``, the spans in order (kind, start, end, base) in code points of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                base, loose = candidates(text)
                spans = [(*c, True) for c in base] + [(*c, False) for c in loose if shared.value.accepts(votes_and_features(text, *c)[1])]
                spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
                rows.append([dict(zip(("kind", "start", "end", "base"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], [id_col, "found"])

    key = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, found array<struct<kind:string,start:long,end:long,base:boolean>>")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on all rows, then finds the spans of each: null and empty texts have none, repeated rows give repeated rows.

    Texts of any length take time in proportion to it. Columns besides id and text are ignored; an empty table gives an
    empty one. Spans of one kind never overlap; those of different kinds may, and order by start, then kind.
    """
    return find_spans(docs, train(docs, text_col), id_col, text_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and hash of the base spans, and all spans as text."""
    text = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    counts = [F.expr(f"cast(size(filter(found, x -> x.base and x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.sha2(F.expr(text.format("filter(found, x -> x.base)")), 256).alias("base_sha256"), F.expr(text.format("found")).alias("spans"))
