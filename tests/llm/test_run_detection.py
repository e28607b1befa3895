"""Runs of repeated words against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from demandlens.llm import run_detection


def all_runs(words):
    """(start, length, smallest period) of every run, by start and period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(24, 3 * q):
                found.setdefault((start, i - start + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(key, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    drop = {w for s, length, q in runs for w in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def repeating(rng):
    k, out = rng.choice([1, 2, 2, 3, 5, 40]), []
    for _ in range(rng.randint(0, 6)):
        kind = rng.randint(0, 3)
        if kind == 0:
            out += [rng.randrange(k) for _ in range(rng.randint(0, 40))]
        elif kind == 1:
            unit = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 17, 20, 40, 70]))]
            out += (unit * rng.randint(1, 9))[: rng.randint(1, 300)]
        elif kind == 2 and out:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randint(1, 100)]
        else:
            unit = [rng.randrange(k) for _ in range(3)]
            out += (unit * 4 + [rng.randrange(k)]) * rng.randint(1, 6)
    return out


@pytest.mark.parametrize("seed", range(24))
def test_equals_a_search_over_all_periods(seed):
    rng = random.Random(seed)
    texts = [repeating(rng) for _ in range(rng.randint(1, 5))] + [[0] * 30]
    texts += texts[:1] * rng.randint(0, 3)
    x = np.concatenate([np.array(t, dtype=np.int64) for t in texts])
    d, start, length, period = run_detection.runs_of(np.unique(x, return_inverse=True)[1], np.cumsum([len(t) for t in texts]))
    for k, text in enumerate(texts):
        got = [tuple(map(int, r)) for r in zip(start[d == k], length[d == k], period[d == k])]
        assert got == all_runs(text)


def test_long_periods_and_long_texts():
    rng = random.Random(1)
    unit = [rng.randrange(50) for _ in range(5000)]
    for text in (unit * 3 + unit[:7], [0] * 200_000, [0, 1, 0, 0, 1] * 30_000, unit + [60] * 24 + unit):
        d, start, length, period = run_detection.runs_of(np.unique(text, return_inverse=True)[1], np.array([len(text)]))
        if text[0] == unit[0] and len(text) < 100_000:
            assert (0, len(text), 5000) in zip(start, length, period) if 60 not in text else (5000, 24, 1) in zip(start, length, period)
        else:
            assert list(zip(start, length, period)) == [(0, len(text), 1 if text[1] == 0 else 5)]


def test_a_grammar_derives_its_text():
    rng = random.Random(2)
    x = np.array([w for _ in range(40) for w in repeating(rng)], dtype=np.int64)
    g = run_detection.re_pair(np.unique(x, return_inverse=True)[1], np.array([len(x)]))
    kept = np.unique(x)

    def derive(s):
        return [int(kept[s])] if s < g.words else derive(g.left[s - g.words]) + derive(g.right[s - g.words])

    assert [w for s in g.symbols for w in derive(s)] == x.tolist()
    assert len(g.symbols) < len(x)


def test_query_on_unkind_rows(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["the", "of", "Straße", "日本", "x"]) for _ in range(n))
    rows = [(None, prose(50)), (1, None), (2, ""), (3, " \n\t"), (4, "a " * 23), (5, "a " * 24), (6, prose(3000)), (7, "a b\n" * 12), (7, "a b\n" * 12)]
    rows += [(i, prose(rng.randint(0, 200)) + rng.choice(["", " la" * 30, " one two three" * 9])) for i in range(8, 80)]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, runs int, collapsed string")
    got = run_detection.digest(run_detection.word_runs(docs, arrange=run_detection.folded)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert run_detection.digest(run_detection.word_runs(docs.limit(0))).count() == 0
    plain = run_detection.word_runs(docs.where("doc_id = 5")).first()
    assert plain.runs == [(0, 24, 1)] and plain.collapsed == "a"
