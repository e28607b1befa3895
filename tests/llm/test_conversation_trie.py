"""Prefix nodes of conversations against brute force, and the trie's own parts."""

import hashlib
import random
import zlib

import pytest

from demandlens.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, n_convs string"


def expected(rows, cross, heads):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = own.get(c - c % cross, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for prefix in members:
        if prefix:
            kids.setdefault(prefix[:-1], []).append(prefix)

    def below(prefix):
        leaves, saved, todo = 0, 0, [prefix]
        while todo:
            p = todo.pop()
            leaves += p not in kids
            saved += (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
            todo += kids.get(p, [])
        return leaves, saved

    out = []
    for prefix, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(prefix))))
        out.append((min(who), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(who), len(kids.get(prefix, [])), *below(prefix), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(seed, convs=60, turns=7):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 1, 2, 3, turns, 4 * turns])):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "user", None, ""]), rng.choice(["a", "a", "a", "bé", None, "", "c" * rng.randint(0, 3)])))
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, trie.prefix_nodes(df, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{"cross": 5, "heads": 9}, {"cross": 5, "heads": 9, "piece": 3, "batch_turns": 20}, {"piece": 1, "batch_turns": 1}, {}])
def test_equals_brute_force(spark, how):
    rows = table(len(how)) + [(None, 0, "user", "lost"), (-7, 0, "user", "a"), (-10, 0, "user", "b"), (70_000, 0, "user", "a"), (1 << 40, None, None, None)]
    rows += rows[:5]
    assert run(spark, rows, **how) == expected(rows, how.get("cross", 1), how.get("heads", 1))


def test_many_ends_of_one_node_and_a_long_conversation(spark):
    rows = [(c, t, "user", "same") for c in range(0, 400_000, 1000) for t in range(2)] + [(5, t, "user", f"t{t % 3}") for t in range(500)]
    assert run(spark, rows, piece=64) == expected(rows, 1, 1)


def test_no_conversations(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []


def test_two_fattest():
    for a in range(40):
        for b in range(a + 1, 40):
            best = max(range(a + 1, b + 1), key=lambda n: n & -n)
            assert trie.two_fattest(a, b) == best


def test_exit_nodes_are_those_of_a_plain_search():
    rng = random.Random(9)
    for _ in range(200):
        z, seen = trie.ZFastTrie(), []
        for c in range(rng.randint(1, 30)):
            keys = [trie.ROOT]
            for _ in range(rng.randint(0, 20)):
                keys.append(hashlib.blake2b(keys[-1] + bytes([rng.random() < 0.2]), digest_size=16).digest())
            if seen:
                node, depth = z.locate(0, keys)
                assert depth == max(sum(a == b for a, b in zip(keys, other)) for other in seen) - 1
                assert node.top < depth <= node.end or depth == node.end
            z.insert(0, keys, [0] * len(keys), c, True)
            seen.append(keys)
        assert {k for _, k, *_ in z.expand()} == {k for keys in seen for k in keys}
