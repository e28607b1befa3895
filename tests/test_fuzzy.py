"""Fuzzy best matches and robots rules against all pairs."""

import random
import re

import pytest

from demandlens.operators import fuzzy, joins


def norm(t):
    return re.sub("[^a-z0-9]+", " ", t.lower()).strip(" ")


def score(candidate, target):
    a, b = norm(candidate), norm(target)
    if not a or not b:
        return 0
    gap = abs(len(a) - len(b))
    if a == b:
        return 1000
    if a.startswith(b) or b.startswith(a):
        return 800 - gap
    if a in b or b in a:
        return 600 - gap
    words, own = b.split(" "), set(a.split(" "))
    shared = sum(w in own for w in words)
    return int(shared / len(words) * 400 + 0.5) - gap / 10 if shared else 0


def all_pairs(options, targets, minimum):
    out = {}
    for key, target in targets:
        best = max(((score(o, target), -place) for place, o in options), default=(0, 0))
        if best[0] > minimum:
            out[key] = (-best[1], round(best[0], 6))
    return out


def text(rng, kind):
    if kind == 0:
        return "".join(rng.choice("abc ,") for _ in range(rng.randint(0, 3)))
    if kind == 1:
        return " ".join(rng.choice(["go", "golang", "lang", "a", "new", "york", "degree", "master s"]) for _ in range(rng.randint(1, 5)))
    return "".join(rng.choice("ab c") for _ in range(rng.randint(1, 400 if kind == 3 else 14)))


@pytest.mark.parametrize("minimum", [300, 0, 375, 700])
def test_best_matches_equal_all_pairs(spark, minimum):
    rng = random.Random(minimum)
    options = [(i, text(rng, rng.choice([0, 0, 1, 1, 2, 3]))) for i in range(220)] + [(900, "go"), (901, "Bachelor's Degree (BA/BS)"), (902, "x" * 700)]
    targets = [(i, text(rng, rng.choice([0, 0, 1, 1, 2, 3]))) for i in range(220)] + [(900, "golang"), (901, "Bachelor's Degree"), (902, "x" * 5), (903, "?!"), (904, "york new new")]
    found = fuzzy.best_match(spark.createDataFrame(options, "place int, option string"), spark.createDataFrame(targets + [(905, None)], "target_id int, target string"), minimum)
    assert {r.target_id: (r.place, round(r.score, 6)) for r in found.collect()} == all_pairs(options, targets, minimum)


def allowed(path, rules):
    hits = []
    for pattern, allow in rules:
        bare = pattern[:-1] if pattern.endswith("$") else pattern
        regex = "^" + ".*".join(map(re.escape, bare.split("*"))) + (r"\Z" if pattern.endswith("$") else "")
        if re.search(regex, path or "/", re.DOTALL):
            hits.append((len(pattern), allow))
    return max(hits)[1] if hits else True


def test_robots_rules_equal_all_pairs(spark):
    rng = random.Random(8)
    pattern = lambda: rng.choice(["/", "/", "*"]) + "".join(rng.choice("ab/*$.\\E") for _ in range(rng.randint(0, 5)))
    rules = [(f"h{rng.randint(0, 2)}", pattern(), rng.random() < 0.4) for _ in range(120)]
    urls = [(i, f"h{i % 4}", "/" + "".join(rng.choice("ab/.$\\E") for _ in range(rng.randint(0, 8)))) for i in range(400)] + [(900, "h0", None), (901, "h0", ""), (902, None, "/a")]
    got = joins.robots_allow(spark.createDataFrame(urls, "url_id int, host string, path string"), spark.createDataFrame(rules + rules[:9], "host string, pattern string, allow boolean"))
    want = {i: allowed(path, [(p, a) for h, p, a in rules if h == host]) for i, host, path in urls}
    assert {r.url_id: r.allowed for r in got.collect()} == want


def test_many_rules_of_one_host_meet_few_paths(spark):
    rules = spark.range(100_000).selectExpr("'h' AS host", "concat('/p', id, '/') AS pattern", "id % 2 = 0 AS allow")
    urls = spark.range(2_000).selectExpr("id AS url_id", "'h' AS host", "concat('/p', id * 40, '/x') AS path")
    assert joins.robots_candidates(urls, rules).count() == 2_000
    assert joins.robots_allow(urls, rules).where("allowed").count() == 2_000
