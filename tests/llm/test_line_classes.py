"""Short lines that are equal and long ones that are near copies."""

import random

import numpy as np

from demandlens.llm import line_dedup


def prose(seed, n, words):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def test_short_equal_and_long_near_lines(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(900)]
    long = [prose(i, n, vocabulary) for i, n in enumerate([20, 27, 60, 200])]
    han = "".join(chr(0x4E00 + r.randrange(5000)) for _ in range(120))
    words = [x.split() for x in long]
    for w in words:
        w[len(w) // 2] = "different"
    near = [" ".join(w) for w in words]
    texts = ["Share\n---\n\nHome\n" + "\n".join(long) + "\n" + han, "Home\n---\n\nshare!\n" + "\n".join(near) + "\n" + han[:60] + "漢字漢" + han[61:], "Share\nyes"]
    out = {x.doc_id: x.dropped for x in line_dedup.drop_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    # of 20 words none may change, of 27 two may; lines without a word stay
    assert out == {0: [], 1: [0, 5, 6, 7, 8], 2: [0]}


def test_words_by_brute_force():
    lines = line_dedup.Lines(["one two, three\n \n漢字 x\nlast", "a b a b a", ""])
    assert lines.n_words.tolist() == [3, 0, 3, 1, 5, 0]
    at = lines.first_word[4]
    assert len(set(lines.words[at : at + 5].tolist())) == 2 and len(set(lines.words.tolist())) == 9
    assert lines.compared(line_dedup.LineConfig()).tolist() == [0, 2, 3, 4]


def test_edits_grow_with_the_words():
    edits = line_dedup.LineConfig().word_edits(np.array([0, 24, 25, 49, 50, 99, 100, 199, 200, 400]))
    assert edits.tolist() == [-1, -1, 2, 2, 2, 2, 3, 3, 3, 4]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b, cfg):
    """The relation of lines, in both units."""
    v, w = a.split(), b.split()
    m, n = min(len(v), len(w)), min(len(a), len(b))
    if a == b or (m >= cfg.long_words and edit_distance(v, w) <= cfg.word_edits(np.array([m]))[0]):
        return True
    return abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= cfg.char_edits(np.array([n]))[0]


def components(texts, cfg):
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near(texts[i], texts[j], cfg):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    return [root(i) for i in range(len(texts))]


def dropped(spark, texts):
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {x.doc_id for x in out if x.dropped}


def test_blanks_put_into_lines_of_any_length(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(4, 8)))
    base = {n: [word() for _ in range(n)] for n in (3, 24, 25, 26, 40, 110)}
    split = lambda w, n: " ".join(x[:2] + " " + x[2:] if i < n else x for i, x in enumerate(w))
    texts = [" ".join(w) for w in base.values()] + [split(base[24], 1), split(base[24], 2), split(base[40], 2), split(base[110], 2), split(base[25], 1), split(base[26], 2)]
    assert dropped(spark, texts) == set(range(6, 12))
    assert dropped(spark, [split(base[40], 3), " ".join(base[40])]) == set()


def test_short_lines_have_fewer_edits(spark):
    texts = ["Home", "Hume", "Contact", "Contacts", "Read more", "Read mire", "Read  mire!", "Privacy policy and terms", "Privacy policy end terme", "Privacy polici end terme"]
    # under 8 characters none, under 24 one, then two; chains count
    assert dropped(spark, texts) == {5, 8, 9} == {i for i, x in enumerate(components(texts, line_dedup.LineConfig())) if x != i}


def test_both_units_by_brute_force(spark):
    r, cfg = random.Random(21), line_dedup.LineConfig()
    texts = []
    for n in (2, 4, 22, 23, 24, 25, 26, 27, 28, 30, 52, 101):
        base = [r.choice(["the", "of", f"b{n}", f"c{r.randrange(60)}"]) for _ in range(n)]
        for _ in range(9):
            line = " ".join(changed(r, base, 2)) if r.random() < 0.4 else " ".join(base)
            for _ in range(r.randint(0, 3)):
                i = r.randrange(len(line))
                line = line[:i] + r.choice(["", " ", "x", line[i] + " "]) + line[i + 1 :]
            texts.append(" ".join(line.split()))
    r.shuffle(texts)
    wanted = {i for i, x in enumerate(components(texts, cfg)) if x != i}
    assert dropped(spark, texts) == wanted and len(wanted) > 30


def changed(r, words, most):
    w = list(words)
    for _ in range(r.randint(0, most)):
        i = r.randrange(len(w) + 1)
        r.choice([lambda i=i: w.insert(i, f"new{r.randrange(10**9)}"), lambda i=i: w.pop(i - 1), lambda i=i: w.__setitem__(i - 1, f"n{r.randrange(10**9)}")])()
    return w


def test_long_lines_by_brute_force(spark):
    r, cfg = random.Random(11), line_dedup.LineConfig()
    bases = [[r.choice(["the", "of", "and", "to", "in", f"b{i}", f"c{r.randrange(60)}"]) for _ in range(n)] for i, n in enumerate([23, 25, 27, 48, 52, 99, 101, 130])]
    lines = [w for b in bases for w in [b, *(changed(r, b, 6) for _ in range(9))]]
    r.shuffle(lines)
    texts = [" ".join(w) for w in lines]
    wanted = {i for i, x in enumerate(components(texts, cfg)) if x != i}
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id for x in out if x.dropped} == wanted and 20 < len(wanted) < len(lines) - len(bases)
