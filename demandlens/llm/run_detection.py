"""Runs of repeated words by a grammar (operator 13).

The words of a group of texts are compressed by Re-Pair: a pair of neighbouring symbols that occurs more than once becomes a
new symbol, frequent pairs first. A round replaces all pairs at once that are more frequent than those which overlap them.
A run that isn't inside one symbol's two halves crosses a boundary: that between the halves of some symbol, where it is
looked for once however often the symbol occurs, or one between neighbours in the compressed text. What is found in a
symbol is carried to all positions at which the symbol is derived; there pieces that a symbol's ends have cut lie inside
the maximal run, which a larger symbol or the text itself has found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BETWEEN_SPACES, U, mix, span_hashes, word_spans

LEAST, TIMES = 24, 3  # a run has max(LEAST, TIMES * period) words
#: Texts are compressed together up to so many words; a longer text alone.
WORDS = 1 << 20
#: Runs of period q whose larger part lies right of a boundary repeat the first words there at distance q: (words, least q, first q of the next).
LEVELS = [(4, 1, 16), (8, 16, 64), *((1 << 2 * k + 3, 1 << 2 * k + 4, 1 << 2 * k + 6) for k in range(1, 14))]
_BINS = 22


@dataclass
class Grammar:
    """Symbols below ``words`` are words; symbol words + r derives left[r] and then right[r]."""

    words: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  # of every symbol, in words
    first: np.ndarray  # of every rule: a position in the text where it is derived
    symbols: np.ndarray  # the compressed texts
    at: np.ndarray  # where each of these begins in the text
    rounds: list[int]  # number of rules before each round, and of all


def _recurring(key: np.ndarray) -> np.ndarray:
    """Places of keys that occur more than once, and perhaps a few others."""
    bits = min(_BINS, 2 + len(key).bit_length())
    bins = (key * U(0x9E3779B97F4A7C15) >> U(64 - bits)).view(np.int64)
    return np.flatnonzero(np.bincount(bins, minlength=1 << bits)[bins] > 1)


def re_pair(x: np.ndarray, doc_ends: np.ndarray) -> Grammar:
    """Of word ids 0, 1, ...; no symbol goes over the end of a text."""
    words = n_symbols = int(x.max()) + 1 if len(x) else 0
    sym, at = x.astype(np.int64), np.arange(len(x))
    last = np.zeros(len(x), dtype=bool)
    last[doc_ends[doc_ends > 0] - 1] = True
    left, right, first, lengths, rounds = [], [], [], np.ones(words, dtype=np.int64), [0]
    # Pairs of which this is the only one stay so: new ones have a new symbol.
    maybe = np.ones(len(x), dtype=bool)
    while len(sym) > 1:
        key = (sym[:-1] * n_symbols + sym[1:]).view(U)
        ok = ~last[:-1] & maybe[:-1]
        # of aaaa, the pairs at even places
        same = np.zeros(len(key), dtype=bool)
        same[1:] = (key[1:] == key[:-1]) & ok[1:] & ok[:-1]
        if same.any():
            place = np.arange(len(key))
            ok &= (place - np.maximum.accumulate(np.where(same, 0, place))) % 2 == 0
        able = np.flatnonzero(ok)
        maybe[able] = False
        able = able[_recurring(key[able])]
        kinds, kind, counts = np.unique(key[able], return_inverse=True, return_counts=True)
        able, kind = able[counts[kind] > 1], kind[counts[kind] > 1]
        maybe[able] = True
        if not len(able):
            break
        rank = np.zeros(len(key) + 2, dtype=np.int64)  # more frequent pairs have higher ones, and no two kinds the same
        rank[able + 1] = counts[kind] * (len(kinds) + 1) + kind + 1
        wins = (rank[able + 1] > rank[able]) & (rank[able + 1] > rank[able + 2])
        able, kind = able[wins], kind[wins]
        _, where, new = np.unique(kind, return_index=True, return_inverse=True)
        a, b = sym[able[where]], sym[able[where] + 1]
        left.append(a)
        right.append(b)
        first.append(at[able[where]])
        lengths = np.concatenate([lengths, lengths[a] + lengths[b]])
        sym[able] = n_symbols + new
        last[able] = last[able + 1]
        n_symbols += len(where)
        rounds.append(n_symbols - words)
        maybe[able] = maybe[np.maximum(able - 1, 0)] = True
        keep = np.ones(len(sym), dtype=bool)
        keep[able + 1] = False
        sym, at, last, maybe = sym[keep], at[keep], last[keep], maybe[keep]
    none = np.zeros(0, dtype=np.int64)
    return Grammar(words, *(np.concatenate([none, *part]) for part in (left, right)), lengths, np.concatenate([none, *first]), sym, at, rounds)


def _common(x: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many words from a on equal those from b on (a < b), at most ``limit``."""
    out, live, wide = np.zeros(len(a), dtype=np.int64), np.flatnonzero(limit > 0), 4
    while len(live):
        step = np.arange(wide)
        here = out[live, None] + step
        inside = here < limit[live, None]
        here = np.where(inside, here, 0)
        equal = (x[a[live, None] + here] == x[b[live, None] + here]) & inside
        run = np.where(equal.all(axis=1), wide, equal.argmin(axis=1))
        out[live] += run
        live = live[(run == wide) & (out[live] < limit[live])]
        wide = min(4 * wide, max(4, (1 << 22) // max(1, len(live))), 1 << 12)
    return out


def _right_heavy(x: np.ndarray, doc: np.ndarray, lo: np.ndarray, p: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs inside lo to hi that cross p with at least half their words from p on: number of the boundary, start, end, period.

    A period that is no smallest one may be among them, beside the smallest with the same start and end.
    """
    found: list[tuple[np.ndarray, ...]] = []
    n, grams, size = len(x), mix(x.astype(U) + U(1)), 1
    salt = mix(doc.astype(U) + U(0x51ED270B27CD7A2F))
    # A run of period q and end j found for a boundary: periods from 2 q to j - q - p are multiples of its smallest one, so words
    # at these distances aren't tried. Kept of the first run found (places 0, 1) and of the one that reaches farthest (2, 3).
    known = np.zeros((4, len(p)), dtype=np.int64)
    known[1] = known[3] = -1
    for wide, least, most in LEVELS:
        todo = np.flatnonzero((hi - p >= max(LEAST // 2, least * TIMES // 2)) & (hi - lo >= max(LEAST, TIMES * least)))
        if not len(todo):
            break
        while size < wide and len(grams) > size:
            grams = mix(grams[:-size] * U(0xD1B54A32D192ED03) + grams[size:])
            size *= 2
        if size < wide:
            break
        # a gram doesn't go over the end of a text
        keys = mix(grams ^ salt[: len(grams)])
        inside = np.flatnonzero(doc[: len(grams)] == doc[size - 1 :])
        inside = inside[_recurring(keys[inside])]
        _, kind, counts = np.unique(keys[inside], return_inverse=True, return_counts=True)
        inside, kind = inside[counts[kind] > 1], kind[counts[kind] > 1]
        if not len(inside):
            continue
        kind_at = np.full(n + 1, -1, dtype=np.int64)
        kind_at[inside] = kind
        places = np.sort(kind * (n + 1) + inside)  # by kind, then position
        todo = todo[kind_at[p[todo]] >= 0]
        after = p[todo] + least - 1
        while len(todo):
            own = kind_at[p[todo]]
            k = np.searchsorted(places, own * (n + 1) + after, side="right")
            next_ = places[np.minimum(k, len(places) - 1)]
            q = next_ - own * (n + 1) - p[todo]
            need = np.maximum(LEAST, TIMES * q)
            ok = (k < len(places)) & (next_ // (n + 1) == own) & (q < most) & (p[todo] + (need + 1) // 2 <= hi[todo]) & (need <= hi[todo] - lo[todo])
            todo, q, need = todo[ok], q[ok], need[ok]
            after = p[todo] + q
            least_from, least_to, far_from, far_to = known[:, todo]
            in_least, in_far = (after >= least_from) & (after <= least_to), (after >= far_from) & (after <= far_to)
            half = (need + 1) // 2 - q
            # a gram that ends the required part tells most others apart
            end = np.minimum(np.maximum(half - wide, 0), n - after)
            likely = np.flatnonzero(~in_least & ~in_far & (kind_at[p[todo] + end] == kind_at[after + end]))
            after = np.maximum(after, np.maximum(np.where(in_least, least_to, 0), np.where(in_far, far_to, 0)))
            at, b, per = p[todo[likely]], todo[likely], q[likely]
            ahead = _common(x, at, at + per, hi[b] - at - per)
            good = ahead >= half[likely]
            at, b, per, ahead, likely = at[good], b[good], per[good], ahead[good], likely[good]
            behind = _common(x[::-1], n - at - per, n - at, at - lo[b])
            good = (ahead + behind + per >= need[likely]) & (behind > 0)
            at, b, per, ahead, behind = at[good], b[good], per[good], ahead[good], behind[good]
            found.append((b, at - behind, at + per + ahead, per))
            new = known[1, b] < 0
            known[0, b[new]], known[1, b[new]] = (at + 2 * per)[new], (at + ahead)[new]
            new = known[3, b] < at + ahead
            known[2, b[new]], known[3, b[new]] = (at + 2 * per)[new], (at + ahead)[new]
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([none, *(f[i] for f in found)]) for i in range(4))


def _crossing(x: np.ndarray, doc: np.ndarray, lo: np.ndarray, p: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """All runs inside lo to hi that have words on both sides of p: number of the boundary, start, end, smallest period."""
    n = len(x)
    b1, i1, j1, q1 = _right_heavy(x, doc, lo, p, hi)
    b2, i2, j2, q2 = _right_heavy(x[::-1], doc[::-1], n - hi, n - p, n - lo)
    b, i, j, q = (np.concatenate(z) for z in ((b1, b2), (i1, n - j2), (j1, n - i2), (q1, q2)))
    order = np.lexsort((q, j, i, b))
    b, i, j, q = b[order], i[order], j[order], q[order]
    new = np.ones(len(b), dtype=bool)
    new[1:] = (b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return b[new], i[new], j[new], q[new]


def _slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each slice, one after the other."""
    total = np.cumsum(sizes)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - sizes - starts, sizes)


def runs_of(x: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of word ids of texts one after the other: text number, start, length and period of each run, by text, start and period."""
    g = re_pair(x, doc_ends)
    doc_starts = np.concatenate([[0], doc_ends[:-1]]).astype(np.int64)
    doc = np.repeat(np.arange(len(doc_ends)), doc_ends - doc_starts)
    rules = np.flatnonzero(g.length[g.words :] >= LEAST)
    joints = np.flatnonzero(doc[g.at[1:]] == doc[g.at[:-1]]) + 1
    own = doc[g.at[joints]]
    lo = np.concatenate([g.first[rules], doc_starts[own]])
    p = np.concatenate([g.first[rules] + g.length[g.left[rules]], g.at[joints]])
    hi = np.concatenate([g.first[rules] + g.length[g.words + rules], doc_ends[own]])
    b, i, j, q = _crossing(x, doc, lo, p, hi)
    in_rule = b < len(rules)
    found = [(i[~in_rule], j[~in_rule], q[~in_rule])]
    if in_rule.any():
        rule, start, end, period = rules[b[in_rule]], i[in_rule] - lo[b[in_rule]], j[in_rule] - lo[b[in_rule]], q[in_rule]
        n_own = np.bincount(rule, minlength=len(g.left))
        own_at = np.cumsum(n_own) - n_own
        bears = np.zeros(len(g.length), dtype=bool)  # symbols that derive a rule with runs
        bears[g.words :] = n_own > 0
        for r0, r1 in zip(g.rounds, g.rounds[1:]):
            bears[g.words + r0 : g.words + r1] |= bears[g.left[r0:r1]] | bears[g.right[r0:r1]]
        sym, at = g.symbols[bears[g.symbols]], g.at[bears[g.symbols]]
        while len(sym):
            r = sym - g.words
            k, base = _slices(own_at[r], n_own[r]), np.repeat(at, n_own[r])
            found.append((base + start[k], base + end[k], period[k]))
            sym, at = np.concatenate([g.left[r], g.right[r]]), np.concatenate([at, at + g.length[g.left[r]]])
            sym, at = sym[bears[sym]], at[bears[sym]]
    i, j, q = (np.concatenate([f[c] for f in found]) for c in range(3))
    d = doc[i] if len(i) else i
    order = np.lexsort((-j, i, q, d))
    d, i, j, q = d[order], i[order], j[order], q[order]
    # of one period in one text, only what isn't inside a piece that begins before
    group = np.cumsum(np.concatenate([[True], (d[1:] != d[:-1]) | (q[1:] != q[:-1])])) if len(d) else d
    reach = np.maximum.accumulate(group * (len(x) + 1) + j) if len(d) else d
    whole = np.ones(len(d), dtype=bool)
    whole[1:] = group[1:] * (len(x) + 1) + j[1:] > reach[:-1]
    d, i, j, q = d[whole], i[whole], j[whole], q[whole]
    order = np.lexsort((q, i, d))
    return d[order], i[order] - doc_starts[d[order]], (j - i)[order], q[order]


Arrange = Callable[[object, int], "np.ndarray | None"]


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrange: Arrange | None = None) -> DataFrame:
    """Per row: id, ``runs`` (array of start, length, period by start, then period; words count from 0) and ``collapsed``
    (the words that no run has after its first period, joined by one blank).

    A run is a stretch of at least max(24, 3 q) words with smallest period q that no neighbour extends. ``arrange`` (id,
    number of words) may give the numbers of the words that a text is to have instead of its own. Rows are independent:
    nothing is shuffled; a task holds a text, or texts of WORDS words together. Words are told apart by 64-bit hashes. Null and empty
    texts have no runs and an empty collapsed text; repeated rows give repeated rows; ids may be null and of any type;
    other columns are ignored; an empty table gives an empty one.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def group(keys: pa.Array, texts: list[bytes], orders: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([len(h) for h in hashes])
            _, x = np.unique(np.concatenate(hashes), return_inverse=True)
            d, start, length, period = runs_of(x, ends)
            offsets = np.searchsorted(d, np.arange(len(texts) + 1))
            collapsed = []
            for k, text in enumerate(texts):
                words = text.split()
                if orders[k] is not None:
                    words = [words[w] for w in orders[k].tolist()]
                if offsets[k] < offsets[k + 1]:
                    drop = np.zeros(len(words) + 1, dtype=np.int64)
                    for r in range(offsets[k], offsets[k + 1]):
                        drop[start[r] + period[r]] += 1
                        drop[start[r] + length[r]] -= 1
                    words = [words[w] for w in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(words))
            runs = pa.StructArray.from_arrays([pa.array(z, pa.int64()) for z in (start, length, period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs).cast(run_type)
            return pa.RecordBatch.from_arrays([keys, lists, pa.array(collapsed, pa.binary()).cast(pa.string())], [id_col, "runs", "collapsed"])

        for batch in batches:
            ids = batch.column(0).to_pylist() if arrange else None
            texts, orders, hashes, size, first = [], [], [], 0, 0
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                b = np.frombuffer(text, dtype=np.uint8)
                starts, ends = word_spans(b, BETWEEN_SPACES)
                h = span_hashes(b, starts, ends)
                order = arrange(ids[k], len(h)) if arrange else None
                if texts and size + len(h) > WORDS:
                    yield group(batch.column(0).slice(first, len(texts)), texts, orders, hashes)
                    texts, orders, hashes, size, first = [], [], [], 0, k
                texts.append(text)
                orders.append(order)
                hashes.append(h if order is None else h[order])
                size += len(h)
            if texts:
                yield group(batch.column(0).slice(first, len(texts)), texts, orders, hashes)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(find, f"`{id_col}` {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def folded(key: object, n: int) -> np.ndarray | None:
    """Word numbers by which one text in ten (by its id's checksum) repeats a stretch of its words to its end."""
    import zlib

    h = zlib.crc32(b"" if key is None else str(key).encode())
    if h % 10 or not n or key is None:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_runs, the run of the greatest length / period (start, length, period, exponent_milli) and the
    checksums of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    # exact: fractions are compared by products; of equal ones the first stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    rows = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        id_col, "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
