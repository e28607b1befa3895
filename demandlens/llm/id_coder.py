"""Adaptive context-mixing range coder for token ids below 65,536, in blocks that are reset one by one.

The probability of the next id is a mixture of four predictions. The id that last followed the two previous ids (order 2)
and the one that last followed the previous id (order 1) get the weights that predictions of their confidence have earned
so far in the block; the rest goes to the counts of the block's ids (order 0), of which a share goes to ids that the block
hasn't had, all alike. One arithmetic coding step of 44 bits codes an id. The contexts learn what has been
coded at every 128th position, the counts at positions 128, 256, 512, ...; in between the model stays as it is, so that an encoder looks
it up for many positions at once.

All blocks of a call are coded in lockstep, position by position, with numpy over the blocks; nothing passes from one
block to another, so each can be decoded alone, and the bytes of a block don't depend on the others.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
MIX, FREQ, IDS = 14, 14, 16  # bits of the mixture's weights, of the counts' shares and of an id
ALL = 1 << FREQ
FIRST = 128  # the counts learn at positions FIRST, 2 FIRST, 4 FIRST, ...
CONTEXTS1, CONTEXTS2 = 12, 13  # bits of the hashed contexts
RENEW = U(1 << 48)  # a smaller range takes in a word of 16 bits
_LEAST = 1 << 6  # least share of unseen ids
PART = 128  # positions after which the contexts learn


def updates(length: int) -> list[int]:
    """Where the counts learn, and the end."""
    out = [0]
    while (at := FIRST if len(out) == 1 else out[-1] * 2) < length:
        out.append(at)
    return [*out, length]


def shares(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the ids so far: each one once, and where its share of 2**14 begins; the last number begins the unseen ids' share,
    which estimates by the ids met once how likely a new one is."""
    if not len(seen):
        return seen, np.zeros(1, dtype=np.int64)
    ordered = np.sort(seen, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(at, append=len(ordered))
    once = int(np.count_nonzero(counts == 1))
    new = min(max(_LEAST, ALL * (once + 1) // (len(seen) + 2)), ALL // 2)
    rest = max(0, ALL - len(at) - new)
    begins = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(1 + counts * rest // len(seen), out=begins[1:])
    return ordered[at], begins


class Contexts:
    """What the first two orders predict, with weights by their confidences; one of each for every block.

    An entry is 0 or an id + 1, plus 2**17 if the prediction before it was right.
    """

    def __init__(self, blocks: int):
        self.one = np.zeros(blocks << CONTEXTS1, dtype=np.int32)
        self.two = np.zeros(blocks << CONTEXTS2, dtype=np.int32)
        self.right2, self.right1, self.tried = (np.zeros(blocks * 9, dtype=np.int64) for _ in range(3))
        self.lane9 = np.arange(blocks, dtype=np.int64) * 9
        self.lane1, self.lane2 = np.arange(blocks, dtype=np.int64) << CONTEXTS1, np.arange(blocks, dtype=np.int64) << CONTEXTS2
        self.weigh()

    def weigh(self) -> None:
        of = 2 * self.tried + 4
        self.w2 = 16 + (2 * self.right2 + 1) * (ALL - 2048) // of
        self.w1 = 16 + (2 * self.right1 + 1) * (ALL - 2048) // of
        self.both = self.w2 + self.w1

    def places(self, prev: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the previous id and the one before it (the last axis goes over the blocks): where the entries stand."""
        n = prev.shape[-1]
        h = prev * 0x9E3B
        return self.lane1[:n] + (h >> 4 & ((1 << CONTEXTS1) - 1)), self.lane2[:n] + (h + before * 0x6A7F1 >> 5 & ((1 << CONTEXTS2) - 1))

    def predict(self, at1: np.ndarray, at2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids + 1 by order 2 and order 1 (0 for none), and the place of their weights."""
        e1, e2 = self.one.take(at1), self.two.take(at2)
        p1, p2 = e1 & 0x1FFFF, e2 & 0x1FFFF
        p1 = p1 * (p1 != p2)  # said already
        c1, c2 = (p1 > 0) * (1 + (e1 >> 17)), (e2 > 0) + (e2 >> 17)
        return p2, p1, self.lane9[: at1.shape[-1]] + (3 * c2 + c1)

    def learn(self, ids: np.ndarray, at1: np.ndarray, at2: np.ndarray, p2: np.ndarray, p1: np.ndarray, ctx: np.ndarray, alive: np.ndarray) -> None:
        """Takes in coded ids, positions by blocks; the last one of a context stays. alive: which of them there are."""
        for count, which in ((self.right2, (p2 == ids + 1) & alive), (self.right1, (p1 == ids + 1) & alive), (self.tried, alive)):
            count += np.bincount(ctx[which], minlength=len(count))
        for table, at in ((self.one, at1[alive]), (self.two, at2[alive])):
            own = ids[alive].astype(np.int32) + 1
            table[at] = own | ((table[at] & 0x1FFFF) == own).astype(np.int32) << 17
        self.weigh()


def _history(ids: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The previous ids of those at positions start to end, and the ones before them; 0 where a block begins."""
    padded = np.concatenate([np.zeros((max(0, 2 - start), ids.shape[1]), dtype=ids.dtype), ids[max(0, start - 2) : end]])
    return padded[1:-1].astype(np.int64), padded[:-2].astype(np.int64)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Of blocks of ids (uint16), longest first: the coded bytes of each."""
    n = len(blocks)
    if not n:
        return []
    sizes = np.array([len(b) for b in blocks])
    length = int(sizes[0])
    ids = np.zeros((length, n), dtype=np.uint16)
    for i, b in enumerate(blocks):
        ids[: len(b), i] = b
    out = np.zeros((n, 3 * length + 8), dtype=np.uint16)
    flat, pos = out.reshape(-1), np.arange(n, dtype=np.int64) * out.shape[1]
    low, rng = np.zeros(n, dtype=U), np.full(n, (1 << 64) - 1, dtype=U)
    model = Contexts(n)
    begin_of, width_of = np.zeros(1 << IDS, dtype=np.int64), np.zeros(1 << IDS, dtype=np.int64)
    steps = updates(length)
    for start, end in zip(steps, steps[1:]):
        begin, width = np.zeros((n, end - start), dtype=np.int32), np.ones((n, end - start), dtype=np.int32)
        for i in range(n):
            part = blocks[i][start:end]
            if not len(part):
                break
            known, begins = shares(blocks[i][:start])
            begin_of[known], width_of[known] = begins[:-1] << IDS, np.diff(begins) << IDS
            b, w = begin_of.take(part), width_of.take(part)
            new = np.flatnonzero(w == 0)
            # an unseen id: its place of 2**16 in the last share
            b[new], w[new] = (begins[-1] << IDS) + (ALL - begins[-1]) * part[new].astype(np.int64), ALL - begins[-1]
            begin[i, : len(part)], width[i, : len(part)] = b, w
            width_of[known] = 0
        for first in range(start, end, PART):
            last = min(end, first + PART)
            live = int(np.count_nonzero(sizes > first))
            own = ids[first:last, :live].astype(np.int64)
            places = model.places(*_history(ids[:, :live], first, last))
            p2, p1, ctx = model.predict(*places)
            hit2, hit1 = p2 == own + 1, p1 == own + 1
            w2, w1, both = model.w2.take(ctx), model.w1.take(ctx), model.both.take(ctx)
            rest = ALL - both
            lows = (both << (FREQ + IDS)) + rest * begin[:live, first - start : last - start].T
            widths = rest * width[:live, first - start : last - start].T
            lows[hit1], widths[hit1] = w2[hit1] << (FREQ + IDS), w1[hit1] << (FREQ + IDS)
            lows[hit2], widths[hit2] = 0, w2[hit2] << (FREQ + IDS)
            lows, widths = lows.view(U), widths.view(U)
            if last < length:
                model.learn(own, *places, p2, p1, ctx, np.arange(first, last)[:, None] < sizes[:live])
            for t in range(first, last):
                a = live if t < sizes[live - 1] else int(np.count_nonzero(sizes > t))
                lo, rg, at = low[:a], rng[:a], pos[:a]
                r = rg >> U(MIX + FREQ + IDS)
                add = r * lows[t - first, :a]
                lo += add
                np.multiply(r, widths[t - first, :a], out=rg)
                over = lo < add
                if over.any():
                    back = at[over] - 1  # a carry into the words already written
                    while len(back):
                        flat[back] += np.uint16(1)
                        back = back[flat[back] == 0] - 1
                small = rg < RENEW
                while small.any():
                    flat[at] = lo >> U(48)
                    shift = small.astype(U) << U(4)
                    lo <<= shift
                    rg <<= shift
                    at += small
                    small = rg < RENEW
    for k in (48, 32, 16, 0):
        flat[pos] = (low >> U(k)) & U(0xFFFF)
        pos += 1
    begins = np.arange(n) * out.shape[1]
    return [flat[a:b].astype("<u2").tobytes() for a, b in zip(begins.tolist(), pos.tolist())]


def decode_blocks(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each block (uint16) from its bytes and number of ids, longest first."""
    n = len(coded)
    if not n:
        return []
    length, counts = sizes[0], np.array(sizes)
    ends = np.cumsum([0, *(len(c) // 2 + 4 for c in coded)])
    words = np.zeros(int(ends[-1]), dtype=U)
    for c, at in zip(coded, ends.tolist()):
        words[at : at + len(c) // 2] = np.frombuffer(c, dtype="<u2")
    pos = ends[:-1].copy()
    code = np.zeros(n, dtype=U)
    for _ in range(4):
        code = code << U(16) | words[pos]
        pos += 1
    rng = np.full(n, (1 << 64) - 1, dtype=U)
    out = np.zeros((length, n), dtype=np.uint16)
    model, a = Contexts(n), n
    prev, before = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    own_slots = np.arange(n) * ALL
    steps = updates(length)
    for start, end in zip(steps, steps[1:]):
        wide = max(1, start) + 2
        slot = np.zeros((n, ALL), dtype=np.uint16)
        begins, known = np.zeros((n, wide), dtype=np.int64), np.full((n, wide), -1, dtype=np.int64)
        for i in range(n):
            if sizes[i] <= start:
                break
            ids, b = shares(out[:start, i])
            begins[i, : len(b)], begins[i, len(b)] = b, ALL
            known[i, : len(ids)] = ids
            slot[i] = np.repeat(np.arange(len(b), dtype=np.uint16), np.diff(b, append=ALL))
        slot, begins, known, own_wide = slot.reshape(-1), begins.reshape(-1), known.reshape(-1), np.arange(n) * wide
        for t in range(start, end):
            if t >= sizes[a - 1]:
                a = int(np.count_nonzero(counts > t))
                prev, before = prev[:a], before[:a]
            cd, rg, at = code[:a], rng[:a], pos[:a]
            p2, p1, ctx = model.predict(*model.places(prev, before))
            w2, both = model.w2.take(ctx), model.both.take(ctx)
            r = rg >> U(MIX + FREQ + IDS)
            target = (cd // r).view(np.int64)
            weight = target >> (FREQ + IDS)
            rest = ALL - both
            hit = weight < both
            inner = (target - (both << (FREQ + IDS))) // rest  # of 2**30; negative where a context predicts the id
            k = own_wide[:a] + slot.take(own_slots[:a] + (inner >> IDS), mode="clip")
            begin = begins.take(k)
            width = begins.take(k + 1) - begin
            ids = known.take(k)
            new = (ids < 0).nonzero()[0]
            lo = begin << IDS
            size = width << IDS
            if len(new):
                fresh = (inner[new] - lo[new]) // np.maximum(1, width[new])
                ids[new] = fresh
                lo[new] += width[new] * fresh
                size[new] = width[new]
            lo = (both << (FREQ + IDS)) + rest * lo
            size *= rest
            if len(hits := hit.nonzero()[0]):
                two = weight[hits] < w2[hits]
                ids[hits] = np.where(two, p2[hits], p1[hits]) - 1
                lo[hits] = np.where(two, 0, w2[hits]) << (FREQ + IDS)
                size[hits] = np.where(two, w2[hits], both[hits] - w2[hits]) << (FREQ + IDS)
            cd -= r * lo.view(U)
            np.multiply(r, size.view(U), out=rg)
            small = rg < RENEW
            while small.any():
                shift = small.astype(U) << U(4)
                cd <<= shift
                cd |= words.take(at) * small
                rg <<= shift
                at += small
                small = rg < RENEW
            out[t, :a] = ids
            prev, before = ids, prev
            if (done := t + 1) % PART == 0 and done < length:
                live = int(np.count_nonzero(counts > done - PART))
                places = model.places(*_history(out[:, :live], done - PART, done))
                model.learn(out[done - PART : done, :live].astype(np.int64), *places, *model.predict(*places), np.arange(done - PART, done)[:, None] < counts[:live])
    return [np.ascontiguousarray(out[:s, i]) for i, s in enumerate(sizes)]
