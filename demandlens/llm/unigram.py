"""Unigram segmentation with the pieces of a SentencePiece file.

The pieces stand in a double-array trie over characters. A model of kind BPE has merge ranks where a unigram model has
log scores; for such a file ``scores="zipf"`` (the default) gives piece number r of the ranking the log probability that
Zipf's law gives rank r. Nothing is trained.

A character without a piece costs ``unk_penalty`` more than the rarest piece and is spelled with byte pieces. Of equally
good segmentations, the one whose last differing piece is longer wins, as in the library.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

MARK = "▁"


class DoubleArray:
    """Trie of strings: child of state s by character code c is base[s] + c, if check there is s."""

    def __init__(self, entries: dict[str, int]):
        self.codes: dict[str, int] = {}
        for c, _ in Counter(c for key in entries for c in key).most_common():
            self.codes[c] = len(self.codes) + 1
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in entries.items():
            at = 0
            for c in key:
                code = self.codes[c]
                if code not in tree[at]:
                    tree[at][code] = len(tree)
                    tree.append({})
                at = tree[at][code]
            ends[at] = value
        size = 2 * (len(tree) + len(self.codes)) + 2
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        free = list(range(size))  # of each slot, a slot from there on that may be the next free one

        def next_free(slot: int) -> int:
            while slot < len(free) and free[slot] != slot:
                if free[slot] < len(free):
                    free[slot] = free[free[slot]]
                slot = free[slot]
            return slot

        free[0] = 1
        wide, todo = 1, [(0, 0)]
        for node, state in todo:
            kids = tree[node]
            self.value[state] = ends.get(node, -1)
            if not kids:
                continue
            first, last = min(kids), max(kids)
            slot, tries = max(1 if len(kids) == 1 else wide, first + 1), 0
            while True:
                slot = next_free(slot)
                b = slot - first
                if (more := b + last + 1 - len(free)) > 0:
                    free += range(len(free), len(free) + more)
                    self.base += [0] * more
                    self.check += [-1] * more
                    self.value += [-1] * more
                if all(self.check[b + c] < 0 for c in kids):
                    break
                slot, tries = slot + 1, tries + 1
            if tries > 32:  # the next ones start where a place was found
                wide = slot
            self.base[state] = b
            for c, child in kids.items():
                self.check[b + c] = state
                free[b + c] = b + c + 1
                todo.append((child, b + c))
        # a missing child of a late state must not look past the end
        pad = len(self.codes) + 1
        self.base += [0] * pad
        self.check += [-1] * pad
        self.value += [-1] * pad


class UnigramModel:
    """Pieces with log scores, byte pieces and the trie; made on the driver and sent to the tasks."""

    def __init__(self, path: str, scores: str = "zipf", unk_penalty: float = 10.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.key = f"{path}:{scores}:{unk_penalty}"
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        normal = []
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(self.text[i][3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
        harmonic = math.log(len(normal)) + 0.5772156649
        law = {i: -math.log(r) - math.log(harmonic) for r, i in enumerate(normal, 1)}
        self.score = [0.0] * n
        for i in normal:
            self.score[i] = law[i] if scores == "zipf" else sp.get_score(i)
        self.unk_score = min(self.score[i] for i in normal) - unk_penalty
        self.max_len = max(len(self.text[i]) for i in normal)
        self.ids = {self.text[i]: i for i in normal}
        self.trie = DoubleArray(self.ids)
        self.bytes = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        #: No piece goes on over the start of a word, so the best segmentation of a text is that of its words.
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", t) for t in self.ids)

    def chunks(self, text: str) -> list[str]:
        """The marked text in parts that can be segmented apart: white-space markers, then what follows them."""
        marked = (MARK + text).replace(" ", MARK)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) if self.splits else [marked]

    def segment(self, s: str) -> list[int]:
        """Viterbi over the trie: ids of the best pieces, unknown characters as bytes."""
        trie, score, n = self.trie, self.score, len(s)
        base, check, value, codes = trie.base, trie.check, trie.value, trie.codes
        row = [codes.get(c, 0) for c in s]
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            state, single, here = 0, False, best[i]
            for j in range(i, n):
                code = row[j]
                if not code:
                    break
                to = base[state] + code
                if check[to] != state:
                    break
                state = to
                if (v := value[state]) >= 0:
                    single |= j == i
                    if (x := here + score[v]) > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = x, i, v
            if not single and (x := here + self.unk_score) > best[i + 1]:
                best[i + 1], back[i + 1], piece[i + 1] = x, i, -1
        out, at = [], n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out += [self.byte_ids[b] for b in reversed(s[back[at] : at].encode())]
            at = back[at]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, markers as spaces, without the space that encoding puts before a text."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


class Packed(dict):
    """Ids of a chunk as packed 32-bit numbers, kept per worker; at most ``limit`` chunks of at most 48 characters."""

    def __init__(self, model: UnigramModel, limit: int = 400_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, chunk: str) -> bytes:
        ids = array("i", self.model.segment(chunk)).tobytes()
        if len(chunk) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids


class ForwardTrie:
    """Pre-tokens in a trie whose nodes hold the forward score and token count of the prefix that they stand for.

    A prefix is scored once, when its node is made, however many pre-tokens share it. ``counts`` has the terminal count
    of each pre-token seen. Both are emptied beyond their limits: counting starts anew, with equal results. Only the first
    ``depth`` characters of a pre-token stand in the trie; what follows goes through the same recurrence in a window of
    as many scores as the longest piece has characters, so that a pre-token of any length takes bounded memory.
    """

    def __init__(self, model: UnigramModel, nodes: int = 300_000, words: int = 600_000, depth: int = 64):
        self.model, self.nodes, self.words, self.depth = model, nodes, words, max(depth, model.max_len)
        self.counts: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.kids: list[dict[str, int]] = [{}]
        self.best, self.tokens = [0.0], [0]

    def insert(self, word: str) -> int:
        model, kids, best, tokens = self.model, self.kids, self.best, self.tokens
        ids, score, longest = model.ids, model.score, model.max_len
        path = [0]
        for d, c in enumerate(word[: self.depth], 1):
            at = path[-1]
            node = kids[at].get(c)
            if node is None:
                top, count = -math.inf, 0
                for start in range(max(0, d - longest), d):
                    i = ids.get(word[start:d])
                    if i is not None and (x := best[path[start]] + score[i]) > top:
                        top, count = x, tokens[path[start]] + 1
                if c not in ids and (x := best[at] + model.unk_score) > top:
                    top, count = x, tokens[at] + len(c.encode())
                node = kids[at][c] = len(kids)
                kids.append({})
                best.append(top)
                tokens.append(count)
            path.append(node)
        if len(word) <= self.depth:
            return tokens[path[-1]]
        last = [(best[x], tokens[x]) for x in path[-longest:]]
        for d in range(self.depth + 1, len(word) + 1):
            top, count = -math.inf, 0
            for back in range(longest, 0, -1):
                i = ids.get(word[d - back : d])
                if i is not None and (x := last[-back][0] + score[i]) > top:
                    top, count = x, last[-back][1] + 1
            c = word[d - 1]
            if c not in ids and (x := last[-1][0] + model.unk_score) > top:
                top, count = x, last[-1][1] + len(c.encode())
            last = [*last[1:], (top, count)]
        return last[-1][1]

    def add(self, words: set[str]) -> None:
        """Inserts what isn't counted yet."""
        if len(self.counts) + len(words) > self.words:
            self.counts = {}
        for word in words.difference(self.counts):
            if len(self.kids) > self.nodes:
                self.clear()
            self.counts[word] = self.insert(word)

    def count(self, words: list[str]) -> int:
        """Tokens of all these words; those longer than the trie is deep are counted but not kept."""
        short = [w for w in words if len(w) <= self.depth]
        self.add(set(short))
        total = sum(map(self.counts.__getitem__, short))
        for word in words if len(short) < len(words) else ():
            if len(word) > self.depth:
                if len(self.kids) > self.nodes:
                    self.clear()
                total += self.insert(word)
        return total


_KEPT: dict = {}


def kept(kind: type, model: UnigramModel):
    """One table of each kind a worker, for the model it used last."""
    found = _KEPT.get(kind)
    if found is None or found.model.key != model.key:
        found = _KEPT[kind] = kind(model)
    return found
