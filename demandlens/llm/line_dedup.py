"""Line dedup by a segment-partition edit join, by characters for all lines and by words too for long ones (operator 9)."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .components import connected_components
from .ngram_join import Seen
from .scratch import Scratch
from .similarity import DIMENSIONS, Bound, KeyFilter, Pairwise, linked, shared_cells
from .words import U, mix, span_hashes

#: Characters of text that are hashed at once.
CHUNK = 1_000_000


@dataclass(frozen=True)
class LineConfig:
    """Two lines are near if they are within a few edits of characters, or, if both have ``long_words`` words, of words. The
    shorter of the two says how many."""

    max_edits: int = 2  # insertions, deletions and replacements of code points, from full_chars characters on
    full_chars: int = 24  # shorter lines may have one edit less
    near_chars: int = 8  # and still shorter ones none: they are equal or not
    min_chars: int = 1  # lines with a word and this many characters are compared
    #: From so many words on, lines may have edits of words: max_edits, and one more each time the words are four times as many.
    long_words: int = 25

    def word_edits(self, words: np.ndarray) -> np.ndarray:
        """Edits that lines of so many words may differ by (the shorter one counts); -1 for lines that aren't long."""
        times = words // self.long_words
        return np.where(times > 0, self.max_edits + np.floor(np.log2(np.maximum(times, 1))).astype(np.int64) // 2, -1)

    def char_edits(self, chars: np.ndarray) -> np.ndarray:
        return np.where(chars >= self.full_chars, self.max_edits, np.where(chars >= self.near_chars, self.max_edits - 1, -1))

    @property
    def both_words(self) -> int:
        """Lines with fewer words can be near one that isn't long: an edit of a character makes at most one word more or less."""
        return self.long_words + self.max_edits


_ASCII_WORDS = bytes(c < 128 and chr(c).isalnum() for c in range(256))
_WORDS: list[np.ndarray] = []


def _word_characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it belongs to a word, and whether it is a word of its own (scripts without spaces)."""
    if not _WORDS:
        own = np.zeros(sys.maxunicode + 1, dtype=bool)
        for low, high in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
            own[low : high + 1] = True
        word = np.array([chr(c).isalnum() for c in range(sys.maxunicode + 1)])
        _WORDS.extend((word, own & word))
    return _WORDS[0], _WORDS[1]


def _powers(n: int, kept: list[tuple[np.ndarray, np.ndarray]] = []) -> tuple[np.ndarray, np.ndarray]:
    """Of an odd number and of its inverse, at least the first n; those of the longest run so far are kept, if it isn't very long."""
    if kept and len(kept[0][0]) >= n:
        return kept[0]
    root = 0x9E3779B97F4A7C15
    up, down = np.full(n + n // 8, root, dtype=U), np.full(n + n // 8, pow(root, -1, 1 << 64), dtype=U)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    if n <= 4 * CHUNK:
        kept[:] = [(up, down)]
    return up, down


def _stirred(values: np.ndarray) -> np.ndarray:
    return mix(values * U(0xD1B54A32D192ED03) + U(1))


_STIRRED: list[np.ndarray] = []


def _stirred_codes(codes: np.ndarray) -> np.ndarray:
    """Of code points, from a table."""
    if not _STIRRED:
        _STIRRED.append(_stirred(np.arange(sys.maxunicode + 1, dtype=U)))
    return _STIRRED[0][codes]


class Run:
    """A sequence of 64-bit values (or 32-bit code points) and the hashes of its parts."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = _powers(n + 1)
        self.total = np.zeros(n + 1, dtype=U)
        np.cumsum((_stirred_codes(values) if values.dtype == np.uint32 else _stirred(values)) * up[:n], out=self.total[1:])

    def hashes(self, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For candidates only: equal parts have equal hashes, but sequences can be made whose unequal parts do too."""
        return mix((self.total[starts + size] - self.total[starts]) * self.down[starts] + size.astype(U))


class Lines:
    """Lines of some texts: offsets and lengths in code points, bytes and words, and the keys that they are told apart by."""

    def __init__(self, texts: list[str]):
        self.text = "\n".join(texts)
        self.raw = np.frombuffer(self.text.encode("utf-8", "replace"), dtype=np.uint8)
        self.raw_starts, self.raw_size = self._parts(self.raw)

    @cached_property
    def codes(self) -> np.ndarray:
        return np.frombuffer(self.text.encode("utf-32-le", "replace"), dtype=np.uint32)

    @cached_property
    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        return self._parts(self.codes)

    @property
    def starts(self) -> np.ndarray:
        return self._places[0]

    @property
    def size(self) -> np.ndarray:
        return self._places[1]

    @staticmethod
    def _parts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.append(np.flatnonzero(c == 10), len(c))
        starts = np.append(0, ends[:-1] + 1)
        return starts, ends - starts

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Even numbers; the odd one that follows stands for the same line among the long ones."""
        return span_hashes(self.raw, self.raw_starts[rows], self.raw_starts[rows] + self.raw_size[rows]).view(np.int64) & ~np.int64(1)

    def compared(self, cfg: LineConfig) -> np.ndarray:
        """Numbers of the lines that hold a word and enough characters."""
        at = np.flatnonzero(self.raw_size)
        if not len(at):
            return at
        # most lines have a letter or digit of ASCII; of the others each is looked at
        word = np.maximum.reduceat(np.frombuffer(self.raw.tobytes().translate(_ASCII_WORDS), dtype=bool), self.raw_starts[at])
        for i in np.flatnonzero(~word).tolist():
            s = self.raw_starts[at[i]]
            word[i] = any(map(str.isalnum, self.raw[s : s + self.raw_size[at[i]]].tobytes().decode()))
        at = at[word]
        return at[self.size[at] >= cfg.min_chars] if cfg.min_chars > 1 else at

    @cached_property
    def word_places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end."""
        word, single = (x[self.codes] for x in _word_characters())
        before = np.append(False, word[:-1])
        start = word & (~before | single | np.append(False, single[:-1]))
        return np.flatnonzero(start), np.flatnonzero(word & np.append(start[1:] | ~word[1:], True)) + 1

    @cached_property
    def words(self) -> np.ndarray:
        """Hashes of all words in order."""
        starts, ends = self.word_places
        return span_hashes(self.codes.view(np.uint8), 4 * starts, 4 * ends)

    @cached_property
    def first_word(self) -> np.ndarray:
        return np.searchsorted(self.word_places[0], self.starts)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.searchsorted(self.word_places[0], self.starts + self.size) - self.first_word

    def near_rows(self, cfg: LineConfig) -> np.ndarray:
        """Numbers of the lines that may have near copies."""
        return np.flatnonzero((self.size >= cfg.near_chars) | (self.n_words >= cfg.long_words))


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], Lines]]:
    """First columns and texts (second ones) of rows of about CHUNK characters, with their lines; null texts are left out."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, t in zip(batch.column(0), batch.column(1)):
            if t.is_valid:
                keys.append(key.as_py())
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= CHUNK:
                    yield keys, texts, Lines(texts)
                    keys, texts, size = [], [], 0
    if keys:
        yield keys, texts, Lines(texts)


def segments(size: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Offsets and lengths of the even segments of lines of these sizes; the last ones are one longer where needed."""
    short, more = size // parts, size % parts
    out, at = [], np.zeros_like(size)
    for i in range(parts):
        own = short + (i >= parts - more)
        out.append((at, own))
        at = at + own
    return out


def cells(run: Run, start: np.ndarray, size: np.ndarray, edits: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number, cell) of the sequences of a run that begin at ``start`` and have ``size`` values. A cell is a length, a
    segment number and the segment's values.

    A sequence of length n that may have e = edits(n) is cut into e + 1 segments, of which e edits can't touch all: a similar
    one that is no shorter has one of them as a part, near its place. So each sequence looks up, for each length that is
    shorter by no more than that length's edits, the parts in whose place that segment can stand (the window that counts
    the edits before and after it). With the same length and no shift that is the sequence's own segment, so the cells are
    both index and probes.
    """
    for less in range(int(edits(size).max(initial=-1)) + 1):
        allowed = edits(size - less)
        for most in np.unique(allowed[allowed >= less]).tolist():
            at_all = np.flatnonzero(allowed == most)
            first, n = start[at_all], size[at_all]
            for i, (at, own) in enumerate(segments(n - less, most + 1)):
                left, right = i, most - i
                for shift in range(max(-left, less - right), min(left, less + right) + 1):
                    where = at + shift
                    ok = (where >= 0) & (where + own <= n) & (own > 0)
                    if ok.any():
                        yield at_all[ok], mix(run.hashes(first[ok] + where[ok], own[ok]) ^ mix((n[ok] - less).astype(U) * U(64) + U(i)))


def within(a: str | list[int], b: str | list[int], edits: int) -> bool:
    """Whether the edit distance of two texts, or of two lists of words, is at most ``edits``.

    Common ends are cut off. Of the dynamic program's columns (one for each character of the shorter one) only the rows
    within ``edits`` of the diagonal are kept, as bit vectors of 2 * edits + 1 differences; the window moves down a row
    with each column. The distance is followed along the window's lowest diagonal to the last row, then along that.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    low, high = 0, len(b)
    while low < high:  # longest common start
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(b)
    while low < high:  # longest common end
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if len(a) <= edits:
        return True
    width = 2 * edits + 1
    full = (1 << width) - 1
    up, down, distance = (full << edits) & full, 0, edits  # vertical steps of +1 and -1
    turn = len(a) - edits  # from this column on the last row is in the window
    #: By character: the rows of the window where it stands, as bits from the row that the window began with at the time.
    places: dict[str | int, tuple[int, int]] = {}
    for i, c in enumerate(a[:edits]):
        places[c] = (-edits, places.get(c, (0, 0))[1] | 1 << (i + edits))
    for j, c in enumerate(b):
        low = j - edits  # the window's first row
        if j + edits < len(a):  # its last one is new
            begin, rows = places.get(x := a[j + edits], (low, 0))
            places[x] = (low, rows >> (low - begin) | 1 << (2 * edits))
        begin, rows = places.get(c, (low, 0))
        same = rows >> (low - begin)
        flat = (((((same & up) + up) & full) ^ up) | same | down) & full  # diagonal steps of 0
        right_up, right_down = down | (full ^ (flat | up)), flat & up  # horizontal steps
        if j < turn:
            distance += not flat >> (width - 1)
        else:
            row = len(a) - j - 1 + edits
            distance += ((right_up >> row) & 1) - ((right_down >> row) & 1)
        if distance > edits + max(0, len(b) - j - 1) and j >= turn:
            return False
        flat >>= 1
        up, down = right_down | (full ^ (flat | right_up)), flat & right_up
    return distance <= edits


def line_rows(docs: DataFrame, cfg: LineConfig, id_col: str, text_col: str) -> DataFrame:
    """doc (id, document key), line_no and key of the lines that are compared."""
    own = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("doc_id"), "doc_key").alias("doc")
    chosen = docs.select(own, text_col)
    kind = chosen.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, lines in chunked(batches):
            first = np.cumsum([0] + [t.count("\n") + 1 for t in texts])
            doc = np.repeat(np.arange(len(texts)), np.diff(first))
            at = lines.compared(cfg)
            own = pa.array(keys, to_arrow_type(kind)).take(pa.array(doc[at]))
            yield pa.RecordBatch.from_arrays([own, pa.array((at - first[doc[at]]).astype(np.int32)), pa.array(lines.keys(at))], ["doc", "line_no", "key"])

    return chosen.mapInArrow(run, T.StructType([T.StructField("doc", kind), T.StructField("line_no", T.IntegerType()), T.StructField("key", T.LongType())]))


def _line_cells(docs: DataFrame, cfg: LineConfig, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for _, _, lines in chunked(batches):
            at = lines.near_rows(cfg)
            keys = lines.keys(at)
            new = np.array([seen.first(k) for k in keys.tolist()], dtype=bool)
            if not new.any():
                continue
            at, keys = at[new], keys[new]
            n, size = lines.n_words[at], lines.size[at]
            short, long = (size >= cfg.near_chars) & (n < cfg.both_words), n >= cfg.long_words
            sigs, owners = [], []
            codes = Run(lines.codes)
            word_starts, word_ends = lines.word_places
            for salt, own, kind, run_, first, length, edits in (
                (0, short, 0, codes, lines.starts, lines.size, cfg.char_edits),
                (0x6C62272E07BB0142, long & (size >= cfg.near_chars), 1, codes, lines.starts, lines.size, cfg.char_edits),
                (0xA24BAED4963EE407, long, 1, Run(codes.hashes(word_starts, word_ends - word_starts)) if long.any() else None, lines.first_word, lines.n_words, cfg.word_edits),
            ):
                rows, key = at[own], keys[own] | kind
                for i, cell in cells(run_, first[rows], length[rows], edits) if len(rows) else ():
                    sigs.append(cell ^ U(salt))
                    owners.append(key[i])
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], ["sig", "key"])

    return shared_cells(docs.select("doc_key", text_col), run)


def _describe(docs: DataFrame, cfg: LineConfig, text_col: str, wanted: KeyFilter) -> DataFrame:
    """Of wanted lines: length, twice the edits that they may have, characters or words counted in groups, and these themselves.

    A line among the short ones counts characters. One among the long ones counts words, of which an edit of a character
    takes or adds three at most (two become one); its words' hashes come before its text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for _, _, lines in chunked(batches):
            # most lines aren't wanted: only those that may be are looked at closely. A character has a byte, a word has a character
            at = np.flatnonzero(lines.raw_size >= min(cfg.near_chars, cfg.long_words))
            keys = lines.keys(at)
            at = at[shared.value.has(keys) | shared.value.has(keys | 1)]
            if not len(at):
                continue
            lines = Lines([lines.raw[s : s + n].tobytes().decode() for s, n in zip(lines.raw_starts[at].tolist(), lines.raw_size[at].tolist())])
            at = lines.near_rows(cfg)
            keys = lines.keys(at)
            rows = []
            for kind in (0, 1):
                words = lines.n_words[at]
                ok = shared.value.has(keys | kind) & (words >= cfg.long_words if kind else (words < cfg.both_words) & (lines.size[at] >= cfg.near_chars))
                for i, key in zip(at[ok].tolist(), (keys[ok] | kind).tolist()):
                    if seen.first(key):
                        s, n = int(lines.starts[i]), int(lines.size[i])
                        text, slack = lines.text[s : s + n].encode("utf-8", "replace"), 2 * int(cfg.char_edits(lines.size[i : i + 1])[0])
                        if kind:
                            n = int(lines.n_words[i])
                            w = lines.words[lines.first_word[i] : lines.first_word[i] + n]
                            own, group = b"w" + np.uint32(n).tobytes() + w.tobytes() + text, (w & U(DIMENSIONS - 1)).astype(np.int64)
                            slack = max(2 * int(cfg.word_edits(np.array([n]))[0]), 3 * cfg.max_edits)
                        else:
                            own, group = b"c" + text, lines.codes[s : s + n] & (DIMENSIONS - 1)
                        rows.append((key, n, slack, np.bincount(group, minlength=DIMENSIONS).tolist(), own))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()))], ["key", "n", "slack", "vec", "payload"])

    return docs.select("doc_key", text_col).mapInArrow(run, "key long, n long, slack long, vec array<int>, payload binary")


class WithinEdits(Pairwise):
    def __init__(self, cfg: LineConfig):
        self.cfg = cfg

    def near(self, a: str, b: str) -> bool:
        edits = int(self.cfg.char_edits(np.array([min(len(a), len(b))]))[0])
        return edits >= 0 and within(a, b, edits)

    def __call__(self, x: bytes, y: bytes) -> bool:
        if x[:1] != y[:1]:
            return False
        if x[:1] == b"c":
            return self.near(x[1:].decode(), y[1:].decode())
        n, m = (int(np.frombuffer(z, dtype=np.uint32, count=1, offset=1)[0]) for z in (x, y))
        a, b = (np.frombuffer(z, dtype=U, count=k, offset=5).tolist() for z, k in ((x, n), (y, m)))
        if within(a, b, int(self.cfg.word_edits(np.array([min(n, m)]))[0])):
            return True
        return self.near(x[5 + 8 * n :].decode(), y[5 + 8 * m :].decode())


def _of_lines(found: DataFrame, scratch: Scratch) -> DataFrame:
    """key and comp of lines, from components in which a line may stand twice (see Lines.keys)."""
    lines = found.select(F.expr("key & -2L").alias("key"), "comp")
    twice = scratch.save(lines.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b"), "twice")
    if twice.isEmpty():
        return lines.dropDuplicates(["key"])
    joined = connected_components(twice.select("a", "b"), scratch).select(F.col("key").alias("comp"), F.col("comp").alias("whole"))
    return lines.join(joined, "comp", "left").select("key", F.coalesce("whole", "comp").alias("comp")).dropDuplicates(["key"])


def repeated_lines(docs: DataFrame, cfg: LineConfig, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """doc_key and ``dropped`` (sorted line numbers, from 0): lines that equal or nearly equal an earlier one.

    Groups are the components of lines near each other (see LineConfig); the first line by (id, document key, line number) stays.
    """
    lines = scratch.save(line_rows(docs, cfg, id_col, text_col), "lines")
    groups = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("key").alias("comp"))
    found = linked(_line_cells(docs, cfg, text_col), lambda wanted: _describe(docs, cfg, text_col, wanted), Bound(2, 1), WithinEdits(cfg), scratch)
    if found is not None:
        found = scratch.save(_of_lines(found, scratch), "near")
        groups = groups.join(found.select("key"), "key", "left_anti").unionByName(found.select("key", "comp"))
    # only the lines of groups go on: those that stand once and have no near copy are most of all
    own = scratch.save(lines.join(groups, "key").select("comp", "doc", "line_no"), "own")
    first = own.groupBy("comp").agg(F.min(F.struct("doc.*", "line_no")).alias("first"))
    again = own.join(first, "comp").withColumn("doc_key", F.col("doc.doc_key")).where(~((F.col("doc_key") == F.col("first.doc_key")) & (F.col("line_no") == F.col("first.line_no"))))
    return again.groupBy("doc_key").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, cfg: LineConfig = LineConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with repeated lines taken out of the text, and ``n_lines`` and ``dropped`` (line numbers).

    Lines are the parts of a text between line feeds. Rows that repeat id and text are one document: they lose the same
    lines. Null texts stay null (no lines), empty ones have one empty line; an empty table gives an empty one. Columns of the input named n_lines or
    dropped are replaced.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    keyed = docs.drop("n_lines", "dropped", "doc_key", "_marks").withColumn("doc_key", F.xxhash64(F.col(id_col), F.col(text_col)))
    # a mark for each line up to the last dropped one, so that texts of very many lines take one pass
    gaps = "flatten(transform(sequence(1, size(dropped)), k -> concat(array_repeat(false, element_at(dropped, k) - if(k = 1, -1, element_at(dropped, greatest(1, k - 1))) - 1), array(true))))"
    dropped = scratch.save(repeated_lines(keyed, cfg, scratch, id_col, text_col).withColumn("_marks", F.expr(gaps)), "dropped")
    scratch.keep(dropped)
    # texts stream past the dropped lines of their partition at every size: they aren't sorted, and nothing is broadcast
    joined = keyed.join(dropped.hint("shuffle_hash"), "doc_key", "left").drop("doc_key")
    lines = F.split(F.col(text_col), "\n")
    left = F.array_join(F.zip_with(lines, "_marks", lambda x, gone: F.when(gone, F.lit(None)).otherwise(x)), "\n")
    counted = joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"))
    return counted.withColumn(text_col, F.when(F.col("dropped").isNull(), F.col(text_col)).otherwise(left)).withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>"))).drop("_marks")


def digest(found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return found.select(id_col, "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.length(text_col).cast("long").alias("kept_chars"), F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256).alias("kept_sha256"))
