"""Quality rules by distribution divergence (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import BETWEEN_SPACES, LOWER, U, covered, ngram_hashes, span_hashes, word_spans

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class QualityConfig:
    """Distances are Jensen-Shannon distances (square root, base 2, 0 to 1) to the nearest language reference."""

    common_words: int = 60  # of each language reference
    max_char_distance: float = 0.25
    max_word_distance: float = 0.42
    min_chars: int = 200  # shorter texts aren't judged by their characters
    min_words: int = 80  # nor by their words


def _classes() -> np.ndarray:
    out = np.full(256, 6)
    for i, group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f", b".,;:!?'\"()-", SYMBOLS)):
        out[list(group)] = i
    out[0xC0:] = 7  # first bytes of characters outside ASCII
    out[0x80:0xC0] = 8  # their other bytes, not counted
    return out


CLASS = _classes()
N_CLASSES = 8
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def base_counts(text: bytes) -> tuple[int, int, int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; then the bytes and the words' starts and ends."""
    b = np.frombuffer(text, dtype=np.uint8)
    starts, ends = word_spans(b, BETWEEN_SPACES)
    n = len(starts)
    word_chars = int(np.count_nonzero(BETWEEN_SPACES[b] & ((b & 0xC0) != 0x80)))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\v\f\r"):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n >= 9:
        grams = ngram_hashes(span_hashes(b, starts, ends), 8)
        _, at, counts = np.unique(grams, return_inverse=True, return_counts=True)
        if (counts > 1).any():
            repeat = int(covered(counts[at] > 1, n, 8).sum())
    return n, word_chars, int(_SYMBOL[b].sum()), dup, repeat, b, starts, ends


def js_distance(p: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of one histogram to the rows of another array; all sum to 1."""
    m = (p + refs) / 2

    def to_mean(q: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)

    return np.sqrt(np.clip((to_mean(np.broadcast_to(p, refs.shape)) + to_mean(refs)) / 2, 0, 1))


def language_references(docs: DataFrame, cfg: QualityConfig, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per language: bin counts over all documents with that language: kind 'char' (bin = class), 'word' (bin = hash of a
    common lower-cased word) and 'words' (all words). Batches add up before the shuffle; a language leaves common_words + 9 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars: dict[str, np.ndarray] = {}
            words: dict[str, list[np.ndarray]] = {}
            total: dict[str, int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if text.is_valid:
                    b = np.frombuffer(text.as_py().translate(LOWER), dtype=np.uint8)
                    starts, ends = word_spans(b, BETWEEN_SPACES)
                    raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                    chars[lang] = chars.get(lang, 0) + np.bincount(CLASS[raw], minlength=9)[:N_CLASSES]
                    words.setdefault(lang, []).append(span_hashes(b, starts, ends))
                    total[lang] = total.get(lang, 0) + len(starts)
            rows = []
            for lang in chars:
                bins, counts = np.unique(np.concatenate(words[lang]), return_counts=True)
                rows += [(lang, "char", i, int(c)) for i, c in enumerate(chars[lang])]
                rows += [(lang, "words", 0, total[lang])]
                rows += zip([lang] * len(bins), ["word"] * len(bins), bins.view(np.int64).tolist(), counts.tolist())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["lang", "kind", "bin", "n"])

    counted = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text_col).mapInArrow(count, "lang string, kind string, bin long, n long").groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "bin"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= max(cfg.common_words, N_CLASSES)).drop("rank")


def _load(rows: list, cfg: QualityConfig) -> dict[str, np.ndarray]:
    langs = sorted({r.lang for r in rows})
    chars, words = np.zeros((len(langs), N_CLASSES)), []
    vocabulary = sorted({r.bin for r in rows if r.kind == "word"})
    place = {w: i for i, w in enumerate(vocabulary)}
    hist = np.zeros((len(langs), len(vocabulary) + 1))
    for r in rows:
        i = langs.index(r.lang)
        if r.kind == "char":
            chars[i, r.bin] = r.n
        elif r.kind == "word":
            hist[i, place[r.bin]] = r.n
        else:
            words.append((i, r.n))
    for i, n in words:
        hist[i, -1] = max(0, n - hist[i, :-1].sum())
    keep = (chars.sum(axis=1) > 0) & (hist.sum(axis=1) > 0)
    chars, hist = chars[keep], hist[keep]
    vocab = np.array(vocabulary, dtype=np.int64).view(U)
    order = np.argsort(vocab)
    hist[:, :-1] = hist[:, :-1][:, order]
    return {"vocab": vocab[order], "char": chars / chars.sum(axis=1, keepdims=True), "word": hist / hist.sum(axis=1, keepdims=True)}


def quality(docs: DataFrame, cfg: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, the five base counts, base_failed, char_distance, word_distance (null where a guard holds) and kept.

    The references come from all documents with a language; a document is compared with each and the nearest counts,
    so its own language isn't used. The id may be any column, also a struct of all; other columns are ignored. Null and empty texts have no words,
    so they fail. Without any reference only the base rules judge. Texts are read whole, a text at a time. Of equally common words those
    with the smallest hashes enter a reference; equal distances don't matter, as only the least counts. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    refs = _load(language_references(docs, cfg, text_col, lang_col).collect(), cfg)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = refs["vocab"]
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()):
                text = text.as_py() or b""
                *counts, b, starts, ends = base_counts(text)
                n, repeat = counts[0], counts[4]
                failed = n < 20 or 100 * repeat > 30 * n
                far = [None, None]
                if not failed and len(refs["char"]):
                    hist = np.bincount(CLASS[b], minlength=9)[:N_CLASSES]
                    if hist.sum() >= cfg.min_chars:
                        far[0] = float(js_distance(hist / hist.sum(), refs["char"]).min())
                    if n >= cfg.min_words:
                        low = np.frombuffer(text.translate(LOWER), dtype=np.uint8)
                        w = span_hashes(low, starts, ends)
                        at = np.minimum(np.searchsorted(vocab, w), max(0, len(vocab) - 1))
                        known = at[vocab[at] == w] if len(vocab) else at[:0]
                        own = np.bincount(known, minlength=len(vocab) + 1).astype(float)
                        own[-1] = n - len(known)
                        far[1] = float(js_distance(own / n, refs["word"]).min())
                ok = not failed and not (far[0] is not None and far[0] > cfg.max_char_distance) and not (far[1] is not None and far[1] > cfg.max_word_distance)
                rows.append((*counts, failed, *far, ok))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names) if rows else pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([], k) for k in kinds)], names)

    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([docs.select(id_col).schema[0], *(T.StructField(n, k) for n, k in zip(names[1:], kinds))])
    return docs.select(id_col, text_col).mapInArrow(judge, schema)
