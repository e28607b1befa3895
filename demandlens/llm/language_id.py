"""Language identification with bit-sliced Bloom filters of n-grams (operator 5)."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U, mix


@dataclass(frozen=True)
class LanguageConfig:
    slots: int = 1 << 20  # of the filters at least, a power of two: each slot has one bit a language
    hashes: int = 3
    #: The largest filter's expected share of n-grams that it holds by chance is no more than this: the slots grow with its members.
    false_positive: float = 0.02
    #: A language's filter gets an n-gram if its share of the language's n-grams is at least this part of the largest share.
    relative_share: float = 0.3
    min_count: int = 3
    folds: int = 5


def held_out(id_col: str, folds: int) -> Column:
    """Documents that training leaves out: checksum of the id as text divisible by ``folds``; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


_LETTERS: list[np.ndarray] = []


def trigrams(text: str) -> np.ndarray:
    """Codes (21 bits a character) of the letter trigrams of a lower-cased text: a letter with its neighbours, other
    characters being one boundary. As many as the text has letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)]))
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    own = np.zeros(len(c) + 2, dtype=U)
    own[1:-1] = np.where(_LETTERS[0][c], c, 0)
    at = np.flatnonzero(own)
    return (own[at - 1] << U(42)) | (own[at] << U(21)) | own[at + 1]


def trigram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """gram, lang, n over all rows; batches add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.is_valid:
                    by_lang.setdefault(lang, []).append(trigrams(text.as_py()))
            for lang, parts in by_lang.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array([lang] * len(grams), pa.string()), pa.array(n)], ["gram", "lang", "n"])

    return docs.select(F.col(lang_col).alias("lang"), text_col).mapInArrow(count, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


#: Slots that come to the driver in one row.
BLOCK = 1 << 12


def slots_for(members: int, cfg: LanguageConfig) -> int:
    """The power of two, cfg.slots at least, at which a filter of so many n-grams keeps the false-positive rate."""
    wanted = -cfg.hashes * members / math.log1p(-(cfg.false_positive ** (1 / cfg.hashes)))
    return max(cfg.slots, 1 << max(0, math.ceil(wanted) - 1).bit_length())


class BloomSlices:
    """One filter a language, side by side: slot i has the bits of all languages, in words of 64 languages (narrower ones if they are few)."""

    def __init__(self, langs: list[str], slots: np.ndarray, hashes: int):
        self.langs, self.slots, self.hashes = langs, slots, hashes
        full = [np.count_nonzero(slots[:, i // 64] & slots.dtype.type(1 << i % 64)) / len(slots) for i in range(len(langs))]
        self.false_positive = np.array([x**hashes for x in full])

    def contained(self, grams: np.ndarray) -> np.ndarray:
        """Bitmask of the languages whose filters have each n-gram."""
        size = U(len(self.slots) - 1)
        out = None
        for i in range(self.hashes):
            got = self.slots[(mix(grams + U(i * 0x9E3779B97F4A7C15 % (1 << 64))) & size).astype(np.int64)]
            out = got if out is None else out & got
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with most contained n-grams, corrected for chance hits, and its share of all; ties: first by name."""
        grams = trigrams(text) if text else np.zeros(0, dtype=U)
        if not len(grams) or not self.langs:
            return "und", 0.0
        masks = self.contained(grams)
        hits = np.array([int(((masks[:, i // 64] >> U(i % 64)) & U(1)).sum()) for i in range(len(self.langs))], dtype=float)
        own = np.maximum(0, (hits - len(grams) * self.false_positive) / np.maximum(1e-9, 1 - self.false_positive))
        best = int(np.argmax(own))
        return self.langs[best], round(float(own[best] / own.sum()), 6) if own.sum() else 0.0


def train(docs: DataFrame, cfg: LanguageConfig = LanguageConfig(), text_col: str = "text", lang_col: str = "lang") -> BloomSlices:
    """Filters of all rows with a language and a text. Only the slots (some ten a member n-gram of the largest
    filter, of one byte for up to 8 languages) and two numbers for each language come to the driver."""
    counts = trigram_counts(docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), text_col, lang_col)
    from .scratch import Scratch

    scratch = Scratch(docs.sparkSession, "language-id")
    counts = scratch.save(counts, "trigrams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return BloomSlices([], np.zeros((cfg.slots, 1), dtype=U), cfg.hashes)
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(langs) <= 8 * np.dtype(k).itemsize), U)
    place = F.create_map(*(F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)))
    total = F.create_map(*(F.lit(x) for lang in langs for x in (lang, float(totals[lang]))))
    share = F.col("n") / total[F.col("lang")]
    grouped = counts.where(F.col("n") >= cfg.min_count).groupBy("gram").agg(F.collect_list(F.struct(place[F.col("lang")].alias("i"), share.alias("share"))).alias("all"), F.max(share).alias("top"))
    member = grouped.select("gram", F.explode("all").alias("x"), "top").where(F.col("x.share") >= cfg.relative_share * F.col("top")).select("gram", (F.col("x.i") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(x.i % 64 as int))").alias("mask"))
    member = scratch.save(member, "members")
    size = slots_for(max((r["count"] for r in member.groupBy("word", "mask").count().collect()), default=0), cfg)
    block = min(BLOCK, size)

    def place_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy().view(U)
            for i in range(cfg.hashes):
                slot = (mix(grams + U(i * 0x9E3779B97F4A7C15 % (1 << 64))) & U(size - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot), batch.column(1), batch.column(2)], ["slot", "word", "mask"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in batch.column(2):
                at, mask = own.values.flatten()
                filled = np.zeros(block, dtype=kind)
                filled[at.to_numpy()] = mask.to_numpy().view(U).astype(kind)
                rows.append(filled.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["block", "word", "bits"])

    placed = member.mapInArrow(place_bits, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    blocks = placed.groupBy(F.expr(f"slot div {block}").alias("block"), "word").agg(F.collect_list(F.struct(F.col("slot") % block, "mask")).alias("own"))
    slots = np.zeros((size, max(1, (len(langs) + 63) // 64)), dtype=kind)
    found = blocks.mapInArrow(pack, "block long, word int, bits binary").toArrow()
    for i, word, bits in zip(*(found.column(c).to_pylist() for c in ("block", "word", "bits"))):
        slots[i * block : (i + 1) * block, word] = np.frombuffer(bits, dtype=kind)
    return BloomSlices(langs, slots, cfg.hashes)


def identify(docs: DataFrame, model: BloomSlices, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Per row: id, the ``keep`` columns, lang_pred and score. Nothing but the text is an input; 'und' with score 0 for
    null texts and texts without a letter. Texts whose n-grams no filter has get the first language with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(text_col).alias("_text"), F.col(id_col), *(keep or []))
    names = chosen.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def language_id(docs: DataFrame, cfg: LanguageConfig = LanguageConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on the rows that aren't held out and predicts all: id, held_out, lang_pred, score.

    The language column must hold strings. Null texts and texts without a letter are 'und' with score 0. Texts are read whole, however long, one
    at a time. Repeated rows count as often as they occur and give repeated rows; a row without an id is held out; other columns are
    ignored; an empty table gives an empty one, and without any language to learn all texts are 'und'.
    """
    out = held_out(id_col, cfg.folds)
    model = train(docs.where(~out), cfg, text_col, lang_col)
    return identify(docs, model, id_col, text_col, [out.alias("held_out")]).select(id_col, "held_out", "lang_pred", "score")
