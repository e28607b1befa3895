"""Jobs over texts: chunking, hashed embeddings, vocabulary resolution, verbatim spans, response validation."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clamped, inline_collapsed, ranked, token_estimate

# ---------------------------------------------------------------- chunks of Markdown

# What headings, list items, code fences and ends of sentences look like.
_FENCE = re.compile(r"\s*(```|~~~)")
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
_BULLET = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+\S")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _size(text: str) -> int:
    return max(1, -(-len(text) // 4)) if text else 0


def markdown_blocks(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of headings, fenced code, list items with what is below them, and paragraphs.

    One pass over the lines: each either goes on with the open block or ends it and opens the next. Code goes on to its
    closing fence; an item to an empty line, a heading, or an item or fence that is indented no further; a paragraph to anything else.
    """
    kind, held, indent, fence = "", [], 0, ""
    for line in [*re.sub("\r\n?", "\n", text).split("\n"), None]:
        if line is None:  # the end of the text
            opens = ""
        elif kind == "code":
            held.append(line)
            if not line.strip().startswith(fence):
                continue
            opens, line = "", None
        else:
            mark = _FENCE.match(line)
            opens = "code" if mark else "heading" if _HEADING.match(line) else "bullet" if _BULLET.match(line) else "paragraph" if line.strip() else ""
            deep = len(line) - len(line.lstrip(" "))
            if (kind == "bullet" and (opens == "paragraph" or opens in ("bullet", "code") and deep > indent)) or (kind == opens == "paragraph"):
                held.append(line.rstrip())
                continue
        if kind:
            yield kind, "\n".join(held)
        kind, held = opens, [line if opens == "code" else line.rstrip()] if opens else []
        if opens == "heading":
            held = [line.strip()]
        elif opens:
            indent, fence = deep, mark[1] if mark else ""


def _gathered(parts: list[str], limit: int) -> list[str]:
    """Parts joined by blanks for as long as they stay within the limit."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + 1 + len(p) <= limit:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def _sentences(text: str, limit: int) -> list[str]:
    atoms: list[str] = []
    for s in filter(None, (x.strip() for x in _SENTENCE.split(text))):
        atoms += [s] if len(s) <= limit else _gathered(s.split(), limit)
    return _gathered(atoms, limit) or [text]


class _Piece(NamedTuple):
    """Text of one or more blocks, whether it begins and ends with a list item, and the tokens of its blocks."""

    text: str
    first: bool
    last: bool
    tokens: int

    def then(self, other: _Piece) -> _Piece:
        return _Piece(self.text + ("\n" if self.last and other.first else "\n\n") + other.text, self.first, other.last, self.tokens + other.tokens)


def _packed(pieces: Iterable[_Piece], smallest: int, largest: int) -> list[str]:
    """Pieces of a section as chunks: each takes in what follows up to ``largest`` tokens; once it is full it joins the chunk
    before it if one of the two is under ``smallest`` and both fit in one."""
    chunks: list[_Piece] = []
    full = None
    for piece in [*pieces, None]:
        if full and piece and full.tokens + piece.tokens <= largest:
            full = full.then(piece)
            continue
        if full:
            sizes = [_size(chunks[-1].text), _size(full.text)] if chunks else []
            if sizes and min(sizes) < smallest and sum(sizes) <= largest:
                chunks[-1] = chunks[-1].then(full)
            else:
                chunks.append(full)
        full = piece
    return [c.text for c in chunks]


def markdown_chunks(text: str, smallest: int = 200, largest: int = 500) -> list[tuple[str | None, str]]:
    """(heading, text) of the chunks of a document, none across a heading.

    Units fill a chunk up to ``largest`` estimated tokens; neighbours of which one is under ``smallest`` are joined if they fit. Paragraphs that are too large
    themselves are cut at sentences, then at blanks; list items and code never are.
    """
    if smallest > largest:
        raise ValueError("smallest must not exceed largest")
    sections: list[tuple[str | None, list[_Piece]]] = [(None, [])]
    for kind, block in markdown_blocks(text):
        if kind == "heading":
            sections.append((block, []))
        elif block.strip():
            parts = _sentences(block, largest * 4) if kind == "paragraph" and _size(block) > largest else [block]
            sections[-1][1].extend(_Piece(p, kind == "bullet", kind == "bullet", _size(p)) for p in parts)
    out: list[tuple[str | None, str]] = []
    for heading, pieces in sections:
        title = _HEADING.match(heading + " ")[2].strip() or None if heading else None
        out += [(title, f"{heading}\n\n{chunk}" if heading else chunk) for chunk in _packed(pieces, smallest, largest)]
    return out


#: Characters of texts whose results a task holds before it passes them on.
HELD_CHARACTERS = 1_000_000


def chunk_batches(batches: Iterator[pa.RecordBatch], smallest: int, largest: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
    for batch in batches:
        rows, held = [], 0
        for row in range(batch.num_rows):  # a text at a time, so that no batch is held as Python strings
            kind, ref, text = (c[row].as_py() for c in batch.columns)
            rows += [(kind, ref, i, h, x) for i, (h, x) in enumerate(markdown_chunks(text or "", smallest, largest))]
            held += len(text or "")
            if rows and (held >= HELD_CHARACTERS or row == batch.num_rows - 1):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["source_type", "source_ref", "ordinal", "heading", "text"])
                rows, held = [], 0


def chunk_documents(docs: DataFrame, smallest: int = 200, largest: int = 500) -> DataFrame:
    """source_type, source_ref, ordinal, heading, text, text_sha256, token_estimate; rows in, rows out, no shuffle."""
    read = docs.select(F.col("source_type").cast("string"), F.col("source_ref").cast("string"), "text")
    cut = read.mapInArrow(lambda batches: chunk_batches(batches, smallest, largest), "source_type string, source_ref string, ordinal int, heading string, text string")
    return cut.withColumn("text_sha256", F.sha2("text", 256)).withColumn("token_estimate", token_estimate(F.col("text")))


# ---------------------------------------------------------------- hashed embeddings


_WORD = re.compile(r"[a-z0-9+#.]+")


def _md5(term: str) -> tuple[int, bool]:
    """A term's number and whether its sign is plus, as SQL can compute them: the first 32 bits of the MD5 and the next hexadecimal digit."""
    h = hashlib.md5(term.encode(), usedforsecurity=False).digest()
    return int.from_bytes(h[:4], "big"), h[4] & 16 == 0


def _blake2b(term: str) -> tuple[int, bool]:
    """First four bytes of the 64-bit BLAKE2b for the number, lowest bit of the fifth for plus."""
    h = hashlib.blake2b(term.encode(), digest_size=8).digest()
    return int.from_bytes(h[:4], "big"), h[4] & 1 == 1


class _Slots(dict):
    """Slot and sign of terms, as 2 * slot + (1 for plus); what was asked before is kept up to a limit."""

    def __init__(self, digest: Callable[[str], tuple[int, bool]], dim: int, limit: int = 500_000):
        super().__init__()
        self.digest, self.dim, self.limit = digest, dim, limit

    def __missing__(self, term: str) -> int:
        number, plus = self.digest(term)
        if len(self) >= self.limit:
            self.clear()
        out = self[term] = number % self.dim * 2 + plus
        return out

    def sums(self, text: str, between: str) -> np.ndarray:
        """Signed counts by slot of the words of a lower-cased text and of its neighbouring words joined by ``between``."""
        words = _WORD.findall(text.lower())
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        pairs = np.fromiter((self[f"{a}{between}{b}"] for a, b in zip(words, words[1:])), np.int64, max(0, len(words) - 1))
        both = np.bincount(np.concatenate([codes, pairs]), minlength=2 * self.dim).reshape(-1, 2)
        return both[:, 1] - both[:, 0]


def sparse_embeddings(df: DataFrame, id_col: str, text_col: str, dim: int = 1536) -> DataFrame:
    """id, slot, weight of the signed hashes (MD5) of a text's words and pairs of words, of length 1. A text's terms are all in its row, so
    nothing is shuffled; null texts and those without a word give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots(_md5, dim)
        for batch in batches:
            rows, own, weights, size = [], [], [], 0
            for i, text in enumerate(batch.column(1)):
                sums = slots.sums(text.as_py() or "", " ")
                at = np.flatnonzero(sums)
                rows.append(np.full(len(at), i))
                own.append(at)
                weights.append(sums[at] / np.sqrt((sums[at] ** 2).sum()) if len(at) else sums[at].astype(float))
                size += len(at)
                if size > 200_000 or i == batch.num_rows - 1:
                    ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(own).astype(np.int64)), pa.array(np.concatenate(weights))], [id_col, "slot", "weight"])
                    rows, own, weights, size = [], [], [], 0

    return df.select(id_col, text_col).mapInArrow(run, T.StructType([df.select(id_col).schema[0], T.StructField("slot", T.LongType()), T.StructField("weight", T.DoubleType())]))


def hashed_vectors(dim: int = 1536) -> Callable[[str], np.ndarray]:
    """A provider: sums of signs by slot (BLAKE2b, pairs joined without a blank), then unit length; zeros for a text without words."""
    slots = _Slots(_blake2b, dim)

    def vector(text: str) -> np.ndarray:
        sums = slots.sums(text, "").astype(float)
        return sums / max(1e-300, np.sqrt((sums * sums).sum())) if sums.any() else sums

    return vector


def fitted(values: Column, dim: int) -> Column:
    """An array cut or padded with zeros to a length."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0).cast("double"), F.greatest(F.lit(0), dim - F.size(values)))), 1, dim)


def embed(df: DataFrame, text_col: str, provider: Callable[[], Callable[[str], Sequence[float]]] = hashed_vectors, dim: int = 1536) -> DataFrame:
    """All columns and ``embedding`` of the text, cut or padded to ``dim``. ``provider`` is called once a task and gives the function from a
    text to its vector. One pass without a shuffle; null texts count as empty."""
    at = df.columns.index(text_col)
    kind = T.ArrayType(T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = provider()
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                made = [np.asarray(vector(t.as_py() or ""), dtype=float) for t in batch.column(at)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(np.concatenate(made)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "embedding"])

    made = df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("embedding", kind)]))
    return made.withColumn("embedding", fitted(F.col("embedding"), dim))


# ---------------------------------------------------------------- verbatim spans

# Typographic characters and their plain forms; characters that count for nothing.
_PLAIN = {
    "\u2018": "'",
    "\u2019": "'",
    "\u201b": "'",
    "\u2032": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u201f": '"',
    "\u2033": '"',
    "\u2010": "-",
    "\u2011": "-",
    "\u2012": "-",
    "\u2013": "-",
    "\u2014": "-",
    "\u2212": "-",
    "\u2026": "...",
}
_NOTHING = "\u200b\u200c\u200d\ufeff\u00ad"
_UNPLAIN = re.compile(rf"[\s{_NOTHING}]+|[{''.join(_PLAIN)}]")


class PlainForm:
    """A text with plain punctuation and single blanks. What was replaced is known by where it begins in both forms; between
    two such places both run alike."""

    def __init__(self, text: str):
        self.text = text
        parts, self.own, self.original, at, length = [], [0], [0], 0, 0
        for m in _UNPLAIN.finditer(text):
            stretch, run = text[at : m.start()], m[0]
            new = _PLAIN.get(run)
            if new is None:  # a blank, if there is one in the run and text on both sides
                new = " " if run.strip(_NOTHING) and (length or stretch) and m.end() < len(text) else ""
            parts += [stretch, new]
            length += len(stretch)
            self.own += [length, length + len(new)]
            self.original += [m.start(), m.end()]
            length += len(new)
            at = m.end()
        self.plain = "".join(parts) + text[at:]

    def place(self, i: int) -> int:
        """Where the i-th plain character stands in the text."""
        k = bisect_right(self.own, i) - 1
        replaced = k % 2 == 1  # stretches begin at even places, what was put in at odd ones
        return self.original[k] + (0 if replaced else i - self.own[k])

    def find(self, span: str) -> str | None:
        """The original characters where the span stands, as written or in another case; None if it doesn't."""
        wanted = PlainForm(span).plain
        if not wanted:
            return None
        at = self.plain.find(wanted)
        if at < 0 and len(self.plain.lower()) == len(self.plain) and len(wanted.lower()) == len(wanted):
            at = self.plain.lower().find(wanted.lower())
        return None if at < 0 else self.text[self.place(at) : self.place(at + len(wanted) - 1) + 1].strip()


def verify_spans(spans: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """All columns of spans (with raw_text) and ``verbatim``, null where the text hasn't the span. A text's spans go to it as one list."""
    columns = spans.columns
    grouped = spans.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("_spans"))
    joined = texts.select(key, F.col("text").alias("_text")).join(grouped, key).select("_text", "_spans")
    item = joined.schema["_spans"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form = PlainForm(text or "")
                found.append([form.find(r["raw_text"] or "") for r in rows])
            flat = batch.column(1).flatten()
            yield pa.RecordBatch.from_arrays([*flat.flatten(), pa.array([v for vs in found for v in vs], pa.string())], [*columns, "verbatim"])

    return joined.mapInArrow(run, T.StructType([*item.fields, T.StructField("verbatim", T.StringType())]))


# ---------------------------------------------------------------- responses

_REQUIREMENTS = "requirements array<struct<raw_text:string,importance:string,confidence:string>>"


def parse_candidates(responses: DataFrame, key: str = "response_id") -> DataFrame:
    """key, raw_text, importance, confidence (0 to 1, 3 places; 0 if unreadable) of JSON payloads; blank spans and unknown importances are left out."""
    items = responses.select(key, F.explode(F.from_json("payload", _REQUIREMENTS)["requirements"]).alias("r")).select(key, "r.*")
    ok = (F.coalesce(F.trim("raw_text"), F.lit("")) != "") & F.col("importance").isin("required", "preferred", "mentioned")
    return items.where(ok).withColumn("confidence", F.round(clamped(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))), 3))


def best_attempt(responses: DataFrame, rejected: DataFrame) -> DataFrame:
    """One response a posting: the first attempt, or, where that had rejected spans, the retry if there is one."""
    bad = rejected.select("response_id", F.lit(True).alias("bad")).distinct()
    marked = responses.join(bad, "response_id", "left")
    first_bad = F.max(F.when(F.col("attempt") == 1, F.coalesce("bad", F.lit(False)))).over(Window.partitionBy("posting_id"))
    wanted = F.when(first_bad, -F.col("attempt")).otherwise(F.col("attempt"))
    return marked.withColumn("_key", wanted).withColumn("_n", F.row_number().over(Window.partitionBy("posting_id").orderBy("_key"))).where("_n = 1").drop("_key", "_n", "bad")


def validate_citations(responses: DataFrame, requirements: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations of accepted responses, and each response's verdict.

    responses: response_id, posting_id, payload {requirements: [{requirement_id, canonical_skill_id, status, evidence_chunk_id}], verdict}; requirements: posting_id, id,
    skill_id; candidates: posting_id, chunk_id. A response is rejected as fabricated (an evidenced row cites what wasn't supplied), else missing (evidenced without a citation),
    else malformed (no rows, unknown or repeated requirement, bad status, number or verdict). Elsewhere an unknown citation is nulled; skills come from the requirements; those not answered are absent.
    A requirement that is listed twice for a posting counts once, with its smallest skill. Each table is grouped by posting once and a
    response is judged in its row, which holds the requirements and candidates of its posting.
    """
    schema = "requirements array<struct<requirement_id:string,canonical_skill_id:string,status:string,evidence_chunk_id:string,reasoning:string>>, verdict string, rationale string"
    asked = requirements.groupBy("posting_id").agg(F.array_sort(F.collect_set(F.struct(F.col("id").cast("long").alias("id"), "skill_id"))).alias("all"))
    asked = asked.select("posting_id", F.expr("filter(all, (x, i) -> i = 0 OR x.id <> all[i - 1].id)").alias("asked"))
    supplied = candidates.groupBy("posting_id").agg(F.collect_set(F.col("chunk_id").cast("long")).alias("supplied"))
    read = responses.select("response_id", "posting_id", F.from_json("payload", schema).alias("p"))
    row = F.transform(
        F.coalesce("p.requirements", F.array().cast("array<struct<requirement_id:string,canonical_skill_id:string,status:string,evidence_chunk_id:string,reasoning:string>>")),
        lambda r: F.struct(r["requirement_id"].try_cast("long").alias("id"), r["status"].alias("status"), r["evidence_chunk_id"].alias("given"), r["evidence_chunk_id"].try_cast("long").alias("chunk_id")),
    )
    met = read.join(asked, "posting_id", "left").join(supplied, "posting_id", "left").select("response_id", "posting_id", "p", "asked", F.coalesce("supplied", F.array().cast("array<bigint>")).alias("supplied"), row.alias("rows"))
    ids = F.coalesce(F.transform("asked", lambda x: x["id"]), F.array().cast("array<bigint>"))
    met = met.withColumn("ids", ids)
    inside = lambda array, x: F.coalesce(F.array_contains(array, x), F.lit(False))
    # the first thing wrong with a row hides what else is
    named = F.transform("rows", lambda r: r["id"])
    severity = F.transform(
        "rows",
        lambda r, i: F.when(
            ~inside(F.col("ids"), r["id"]) | (F.array_position(named, r["id"]) <= i) | ~F.coalesce(r["status"].isin("evidenced", "weak", "absent"), F.lit(False)) | (r["given"].isNotNull() & r["chunk_id"].isNull()), 1
        ).when((r["status"] == "evidenced") & r["chunk_id"].isNull(), 2).when((r["status"] == "evidenced") & ~inside(F.col("supplied"), r["chunk_id"]), 3).otherwise(0),
    )
    level = F.coalesce(F.array_max(severity), F.lit(0))
    shape = F.col("p.requirements").isNull() | ~F.coalesce(F.col("p.verdict").isin("strong", "plausible", "stretch", "no"), F.lit(False))
    judged = met.withColumn("level", level).withColumn("outcome", F.expr("CASE level WHEN 3 THEN 'fabricated' WHEN 2 THEN 'missing' WHEN 1 THEN 'malformed' END")).withColumn("outcome", F.coalesce("outcome", F.when(shape, "malformed").otherwise("accepted")))
    verdicts = judged.select("response_id", "posting_id", "outcome", F.col("p.verdict").alias("verdict"), F.trim(F.coalesce("p.rationale", F.lit(""))).alias("rationale"))
    ok = judged.where("outcome = 'accepted'")
    one = F.explode(
        F.transform(
            "asked",
            lambda x: F.struct(
                x["id"].alias("requirement_id"), x["skill_id"].alias("skill_id"), F.get(F.filter("rows", lambda r: r["id"] == x["id"]), F.lit(0)).alias("r")
            ),
        )
    )
    rows = ok.select("response_id", "posting_id", "supplied", one.alias("x")).select("response_id", "posting_id", "x.*", "supplied")
    cited = F.when(inside(F.col("supplied"), F.col("r.chunk_id")), F.col("r.chunk_id"))
    return rows.select("response_id", "posting_id", "requirement_id", "skill_id", F.coalesce("r.status", F.lit("absent")).alias("status"), cited.alias("chunk_id"), F.col("r").isNotNull().alias("answered")), verdicts


def validate_rewrites(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Accepted rewrites (source_id, text): the first good one of each source by ``pos``.

    40 to min(420, max(100, 1.45 times the original)) characters, one line, ends in '.' or ';', no first person, no new number, each used keyword a tag of the source and in the text, and
    no mention of the target company or title that the original lacks.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9+#./-]+", " "))
    numbers = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?<![a-z])(\d+(?:[.,]\d+)?)"), F.lit(1))
    padded = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, "[^a-z0-9]+", " "), F.lit(" "))
    both = candidates.join(sources, "source_id")
    text, original = F.trim("text"), F.trim("original")
    most = F.least(F.lit(420), F.greatest(F.lit(100), F.floor(F.length(original) * 1.45)))
    tags = F.transform("tags", norm)
    used = F.transform("keywords", norm)
    inside = lambda phrase, c: F.contains(padded(norm(c)), F.concat(F.lit(" "), F.trim(F.regexp_replace(phrase, "[^a-z0-9]+", " ")), F.lit(" ")))
    leak = F.exists(F.array("company", "title"), lambda x: (F.length(norm(x)) >= 3) & inside(norm(x), text) & ~inside(norm(x), original))
    ok = (
        F.length(text).between(F.lit(40), most) & ~F.contains(text, F.lit("\n")) & (text != original) & ~F.lower(text).rlike("^(i|my) ") & text.rlike("[.;]$")
        & (F.size(F.array_except(numbers(text), numbers(original))) == 0) & F.forall(used, lambda k: F.array_contains(tags, k) & inside(k, text)) & ~F.coalesce(leak, F.lit(False))
    )
    return both.where(ok).groupBy("source_id").agg(F.min_by(text, "pos").alias("text"))


def extraction_quality(labels: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Per document: labels, those found (one text holds the other after folding) and those found with the same importance."""
    fold = lambda c: F.lower(inline_collapsed(c))
    a = labels.select(key, fold(F.col("raw_text")).alias("wanted"), F.col("importance").alias("wanted_importance"))
    # numbered within a document, so that both uses number alike; equal labels may change places
    a = a.withColumn("label", F.row_number().over(Window.partitionBy(key).orderBy("wanted", "wanted_importance")))
    b = rows.select(key, fold(F.col("raw_text")).alias("got"), "importance")
    hits = a.join(b, key).where(F.contains("got", "wanted") | F.contains("wanted", "got")).groupBy(key, "label").agg(F.max((F.col("importance") == F.col("wanted_importance")).cast("int")).alias("same"))
    return a.join(hits, [key, "label"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("labels"), F.count("same").alias("found"), F.coalesce(F.sum("same"), F.lit(0)).alias("agreed"))


def strongest(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.max_by("importance", ranked(F.col("importance"), {"required": 3, "preferred": 2, "mentioned": 1})).alias("importance"), F.max("confidence").alias("confidence"))
