"""Rankings and selections. Top-n comes from a limited sort; groups use aggregates before windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shortlist(scores: DataFrame, run_id: str, n: int) -> DataFrame:
    """The n best by score, ties to the lower posting id, with dense ranks from 1. Only n rows are numbered."""
    order = [F.desc("score"), F.asc("posting_id")]
    return scores.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order))).withColumn("run_id", F.lit(run_id))


def latest_matches(matches: DataFrame) -> DataFrame:
    """The newest match of each posting, ties to the higher id."""
    return matches.groupBy("posting_id").agg(F.max_by(F.struct(*(c for c in matches.columns if c != "posting_id")), F.struct("computed_at", "id")).alias("m")).select("posting_id", "m.*")


def stale_sweep(matches: DataFrame, postings: DataFrame, n: int) -> DataFrame:
    """Active postings with a stale match, longest waiting first."""
    live = postings.where("inactive_at is null").select(F.col("id").alias("posting_id"))
    waiting = matches.where("is_stale").join(live, "posting_id", "left_semi").groupBy("posting_id").agg(F.min(F.struct("computed_at", "id")).alias("since"))
    return waiting.orderBy("since", "posting_id").limit(n).select("posting_id")


#: Tags of a library that is sent to every task; those of a larger one meet the words by a shuffle.
SENT_TAGS = 100_000
#: Bytes of a text whose words a task holds at once.
WORDS_AT_ONCE = 1 << 20


def _sift(wanted: frozenset[bytes], table: bytes, at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of texts (second column), the wanted words, each once, beside the first column. ``table`` makes all bytes between words spaces."""

    def words(text: bytes) -> set[bytes]:
        found: set[bytes] = set()
        plain, at = text.decode("utf-8", "replace").lower().encode().translate(table), 0
        while at < len(plain):
            cut = plain.find(b" ", at + at_once)  # parts end between words
            end = len(plain) if cut < 0 else cut
            found |= wanted.intersection(plain[at:end].split())
            at = end
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(words(t.as_py())) if t.is_valid else [] for t in batch.column(1)]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array([w.decode() for f in found for w in f], pa.string())], batch.schema.names[:1] + ["word"])

    return run


def text_words(texts: DataFrame, wanted: DataFrame, between: str, most: int = SENT_TAGS, at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """text_id and each word of its lower-cased texts once that is in ``wanted`` (column ``word``), dealt by text_id.

    ``between``: pattern of one character that separates words; everything outside ASCII must match it. Wanted words are counted when the plan is built:
    up to ``most`` go to every task, which reads the texts once and passes only hits on; more meet all words by equality, by a shuffle.
    """
    wanted = wanted.select("word").where("word <> ''").distinct()
    known = [r["word"] for r in wanted.limit(most + 1).collect()]
    if len(known) > most:
        split = texts.select("text_id", F.explode(F.array_distinct(F.split(F.lower("text"), f"{between}+"))).alias("word")).where("word <> ''")
        return split.join(wanted, "word", "left_semi").select("text_id", "word").repartition("text_id").distinct()
    table = bytes(32 if i > 127 or re.fullmatch(between, chr(i), re.DOTALL) else i for i in range(256))
    kind = texts.schema["text_id"].dataType.simpleString()
    run = _sift(frozenset(w.encode() for w in known), table, at_once)
    return texts.select("text_id", F.col("text").cast("binary")).mapInArrow(run, f"text_id {kind}, word string").repartition("text_id").distinct()


def tag_hits(texts: DataFrame, bullets: DataFrame, most: int = SENT_TAGS) -> DataFrame:
    """text_id, entry_id, bullet_id, tag: tags of bullets (one word each) that the text has as a word (rows that repeat an id are one text)."""
    tags = bullets.select("entry_id", "bullet_id", F.explode(F.array_distinct("tags")).alias("tag")).withColumn("tag", F.lower("tag"))
    hits = text_words(texts, tags.select(F.col("tag").alias("word")), "[^a-z0-9+#./-]", most).withColumnRenamed("word", "tag")
    return hits.join(F.broadcast(tags) if tags.limit(most + 1).count() <= most else tags, "tag")


def select_content(texts: DataFrame, bullets: DataFrame, entries: int = 3, per_entry: int = 2, total: int = 5) -> DataFrame:
    """Per text the best entries and in them the best bullets: 4 points a tag found; ties keep their order.

    bullets: entry_id, bullet_id (in order), tags. At most ``entries`` entries with some points, ``per_entry`` bullets each and ``total`` in all, taken in
    entry order while the budget lasts. Texts are read once: an entry's points and its best bullets come from the same hits. Bullets without points
    follow those with some, so an entry's first ``per_entry`` ones are all that can be needed of them.
    """
    points = tag_hits(texts, bullets).groupBy("text_id", "entry_id", "bullet_id").agg((4 * F.count(F.lit(1))).alias("points"))
    entry = Window.partitionBy("text_id", "entry_id")
    hit = points.withColumn("entry_points", F.sum("points").over(entry)).withColumn("_place", F.row_number().over(entry.orderBy(F.desc("points"), "bullet_id"))).where(F.col("_place") <= per_entry)
    scored = hit.groupBy("text_id", "entry_id").agg(F.first("entry_points").alias("entry_points"), F.collect_list(F.struct((-F.col("points")).alias("minus"), "bullet_id")).alias("hits"))
    best = scored.withColumn("entry_place", F.row_number().over(Window.partitionBy("text_id").orderBy(F.desc("entry_points"), "entry_id"))).where(F.col("entry_place") <= entries)
    firsts = bullets.select("entry_id", "bullet_id").distinct().withColumn("_place", F.row_number().over(Window.partitionBy("entry_id").orderBy("bullet_id"))).where(F.col("_place") <= per_entry)
    firsts = firsts.groupBy("entry_id").agg(F.collect_list("bullet_id").alias("firsts"))
    others = F.transform(F.array_except("firsts", F.col("hits.bullet_id")), lambda b: F.struct(F.lit(0).cast("long").alias("minus"), b.alias("bullet_id")))
    own = best.join(firsts, "entry_id").select("text_id", "entry_id", "entry_place", F.posexplode(F.slice(F.array_sort(F.concat("hits", others)), 1, per_entry)).alias("place", "own"))
    own = own.select("text_id", "entry_id", "own.bullet_id", (-F.col("own.minus")).alias("points"), "entry_place", (F.col("place") + 1).alias("bullet_place"))
    budget = Window.partitionBy("text_id").orderBy("entry_place", "bullet_place").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("_used", F.count(F.lit(1)).over(budget)).where(F.col("_used") <= total).select("text_id", "entry_id", "bullet_id", "points", "entry_place", "bullet_place")


def matched_tags(hits: DataFrame) -> DataFrame:
    """Tags of each text by number of bullets, then name, as one ordered list."""
    counts = hits.groupBy("text_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))), lambda x: x["tag"]), ",").alias("tags"))


def detect_role(texts: DataFrame, signals: DataFrame, preferred: str = "swe") -> DataFrame:
    """Role with most signal words (role, signal) in the text; ties to the preferred one, then the first by name."""
    words = text_words(texts, signals.select(F.col("signal").alias("word")), "[^a-z0-9]").withColumnRenamed("word", "signal")
    hits = words.join(signals, "signal").groupBy("text_id", "role").agg(F.count(F.lit(1)).alias("n"))
    best = hits.groupBy("text_id").agg(F.min_by("role", F.struct(-F.col("n"), F.col("role") != preferred, "role")).alias("role"))
    return texts.select("text_id").join(best, "text_id", "left").select("text_id", F.coalesce("role", F.lit(preferred)).alias("role"))
