"""Cleaning of a document corpus in five stages, each one operator of ``demandlens.llm`` over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm import decontamination, line_dedup, ngram_join, quality, sentence_pieces
from demandlens.llm.queries import PIECES, table
from demandlens.llm.scratch import Scratch


def _carried(docs: DataFrame, *columns: str) -> DataFrame:
    """Whole rows in one column that operators pass on, besides the columns that they read (null where the table lacks one):
    filters then need no join, and no column of the table meets one of the operator's."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *(c if c in docs.columns else F.lit(None).cast("string").alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all columns.

    Null and empty texts have no words, so they go; a null language only leaves a text out of the references, as does a table
    without languages. Texts are read whole. A row is judged by its text alone: equal texts fare alike, repeated rows stay or go together. An empty table stays empty.
    """
    return quality.quality(_carried(docs, "text", "lang"), id_col="_row").where("kept").select("_row.*")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which nothing but white space is left. ``n_chars``, if there, follows the text.

    Of equal or nearly equal lines the one in the document with the smallest id stays (null ids last), in it the first. Null
    and empty texts have no lines and stay as they are. Rows that repeat id and text lose the same lines. Lines of any length are compared.
    Columns of any name are kept; an empty table stays empty.
    """
    # the operator's own columns must not replace the table's
    aside = {c: f"_own_{c}" for c in docs.columns if c in ("n_lines", "dropped", "doc_key", "_marks")}
    found = line_dedup.drop_repeated_lines(docs.withColumnsRenamed(aside))
    changed = F.size("dropped") > 0
    kept = found.where(~F.coalesce(changed & ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Null and empty texts are in no group and stay. Documents without an id can't be told apart, so they stay, and never stand for a
    group. Rows that repeat a kept id stay with it. Texts are compared whole; other columns, of any name, are passed on; an empty table stays empty.
    """
    others = ngram_join.ngram_components(docs, n=5, percent=80).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window, with all columns.

    Null and empty texts have no words and stay; items without words match nothing, those without an id do. Texts are read
    whole. A row is judged by its text alone, so repeated rows stay or go together. An empty table, or benchmark, changes nothing.
    """
    found = decontamination.contamination(_carried(docs, "text"), table(spark, sf_dir, "benchmark"), id_col="_row")
    return found.where("size(hits) = 0").select("_row.*")


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each text: null for a null text, none for an empty one; a row for every row, also repeated ones
    and those without an id; texts of any length; other columns, of any name, are left out."""
    return sentence_pieces.encode(docs, PIECES)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", piece_encoding),
]

#: SQL can't express the first stage's distances, the edit join and the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's output is written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
