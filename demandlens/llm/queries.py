"""Registered queries of the operators over whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontamination, id_files, language_id, line_dedup, ngram_join, personal_data, quality, run_detection, sentence_pieces, sharding, sql, token_counts, url_filters

#: Folder of public vocabulary files; a parameter of the operators, here read from the environment.
TOKENIZERS = os.environ.get("DEMANDLENS_TOKENIZERS", "/opt/tokenizers")
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
WORDS = f"{TOKENIZERS}/word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECES)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.personal_data(table(spark, sf_dir, "documents")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and hash of the ids of each text, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents")
    return sentence_pieces.round_trip(docs, PIECES)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filters.evaluate(url_filters.dated_captures(pages), url_filters.derived_entries(pages))
    return found.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.round_trip(table(spark, sf_dir, "documents"), WORDS)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_nodes(table(spark, sf_dir, "conversations"), cross=5, heads=9)


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_detection.digest(run_detection.word_runs(table(spark, sf_dir, "documents"), arrange=run_detection.folded))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_personal_data, op3_ngram_join, op4_sentence_pieces, op5_language_id, op6_decontamination, op7_byte_shards, op8_quality, op9_line_dedup, op10_url_filters, op11_token_files, op12_conversation_trie, op13_word_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": sql.OP3, "op6_decontamination": sql.OP6, "op10_url_filters": sql.OP10, "op12_conversation_trie": sql.OP12}
