"""Markdown trees, several document sources, and the curated vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import literal, taxonomy_normalized

CATEGORIES = ("language", "database", "cloud", "infra", "ml", "framework", "practice", "domain", "soft")
#: Folders of other people's files.
VENDOR_FOLDERS = ("node_modules", "vendor", "venv", "__pycache__", "dist", "build", "site-packages")


def read_markdown(spark: SparkSession, root: str, source_type: str = "markdown") -> DataFrame:
    """Markdown files below a folder, at any depth."""
    return markdown_records(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content"), root, source_type)


def markdown_records(files: DataFrame, root: str, source_type: str = "markdown") -> DataFrame:
    """source_type, source_ref (path below the root) and text of .md, .markdown and .mdx files; hidden and vendor folders,
    blank files and files that aren't UTF-8 are left out."""
    ref = F.regexp_replace("path", "^.*?" + literal(root.rstrip("/")) + "/", "")
    below = F.concat(F.lit("/"), F.col("source_ref"))
    rows = files.withColumn("source_ref", ref).where(F.lower("source_ref").rlike(r"\.(md|markdown|mdx)$")).where(~below.rlike(r"/\.") & ~below.rlike(f"/({'|'.join(VENDOR_FOLDERS)})/"))
    text = rows.where(F.expr("is_valid_utf8(cast(content AS string))")).select(F.lit(source_type).alias("source_type"), "source_ref", F.decode("content", "UTF-8").alias("text"))
    return text.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def union_sources(*sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All records, and the source types that gave any: only these may lose chunks later."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out, out.select("source_type").distinct()


def check_taxonomy(specs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Skills and aliases (owner, alias, alias_norm) of specs (name, category, is_actionable, aliases), and problems.

    Every name is an alias of itself. Problems: bad category, empty or long name, a name twice, an alias with several owners.
    """
    named = specs.withColumn("name", F.trim("name"))
    skills = named.select("name", "category", "is_actionable")
    aliases = named.select(F.col("name").alias("owner"), F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array())))).alias("alias")).withColumn("alias_norm", taxonomy_normalized(F.col("alias"))).where("alias_norm <> ''")
    bad = named.select("name", F.when(F.coalesce("name", F.lit("")) == "", "no name").when(F.length("name") > 128, "name too long").when(~F.col("category").isin(*CATEGORIES), "bad category").alias("problem")).where("problem is not null")
    twice = duplicate_names(skills).select("name", F.lit("name twice").alias("problem"))
    shared = ambiguous_aliases(aliases).select(F.col("alias_norm").alias("name"), F.lit("alias of several").alias("problem"))
    return skills, aliases, bad.unionByName(twice).unionByName(shared)


def duplicate_names(skills: DataFrame) -> DataFrame:
    return skills.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ambiguous_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("alias_norm").agg(F.countDistinct("owner").alias("owners")).where("owners > 1")


def load_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The curated file: one JSON object a line (name, category, is_actionable, aliases, notes)."""
    return check_taxonomy(spark.read.schema("name string, category string, is_actionable boolean, aliases array<string>, notes string").json(path))
