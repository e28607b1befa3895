"""Feed snapshots: one JSON array a file, as records and quarantined elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ascii_identity, canonical_key, epoch_timestamp, identity_normalized, is_remote, role_type, start_season, url_host


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The elements of the feed files under a path."""
    return feed_elements(spark.read.format("binaryFile").load(path).select("path", "content"))


def feed_elements(files: DataFrame) -> DataFrame:
    """path, sha256 (of the raw bytes), pos and element (variant) of files (path, content); one that isn't a JSON array is fatal."""
    read = files.select("path", F.sha2("content", 256).alias("sha256"), F.expr("try_parse_json(decode(content, 'UTF-8'))").alias("body"))
    array = F.coalesce(F.startswith(F.expr("schema_of_variant(body)"), F.lit("ARRAY")), F.lit(False))
    checked = read.withColumn("body", F.when(array, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("path"))).cast("variant")))
    return checked.select("path", "sha256", F.posexplode(F.expr("cast(body AS array<variant>)")).alias("pos", "element"))


def lines_as_elements(lines: DataFrame, column: str) -> DataFrame:
    """pos and element of rows that hold one JSON value each (the form for large feeds)."""
    return lines.select("pos", F.expr(f"try_parse_json({column})").alias("element"))


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.expr(f"try_variant_get(element, '$.{name}', 'string')")), F.lit(""))


def map_feed_records(raw: DataFrame, ascii_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Typed records, and the elements that are no object or lack company, title or url.

    ``active`` is false where missing and also needs ``is_visible`` (true where missing). ``ascii_only`` leaves the Unicode folding of names out.
    """
    fields = {"company": _text("company_name"), "title": _text("title"), "url": _text("url")}
    typed = raw.withColumns(fields | {"ok": F.lit(True)})
    ok = F.col("company").isNotNull() & F.col("title").isNotNull() & F.col("url").isNotNull()
    norm = ascii_identity if ascii_only else identity_normalized
    places = F.filter(F.transform(F.coalesce(F.expr("try_variant_get(element, '$.locations', 'array<string>')"), F.array(F.expr("try_variant_get(element, '$.locations', 'string')"))), F.trim), lambda x: F.coalesce(x != "", F.lit(False)))
    flag = lambda n, default: F.coalesce(F.expr(f"try_variant_get(element, '$.{n}', 'boolean')"), F.lit(default))
    given = _text("id")
    good = typed.where(ok).withColumn("locations", places).select(
        *(c for c in raw.columns if c != "element"),
        canonical_key(given, norm(F.col("company")), norm(F.col("title")), F.col("url")).alias("canonical_key"),
        given.alias("source_id"), "company", "title", "url", F.nullif(url_host(F.col("url")), F.lit("")).alias("url_host"), "locations",
        _text("sponsorship").alias("sponsorship"), role_type(_text("category")).alias("role_type"), start_season(F.col("title")).alias("start_season"),
        is_remote(F.col("locations")).alias("is_remote"), epoch_timestamp(F.expr("try_variant_get(element, '$.date_posted', 'string')")).alias("posted_at"),
        (flag("active", False) & flag("is_visible", True)).alias("active"), F.col("element").alias("raw"),
    )
    return good, typed.where(~ok).select(*raw.columns)
