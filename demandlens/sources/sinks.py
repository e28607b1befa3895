"""Metrics, reports and payloads on their way out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_rows(df: DataFrame, run_id: str, stage: str | Column, metrics: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """One row for each metric column of each row."""
    pairs = F.explode(F.map_from_arrays(F.array(*(F.lit(m) for m in metrics)), F.array(*(F.col(m).cast("decimal(18,6)") for m in metrics))))
    marked = F.create_map(*(F.lit(x) for kv in (labels or {}).items() for x in kv)) if labels else F.create_map().cast("map<string,string>")
    return df.select(F.lit(run_id).alias("run_id"), (stage if isinstance(stage, Column) else F.lit(stage)).alias("stage"), pairs.alias("metric", "value"), marked.alias("labels")).withColumn("recorded_at", F.current_timestamp())


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("stage").parquet(path)


def write_shortlist(rows: DataFrame, path: str) -> None:
    """Replaces the run's own partition only; other runs stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def report_json(report: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object a row, doubles rounded to 4 places."""
    kinds = dict(report.dtypes)
    return report.select(F.to_json(F.struct(*(F.round(c, 4).alias(c) if kinds[c] == "double" else F.col(c) for c in columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_report(report: DataFrame, path: str, columns: list[str]) -> None:
    report_json(report, columns).write.mode("overwrite").text(path)


def cell(c: Column) -> Column:
    """Text that can stand in a Markdown table."""
    return F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "), F.lit("|"), F.lit("\\|"))


def markdown_table(rows: DataFrame, columns: list[str], order: list[Column], limit: int = 50) -> DataFrame:
    """One row with a Markdown table of the first ``limit`` rows."""
    top = rows.orderBy(*order).limit(limit)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.col(c)) for c in columns)), F.lit(" |"))
    numbered = top.select(line.alias("line")).withColumn("n", F.monotonically_increasing_id()).coalesce(1)
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return numbered.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")).alias("markdown"))


def to_payload(df: DataFrame) -> DataFrame:
    """All columns as one JSON object in ``payload``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("payload"))
