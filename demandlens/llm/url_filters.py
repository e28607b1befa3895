"""URL filters by a temporal list join (operator 10): DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Host of an http or https URL: lower case, no credentials, port or trailing dot; null for other texts."""
    authority = F.regexp_extract(F.trim(url), r"(?i)^https?://([^/?#\\]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r"(:[0-9]*)?$", "")
    return F.nullif(F.regexp_replace(bare, r"\.+$", ""), F.lit(""))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (list_name, pattern, action, dated) as intervals (list_name, pattern, action, valid_from, valid_to).

    The newest entry of a list for a pattern holds until the next one; ``remove`` ends it. Of entries with the same date
    the action that sorts last holds. Repeated entries count once; entries with a null in any column are left out.
    """
    dated = entries.select("list_name", "pattern", "action", "dated").na.drop().groupBy("list_name", "pattern", "dated").agg(F.max("action").alias("action"))
    until = F.lead("dated").over(Window.partitionBy("list_name", "pattern").orderBy("dated"))
    return dated.select("list_name", "pattern", "action", F.col("dated").alias("valid_from"), until.alias("valid_to")).where("action <> 'remove'")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Per capture: id, host, fetched_at, n_active (matching entries that held at fetch time), pattern and action of the
    deciding one and kept.

    An entry matches a host that is its pattern or ends with a dot and it. Of the entries that hold, the longest pattern
    decides; of equal ones 'allow' goes before 'block'. Captures without a valid host or time match nothing and are kept
    only if they have a host. Repeated captures give repeated rows. Other columns are ignored; an empty table of captures
    gives an empty one, without entries nothing is active.

    Captures meet entries by host, not row by row: the distinct (host, time) pairs are made first with a map-side
    combine, each looks up its suffixes (an equi-join on the pattern, whose interval test is the as-of condition), and
    the verdicts join back. A hot host is thus as many rows as it has distinct times, and those joins can be split.
    """
    own = captures.select(F.col(id_col), host(F.col(url_col)).alias("host"), F.col(time_col).alias("fetched_at"))
    asked = own.where("host is not null and fetched_at is not null").select("host", "fetched_at").distinct()
    # all suffixes, down to the whole host; each is cut from its own row, so that a host of very many labels needs no array of them
    numbered = asked.select("host", "fetched_at", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))).alias("n"))
    looked_up = numbered.select("host", "fetched_at", F.expr("substring_index(host, '.', -n)").alias("pattern"))
    intervals = validity_intervals(entries)
    holds = looked_up.join(intervals, "pattern").where("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    rank = F.struct(F.length("pattern"), (F.col("action") == "allow").cast("int"), F.col("pattern"))
    verdicts = holds.groupBy("host", "fetched_at").agg(F.count(F.lit(1)).alias("n_active"), F.max_by(F.struct("pattern", "action"), rank).alias("by"))
    return own.join(verdicts, ["host", "fetched_at"], "left").select(
        id_col, "host", "fetched_at", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("by.pattern").alias("pattern"), F.col("by.action").alias("action"),
        (F.col("host").isNotNull() & (F.coalesce("by.action", F.lit("none")) != "block")).alias("kept"),
    )


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time, which the table lacks: one second a page number from 2024 on, over 30 days again and again."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 977, F.lit(2592000))).cast("timestamp").alias("fetched_at"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries derived from all pages, as the tables hold no list.

    Every distinct host and every distinct three-label suffix takes part by its MD5: a sixth of the hosts are blocked from some day on, half of those
    are removed later and a fifth of them blocked again; suffixes of advertising, betting and pill hosts are blocked from day 3; a
    seventh of the hosts are allowed from some day on by a second list.
    """
    hosts = pages.select(host(F.col("url")).alias("host")).where("host is not null").distinct().withColumn("c", F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 6), 16, 10).cast("long"))
    day = lambda d: F.timestamp_seconds(F.lit(1704067200) + d.cast("long") * 86400)
    start = F.pmod("c", F.lit(13))

    def entry(rows: DataFrame, name: str, pattern: Column, action: str, dated: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("list_name"), pattern.alias("pattern"), F.lit(action).alias("action"), day(dated).alias("dated"))

    blocked = hosts.where("c % 6 = 0")
    parts = [
        entry(blocked, "hosts", F.col("host"), "block", start),
        entry(blocked.where("c % 12 = 0"), "hosts", F.col("host"), "remove", start + 5),
        entry(blocked.where("c % 60 = 0"), "hosts", F.col("host"), "block", start + 9),
        entry(hosts.where("c % 7 = 0"), "trusted", F.col("host"), "allow", F.pmod("c", F.lit(17))),
        entry(hosts.select(F.substring_index("host", ".", -3).alias("host")).where(r"host rlike '(^|[.-])(ads|bets|pills|casino)([.-])'").distinct(), "themes", F.col("host"), "block", F.lit(3)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
