"""Reports over any window of days from sketches that are stored by day.

A day's rows are read once; windows merge small sketches, so a month costs days and keys, not rows. Every aggregate is
mergeable, so a hot key is combined before the shuffle and takes bounded memory, unlike an exact percentile or distinct
count. Quantiles come from KLL sketches, distinct counts from HyperLogLog.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a KLL sketch keeps on its largest level. A quantile's true rank is off by less than 2.296 / K ** 0.9021 with a
#: probability of 99 %, about 0.0193 here.
K = 200
#: Bits of a HyperLogLog's registers' number: the relative standard error is 1.04 / 2 ** (LG_K / 2), about 0.0163 here.
LG_K = 12


def rank_error(k: int = K) -> float:
    return 2.296 / k**0.9021


def relative_error(lg_k: int = LG_K) -> float:
    """One standard error."""
    return 1.04 / math.sqrt(1 << lg_k)


def daily_quantiles(rows: DataFrame, key: str, value: str, at: str, k: int = K) -> DataFrame:
    """Per key and day: n, the sketch of the values, least and most. Null values and times are left out."""
    known = rows.where(F.col(value).isNotNull() & F.col(at).isNotNull())
    number = F.col(value).cast("double")
    return known.groupBy(key, F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(number, k).alias("sketch"), F.min(number).alias("least"), F.max(number).alias("most"))


def quantiles(daily: DataFrame, key: str, at: Mapping[str, float], start: object = None, end: object = None, k: int = K) -> DataFrame:
    """Per key, over the days from ``start`` to before ``end`` (all by default): n, least, most and the quantiles named in ``at``."""
    own = _window(daily, start, end).groupBy(key).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return own.select(key, "n", "least", "most", *(F.kll_sketch_get_quantile_double("sketch", F.lit(q).cast("double")).alias(name) for name, q in at.items()))


def daily_distinct(rows: DataFrame, key: str, counted: str, at: str, conditions: Mapping[str, Column] | None = None, lg_k: int = LG_K) -> DataFrame:
    """Per key and day: n rows and a sketch ``distinct`` of the values of ``counted``, and for each condition the same of the
    rows that meet it (n_<name>, <name>). Null keys and times are left out; null values count for nothing."""
    known = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(counted, lg_k).alias("distinct")]
    for name, condition in (conditions or {}).items():
        aggs += [F.count_if(condition).alias(f"n_{name}"), F.hll_sketch_agg(F.when(condition, F.col(counted)), lg_k).alias(name)]
    return known.groupBy(key, F.to_date(at).alias("day")).agg(*aggs)


def distinct_counts(daily: DataFrame, key: str, start: object = None, end: object = None) -> DataFrame:
    """Per key, over the days from ``start`` to before ``end``: sums of the row counts and, for each sketch, the estimated
    number of distinct values. A union of days has the registers of one sketch over all their rows."""
    sketches = [c for c, kind in daily.dtypes if kind == "binary"]
    counts = [c for c, kind in daily.dtypes if kind == "bigint" and c != key]
    aggs = [F.sum(c).alias(c) for c in counts] + [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in sketches]
    return _window(daily, start, end).groupBy(key).agg(*aggs)


def _window(daily: DataFrame, start: object, end: object) -> DataFrame:
    if start is not None:
        daily = daily.where(F.col("day") >= F.lit(start).cast("date"))
    return daily if end is None else daily.where(F.col("day") < F.lit(end).cast("date"))
