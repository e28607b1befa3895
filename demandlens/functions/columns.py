"""Scalar functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def ilike_any(c: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.ilike(p)
    return out


def ranked(c: Column, values: dict[str, float]) -> Column:
    """A literal for each value of ``c``; null for others."""
    out = None
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


@pandas_udf(T.StringType())
def _nfkd_folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@pandas_udf(T.StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


@pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def accents_folded(c: Column) -> Column:
    """Compatibility forms without combining marks; null stays null."""
    return _nfkd_folded(c)


def identity_normalized(c: Column) -> Column:
    """Compatibility forms and accents folded, lower case, everything but a-z and 0-9 as one space; '' for null.

    Python only decomposes: Spark has no normal forms. ASCII strings pass through unchanged.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_nfkd_folded(c), F.lit(""))), "[^0-9a-z]+", " "))


def ascii_identity(c: Column) -> Column:
    """The same for text that is known to be ASCII, without Python."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z]+", " "))


#: Typographic characters and what they fold to; the last one goes.
_FOLD_FROM = "\u2018\u2019\u02bc\u201b\u201c\u201d\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u00a0\u200b"
_FOLD_TO = "'" * 4 + "  " + "-" * 7 + " "
_WHITE = r"\p{IsWhite_Space}\x1c-\x1f"


def taxonomy_folded(c: Column) -> Column:
    """Matching form: lower case, '&' as 'and', no apostrophes, '+', '#' and word-gluing or leading dots kept.

    A dot stays where a letter or digit follows it, and a letter, a digit, white space or nothing stands before it.
    """
    s = F.lower(F.translate(c, _FOLD_FROM, _FOLD_TO))
    s = F.regexp_replace(F.replace(s, F.lit("&"), F.lit(" and ")), "'", "")
    s = F.regexp_replace(s, rf"\.(?![\p{{L}}\p{{N}}])|(?<=[^\p{{L}}\p{{N}}{_WHITE}])\.", " ")
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"[^\p{L}\p{N}+#.]+", " "))


def taxonomy_normalized(c: Column) -> Column:
    return taxonomy_folded(_nfkc(c))


def url_host(url: Column) -> Column:
    """Lower-case host without a leading www., '' if there is none."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(F.trim(url), F.lit("HOST")), F.lit(""))), r"^www\.", "")
    return host


def url_path(url: Column) -> Column:
    """Path without trailing slashes (a lone one stays); query and fragment are no part of it."""
    path = F.coalesce(F.try_parse_url(F.trim(url), F.lit("PATH")), F.lit(""))
    return F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)


def canonical_key(given: Column, company: Column, title: Column, url: Column) -> Column:
    """The trimmed id, else a hash of normalised company, title, host and path with nothing between them."""
    own = F.nullif(F.trim(given), F.lit(""))
    return F.coalesce(own, F.sha2(F.concat(company, title, url_host(url), url_path(url)), 256))


#: Feed categories and the role types that they stand for.
ROLE_BY_CATEGORY = {
    "software": "swe",
    "software engineering": "swe",
    "ai/ml/data": "ai_ml_data",
    "data science, ai & machine learning": "ai_ml_data",
    "hardware": "hardware",
    "quant": "quant",
    "quantitative finance": "quant",
    "product": "pm",
    "product management": "pm",
}


def role_type(category: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLE_BY_CATEGORY.items() for x in pair))
    return F.when(F.nullif(category, F.lit("")).isNotNull(), F.coalesce(F.try_element_at(names, F.lower(F.trim(category))), F.lit("other")))


def is_remote(locations: Column) -> Column:
    # The words that say so.
    return F.coalesce(F.exists(locations, lambda x: F.coalesce(x.rlike(r"(?i)\bremote\b|\bwork from home\b|\bwfh\b|\banywhere\b"), F.lit(False))), F.lit(False))


def start_season(*texts: Column) -> Column:
    """'Summer 2027' from season and year in either order, else a year from 2020 to 2049 alone, of the first text that gives
    one; else null. Compatibility forms are folded first, so a no-break space is a blank."""
    # The names of seasons, what may stand between a name and a year, and the years.
    names, gap = "(spring|summer|fall|autumn|winter)", r"\b[\s,'’-]*\b"
    found = []
    for text in map(_nfkd, texts):
        first = [F.regexp_extract(text, rf"(?i)\b{names}{gap}(20\d{{2}})\b", i) for i in (1, 2)]
        second = [F.regexp_extract(text, rf"(?i)\b(20\d{{2}}){gap}{names}\b", i) for i in (2, 1)]
        for season, year in (first, second):
            found.append(F.when(season != "", F.concat_ws(" ", F.when(F.lower(season) == "autumn", F.lit("Fall")).otherwise(F.initcap(season)), year)))
        found.append(F.nullif(F.regexp_extract(text, r"\b(20[2-4]\d)\b", 1), F.lit("")))
    return F.coalesce(*found)


def epoch_timestamp(c: Column) -> Column:
    """Unix seconds as a timestamp; null for zero, negative and unreadable values and those that no timestamp holds.

    Decimals, as a double of microseconds is a second off from the year 20237 on.
    """
    seconds = c.try_cast("decimal(38,18)")
    micros = (seconds * 1_000_000).try_cast("long")
    return F.when(seconds > 0, F.timestamp_micros(micros))


def collapsed(c: Column) -> Column:
    """Runs of blanks as one, no blanks at line ends, at most one empty line between lines, no white space around."""
    s = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t\x0B\f ]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def inline_collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def token_estimate(c: Column) -> Column:
    n = F.coalesce(F.length(c), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4)).cast("int"))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    return (tokens_in * rate_in + tokens_out * rate_out) / 1e6


def has_boost_location(locations: Column, terms: Sequence[str]) -> Column:
    return F.coalesce(F.exists(locations, lambda x: ilike_any(x, [f"%{t.strip()}%" for t in terms if t.strip()])), F.lit(False))


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0d, (s, x) -> s + x)")


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def literal(text: str) -> str:
    """A pattern for just this text."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def has_phrase(text: Column, phrase: str) -> Column:
    """The phrase with no letter or digit beside it."""
    return F.coalesce(text.rlike(r"(?i)(?<![a-z0-9])" + literal(phrase) + "(?![a-z0-9])"), F.lit(False))


def shortened(c: Column, n: int) -> Column:
    """White space collapsed; beyond n characters cut to n with an ellipsis as the last one."""
    flat = inline_collapsed(c)
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))).otherwise(flat)


def title_parts(title: Column, host: Column) -> tuple[Column, Column]:
    """Title before its last separator, and a company name from the host's labels."""
    shown = F.regexp_extract(title, r"^(.*\S)\s+[|–—-]\s+\S.*$", 1)
    labels = F.filter(F.split(host, r"\."), lambda x: ~x.isin("www", "jobs", "careers", "apply", "boards", "m", "blog"))
    company = F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(F.try_element_at(labels, F.lit(1)))
    return F.when(shown != "", shown).otherwise(F.trim(title)), company


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def flexible_date(c: Column) -> Column:
    """ISO, m/d/y, 'May 2026' and bare years as (year, month, day); missing parts null."""
    iso = [F.regexp_extract(c, r"(\d{4})-(\d{1,2})(?:-(\d{1,2}))?", i) for i in (1, 2, 3)]
    us = [F.regexp_extract(c, r"(\d{1,2})/(?:(\d{1,2})/)?(\d{4})", i) for i in (3, 1, 2)]
    word = [F.regexp_extract(c, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{4})", i) for i in (2, 1)]
    year = F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1)
    num = lambda x: F.nullif(x, F.lit("")).try_cast("int")
    month = F.create_map(*(F.lit(x) for i, m in enumerate(_MONTHS, 1) for x in (m, i)))
    made = lambda y, m, d: F.struct(y.alias("year"), m.alias("month"), d.alias("day"))
    none = F.lit(None).cast("int")
    return (
        F.when(iso[0] != "", made(*map(num, iso)))
        .when(us[0] != "", made(*map(num, us)))
        .when(word[0] != "", made(num(word[0]), F.try_element_at(month, F.lower(word[1])), none))
        .when(year != "", made(num(year), none, none))
    )


def date_range(c: Column) -> tuple[Column, Column]:
    """Start and end of 'Jun. 2026 – Aug. 2026'; a lone date is the end."""
    parts = F.split(c, r"\s+(?:–|—|-|to)\s+")
    return F.when(F.size(parts) > 1, flexible_date(parts[0])), flexible_date(F.element_at(parts, -1))


def label_text(labels: Column) -> Column:
    """``text``, else ``summary`` of a JSON object."""
    return F.coalesce(F.get_json_object(labels, "$.text"), F.get_json_object(labels, "$.summary"))


def text_or_fallback(text: Column, company: Column, title: Column) -> tuple[Column, Column]:
    present = F.coalesce(F.trim(text) != "", F.lit(False))
    return F.when(present, text).otherwise(F.concat_ws("\n", company, title)), present
