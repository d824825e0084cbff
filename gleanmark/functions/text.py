"""Text, number and markup expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest title, in code points, and the title of a page without one.
TITLE_LENGTH, UNTITLED = 64, "untitled page"


def clean(value: Column) -> Column:
    """Without addresses, white space collapsed; '' for null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "https?://[^\\s<>\"）)]+", ""), "\\s+", " "))


def escape_html(value: Column) -> Column:
    """The five special characters as entities, the ampersand first; '' for null."""
    out = F.coalesce(value, F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def composed(value: Column) -> Column:
    """Canonical composition (NFC), which Spark has no function for."""

    def nfc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    return F.pandas_udf(nfc, "string")(value)


def safe_title(value: Column) -> Column:
    """A title that can name a file: composed, no path, control or direction marks, at most 64 code points, no closing dot or
    space."""
    bare = F.regexp_replace(F.coalesce(composed(value), F.lit("")), '[<>:"/\\\\|?*\\x00-\\x1f\\x7f\\u202a-\\u202e\\u2066-\\u2069]', " ")
    cut = F.substring(F.trim(F.regexp_replace(bare, "\\s+", " ")), 1, TITLE_LENGTH)
    short = F.regexp_replace(cut, "[. ]+$", "")
    return F.when(short == "", F.lit(UNTITLED)).otherwise(short)


def metric(label: Column, shown: Column) -> Column:
    """``struct<value, raw, approximate>`` of a count as shown: the label where it has a digit, else the text.

    A number with an optional unit (thousands, millions, billions, 万, 亿; a Latin unit must end its word). Without a
    number the value is null; a lone comma is no number.
    """
    raw = F.trim(F.when(label.rlike("\\d"), label).otherwise(F.coalesce(F.when(shown != "", shown), label, F.lit(""))))
    pattern = "(?i)(-?\\d[\\d,]*(?:\\.\\d+)?)\\s*(?:(万|亿)|([kmb])(?:[^a-z]|$))?"
    number = F.regexp_replace(F.regexp_extract(raw, pattern, 1), ",", "")
    unit = F.lower(F.concat(F.regexp_extract(raw, pattern, 2), F.regexp_extract(raw, pattern, 3)))
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).when(unit == "万", 1e4).when(unit == "亿", 1e8).otherwise(1.0)
    return F.struct(F.when(number != "", number.cast("double") * factor).alias("value"), raw.alias("raw"), (unit != "").alias("approximate"))


def matches_words(text: Column, words: Column) -> Column:
    """Whether ``text`` holds all words of a query: ASCII words whole, others as substrings; blank queries match all."""
    low = F.lower(F.coalesce(text, F.lit("")))
    terms = F.filter(F.split(F.lower(F.coalesce(words, F.lit(""))), "\\s+"), lambda t: t != "")

    def holds(t: Column) -> Column:
        whole = F.concat(F.lit("(^|[^a-z0-9_])\\Q"), t, F.lit("\\E([^a-z0-9_]|$)"))
        return F.when(t.rlike("^[\\x00-\\x7f]+$") & t.rlike("^[a-z0-9_]+$"), F.rlike(low, whole)).otherwise(F.contains(low, t))

    return F.forall(terms, holds)


def static_text(html: Column) -> Column:
    """Text of markup without scripts, styles, comments and tags; what a layout hides can't be told."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<!--.*?-->", " ")
    out = F.regexp_replace(out, "(?is)<(script|style|noscript|template)\\b.*?</\\1\\s*>", " ")
    out = F.regexp_replace(out, "(?s)<[^>]*>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def safe_markup(html: Column) -> Column:
    """Markup without active elements, event handlers, filled-in values and script or data addresses."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|iframe|object|embed|form|noscript)\\b.*?</\\1\\s*>", "")
    out = F.regexp_replace(out, "(?is)<(script|iframe|object|embed|form|base|link|meta|input|button)\\b[^>]*>", "")
    out = F.regexp_replace(out, "(?is)\\s(on\\w+|value|srcdoc|nonce)\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>]+)", "")
    return F.regexp_replace(out, "(?is)\\s(href|src|action|poster)\\s*=\\s*(\"\\s*(javascript|data):[^\"]*\"|'\\s*(javascript|data):[^']*')", "")


def links_of(html: Column) -> Column:
    """Absolute http(s) targets of links, in order, first of each."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)<a\\b[^>]*?\\shref\\s*=\\s*[\"'](https?://[^\"']+)[\"']"), 1))


def media_of(html: Column) -> Column:
    """``array<struct<kind, url>>`` of images, videos, audios and their sources with absolute addresses."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)<((?:img|video|audio|source)\\b[^>]*?\\ssrc\\s*=\\s*[\"']https?://[^\"']+)[\"']"), 1)
    one = lambda x: F.struct(F.lower(F.regexp_extract(x, "^(\\w+)", 1)).alias("kind"), F.regexp_extract(x, "(?is)src\\s*=\\s*[\"'](.*)$", 1).alias("url"))
    return F.array_distinct(F.transform(found, one))


def addresses_in(text: Column) -> Column:
    """Addresses in free text, in order, repeats kept; brackets, quotes and full-width marks end one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(https?://[^\\s<>\\[\\]\"'`，。；）)]+)"), 1)


def excerpt(title: Column, text: Column, length: int = 125) -> Column:
    """A telling line of ``text``: one with the beginning of the title, else a long one, else the first; addresses and
    copyright lines don't count. '' where there is none."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[\\r\\n]+"), clean), lambda s: (F.length(s) >= 8) & ~s.rlike("(?i)^Copyright|^版权所有"))
    head = F.substring(clean(title), 1, 15)
    with_title = F.filter(lines, lambda s: (head != "") & F.contains(s, head))
    long = F.filter(lines, lambda s: F.length(s) >= 50)
    chosen = F.coalesce(F.get(with_title, F.lit(0)), F.get(long, F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))
    return F.substring(chosen, 1, length)
