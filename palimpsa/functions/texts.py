"""Small text functions with Unicode whitespace, sentences and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsa.functions.patterns import NOT_WS, SENTENCE_BREAK, WORD, WS_CHARS


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(NOT_WS)


def sentences(text: Column) -> Column:
    """Split after . ! ? followed by whitespace; empty pieces are dropped."""
    pieces = F.transform(F.split(strip(text), SENTENCE_BREAK, -1), strip)
    return F.filter(pieces, lambda s: s != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def capital_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def starts_upper(text: Column) -> Column:
    first = F.substring(text, 1, 1)
    return (F.upper(first) == first) & (F.lower(first) != first)


def escape_markup(text: Column) -> Column:
    """Ampersand first, so entities are not escaped twice."""
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def file_extension(filename: Column) -> Column:
    """Lower-cased suffix from the last dot, dot included; empty without a dot."""
    return F.lower(F.regexp_extract(filename, r"(?s)(\.[^.]*)\z", 1))
