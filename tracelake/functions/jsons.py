"""JSON text columns: objects as maps of texts, falling back to the plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, non_blank


def json_object(c: Column | str) -> Column:
    """The top-level entries of a JSON object as texts (nested values as JSON); NULL for anything else."""
    c = as_col(c)
    return F.when(F.ltrim(c).startswith("{"), F.from_json(c, "map<string,string>"))


def get(obj: Column | str, key: str) -> Column:
    return F.try_element_at(as_col(obj), F.lit(key))


def get_filled(obj: Column | str, *keys: str) -> Column:
    """The first value that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(get(obj, k), F.lit("")) for k in keys])


def json_or_text(c: Column | str) -> Column:
    """NULL for nothing and for "null"; otherwise the stripped text (valid JSON or not)."""
    c = as_col(c)
    return F.when(c.isin("", "null"), None).otherwise(non_blank(c))


def is_json(c: Column | str) -> Column:
    """Whether the whole text is JSON (the parser alone would let words after a number pass)."""
    c = as_col(c)
    closed = c.rlike(r'(?s)^\s*(?:\{.*\}|\[.*\]|".*"|true|false|null|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*$')
    return closed & F.try_parse_json(c).isNotNull()


def first_object(c: Column | str) -> Column:
    """The widest {...} span of a model's reply, NULL if there is none or it isn't JSON."""
    span = F.nullif(F.regexp_extract(as_col(c), r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(is_json(span), span)


def first_array(c: Column | str) -> Column:
    span = F.nullif(F.regexp_extract(as_col(c), r"(?s)\[.*\]", 0), F.lit(""))
    return F.when(is_json(span), span)
