"""Small helpers for expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def share(part: Column | str, whole: Column | str) -> Column:
    """Percentage to one decimal; null if either is null or the whole is 0."""
    return F.round(100 * F.try_divide(col(part), F.nullif(col(whole), F.lit(0))), 1)


def json_or_null(text: Column | str, schema: str) -> Column:
    """Tolerant parse: corrupt JSON is null."""
    return F.from_json(col(text), schema, {"mode": "PERMISSIVE"})


def json_inside(text: Column | str, schema: str) -> Column:
    """The JSON object between the first { and the last } of a text."""
    return json_or_null(F.regexp_extract(col(text), r"(?s)(\{.*\})", 1), schema)
