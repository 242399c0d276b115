"""Vectors as ARRAY<FLOAT> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.columns import col


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision, the cosine of unit vectors."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """v over its Euclidean norm; a zero vector stays."""
    norm = F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(col(v), lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))
