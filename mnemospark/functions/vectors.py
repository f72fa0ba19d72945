"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, other lengths, a zero norm or a null."""
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(ok & (norms > 0), dot(a, b) / norms), F.lit(0.0))


def unit(v: Column) -> Column:
    """Scaled to length one; null where that can't be."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(doubles(v), lambda x: x / norm))
