"""Column expressions over embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; null when either vector is null or all zero, or when the lengths differ."""
    size = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.when(F.size(a) == F.size(b), _dot(a, b) / F.nullif(size, F.lit(0.0)))
