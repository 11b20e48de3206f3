"""Vector arithmetic on arrays, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets held as arrays; 1 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / u)
