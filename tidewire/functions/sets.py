"""Set similarity over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared over all distinct elements; ``empty`` if there are none."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.when(union > 0, union))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays in double precision; 0 for different lengths, norms of 0 count as 1."""
    number = lambda x: x.cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: number(v) * number(v))))
    one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    dot = total(F.zip_with(a, b, lambda x, y: number(x) * number(y)))
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(dot / (one(norm(a)) * one(norm(b))))
