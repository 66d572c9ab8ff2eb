"""Array arithmetic for embeddings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def dim_violations(vec: Column, dim: int) -> Column:
    return F.count_if(F.size(vec) != dim)


def minmax(value: Column, low: Column, high: Column) -> Column:
    return F.when(high <= low, F.lit(1.0)).otherwise((value - low) / (high - low))
