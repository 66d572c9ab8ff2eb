"""Two tables dealt in blocks of bounded size, so that every pair of blocks meets once, in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def block_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_size: Column, right_size: Column, most: int):
    """Both tables, grouped by pairs of their hash blocks, for a function of two frames (``cogroup``).

    ``left_size`` and ``right_size`` are the sizes of a row, ``most`` that of a block.  Comparing everything with everything is
    quadratic; here a task holds two blocks, no pair of rows is ever shuffled and nothing passes through the driver.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism

    def number(df: DataFrame, size: Column) -> int:
        """Enough blocks for their size and for all cores."""
        total = df.agg(F.sum(size)).first()[0] or 0
        return max(math.ceil(total / most), math.isqrt(cores))

    n, m = number(left, left_size), number(right, right_size)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    a = left.select("*", F.pmod(F.xxhash64(left_id), F.lit(n)).alias("_i"), every(m).alias("_j"))
    b = right.select("*", F.pmod(F.xxhash64(right_id), F.lit(m)).alias("_j"), every(n).alias("_i"))
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j"))
