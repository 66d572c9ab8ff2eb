"""Distance-based scores over embedding tables: neighbours, centroids, cluster separation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fabsight.plans.blocks import block_pairs
from fabsight.plans.metric import distances, metric_index, nearest, packed
from fabsight.session import durable

BLOCK_BYTES = 64 << 20
#: Rows of two blocks whose distances are computed at a time.
TILE = 1_024, 4_096
#: Bytes of a block of ``silhouette``: a sum for every row and label of two blocks is held with them.
SILHOUETTE_BYTES = 16 << 20


def vector_pairs(left: DataFrame, right: DataFrame, ident: str, vector: str, extra: Sequence[str] = (), most: int = BLOCK_BYTES):
    columns = [ident, vector, *extra]
    size = 8 * F.size(vector)
    return block_pairs(left.select(*columns), right.select(*columns), ident, ident, size, size, most)


def rows_of(pdf: pd.DataFrame, vector: str) -> np.ndarray:
    return np.stack(pdf[vector].to_numpy()).astype(float)


def knn_outlier_score(queries: DataFrame, bank: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding",
                      exclude_self: bool = False) -> DataFrame:
    """Mean Euclidean distance to the ``k`` nearest bank vectors, exact; null where there is none to compare with."""
    asked = packed(queries, [F.col(ident).alias("query_id"), F.lit(None).cast("string").alias("grp")], vector, False)

    def mean(found: DataFrame) -> DataFrame:
        best = found.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= k)
        return best.groupBy(F.col("query_id").alias(ident)).agg((-F.avg("score")).alias("score"))

    means = nearest(asked, metric_index(bank, ident, vector), k, exclude_self, mean)
    return queries.select(ident).join(means, ident, "left")


def centroid_cosine_score(df: DataFrame, normal: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """1 - cosine to the mean of the normal vectors."""
    from fabsight.functions.vectors import cosine_similarity
    mean = normal.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    center = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda r: r["m"]).alias("c")).scalar()  # one vector
    with_center = df.select(ident, vector, center.alias("_c"))
    return with_center.select(ident, (1.0 - cosine_similarity(F.col(vector), F.col("_c"))).alias("score"))


def label_sums(x: np.ndarray, y: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of distances of every row of ``x`` to the rows of ``y`` of each label 0 .. n - 1; a tile of distances is held at a time."""
    out = np.zeros((len(x), n))
    for i in range(0, len(x), TILE[0]):
        for j in range(0, len(y), TILE[1]):
            # few labels of a tile have rows in it
            known, own = np.unique(at[j:j + TILE[1]], return_inverse=True)
            order = np.argsort(own, kind="stable")
            begins = np.searchsorted(own[order], np.arange(len(known)))
            out[i:i + TILE[0], known] += np.add.reduceat(distances(x[i:i + TILE[0]], y[j:j + TILE[1]][order]), begins, axis=1)
    return out


def silhouette(df: DataFrame, label: str, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Mean Euclidean silhouette. Each task adds distances per label and block; no pair leaves a task."""
    kind, lab = df.schema[ident].dataType.simpleString(), df.schema[label].dataType.simpleString()

    def scan(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(others):
            return pd.DataFrame({ident: mine[ident][:0], label: mine[label][:0], "other": mine[label][:0], "s": np.zeros(0)})
        labels, at = np.unique(others[label].to_numpy(), return_inverse=True)
        total = label_sums(rows_of(mine, vector), rows_of(others, vector), at, len(labels))
        return pd.DataFrame({ident: mine[ident].to_numpy().repeat(len(labels)), label: mine[label].to_numpy().repeat(len(labels)),
                             "other": np.tile(labels, len(mine)), "s": total.ravel()})

    sums = vector_pairs(df, df, ident, vector, [label], SILHOUETTE_BYTES).applyInPandas(scan, f"{ident} {kind}, {label} {lab}, other {lab}, s double")
    sizes = df.groupBy(F.col(label).alias("other")).agg(F.count(F.lit(1)).alias("n"))
    per = sums.groupBy(ident, label, "other").agg(F.sum("s").alias("s")).join(sizes, "other")
    own = F.col("other") == F.col(label)
    point = per.groupBy(ident, label).agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    return point.agg(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))).alias("silhouette"))


def squared_silhouette(df: DataFrame, label: str, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Mean silhouette of squared Euclidean distances, from counts, sums and squared norms per label: linear, no pairs.

    The sum of squared distances from x to a label with n vectors, sum s and sum of squared norms q is n|x|^2 - 2 x.s + q.
    A label of one vector scores 0, as in ``silhouette``.
    """
    long = df.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    per = long.groupBy(label, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    packed_sums = per.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("p"), F.sum("q").alias("q"))  # an entry per dimension
    known = packed_sums.join(sizes, label).select(F.struct(F.col(label).alias("label"), F.transform("p", lambda r: r["s"]).alias("s"), "q", "n").alias("c"))
    every = durable(known.agg(F.collect_list("c").alias("_c")))  # a row per label, as many numbers as dimensions
    x = F.col(vector).cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, w: u * w), F.lit(0.0), lambda t, u: t + u)
    rows = df.select(F.col(label).alias("_l"), x.alias("_x")).withColumn("_n", dot(F.col("_x"), F.col("_x"))).crossJoin(F.broadcast(every))
    total = lambda c: c["n"] * F.col("_n") - 2.0 * dot(F.col("_x"), c["s"]) + c["q"]
    own = F.filter("_c", lambda c: c["label"] == F.col("_l"))[0]
    a = F.when(own["n"] > 1, total(own) / (own["n"] - 1))
    b = F.array_min(F.transform(F.filter("_c", lambda c: c["label"] != F.col("_l")), lambda c: total(c) / c["n"]))
    point = rows.select(a.alias("a"), b.alias("b"))
    return point.agg(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))).alias("silhouette"))
