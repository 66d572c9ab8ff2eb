"""Approximate nearest neighbours by an inverted multi-index.

Two codebooks quantise the halves of a vector; a cell of the index is a pair of centroids.  A query walks the cells in order
of the summed nearness of their centroids, with a heap over the two sorted lists, until the cells it has met hold the wanted
share of the index; the vectors in them are ranked by the exact measure.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fabsight.llm.common import durable, session
from fabsight.llm.vectors import comparable, matrix, packed, sample

#: Vectors the codebooks are fitted on at most, centroids of a half, share of the index that a query visits.
FIT, CENTROIDS, VISIT = 16_384, 64, 0.5
#: Index rows and queries that meet in one task.
ROWS, QUERIES = 16_384, 4_096


def codebook(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's iterations; empty ones move to the points that are worst represented."""
    draw = np.random.default_rng(seed)
    centers = points[draw.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        apart = (centers ** 2).sum(1)[None, :] - 2 * points @ centers.T
        own = apart.argmin(1)
        counts = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
        if not full.all():
            far = np.argsort(-(apart[np.arange(len(points)), own] + (points ** 2).sum(1)))
            centers[~full] = points[far[:int((~full).sum())]]
    return centers


def nearest_centroid(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers ** 2).sum(1)[None, :] - 2 * points @ centers.T).argmin(1)


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Cells by falling sum of the halves' scores until they hold ``wanted`` vectors; empty cells are passed over."""
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    x, y = left[a], right[b]
    heap, reached, cells, held = [(-(x[0] + y[0]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        n = sizes[a[i], b[j]]
        if n:
            cells.append((int(a[i]), int(b[j])))
            held += n
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in reached:
                reached.add((p, q))
                heapq.heappush(heap, (-(x[p] + y[q]), p, q))
    return cells


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, allowed: np.ndarray, k: int):
    """(query, id, score) of the k best allowed vectors of each query: by exact score, ties to the smaller id."""
    out = []
    for s in range(0, len(queries), 256):
        q = queries[s:s + 256]
        rough = q @ vectors.T
        rough[~allowed[s:s + 256] | (query_ids[s:s + 256, None] == ids[None, :])] = -np.inf
        last = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
        # equal vectors may differ in the last bits of a product; these are taken along and summed in one fixed order
        r, c = np.nonzero((rough >= (last - 1e-9 * (1 + np.abs(np.where(np.isfinite(last), last, 0))))[:, None]) & np.isfinite(rough))
        exact = (q[r] * vectors[c]).sum(axis=1)
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < k
        out.append((query_ids[s:s + 256][r[keep]], ids[c[keep]], exact[keep]))
    return [np.concatenate(x) for x in zip(*out)]


def search(rows: DataFrame, queries: DataFrame, k: int = 20, visit: float = VISIT, centroids: int = CENTROIDS, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query by inner product, ties to the smaller id.

    A query never finds a row of its own id.  All candidates come back if there are fewer than ``k``.  Null, empty and zero
    vectors, vectors with null or non-finite components, those of another length than most and null ids take no part; a
    repeated row counts once; other columns are ignored; no rows or no queries give no rows.

    Only the k + 1 smallest ids of equal vectors can be among the k nearest, so the index holds no more of them; they are cut
    before the shuffle.  Codebooks are fitted on at most ``FIT`` vectors; every row is in the index.
    """
    spark = session(rows.sparkSession)
    usable = packed(comparable(rows, id_col, vec_col).where("id IS NOT NULL"))
    points = sample(usable, FIT)
    size = points.shape[1]
    if not len(points):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    half = max(1, size // 2)
    books = [codebook(p, centroids, 5 + i) for i, p in enumerate((points[:, :half], points[:, half:]))]
    first = Window.partitionBy("v").orderBy("id")
    index = usable.where(F.length("v") == size * 8).withColumn("nth", F.dense_rank().over(first)).where(F.col("nth") <= k + 1).dropDuplicates(["v", "id"])

    def assign(batches):
        for b in batches:
            m = matrix(b.column(1).to_pylist())
            cells = [nearest_centroid(m[:, :half], books[0]), nearest_centroid(m[:, half:], books[1])] if len(m) else [[], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int32()) for c in cells)], names=["id", "v", "c1", "c2"])

    index = durable(index.select("id", "v").mapInArrow(assign, "id long, v binary, c1 int, c2 int"))
    sizes = np.zeros((len(books[0]), len(books[1])), dtype=np.int64)
    for r in index.groupBy("c1", "c2").count().collect():  # at most centroids * centroids rows
        sizes[r.c1, r.c2] = r["count"]
    wanted = max(visit * sizes.sum(), k + 1)
    salts = np.maximum(1, -(-sizes.sum(axis=1) // ROWS)).tolist()

    def plan(batches):
        """A row for each list of the index that a query visits, with the cells of that list."""
        for b in batches:
            m = matrix(b.column(1).to_pylist())
            out = []
            for i in range(len(m)):
                lists: dict[int, list[int]] = {}
                for c1, c2 in walk(m[i, :half] @ books[0].T, m[i, half:] @ books[1].T, sizes, wanted):
                    lists.setdefault(c1, []).append(c2)
                out += [(i, c1, salt, c2) for c1, c2 in lists.items() for salt in range(salts[c1])]
            take = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array([o[j] for o in out], t) for j, t in (
                (1, pa.int32()), (2, pa.int32()), (3, pa.list_(pa.int32()))))], names=["id", "v", "c1", "salt", "cells"])

    asked = packed(comparable(queries, id_col, vec_col).where("id IS NOT NULL")).where(F.length("v") == size * 8).dropDuplicates(["id", "v"])
    chunks = durable(asked)
    parts = max(1, -(-chunks.count() // QUERIES))
    # the walk is work for every query: spread, however small the table
    lists = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").mapInArrow(plan, "id long, v binary, c1 int, salt int, cells array<int>")
    lists = lists.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    # a long list is dealt in blocks, and meets its queries in chunks
    salted = F.element_at(F.array(*[F.lit(s) for s in salts]), F.col("c1") + 1)
    blocks = (index.withColumn("salt", F.pmod(F.xxhash64("id"), salted).cast("int"))
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))

    def rank(block, asking):
        import pandas as pd

        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(block) or not len(asking):
            return empty
        visits = np.zeros((len(asking), len(books[1])), dtype=bool)
        for i, cells in enumerate(asking["cells"]):
            visits[i, np.asarray(cells, dtype=np.int64)] = True
        q, v, s = best(asking["id"].to_numpy(), matrix(asking["v"]), block["id"].to_numpy(), matrix(block["v"]), visits[:, block["c2"].to_numpy()], k)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    key = ["c1", "salt", "part"]
    found = blocks.groupBy(*key).cogroup(lists.groupBy(*key)).applyInPandas(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
