"""Exact largest inner products over vectors by falling length.

Vectors become integers, equal ones are held once, and blocks of them follow each other by falling length.  A rotation from a
singular value decomposition moves most of the length into the first coordinates.  A query meets a block unless the product of
the lengths already rules it out; inside, the sum over the first coordinates plus the product of the lengths of the rest
(Cauchy-Schwarz) bounds a score from above, and only vectors whose bound reaches the query's k-th best are multiplied out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fabsight.llm.common import durable, session
from fabsight.session import shuffle_partitions

#: Vectors of one block; queries that meet a block in one task; longest vectors that give a query its first bound; vectors
#: that the rotation is fitted on at most.
BLOCK, QUERIES, HEAD, FIT = 8_192, 262_144, 2_048, 16_384
#: Vectors that are bounded at a time, pairs that are multiplied out at a time, share of the squared length before the cut.
STEP, PAIRS, ENERGY = 1_024, 65_536, 0.75
#: Lengths from here on could give scores beyond 64 bits.
LONGEST = 2.0 ** 31
FOUND = "array<struct<score: long, id: long>>"


def integer_vectors(rows: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, norm2): floor(scale * x) of every component as little-endian 32-bit integers, and the squared length."""
    v = F.col(vec_col).cast("array<double>")
    fine = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(
        F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))

    def pack(batches):
        for b in batches:
            flat = np.floor(scale * b.column(1).flatten().to_numpy(zero_copy_only=False))
            at = np.zeros(b.num_rows + 1, dtype=np.int64)
            np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False), out=at[1:])
            norm2 = np.add.reduceat(flat * flat, at[:-1]) if len(flat) else np.zeros(0)
            kept = np.flatnonzero(norm2 < LONGEST ** 2)
            whole = [flat[at[i]:at[i + 1]].astype("<i4") for i in kept]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), pa.array([w.tobytes() for w in whole], pa.binary()),
                                              pa.array([int((w.astype(np.int64) ** 2).sum()) for w in whole], pa.int64())], names=["id", "v", "norm2"])

    return fine.mapInArrow(pack, "id long, v binary, norm2 long")


def matrix(column) -> np.ndarray:
    values = list(column)
    return np.frombuffer(b"".join(values), dtype="<i4").reshape(len(values), -1).astype(np.int64)


class Rotation:
    """An orthogonal change of coordinates, and where it is cut."""

    def __init__(self, points: np.ndarray):
        # the right singular vectors of the points are those of their products; no matrix of the size of the points is made
        _, spread, axes = np.linalg.svd(points.T.astype(np.float64) @ points)
        self.axes, energy = axes.T, np.cumsum(spread)
        self.cut = int(min(np.searchsorted(energy, ENERGY * energy[-1]) + 1, points.shape[1]))

    def parts(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First coordinates, length of the rest, whole length."""
        turned = vectors @ self.axes
        return turned[:, :self.cut], np.sqrt((turned[:, self.cut:] ** 2).sum(1)), np.sqrt((turned ** 2).sum(1))


def products(queries: np.ndarray, vectors: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs."""
    out = np.empty(len(r), dtype=np.int64)
    for s in range(0, len(r), PAIRS):
        out[s:s + PAIRS] = (queries[r[s:s + PAIRS]] * vectors[c[s:s + PAIRS]]).sum(1)
    return out


class Block:
    """Vectors by falling length, with the parts that bound their products."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], rotation: Rotation):
        self.rotation = rotation
        order = np.argsort(-(vectors ** 2).sum(1), kind="stable")
        self.vectors, self.ids = vectors[order], [ids[i] for i in order]
        self.least = np.array([i[0] for i in self.ids], dtype=np.int64)
        self.front, self.rest, self.norm = rotation.parts(self.vectors)
        self.bounded = self.multiplied = 0

    def search(self, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score): the k best vectors of each query that score ``floor`` or more; ties to the smaller first id."""
        front, rest, norm = self.rotation.parts(queries)
        low, r, c, score = floor.astype(np.float64), *(np.zeros(0, dtype=np.int64) for _ in range(3))
        s, step = 0, 4 * k
        while s < len(self.vectors):
            part = slice(s, s + step)
            # doubles carry 53 bits: a bound gives way by far more than its rounding
            live = np.flatnonzero(norm * self.norm[s] * (1 + 1e-9) + 1 >= low)
            if not len(live):
                break
            bound = front[live] @ self.front[part].T + rest[live, None] * self.rest[None, part]
            slack = 1e-9 * norm[live, None] * self.norm[None, part] + 1
            i, j = np.nonzero(bound + slack >= low[live, None])
            self.bounded, self.multiplied = self.bounded + bound.size, self.multiplied + len(i)
            i, j, s, step = live[i], j + s, s + step, min(2 * step, STEP)  # short steps first, until a query has its k best to beat
            exact = products(queries, self.vectors, i, j)
            fits = exact >= floor[i]
            r, c, score = np.concatenate([r, i[fits]]), np.concatenate([c, j[fits]]), np.concatenate([score, exact[fits]])
            order = np.lexsort((self.least[c], -score, r))
            r, c, score = r[order], c[order], score[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            full = place == k - 1
            low[r[full]] = np.maximum(low[r[full]], score[full])
            keep = place < k
            r, c, score = r[keep], c[keep], score[keep]
        return r, c, score


def _blocks(usable: DataFrame, k: int) -> DataFrame:
    """(block, v, norm2, ids): different vectors, the k smallest ids of each, in blocks by falling length."""
    first = Window.partitionBy("v").orderBy("id")
    few = usable.withColumn("nth", F.dense_rank().over(first)).where(F.col("nth") <= k)
    held = durable(few.groupBy("v", "norm2").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    parts = max(1, -(-held.count() // BLOCK))
    return durable(held.repartitionByRange(parts, F.desc("norm2"), "v").withColumn("block", F.spark_partition_id()))


def top_products(rows: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner product of floor(scale * x), exact, ties to the smaller id.

    A query never finds a row of its own id; all others come back if there are fewer than ``k``.  Zero vectors take part.  Null and
    empty vectors, those with null or non-finite components, those of another length than most rows have, those so long that
    a score might not fit 64 bits (2^31 after scaling) and null ids take no part; a repeated row counts once; other columns are
    ignored; no rows or no queries give no rows.

    Only the k + 1 smallest ids of equal vectors can be among the k best of a query, so no more are held; equal queries are
    searched once.  The rotation is fitted on at most ``FIT`` vectors and decides the work only, not the result.
    """
    spark = session(rows.sparkSession)
    usable = integer_vectors(rows, scale, id_col, vec_col)
    most = usable.groupBy(F.length("v").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index = _blocks(usable.where(F.length("v") == most.bytes), k + 1)
    asking = durable(integer_vectors(queries, scale, id_col, vec_col).where(F.length("v") == most.bytes).select("id", "v").distinct())
    asked = durable(asking.groupBy("v").agg(F.min("id").alias("query")))
    rotation = Rotation(matrix(r.v for r in index.orderBy(F.xxhash64("v"), "v").limit(FIT).select("v").collect()))
    longest = index.orderBy(F.desc("norm2"), "v").limit(HEAD).select("v", "ids").collect()
    head = matrix(r.v for r in longest), [r.ids for r in longest]
    # two numbers for every BLOCK vectors
    norms = np.array(sorted((r.block, r.longest) for r in index.groupBy("block").agg(F.max("norm2").alias("longest")).collect()), dtype=np.float64).reshape(-1, 2)

    shares = max(1, -(-asked.count() // QUERIES))

    def route(batches):
        """A row for each block that may hold one of a query's best, with the score to reach."""
        first = Block(*head, rotation)
        for b in batches:
            q = matrix(b.column(0).to_pylist())
            floor = np.full(len(q), -(2 ** 62), dtype=np.int64)
            r, c, score = first.search(q, floor, k + 1)
            last = np.searchsorted(r, np.arange(len(q)), side="right") - 1
            full = np.bincount(r, minlength=len(q)) == k + 1
            floor[full] = score[last[full]]
            i, j = np.nonzero(np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(norms[None, :, 1]) * (1 + 1e-9) + 1 >= floor[:, None])
            take = pa.array(i, pa.int64())
            share = b.column(1).to_numpy()[i] % shares
            yield pa.RecordBatch.from_arrays([pa.array(norms[j, 0].astype(np.int64) * shares + share), pa.array(np.ones(len(i), dtype=np.int32)), b.column(0).take(take),
                                              b.column(1).take(take), pa.array(floor[i]), pa.nulls(len(i), pa.list_(pa.int64()))],
                                             names=["block", "kind", "v", "query", "floor", "ids"])

    def meet(batches):
        """Blocks one after another: first the vectors of a block, then its queries as a stream."""
        current, vectors, ids, block = None, [], [], None
        for b in batches:
            kinds = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), b.num_rows]
            for x, y in zip(edges, edges[1:]):
                if x == y:
                    continue
                part = b.slice(x, y - x)
                if current != kinds[x] // 2:
                    current, vectors, ids, block = kinds[x] // 2, [], [], None
                if kinds[x] % 2 == 0:
                    vectors += part.column(2).to_pylist()
                    ids += part.column(5).to_pylist()
                    continue
                block = block or Block(matrix(vectors), ids, rotation)
                r, c, score = block.search(matrix(part.column(2).to_pylist()), part.column(4).to_numpy(), k + 1)
                sizes = np.array([len(block.ids[j]) for j in c], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column(3).take(pa.array(np.repeat(r, sizes))), pa.array(np.repeat(score, sizes)),
                                                  pa.array([i for j in c for i in block.ids[j]], pa.int64())], names=["query", "score", "id"])

    dealt = index.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    held = dealt.select((F.col("block").cast("long") * shares + F.col("share")).alias("block"), F.lit(0).alias("kind"), "v", F.lit(None).cast("long").alias("query"), F.lit(None).cast("long").alias("floor"), "ids")
    routed = asked.select("v", "query").repartition(shuffle_partitions(spark)).mapInArrow(
        route, "block long, kind int, v binary, query long, floor long, ids array<long>")
    met = held.unionAll(routed).repartition(max(4 * len(norms) * shares, shuffle_partitions(spark)), "block").sortWithinPartitions("block", "kind")
    found = met.mapInArrow(meet, "query long, score long, id long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("nth", "score", "id"))).alias("best"))
    answers = asking.withColumnRenamed("id", "query_id").join(asked.join(best, "query").select("v", "best"), "v")
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others)).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("vec_id"), F.col("col.score").alias("score"))
