"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits the space again and again at the median along a random direction; vectors near a split go to both sides
(spill overlap).  Vectors are compared within leaves by their exact cosine.  A pair that meets in several leaves counts in the
first of them, so partners are summed without listing pairs; leaves give spanning links, and the components are their union.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fabsight.llm.common import durable, session
from fabsight.llm.components import connected
from fabsight.llm.simhash import spanning
from fabsight.llm.vectors import SAMPLE, comparable, matrix, packed, sample

TREES, LEAF, LEAST_SAMPLE = 6, 400, 32
#: Rows of a leaf that one task compares; a larger leaf is dealt in blocks, and every pair of blocks is a task.
BLOCK = 4096
#: Half width of the overlap, in standard deviations of the projected difference of two vectors at the threshold.
OVERLAP = 0.5


@dataclass
class Tree:
    direction: np.ndarray
    cut: np.ndarray
    below: np.ndarray  # child or ~leaf
    above: np.ndarray
    leaves: int

    def leaf_rows(self, units: np.ndarray, margin: float) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows) that the unit vectors reach, with overlap."""
        out, todo = [], [(0 if len(self.cut) else -1, np.arange(len(units)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((~node, rows))
                continue
            at = units[rows] @ self.direction[node]
            todo.append((self.below[node], rows[at <= self.cut[node] + margin]))
            todo.append((self.above[node], rows[at >= self.cut[node] - margin]))
        return out


def grow(units: np.ndarray, rows: int, seed: int) -> Tree:
    """A tree over the sample, deep enough for ``rows`` vectors as far as the sample carries."""
    draw = np.random.default_rng(seed)
    direction, cut, below, above, leaves = [], [], [], [], 0
    per_sample = rows / max(1, len(units))

    def split(members: np.ndarray) -> int:
        nonlocal leaves
        if len(members) < 2 * LEAST_SAMPLE or len(members) * per_sample <= LEAF:
            leaves += 1
            return ~(leaves - 1)
        d = draw.standard_normal(units.shape[1])
        d /= np.linalg.norm(d)
        at = units[members] @ d
        middle = float(np.median(at))
        low = at <= middle
        if low.all():  # all alike along this direction
            leaves += 1
            return ~(leaves - 1)
        node = len(cut)
        direction.append(d)
        cut.append(middle)
        below.append(0)
        above.append(0)
        below[node] = split(members[low])
        above[node] = split(members[~low])
        return node

    split(np.arange(len(units)))
    return Tree(np.array(direction), np.array(cut), np.array(below), np.array(above), max(1, leaves))


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _deal(distinct: DataFrame, forest, size: int, margin: float) -> DataFrame:
    """(leaf, rep, copies, v, leaves): a row for every leaf that a vector reaches."""

    def route(batches):
        trees = forest.value
        firsts = np.cumsum([0, *(t.leaves for t in trees)])
        for b in batches:
            keep = [i for i, v in enumerate(b.column(1).to_pylist()) if len(v) == size]
            if not keep:
                continue
            b = b.take(pa.array(keep))
            units = _units(matrix(b.column(1).to_pylist()))
            found: list[list[int]] = [[] for _ in keep]
            for first, t in zip(firsts, trees):
                for leaf, rows in t.leaf_rows(units, margin):
                    for r in rows.tolist():
                        found[r].append(int(first) + leaf)
            rows = np.repeat(np.arange(len(keep)), [len(x) for x in found])
            full = b.take(pa.array(rows))
            lists = pa.array([sorted(x) for x in found], pa.list_(pa.int32())).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f], pa.int32()), full.column(0), full.column(2), full.column(1), lists],
                                             names=["leaf", "rep", "copies", "v", "leaves"])

    return distinct.select("rep", "v", "copies").mapInArrow(route, "leaf int, rep long, copies long, v binary, leaves array<int>")


def _met_before(leaves: list[np.ndarray], leaf: int):
    """A function of row numbers (a, b): whether the pair shares a leaf before this one."""
    own = [x[x < leaf] for x in leaves]
    wide = max((len(x) for x in own), default=0)
    table = np.full((len(own), max(1, wide)), -1)
    for i, x in enumerate(own):
        table[i, :len(x)] = x

    def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        for s in range(0, len(a), 50_000):
            x, y = table[a[s:s + 50_000]], table[b[s:s + 50_000]]
            hit = np.zeros(len(x), dtype=bool)
            for k in range(x.shape[1]):
                hit |= ((y == x[:, k:k + 1]) & (x[:, k:k + 1] >= 0)).any(axis=1)
            out[s:s + 50_000] = hit
        return out

    return met


def _compare(frame, least: float):
    """Links inside a leaf, or between two of its blocks: rows (a, n) with the partners met first here, and (a, b) that span."""
    import pandas as pd

    leaf, i, j = (int(frame[c].iloc[0]) for c in ("leaf", "i", "j"))
    frame = frame.sort_values("rep")
    m = matrix(frame["v"])
    norms = np.linalg.norm(m, axis=1)
    reps, copies, block = frame["rep"].to_numpy(), frame["copies"].to_numpy(), frame["block"].to_numpy()
    met = _met_before([np.asarray(x) for x in frame["leaves"]], leaf)
    one, two = (np.flatnonzero(block == k) for k in (i, j))
    partners, ends = np.zeros(len(reps), dtype=np.int64), []
    for s in range(0, len(one), 1024):
        rows = one[s:s + 1024]
        cosine = (m[rows] @ m[two].T) / (norms[rows, None] * norms[None, two])
        a, b = np.nonzero(cosine >= least)
        a, b = rows[a], two[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        ends.append(spanning(np.minimum(a, b), np.maximum(a, b), len(reps)))
        new = ~met(a, b)
        np.add.at(partners, a[new], copies[b[new]])
        np.add.at(partners, b[new], copies[a[new]])
    ends = np.concatenate(ends) if ends else np.zeros((0, 2), dtype=np.int64)
    have = np.flatnonzero(partners)
    return pd.concat([pd.DataFrame({"a": reps[have], "b": np.int64(0), "n": partners[have]}),
                      pd.DataFrame({"a": reps[ends[:, 0]], "b": reps[ends[:, 1]], "n": np.int64(0)})])


def forest_links(rows: DataFrame, least: float = 0.95, trees: int = TREES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs with cosine >= ``least``.

    Copies of a vector are compared once and counted as often as they occur.  Null, empty, zero vectors, vectors with null or
    non-finite components, and those of another length than most, link with nothing.  Repeated rows are copies and come back
    as often; a null id is counted, and stands for a component only without another id.  Other columns are ignored; no rows
    give no rows.
    """
    spark = session(rows.sparkSession)
    all_rows = comparable(rows, id_col, vec_col)
    vectors = durable(packed(all_rows))
    distinct = durable(vectors.groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
                       .select(F.xxhash64("v").alias("rep"), "v", "first", "copies"))
    units = sample(distinct, SAMPLE)
    size = units.shape[1] * 8
    units = _units(units) if len(units) else units
    count = distinct.count()
    # a difference of two such vectors has this length; along a random direction its spread is the dimension's root smaller
    margin = OVERLAP * float(np.sqrt(2 * (1 - least)) / np.sqrt(max(1, units.shape[1])))
    forest = spark.sparkContext.broadcast([grow(units, count, 17 + t) for t in range(trees)])
    dealt = _deal(distinct, forest, size, margin)
    dealt = durable(dealt)
    # as many leaves as the bounded sample allows
    sizes = dealt.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = (dealt.join(sizes, "leaf").withColumn("block", F.pmod("rep", F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
              .select("leaf", "i", "j", "block", "rep", "copies", "v", "leaves"))
    found = durable(placed.groupBy("leaf", "i", "j").applyInPandas(lambda f: _compare(f, least), "a long, b long, n long"))
    partners = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    groups = connected(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "rep")
    named = distinct.join(partners, "rep", "left").join(groups, "rep", "left").select(
        "v", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    # vectors of another length than most are not compared, not even with their copies
    named = named.withColumn("n_links", F.when(F.length("v") == size, F.col("n_links")).otherwise(F.lit(0)))
    least_id = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least_id, "root").select("v", "n_links", F.when(F.length("v") == size, F.col("component_id")).alias("component_id"))
    linked = vectors.join(named, "v").select(F.col("id").alias("vec_id"), "n_links", F.coalesce("component_id", "id").alias("component_id"))
    alone = all_rows.where("NOT usable").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
