"""Exact Jaccard similarity of word shingles: which of a group of candidates stay.

Candidates come as groups.  Members are taken by id: one stays unless a member that stays is similar to it.  So every row that
goes has a similar row that stays, and no two of those that stay are similar, whatever chains of links made the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fabsight.llm.common import durable, text_or_empty

SEED = 42
#: Least similarity of near copies, and the members of a group that one task decides at a time.
SIMILARITY, BLOCK = 0.8, 512
ORDER = ("no_id", "oid", "key")
MEMBER = "component long, n long, no_id boolean, oid long, key long, shingles binary"


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """64-bit hashes of the shingles, in order, repeats included; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest as digest

    found = text.encode().lower().split()  # ASCII only: A-Z, and the white space of the contract
    if not found:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([digest(joined, SEED)], dtype="<u8")
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    starts = np.zeros(len(found), dtype=np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    ends = (starts + lengths)[words - 1:].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)), dtype="<u8", count=len(ends))


def staying(sets: list[np.ndarray], fixed: int, similarity: float) -> np.ndarray:
    """Which of the sets stay, in their order.  The first ``fixed`` stay anyway; if there are any, the others meet only these.

    Two sets are similar from a Jaccard similarity of ``similarity`` on; two empty ones are.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    stays = np.ones(len(sets), dtype=bool)
    if len(sets) < 2:
        return stays
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    marked = np.zeros(len(values), dtype=bool)
    for i in range(fixed or len(sets)):
        if not stays[i]:
            continue
        own = flat[ends[i] - sizes[i]:ends[i]]
        marked[own] = True
        first = max(fixed, i + 1)
        start = ends[first - 1]
        seen = np.concatenate([[0], np.cumsum(marked[flat[start:]])])
        common = seen[ends[first:] - start] - seen[ends[first:] - sizes[first:] - start]
        stays[first:] &= common < similarity * (sizes[i] + sizes[first:] - common) - 1e-9
        if not sizes[i]:
            stays[first:] &= sizes[first:] > 0
        marked[own] = False
    return stays


def _decide(similarity: float, filtering: bool, block: int):
    """For mapInArrow: rows of a group follow each other, those that stay anyway first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("component", pa.int64()), ("n", pa.int64()), ("no_id", pa.bool_()), ("oid", pa.int64()), ("key", pa.int64()), ("shingles", pa.binary())])

        def decided(rows: list[tuple]) -> list[tuple]:
            fixed = sum(r[7] for r in rows) if filtering else 0
            if filtering and not fixed:
                return [r[:6] for r in rows]
            stays = staying([np.frombuffer(r[5], dtype="<u8") for r in rows], fixed, similarity)
            # a group that ends here needs its sets no more
            return [(*r[:5], r[5] if r[1] > block else b"") for r, s in zip(rows[fixed:], stays[fixed:]) if s]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        held, group, ready = None, [], []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                now = (row[0], row[6]) if filtering else row[0]
                if now != held:
                    ready += decided(group) if group else []
                    held, group = now, []
                    if len(ready) >= 256:
                        yield out(ready)
                        ready = []
                group.append(row)
        ready += decided(group) if group else []
        if ready:
            yield out(ready)

    return run


def _members(docs: DataFrame, firsts: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """MEMBER rows: the sorted distinct shingles of every member; repeated rows once."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    texts = texts.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("oid"), F.xxhash64("text").alias("key"), "text")
    found = texts.join(firsts, list(ORDER)).select("component", "n", *ORDER, "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in b.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sets, pa.binary())], names=["component", "n", *ORDER, "shingles"])

    return found.mapInArrow(cut, MEMBER).dropDuplicates(["component", *ORDER])


def dissimilar(docs: DataFrame, groups: DataFrame, words: int, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key) of the rows that stay; ``groups``: (doc_id, key, component) of all rows, key = xxhash64 of the text.

    Equal texts must be in one group; of these the first id counts.  A group is decided by blocks of BLOCK members: those of a block
    that stay are compared with all later members, in tasks of about as many; the next block is made of what is left.
    """
    texts = groups.groupBy("component", "key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("oid"))).alias("f"))
    texts = durable(texts.select("component", "f.no_id", "f.oid", "key"))
    firsts = texts.join(texts.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    found = [firsts.where("n = 1").select(*ORDER)]
    rest = durable(_members(docs, firsts.where("n > 1"), words, id_col, text_col))
    columns = ["component", "n", *ORDER, "shingles"]
    nth = F.row_number().over(Window.partitionBy("component").orderBy(*ORDER))
    while True:
        block = rest.withColumn("nth", nth).where(F.col("nth") <= BLOCK).select(*columns)
        kept = durable(block.mapInArrow(_decide(similarity, False, BLOCK), MEMBER))
        found.append(kept.select(*ORDER))
        later = rest.where(F.col("n") > BLOCK)
        if later.isEmpty():
            break
        last = (later.select("component", *ORDER).withColumn("nth", nth).where(F.col("nth") == BLOCK)
                .select("component", F.struct(*ORDER).alias("last")))
        parts = F.floor(F.col("n") / BLOCK)
        later = later.join(last, "component").where(F.struct(*ORDER) > F.col("last")).select(*columns, F.pmod("key", parts + 1).alias("part"), F.lit(0).alias("fixed"))
        ahead = kept.where(F.col("n") > BLOCK).select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("part"), F.lit(1).alias("fixed"))
        both = later.union(ahead).repartition("component", "part").sortWithinPartitions("component", "part", F.desc("fixed"), *ORDER)
        left = durable(both.mapInArrow(_decide(similarity, True, 0), MEMBER))
        rest = durable(left.drop("n").join(left.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component").select(*columns))
    stay = found[0]
    for more in found[1:]:
        stay = stay.union(more)
    return stay.select(F.when(~F.col("no_id"), F.col("oid")).alias("doc_id"), "key")


def rows_of(docs: DataFrame, first: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose (doc_id, key) is in ``first``, with all their columns; of repeated rows one."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                      F.xxhash64(text_or_empty(text_col)).alias("key"))
    kept = row.alias("r").join(first.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.key") == F.col("f.key")))
    nth = Window.partitionBy("r.doc_id", "r.key").orderBy("r.key")
    return kept.withColumn("nth", F.row_number().over(nth)).where("nth = 1").select(*[F.col(f"r.row.`{c}`").alias(c) for c in docs.columns])
