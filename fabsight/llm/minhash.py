"""Near copies by shingle similarity: SimHash fingerprints and MinHash bands find the candidates, exact Jaccard decides.

Two texts agree in a minimum with the chance of their Jaccard similarity s, so they share none of the bands with a chance of
(1 - s^ROWS)^BANDS: 5e-8 at 0.8, 4e-15 at 0.9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fabsight.llm.common import durable, session, text_or_empty
from fabsight.llm.components import connected
from fabsight.llm.similar import SEED, SIMILARITY, dissimilar, rows_of, shingle_hashes
from fabsight.llm.simhash import links as fingerprint_links, majority

BANDS, ROWS = 32, 4
_draw = np.random.default_rng(SEED)
FLIP = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
FACTOR = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
MIX = _draw.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key of each band's minima; texts without shingles share theirs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192]
        np.minimum(least, ((part[None, :] ^ FLIP[:, None]) * FACTOR[:, None]).min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS)
    # factors of its own for each band, so equal minima of two bands make no bucket; the high bits count, so these come down
    return ((least ^ least >> np.uint64(32)) * MIX).sum(axis=1, dtype=np.uint64)


def candidate_groups(docs: DataFrame, words: int, radius: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, component) for every row, key = xxhash64 of the text: texts that are linked, directly or by others.

    Texts that share a band are linked; with ``radius``, so are those whose fingerprints differ in at most as many bits.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t, words) for t in b.column(1).to_pylist()]
            keys = np.array([bands(h) for h in hashes], dtype=np.uint64).reshape(-1)
            lists = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), keys.view(np.int64))
            fps = np.fromiter((majority(h) if radius is not None else 0 for h in hashes), dtype=np.uint64, count=len(hashes))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists, pa.array(fps.view(np.int64))], names=["doc_id", "key", "bands", "fp"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    marked = durable(texts.withColumn("key", F.xxhash64("text")).mapInArrow(hashed, "doc_id long, key long, bands array<long>, fp long"))
    keyed = marked.select("key", F.explode("bands").alias("band"))
    # every text of a bucket is linked to the least one; counts are combined before the shuffle, copies are one text
    shared = keyed.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("band", "least")
    links = keyed.join(shared, "band").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    if radius is not None:
        links = links.union(_fingerprint_links(marked, radius))
    groups = connected(links)
    return marked.join(groups, marked.key == groups.node, "left").select("doc_id", "key", F.coalesce("root", "key").alias("component"))


def _fingerprint_links(marked: DataFrame, radius: int) -> DataFrame:
    """(a, b) between text keys: a text and the least one of its fingerprint, and the least ones of linked fingerprints."""
    least = durable(marked.groupBy("fp").agg(F.min("key").alias("least"), F.max("key").alias("most")))
    copies = marked.join(least.where("least <> most"), "fp").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    near = fingerprint_links(least, radius)
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in ("a", "b")]
    return copies.union(near.join(ends[0], "a").join(ends[1], "b").select("_a", "_b"))


def drop_near_copies(docs: DataFrame, words: int, similarity: float = SIMILARITY, radius: int | None = None, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies, with all columns; candidates as in ``candidate_groups``.

    A row goes if a row that stays has a shingle Jaccard of ``similarity`` or more with it; rows are taken by id, null ids last.
    A null text is an empty one; texts without words are copies of each other; of repeated rows one stays; no rows give no rows.
    """
    session(docs.sparkSession)
    groups = durable(candidate_groups(docs, words, radius, id_col, text_col))
    return rows_of(docs, dissimilar(docs, groups, words, similarity, id_col, text_col), id_col, text_col)
