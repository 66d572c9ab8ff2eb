"""SimHash fingerprints and covering locality-sensitive hashing.

Masks: every bit position gets a random label of r + 1 bits; mask v (1 .. 2^(r+1) - 1) holds the positions whose label has an
odd number of bits in common with v.  The labels of at most r differing positions cannot span all r + 1 dimensions, so some v
is orthogonal to them: under that mask the two fingerprints agree.  Every pair within the radius meets in some table.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fabsight.llm.common import durable, session, text_or_empty
from fabsight.llm.components import connected
from fabsight.llm.similar import SEED, SIMILARITY, dissimilar, rows_of, shingle_hashes

BITS = 64
#: Fingerprints of one bucket that are compared with each other directly; larger buckets are covered again.
BUCKET = 2048


def fingerprint(text: str, words: int) -> int:
    """Majority bits of the shingles' 64-bit hashes; 0 for a text without words."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    set_in = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(set_in * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp): a key of the text, and the fingerprint as a signed long.  A null text has no words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.withColumn("key", F.xxhash64("text")).mapInArrow(hashed, "doc_id long, key long, fp long")


def covering_masks(radius: int, positions: list[int], seed: int) -> list[int]:
    """Masks over ``positions`` such that any two values differing in at most ``radius`` of them agree under one mask."""
    draw = random.Random(seed)
    # balanced labels: no mask keeps too few positions
    labels = [1 + i % ((1 << radius + 1) - 1) for i in range(len(positions))]
    draw.shuffle(labels)
    masks = []
    for v in range(1, 1 << radius + 1):
        masks.append(sum(1 << p for p, label in zip(positions, labels, strict=True) if (label & v).bit_count() % 2))
    return masks


def local_links(fps: np.ndarray, radius: int, free: list[int], depth: int = 0) -> list[np.ndarray]:
    """Index pairs of distinct values within the radius, enough of them to connect all that are linked.

    ``free``: the positions in which members can differ at all.  A large bucket is covered again over these positions, so the
    work stays far below its square.
    """
    n = len(fps)
    if n < 2:
        return []
    if n <= BUCKET or len(free) <= 1 << radius:
        out = []
        for at in range(0, n, 1024):
            apart = np.bitwise_count(fps[at:at + 1024, None] ^ fps[None, :])
            a, b = np.nonzero(apart <= radius)
            a += at
            keep = a < b
            out.append(spanning(a[keep], b[keep], n))
        return out
    out = []
    for mask in covering_masks(radius, free, seed=1000 + depth):
        key = fps & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order])) + 1
        inner = [p for p in free if not mask >> p & 1]
        for group in np.split(order, edges):
            for pairs in local_links(fps[group], radius, inner, depth + 1):
                out.append(group[pairs])
    return out


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """At most n - 1 of the links (a, b), which connect what all of them connect: each index with the least it reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    own = np.flatnonzero(label != np.arange(n))
    return np.stack([label[own], own], axis=1) if len(own) else np.zeros((0, 2), dtype=np.int64)


def links(values: DataFrame, radius: int) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp), which connect all pairs within the radius."""
    masks = covering_masks(radius, list(range(BITS)), SEED)
    signed = [m - (1 << BITS) if m >> BITS - 1 else m for m in masks]
    keyed = values.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "key"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets follow each other in order; one is held at a time."""

        def found(mask: int, parts: list[np.ndarray]) -> pa.RecordBatch | None:
            fps = np.unique(np.concatenate(parts)).view(np.uint64)
            inner = [p for p in range(BITS) if not masks[mask] >> p & 1]
            pairs = [p for p in local_links(fps, radius, inner) if len(p)]
            if not pairs:
                return None
            pairs = np.concatenate(pairs)
            ids = fps.view(np.int64)[spanning(pairs[:, 0], pairs[:, 1], len(fps))]
            return pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1])], names=["a", "b"])

        held, parts = None, []
        for batch in batches:
            mask, key, fp = (c.to_numpy() for c in batch.columns)
            if not len(fp):
                continue
            starts = np.concatenate([[0], np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1])
            ends = np.append(starts[1:], len(fp))
            # the first run may go on with what is held, the last may go on in the next batch; runs of one row hold no pair
            for i in [0, *(np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1).tolist(), *([len(starts) - 1] if len(starts) > 1 else [])]:
                now = (int(mask[starts[i]]), int(key[starts[i]]))
                if now != held:
                    if sum(map(len, parts)) > 1 and (out := found(held[0], parts)) is not None:
                        yield out
                    held, parts = now, []
                parts.append(fp[starts[i]:ends[i]])
        if sum(map(len, parts)) > 1 and (out := found(held[0], parts)) is not None:
            yield out

    return (keyed.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp")
            .mapInArrow(compare, "a long, b long"))


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp, component_id) for every row: groups of documents whose fingerprints link within ``radius`` bits.

    ``component_id`` is the smallest id that links reach.  Null texts and texts without words have fingerprint 0 and link like
    any other; copies share one fingerprint, which is compared once; repeated rows come back as often as they came in; a null
    id is kept, and is a group's id only if the group has no other; other columns are ignored; no rows give no rows.
    """
    session(docs.sparkSession)
    marked = durable(fingerprints(docs, words, id_col, text_col))
    values = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = connected(links(values, radius))  # (node, root): only of fingerprints with links
    rooted = values.join(groups, values.fp == groups.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "key", "fp", "component_id")


def keep_one(docs: DataFrame, words: int, radius: int, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without the near copies that the fingerprints find, with all columns.

    Groups as in ``simhash_groups`` are candidates only: a row goes if a row that stays has a shingle Jaccard of ``similarity`` or
    more with it.  Texts without words are copies of each other; of repeated rows one stays; null ids come last.
    """
    groups = simhash_groups(docs, words, radius, id_col, text_col).select("doc_id", "key", F.col("component_id").alias("component"))
    # no group has a null id but one of null ids only, which holds texts of different groups
    groups = durable(groups.withColumn("component", F.coalesce("component", "key")))
    return rows_of(docs, dissimilar(docs, groups, words, similarity, id_col, text_col), id_col, text_col)
