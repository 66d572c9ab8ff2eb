"""Embedding rows as byte strings, and which of them can be compared."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Vectors that fits are made from, the first by a hash of the id.
SAMPLE = 65_536


def comparable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, usable): usable vectors are not null or empty, not zero, and hold only finite numbers."""
    v = F.col(vec_col).cast("array<double>")
    fine = (v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vec"), F.coalesce(fine, F.lit(False)).alias("usable"))


def packed(rows: DataFrame) -> DataFrame:
    """(id, v): the usable vectors as little-endian 64-bit floats; -0 is 0."""
    import pyarrow as pa

    def pack(batches):
        for b in batches:
            flat, at = b.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0, np.zeros(b.num_rows + 1, dtype=np.int64)
            np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False), out=at[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[x:y].astype("<f8").tobytes() for x, y in zip(at, at[1:])], pa.binary())],
                                             names=["id", "v"])

    return rows.where("usable").select("id", "vec").mapInArrow(pack, "id long, v binary")


def matrix(column) -> np.ndarray:
    """Rows of packed vectors, all of one length, as a matrix."""
    values = list(column)
    return np.frombuffer(b"".join(values), dtype="<f8").reshape(len(values), -1) if values else np.zeros((0, 0))


def sample(vectors: DataFrame, size: int = SAMPLE) -> np.ndarray:
    """At most ``size`` vectors (a bound of the fit, not of what is compared) of the most frequent length."""
    taken = [bytes(r.v) for r in vectors.orderBy(F.xxhash64("v"), "v").limit(size).select("v").collect()]
    if not taken:
        return np.zeros((0, 0))
    lengths, counts = np.unique([len(v) for v in taken], return_counts=True)
    return matrix(v for v in taken if len(v) == lengths[counts.argmax()])
