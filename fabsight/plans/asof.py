"""Joins along a time line without comparing pairs.

Both tables are merged into one line per key, range-partitioned so that a hot key or a hot moment is spread
over tasks.  What a left row needs from the right rows before or after it (the last one, the first one, a
maximum) is a running aggregate inside a partition plus one carried value per partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from fabsight.plans.series import PIECE, _pairs
from fabsight.session import durable, range_partitions


def along(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, picks: Mapping[str, tuple[str, Column]],
          tie: str | None = None, right_first: bool = True) -> DataFrame:
    """Add ``picks`` to the left rows.

    A pick is ``(how, expression over right columns)`` with how one of ``last`` (newest right row before),
    ``first`` (oldest right row after), ``max`` (largest value before).  ``right_first`` says on which side of a
    left row a right row of the same time lies: before it (so ``last``/``max`` include it) or after it.
    With ``tie``, of several right rows of one time the smallest ``tie`` is taken in both directions.
    """
    keys = list(keys)
    kept = F.struct(*left.columns)
    tied = F.col(tie) if tie else F.lit(0)
    r = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0 if right_first else 1).alias("_side"), tied.alias("_tie"),
                     F.struct(*[e.alias(n) for n, (_, e) in picks.items()]).alias("_right"))
    lf = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1 if right_first else 0).alias("_side"), kept.alias("_left"))
    line = r.unionByName(lf, allowMissingColumns=True)
    order = [F.asc("_at"), F.asc("_side"), F.asc("_tie")]
    fixed = durable(line.repartitionByRange(range_partitions(line), *[F.asc(k) for k in keys], *order).withColumn(PIECE, F.spark_partition_id()))
    hit = F.col("_right").isNotNull()
    # the struct keeps NULL values apart from no row, and tells time and tie where pieces meet
    value = lambda name: F.when(hit, F.struct(F.col("_at").alias("at"), (-F.col("_tie")).alias("nt"), F.col("_right")[name].alias("v")))
    ahead = W.partitionBy(PIECE, *keys).orderBy(F.asc("_at"), F.asc("_side"), F.desc("_tie")).rowsBetween(W.unboundedPreceding, 0)
    behind = W.partitionBy(PIECE, *keys).orderBy(F.desc("_at"), F.desc("_side"), F.desc("_tie")).rowsBetween(W.unboundedPreceding, 0)
    local, ends, prior = {}, {}, {}
    earlier = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(1, W.unboundedFollowing)
    newest, oldest = F.struct(F.col("_at"), -F.col("_tie")), F.struct("_at", "_tie")
    for name, (how, _) in picks.items():
        v = value(name)
        if how == "last":
            local[f"_l_{name}"] = F.last(v, ignorenulls=True).over(ahead)
            ends[f"_e_{name}"] = F.max_by(v, F.when(hit, newest))
            e = F.col(f"_e_{name}")
            prior[f"_c_{name}"] = F.max_by(e, F.when(e.isNotNull(), F.struct(e["at"], e["nt"]))).over(earlier)
        elif how == "first":
            local[f"_l_{name}"] = F.last(v, ignorenulls=True).over(behind)
            ends[f"_e_{name}"] = F.min_by(v, F.when(hit, oldest))
            prior[f"_c_{name}"] = F.first(f"_e_{name}", ignorenulls=True).over(later)
        elif how == "max":
            v = F.when(hit, F.struct(F.col("_right")[name].alias("v")))
            local[f"_l_{name}"] = F.max(v).over(ahead)
            ends[f"_e_{name}"] = F.max(v)
            prior[f"_c_{name}"] = F.max(f"_e_{name}").over(earlier)
        else:
            raise ValueError(how)
    carry = fixed.groupBy(PIECE, *keys).agg(*[e.alias(c) for c, e in ends.items()]).select(
        F.col(PIECE).alias("_part"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[e.alias(c) for c, e in prior.items()])
    seen = fixed.select("*", *[e.alias(c) for c, e in local.items()]).where(~hit)
    joined = seen.join(carry, (F.col(PIECE) == F.col("_part")) & _pairs(keys))
    out = []
    for name, (how, _) in picks.items():
        a, b = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if how == "max":
            got = F.greatest(a, b)
        elif how == "last":  # rows of one time may lie in several pieces; the smallest tie is in the earliest
            got = F.when((b["at"] == a["at"]) & (b["nt"] > a["nt"]), b).otherwise(F.coalesce(a, b))
        else:
            got = F.coalesce(a, b)
        out.append(got["v"].alias(name))
    return joined.select("_left.*", *out)


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, columns: Sequence[str],
                  tie: str | None = None) -> DataFrame:
    """Columns of the newest right row not later than each left row (NULL when there is none)."""
    got = along(left, right, [key], left_at, right_at, {"_r": ("last", F.struct(*columns))}, tie)
    return got.select(*left.columns, *[F.col("_r")[c].alias(c) for c in columns])


def last_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, n: int, tie: str, name: str = "rows") -> DataFrame:
    """Add ``name``: the last ``n`` right rows before each left row (by ``right_at``, then ``tie``), oldest first, without the keys.

    Rows move once, to sorted range partitions, and pass through a task that holds ``n`` right rows.  A partition also writes the last rows
    of each key; left rows that saw fewer than ``n`` in theirs take the others from there.
    """
    keys, values = list(keys), [c for c in right.columns if c not in keys]
    r = right.dropna(subset=keys).select(*keys, F.col(right_at).alias("_at"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), F.struct(*values).alias("_right"))
    lf = left.select(*keys, F.col(left_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_left"))
    line = r.unionByName(lf, allowMissingColumns=True)
    order = [*[F.asc(k) for k in keys], F.asc("_at"), F.asc("_side"), F.asc("_tie")]
    sorted_ = line.repartitionByRange(range_partitions(line), *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias(PIECE), *keys, "_left", "_right")
    kinds = {f.name: f for f in line.schema.fields}
    schema = T.StructType([T.StructField(PIECE, T.IntegerType()), *[kinds[k] for k in keys], T.StructField("_left", kinds["_left"].dataType),
                           T.StructField("_rows", T.ArrayType(kinds["_right"].dataType))])
    width = len(keys) + 1

    def listed(rows: pa.Array, first: np.ndarray, last: np.ndarray) -> pa.ListArray:
        size = last - first
        begin = np.concatenate([[0], np.cumsum(size)])
        return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), rows.take(pa.array(np.repeat(first - begin[:-1], size) + np.arange(begin[-1]))))

    def batch(head: list, lefts: pa.Array, rows: pa.ListArray) -> pa.RecordBatch:
        same = [pa.array([v] * len(lefts), t) for v, t in head]
        return pa.RecordBatch.from_arrays([*same, lefts, rows], names=[PIECE, *keys, "_left", "_rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, None

        def tail():
            return batch(head, pa.nulls(1, lefts_type), listed(held, np.array([0]), np.array([len(held)])))

        for b in batches:
            if not b.num_rows:
                continue
            lefts_type, change = b.column(width).type, np.zeros(b.num_rows, dtype=bool)
            for i in range(1, width):
                change[1:] |= np.diff(b.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)) != 0
            cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                part = b.slice(s, e - s)
                now = [(part.column(i)[0].as_py(), part.column(i).type) for i in range(width)]
                if now != head:
                    if head is not None:
                        yield tail()
                    head, held = now, part.column(width + 1).slice(0, 0)
                own = part.column(width + 1).is_valid().to_numpy(zero_copy_only=False)
                at = np.flatnonzero(~own)
                seen = np.cumsum(own)[at] + len(held)
                rows = pa.concat_arrays([held, part.column(width + 1).filter(pa.array(own))])
                if len(at):
                    yield batch(head, part.column(width).take(pa.array(at)), listed(rows, np.maximum(seen - n, 0), seen))
                held = rows.slice(max(len(rows) - n, 0))
        if head is not None:
            yield tail()

    found = durable(sorted_.mapInArrow(run, schema))
    # a row per range partition and key from here to ``carry``
    tails = found.where(F.col("_left").isNull())
    some = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(-(n - 1), 0)
    after = tails.where(F.size("_rows") > 0).select(PIECE, *keys, F.flatten(F.collect_list("_rows").over(some)).alias("_a"))
    spots = tails.select(PIECE, *keys).unionByName(after, allowMissingColumns=True).groupBy(PIECE, *keys).agg(F.first("_a", ignorenulls=True).alias("_a"))
    earlier = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    carry = durable(spots.select(F.col(PIECE).alias("_part"), *[F.col(k).alias(f"_k_{k}") for k in keys],
                                 F.last("_a", ignorenulls=True).over(earlier).alias("_carry")).where("_carry IS NOT NULL"))
    joined = found.where(F.col("_left").isNotNull()).join(carry, (F.col(PIECE) == F.col("_part")) & _pairs(keys) & (F.size("_rows") < n), "left")
    whole = F.concat(F.coalesce("_carry", F.array().cast(schema["_rows"].dataType)), F.col("_rows"))
    return joined.select("_left.*", F.when(F.col("_carry").isNull(), F.col("_rows")).otherwise(
        F.slice(whole, F.greatest(F.size(whole) - (n - 1), F.lit(1)), n)).alias(name))
