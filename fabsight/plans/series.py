"""Ordered operations on long series without putting a whole series into one task.

Spark's ``Window.partitionBy(key)`` sends all rows of a key to one task.  One machine may own a third
of the table, so every ordered operator here works on *pieces* of a series:

* ``ordered_sums`` / ``number_rows``: range partitioning on (key, order) splits a hot key over many
  tasks; totals per piece are prefix-summed (one row per piece) and added to the local running values.
* ``pieces``: once rows carry a dense position, the piece is ``position // size``; rows next to a border
  are copied into the neighbouring piece so that any bounded frame is complete inside one piece.
* ``running_sums`` / ``ewma``: scans as local result plus a carry composed over piece summaries.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fabsight.session import durable, range_partitions

PLACE = "_place"
PIECE_ROWS = 65_536
PIECE, OWN = "_piece", "_own"


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def ordered_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Add inclusive running sums per ``keys`` along ``order`` (a total order).

    The number of range partitions follows the input, and is stated so that adaptive execution does not merge them again.
    """
    order = list(order)
    ranged = df.repartitionByRange(range_partitions(df), *[F.col(k).asc_nulls_first() for k in keys], *order)
    fixed = durable(ranged.withColumn(PIECE, F.spark_partition_id()))
    local = W.partitionBy(PIECE, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = fixed.groupBy(PIECE, *keys).agg(*[F.sum(e).alias(f"_t_{c}") for c, e in sums.items()])
    before = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        PIECE, *keys, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    out = fixed.select("*", *[F.sum(e).over(local).alias(c) for c, e in sums.items()])
    joined = out.join(offsets.withColumnRenamed(PIECE, "_part").select(
        "_part", *[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_o_{c}" for c in sums]),
        (F.col(PIECE) == F.col("_part")) & _pairs(keys), "inner")
    return joined.select(*df.columns, *[(F.col(c) + F.col(f"_o_{c}")).alias(c) for c in sums])


def _pairs(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return cond


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "pos", keep: Sequence[str] | None = None) -> DataFrame:
    """Dense 0-based position of every row inside its key, exact, spread over all tasks; ``keep``: the columns that go on.

    Rows are shuffled and written once: a sorted range partition numbers its own rows, and the first number and count of every
    (partition, key) place them in their key.
    """
    order, kept = list(order), list(df.columns if keep is None else keep)
    sort = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    if not sort:
        raise ValueError("rows are numbered by a key or an order")
    ranged = df.repartitionByRange(range_partitions(df), *sort).sortWithinPartitions(*sort)
    fixed = durable(ranged.select(*kept, F.spark_partition_id().alias(PIECE), F.monotonically_increasing_id().alias(PLACE)))
    ends = fixed.groupBy(PIECE, *keys).agg(F.min(PLACE).alias("_f"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    shifts = durable(ends.select(F.col(PIECE).alias("_part"), *[F.col(k).alias(f"_k_{k}") for k in keys],
                                 (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_f")).alias("_shift")))
    joined = fixed.join(shifts, (F.col(PIECE) == F.col("_part")) & _pairs(keys))
    return joined.select(*kept, (F.col(PLACE) + F.col("_shift")).alias(name))


def pieces(df: DataFrame, pos: str, before: int = 0, after: int = 0, size: int = PIECE_ROWS) -> DataFrame:
    """Add the piece number and copy ``before``/``after`` border rows into the neighbouring pieces."""
    size = max(size, before + 1, after + 1)
    home = F.floor(F.col(pos) / size)
    if not before and not after:
        return df.withColumn(PIECE, home).withColumn(OWN, F.lit(True))
    within = F.pmod(F.col(pos), F.lit(size))
    targets = F.array(home)
    if before:
        targets = F.when(within >= size - before, F.concat(targets, F.array(home + 1))).otherwise(targets)
    if after:
        targets = F.when(within < after, F.concat(targets, F.array(home - 1))).otherwise(targets)
    return df.withColumn(PIECE, F.explode(targets)).withColumn(OWN, F.col(PIECE) == home)


def by_piece(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by key and piece, as ``frame`` needs them, into as many partitions as the input asks for."""
    return df.repartition(range_partitions(df), *keys, PIECE)


def frame(keys: Sequence[str], pos: str):
    return W.partitionBy(*keys, PIECE).orderBy(pos)


def neighbours(df: DataFrame, keys: Sequence[str], pos: str, columns: Mapping[str, Column | tuple],
               before: int = 0, after: int = 0, size: int = PIECE_ROWS) -> DataFrame:
    """Window expressions over a bounded frame. Values are functions ``window_spec -> Column``."""
    spec = frame(keys, pos)
    wide = by_piece(pieces(df, pos, before, after, size), keys).select("*", *[fn(spec).alias(c) for c, fn in columns.items()])
    return wide.where(OWN).drop(PIECE, OWN)


def running_sums(df: DataFrame, keys: Sequence[str], pos: str, sums: Mapping[str, Column],
                 size: int = PIECE_ROWS) -> DataFrame:
    """Inclusive running sums along a dense position: local sums plus the totals of earlier pieces."""
    base = df.withColumn(PIECE, F.floor(F.col(pos) / size))
    local = frame(keys, pos).rowsBetween(W.unboundedPreceding, 0)
    whole = by_piece(base, keys).select("*", *[F.sum(e).over(local).alias(f"_l_{c}") for c, e in sums.items()])
    totals = base.groupBy(*keys, PIECE).agg(*[F.sum(e).alias(f"_t_{c}") for c, e in sums.items()])
    before = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(PIECE).alias("_p"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    joined = whole.join(offsets, (F.col(PIECE) == F.col("_p")) & _pairs(keys), "inner")
    return joined.select(*df.columns, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(c) for c in sums])


def piece_for_decay(alpha: float, most: int = 4096) -> int:
    """Longest piece for which ``(1-alpha)**-n`` stays far from overflow."""
    if alpha >= 1.0:
        return most
    return max(2, min(most, int(500 / -math.log1p(-alpha))))


#: Pieces whose steps are composed by one task before the carry passes from block to block.
BLOCK_PIECES = 1024


def _folded(rows: DataFrame, keys: Sequence[str], at: str, within: Sequence[str], start, step, ddl: str) -> DataFrame:
    """Rows in order of ``at`` inside each (keys, within), with the state before each row: ``start`` first, then ``step``.

    Rows are sorted inside hash partitions and pass through as a stream with one state; no group is gathered.
    """
    group = [*keys, *within]

    def fold(batches):
        current, state = None, None
        for pdf in batches:
            keyed = list(zip(*[pdf[k] for k in group], strict=True)) if group else [()] * len(pdf)
            out = []
            for key, gain, shift, seed in zip(keyed, pdf["gain"], pdf["shift"], pdf["seed"], strict=True):
                if key != current:
                    current, state = key, start(seed)
                out.append(state)
                state = step(state, gain, shift)
            yield pdf.assign(_g=[g for g, _ in out], _s=[v for _, v in out])

    arranged = rows.repartition(*group) if group else rows.coalesce(1)
    return arranged.sortWithinPartitions(*group, at).mapInPandas(fold, ddl)


def _carry(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``carry_0 = seed``; ``carry_{m+1} = gain_m * carry_m + shift_m`` over piece summaries, in two levels.

    Steps compose: the pieces of a block are composed by a task of their own, so a long key is spread over many tasks; only one
    step per block of BLOCK_PIECES pieces is folded in a row, and is applied back to the pieces.
    """
    names = list(keys)
    fields = {f.name: f.dataType.simpleString() for f in summaries.schema.fields}
    keyed = [f"`{k}` {fields[k]}" for k in names]
    numbers = ["gain double", "shift double", "seed double"]
    blocks = summaries.select(*names, PIECE, F.floor(F.col(PIECE) / BLOCK_PIECES).alias("_block"), *[F.col(c).cast("double") for c in ("gain", "shift", "seed")])
    compose = lambda state, gain, shift: (gain * state[0], gain * state[1] + shift)
    inner = durable(_folded(blocks, names, PIECE, ["_block"], lambda seed: (1.0, 0.0), compose,
                            ", ".join([*keyed, f"{PIECE} long", "_block long", *numbers, "_g double", "_s double"])))
    last = F.max_by(F.struct((F.col("gain") * F.col("_g")).alias("gain"), (F.col("gain") * F.col("_s") + F.col("shift")).alias("shift")), PIECE)
    whole = inner.groupBy(*names, "_block").agg(last.alias("t"), F.max("seed").alias("seed")).select(*names, "_block", "t.gain", "t.shift", "seed")
    entering = _folded(whole, names, "_block", [], lambda seed: (0.0, seed), lambda state, gain, shift: (0.0, gain * state[1] + shift),
                       ", ".join([*keyed, "_block long", *numbers, "_g double", "_s double"]))
    entering = entering.select(*[F.col(k).alias(f"_k_{k}") for k in names], F.col("_block").alias("_b"), F.col("_s").alias("_enter"))
    joined = inner.join(entering, (F.col("_block") == F.col("_b")) & _pairs(names))
    return joined.select(*names, PIECE, (F.col("_g") * F.col("_enter") + F.col("_s")).alias("_carry"))


def ewma(df: DataFrame, keys: Sequence[str], pos: str, value: str, alpha: float, name: str = "ewma",
         mask: str | None = None, size: int | None = None) -> DataFrame:
    """Recursive EWMA ``y = (1-a)*y + a*x`` seeded with the first unmasked value.

    Masked rows hold the value; a fully masked series is 0.  Inside a piece the recursion is a running
    sum of ``a * x * (1-a)**-n``; the value entering a piece comes from ``_carry``.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    keep = ~F.col(mask) if mask else F.lit(True)
    if alpha == 1.0:
        # y is simply the last unmasked value: decay of zero cannot be inverted
        return _hold_last(df, keys, pos, value, keep, name)
    size = size or piece_for_decay(alpha)
    base = (by_piece(df.withColumn(PIECE, F.floor(F.col(pos) / size)), keys)
            .withColumn("_n", F.sum(keep.cast("int")).over(frame(keys, pos).rowsBetween(W.unboundedPreceding, 0))))
    decay = F.pow(F.lit(1.0 - alpha), F.col("_n"))
    term = F.when(keep, F.lit(alpha) * F.col(value) / decay).otherwise(F.lit(0.0))
    local = base.withColumn(
        "_local", decay * F.sum(term).over(frame(keys, pos).rowsBetween(W.unboundedPreceding, 0)))
    summary = local.groupBy(*keys, PIECE).agg(
        F.max_by("_local", pos).alias("shift"), F.pow(F.lit(1.0 - alpha), F.max("_n")).alias("gain"),
        F.min(F.when(keep, F.struct(F.col(pos), F.col(value)))).alias("_first"))
    seeds = W.partitionBy(*keys)
    summary = summary.withColumn("seed", F.coalesce(F.min("_first").over(seeds)[value], F.lit(0.0)))
    carry = _carry(summary.select(*keys, PIECE, "gain", "shift", "seed"), keys)
    joined = local.join(carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(PIECE).alias("_p"), "_carry"),
                        (F.col(PIECE) == F.col("_p")) & _pairs(keys))
    return joined.select(*df.columns, (F.col("_local") + decay * F.col("_carry")).alias(name))


def ewma_last(df: DataFrame, keys: Sequence[str], pos: str, value: str, alpha: float, size: int | None = None) -> DataFrame:
    """(keys, ewma_last): the last value of ``ewma``, as an aggregate; ``pos`` is dense from 0.

    A stretch of positions maps the value before it by one step, gain * y + shift.  The steps of pieces are sums, so rows combine on
    the map side; steps compose, so the pieces of a block and then the blocks of a key are folded apart.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    size = size or piece_for_decay(alpha)
    within = F.pmod(F.col(pos), F.lit(size))
    keep = F.lit(1.0 - alpha)
    # the first value of a key is its seed: it enters whole
    term = F.when(F.col(pos) == 0, F.col(value)).otherwise(F.lit(alpha) * F.col(value)) / F.pow(keep, within)
    steps = df.groupBy(*keys, F.expr(f"{pos} div {size}").alias(PIECE)).agg(F.sum(term).alias("_s"), F.count(F.lit(1)).alias("_n")).select(
        *keys, PIECE, F.pow(keep, F.col("_n")).alias("gain"), (F.col("_s") * F.pow(keep, F.col("_n") - 1)).alias("shift"))
    for group in (F.expr(f"{PIECE} div {BLOCK_PIECES}"), F.lit(0)):
        ordered = F.array_sort(F.collect_list(F.struct(PIECE, "gain", "shift")))
        start = F.struct(F.lit(1.0).alias("gain"), F.lit(0.0).alias("shift"))
        folded = F.aggregate(ordered, start, lambda t, x: F.struct((t["gain"] * x["gain"]).alias("gain"), (x["gain"] * t["shift"] + x["shift"]).alias("shift")))
        steps = steps.withColumn("_b", group).groupBy(*keys, "_b").agg(folded.alias("_f")).select(
            *keys, F.col("_b").alias(PIECE), F.col("_f.gain").alias("gain"), F.col("_f.shift").alias("shift"))
    return steps.select(*keys, F.col("shift").alias("ewma_last"))


def _hold_last(df, keys, pos, value, keep, name):
    base = df.withColumn(PIECE, F.floor(F.col(pos) / PIECE_ROWS))
    spec = frame(keys, pos).rowsBetween(W.unboundedPreceding, 0)
    base = base.withColumn("_held", F.last(F.when(keep, F.col(value)), ignorenulls=True).over(spec))
    tails = base.groupBy(*keys, PIECE).agg(F.max_by("_held", pos).alias("_tail"),
                                           F.min(F.when(keep, F.struct(pos, value))).alias("_first"))
    prior = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    tails = tails.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(PIECE).alias("_p"),
                         F.last("_tail", ignorenulls=True).over(prior).alias("_prev"),
                         F.min("_first").over(W.partitionBy(*keys))[value].alias("_seed"))
    joined = base.join(tails, (F.col(PIECE) == F.col("_p")) & _pairs(keys))
    return joined.select(*df.columns, F.coalesce("_held", "_prev", "_seed", F.lit(0.0)).alias(name))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, exact, without holding a group's values in one task.

    Equal values are first merged into counts; ranks come from range-partitioned running counts, and only
    the two values around each wanted rank take part in the final aggregate.
    """
    return weighted_quantiles(df, keys, value, None, probs)


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: str | None, probs: Mapping[str, float]) -> DataFrame:
    """``exact_quantiles`` of rows that stand for ``weight`` equal ones each."""
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(times.alias("_c"))
    ranged = counted.repartitionByRange(range_partitions(counted), *[F.col(k).asc_nulls_first() for k in keys], F.col(value).asc())
    fixed = durable(ranged.withColumn(PIECE, F.spark_partition_id()))
    # a row per range partition and key; only those that hold a wanted rank are ranked
    sums = fixed.groupBy(PIECE, *keys).agg(F.sum("_c").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    parts = sums.select(F.col(PIECE).alias("_part"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_n",
                        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*keys)).alias("_total"))
    ranks = [F.lit(float(q)) * (F.col("_total") - 1) for q in probs.values()]
    holds = [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")) for at in ranks for r in (F.floor(at), F.ceil(at))]
    wanted = durable(parts.where(reduce(or_, holds)).drop("_n"))
    local = W.partitionBy(PIECE, *keys).orderBy(F.col(value).asc()).rowsBetween(W.unboundedPreceding, 0)
    joined = fixed.join(wanted, (F.col(PIECE) == F.col("_part")) & _pairs(keys)).select(
        *keys, value, "_c", "_total", (F.sum("_c").over(local) + F.col("_before")).alias("_hi"))
    aggs = []
    for i, at in enumerate(ranks):
        lo, hi = F.floor(at), F.ceil(at)
        covers = lambda r: (r >= F.col("_hi") - F.col("_c")) & (r < F.col("_hi"))
        aggs += [F.max(F.when(covers(lo), F.col(value))).alias(f"_lo{i}"),
                 F.max(F.when(covers(hi), F.col(value))).alias(f"_up{i}"),
                 F.max(at - lo).alias(f"_w{i}")]
    got = joined.groupBy(*keys).agg(*aggs)
    return got.select(*keys, *[
        (F.col(f"_lo{i}") + (F.col(f"_up{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(name)
        for i, name in enumerate(probs)])
