"""Sliding windows over tick series and their features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fabsight import constants as K
from fabsight.plans.series import PIECE, PIECE_ROWS, _pairs, by_piece, frame, neighbours, number_rows, running_sums
from fabsight.session import durable

STATS = ("mean", "std", "min", "max", "slope", "dstd")
CHANNEL_FEATURES = [f"{s}_{ch}" for ch in K.CHANNELS for s in STATS]
PAIRS = list(combinations(K.CHANNELS, 2))
PAIR_FEATURES = [f"corr_{a}__{b}" for a, b in PAIRS]
ALL_FEATURES = CHANNEL_FEATURES + PAIR_FEATURES


def check_window(window: int, stride: int) -> None:
    if window < 1 or stride < 1:
        raise ValueError("window and stride must be positive")


def window_starts(length: int, window: int, stride: int) -> list[int]:
    check_window(window, stride)
    return list(range(0, length - window + 1, stride))


def window_numbers(pos: Column, window: int, stride: int) -> Column:
    """Numbers of the windows a position belongs to; window k covers [k*stride, k*stride + window)."""
    first = F.greatest(F.ceil((pos - window + 1) / stride), F.lit(0)).cast("long")
    last = F.floor(pos / stride).cast("long")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def sliding_windows(df: DataFrame, pos: str = "tick", window: int = K.WINDOW, stride: int = K.STRIDE,
                    keys: Sequence[str] = ("equipment_id",)) -> DataFrame:
    """Long table of full windows: every row once per window it is in, with ``win`` and ``off``.

    A window that would run past the end of its series is dropped; the series length is an aggregate.
    """
    check_window(window, stride)
    ends = df.groupBy(*keys).agg((F.max(pos) + 1).alias("_len"))
    wide = df.withColumn("win", F.explode(window_numbers(F.col(pos), window, stride)))
    full = wide.join(ends, list(keys)).where(F.col("win") * stride + window <= F.col("_len")).drop("_len")
    return full.withColumn("off", F.col(pos) - F.col("win") * stride)


def window_overlaps_event(win: Column, window: int, stride: int, start: Column, end: Column) -> Column:
    return (win * stride <= end) & (win * stride + window - 1 >= start)


def closed_up(df: DataFrame, keep: Column, keys: Sequence[str] = ("equipment_id",), pos: str = "tick",
              name: str = "pos") -> DataFrame:
    """Keep the rows of a condition and give them dense positions again (no second sort).

    The condition and what is below it are worked out once: rows are written with their number in their piece, and the counts of the
    pieces before, a row each, place them.
    """
    own = list(keys)
    kept = by_piece(df.where(keep).withColumn(PIECE, F.floor(F.col(pos) / PIECE_ROWS)), own)
    fixed = durable(kept.withColumn(name, F.row_number().over(frame(own, pos)).cast("long")))
    before = W.partitionBy(*own).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    counts = fixed.groupBy(*own, PIECE).agg(F.count(F.lit(1)).alias("_c"))
    shifts = durable(counts.select(*[F.col(k).alias(f"_k_{k}") for k in own], F.col(PIECE).alias("_part"),
                                   (F.coalesce(F.sum("_c").over(before), F.lit(0)) - 1).alias("_shift")))
    joined = fixed.join(shifts, (F.col(PIECE) == F.col("_part")) & _pairs(own))
    return joined.select(*df.columns, (F.col(name) + F.col("_shift")).alias(name))


def diffs(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    return neighbours(df, keys, pos, {f"diff_{ch}": (lambda w, ch=ch: F.col(ch) - F.lag(ch).over(w)) for ch in K.CHANNELS}, before=1)


def feature_matrix(x: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """The columns ALL_FEATURES of windows (n, window, channels); with ``known``, of the values that it marks, NaN where there are none."""
    off = np.broadcast_to(np.arange(x.shape[1], dtype=float)[None, :, None], x.shape)
    known = np.ones(x.shape, dtype=bool) if known is None else known
    whole = bool(known.all())

    def mean(values, own):
        return values.mean(axis=1) if whole else np.where(own, values, 0.0).sum(axis=1) / own.sum(axis=1)

    def spread(values, own):
        return np.sqrt(mean((values - mean(values, own)[:, None]) ** 2, own))

    with np.errstate(divide="ignore", invalid="ignore"):
        x = x if whole else np.where(known, x, np.nan)
        centered = x - mean(x, known)[:, None]
        std = np.sqrt(mean(centered ** 2, known))
        at = off - mean(off, known)[:, None]
        slope = mean(at * centered, known) / mean(at ** 2, known)
        steps = spread(np.diff(x, axis=1), known[:, 1:] & known[:, :-1])
        low, high = x, x
        if not whole:
            low, high = np.where(known, x, np.inf), np.where(known, x, -np.inf)
        none = ~known.any(axis=1)
        # NaN counts as the largest number, as in Spark's order
        low, high = np.where(none, np.nan, np.fmin.reduce(low, axis=1)), np.where(none, np.nan, high.max(axis=1))
        stats = np.stack([mean(x, known), std, low, high, slope, steps], axis=2)
        pairs = []
        for a, b in PAIRS:
            a, b = K.CHANNELS.index(a), K.CHANNELS.index(b)
            both = known[:, :, a] & known[:, :, b]
            own = (x[:, :, c] - mean(x[:, :, c], both)[:, None] for c in (a, b))
            pairs.append(mean(np.multiply(*own), both) / (std[:, a] * std[:, b] + 1e-12))
    return np.hstack([stats.reshape(len(x), -1), np.stack(pairs, axis=1)])


#: Windows whose features are computed at a time.
BATCH_WINDOWS = 4_096


def window_features(df: DataFrame, pos: str = "tick", window: int = K.WINDOW, stride: int = K.STRIDE,
                    keys: Sequence[str] = ("equipment_id", "process_type"), correlation: bool = True,
                    tensor: bool = False) -> DataFrame:
    """One row per full window with its features.

    ``tensor`` adds ``x``: the window's values position by position, ``window`` x channels, flattened.

    Rows move once, to the piece of the series in which their windows begin (those that windows of two pieces need, to both), and
    pass through a task in order; one piece is held at a time.
    """
    check_window(window, stride)
    if window < 2:
        raise ValueError("features need a window of at least 2")
    own = [k for k in keys if k == "equipment_id"] or list(keys)
    size = -(-max(PIECE_ROWS, window) // stride) * stride
    home, lap = F.floor(F.col(pos) / size), F.pmod(F.col(pos), F.lit(size)) < window - 1
    rows = df.select(*keys, F.col(pos).cast("long").alias("_at"), *[F.col(c).cast("double").alias(c) for c in K.CHANNELS],
                     F.explode(F.when(lap & (home > 0), F.array(home - 1, home)).otherwise(F.array(home))).alias(PIECE))
    arranged = by_piece(rows, own).sortWithinPartitions(*own, PIECE, "_at").select(PIECE, "_at", *K.CHANNELS, *keys)
    columns = CHANNEL_FEATURES + (PAIR_FEATURES if correlation else [])
    fixed, first_own = 2 + len(K.CHANNELS), [2 + len(K.CHANNELS) + list(keys).index(k) for k in own]

    def codes(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)

    def changes(columns, n: int) -> np.ndarray:
        """Whether a row begins a new run of equal values."""
        out = np.zeros(n, dtype=bool)
        for c in columns:
            out[1:] |= np.diff(codes(c)) != 0
        return out

    def featured(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        piece, at = t.column(0)[0].as_py(), t.column(1).to_numpy()
        run = np.cumsum(changes([t.column(i) for i in range(fixed, t.num_columns)], len(at)))
        begins = np.flatnonzero((at >= 0) & (at % stride == 0) & (at // size == piece))
        begins = begins[begins + window <= len(at)]
        ends = begins + window - 1
        begins = begins[(at[ends] - at[begins] == window - 1) & (run[ends] == run[begins])]
        values = np.stack([t.column(i).to_numpy() for i in range(2, fixed)], axis=1)
        gone = any(t.column(i).null_count for i in range(2, fixed))
        known = np.stack([t.column(i).is_valid().to_numpy() for i in range(2, fixed)], axis=1) if gone else None
        for i in range(0, len(begins), BATCH_WINDOWS):
            start = begins[i:i + BATCH_WINDOWS]
            inside = start[:, None] + np.arange(window)
            x, here = values[inside], known[inside] if gone else None
            found = feature_matrix(x, here)[:, :len(columns)]
            out = [t.column(j).combine_chunks().take(pa.array(start)) for j in range(fixed, t.num_columns)]
            out.append(pa.array(at[start] // stride))
            # of no values there is no feature
            out += [pa.array(f, mask=np.isnan(f)) if gone else pa.array(f) for f in found.T.copy()]
            if tensor:
                flat = pa.array(x.reshape(-1), mask=~here.reshape(-1)) if gone else pa.array(x.reshape(-1))
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1, dtype=np.int32) * (window * len(K.CHANNELS))), flat))
            yield pa.RecordBatch.from_arrays(out, names=[*keys, "win", *columns, *(["x"] if tensor else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for b in batches:
            if not b.num_rows:
                continue
            starts = [0, *np.flatnonzero(changes([b.column(0), *[b.column(i) for i in first_own]], b.num_rows)).tolist(), b.num_rows]
            for s, e in zip(starts, starts[1:]):
                now = (b.column(0)[s].as_py(), *[b.column(i)[s].as_py() for i in first_own])
                if held and now != current:
                    yield from featured(held)
                    held = []
                current = now
                held.append(b.slice(s, e - s))
        if held:
            yield from featured(held)

    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    return arranged.mapInArrow(run, ", ".join([*kinds, "win long", *[f"{c} double" for c in columns], *(["x array<double>"] if tensor else [])]))


def window_step_label(df: DataFrame, step: str = "step", keys: Sequence[str] = ("equipment_id",), pos: str = "tick",
                      window: int = K.WINDOW, stride: int = K.STRIDE) -> DataFrame:
    """The single step of a window, or 'transition'."""
    wide = df.select(*keys, step, F.explode(window_numbers(F.col(pos), window, stride)).alias("win"))
    per = wide.groupBy(*keys, "win").agg(F.count(F.lit(1)).alias("_n"), F.min(step).alias("_a"), F.max(step).alias("_b"))
    return per.where(F.col("_n") == window).select(
        *keys, "win", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("transition").alias("step"))


def step_runs(df: DataFrame, step: str = "step", keys: Sequence[str] = ("equipment_id",), pos: str = "win") -> DataFrame:
    """Number of the run of equal steps a row is in (0-based), for a dense position."""
    changed = neighbours(df, keys, pos, {"_c": lambda w: (~F.col(step).eqNullSafe(F.lag(step).over(w))).cast("long")}, before=1)
    return running_sums(changed, keys, pos, {"run": F.col("_c")}).withColumn("run", F.col("run") - 1).drop("_c")


def position_in_run(df: DataFrame, keys: Sequence[str] = ("equipment_id",), pos: str = "win", name: str = "run_pos") -> DataFrame:
    starts = df.groupBy(*keys, "run").agg(F.min(pos).alias("_start"))
    return df.join(starts, [*keys, "run"]).withColumn(name, F.col(pos) - F.col("_start")).drop("_start")


def dense(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "pos") -> DataFrame:
    return number_rows(df, keys, order, name)


def sample_per_group(df: DataFrame, keys: Sequence[str], ident: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` pseudo-random rows per group, the same ones every time."""
    h = F.md5(F.concat_ws(":", F.lit(seed), ident))  # any engine can order by it
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(h, F.col(ident)))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")
