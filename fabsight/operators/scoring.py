"""Score post-processing along window series: confirmation, suppression, accumulation, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fabsight import constants as K
from fabsight.plans.series import ewma, exact_quantiles, neighbours

KEY = ("equipment_id",)


def sustained_k(df: DataFrame, over: str, k: int = K.CONFIRM_K, name: str = "confirmed", keys: Sequence[str] = KEY,
                pos: str = "win") -> DataFrame:
    """True when this and the k-1 previous windows are all over the threshold."""
    if k <= 1:
        return df.withColumn(name, F.col(over))
    return neighbours(df, keys, pos, {
        name: lambda w: F.sum(F.col(over).cast("int")).over(w.rowsBetween(-(k - 1), 0)) == k}, before=k - 1)


def transition_mask(df: DataFrame, raw: str, threshold: float = K.TRANSITION_THRESHOLD, settle: int = K.TRANSITION_SETTLE,
                    name: str = "masked", keys: Sequence[str] = KEY, pos: str = "win") -> DataFrame:
    """True on a jump to the threshold and on the ``settle`` windows after it."""
    if threshold <= 0:
        return df.withColumn(name, F.lit(False))
    return neighbours(df, keys, pos, {
        name: lambda w: F.coalesce(F.max(F.col(raw) >= threshold).over(w.rowsBetween(-settle, 0)), F.lit(False))}, before=settle)


def accumulate_normalize(df: DataFrame, raw: str, limit: Column, mask: str | None = "masked", name: str = "score",
                         alpha: float = K.EWMA_ALPHA, clip: float = K.SCORE_CLIP, keys: Sequence[str] = KEY,
                         pos: str = "win") -> DataFrame:
    """Masked EWMA of the clipped score, divided by its limit."""
    clipped = df.withColumn("_clip", F.least(F.col(raw), F.lit(clip)))
    acc = ewma(clipped, keys, pos, "_clip", alpha, "_acc", mask)
    return acc.withColumn(name, F.col("_acc") / limit).drop("_clip", "_acc")


def steady_scores(df: DataFrame, alpha: float = K.EWMA_ALPHA, least: int = K.MIN_STEADY_WINDOWS, keys: Sequence[str] = KEY,
                  pos: str = "win") -> DataFrame:
    """Drop the warm-up of an accumulated series unless fewer than ``least`` windows would remain."""
    warm = int(K.WARMUP_TAUS / alpha)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    short = F.col("_n") - warm < least
    return df.join(n, list(keys)).where(short | (F.col(pos) >= warm)).drop("_n")


def limit_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float = K.LIMIT_QUANTILE, name: str = "limit") -> DataFrame:
    out = exact_quantiles(df, keys, value, {name: q})
    return out.withColumn(name, F.greatest(F.col(name), F.lit(1e-12)))


def clamp_limit(own: Column, process: Column) -> Column:
    return F.greatest(F.least(own, process * K.CALIBRATION_HIGH), process * K.CALIBRATION_LOW)


def limit_override(df: DataFrame, process_limits: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Equipment limit when calibrated, else the limit of its process type."""
    own = calibrations.select("equipment_id", F.col("ewma_limit").alias("_own"))
    typ = process_limits.select("process_type", F.col("ewma_limit").alias("_type"))
    return df.join(own, "equipment_id", "left").join(typ, "process_type", "left").withColumn(
        "limit", F.coalesce("_own", "_type")).drop("_own", "_type")


def step_run_ewma(df: DataFrame, value: str, alpha: float = K.EWMA_ALPHA, skip: int = 3, keys: Sequence[str] = KEY) -> DataFrame:
    """EWMA restarted in every step run; ``judged`` is false on the first ``skip`` windows of a run."""
    acc = ewma(df, [*keys, "run"], "run_pos", value, alpha, "ewma")
    return acc.withColumn("judged", F.col("run_pos") >= skip)
