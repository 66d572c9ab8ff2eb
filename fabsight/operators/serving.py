"""Fitting per process type, calibration per equipment, scoring of newest or all windows, alarm transitions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fabsight import constants as K
from fabsight.operators import detectors as D, scoring as S, telemetry as T, windows as Wn
from fabsight.plans.series import ewma
from fabsight.session import durable


@dataclass
class Fitted:
    pca: list = field(default_factory=list)
    var: list = field(default_factory=list)
    limits: DataFrame | None = None        # process_type, ewma_limit, var_ewma_limit, train_windows
    calibrations: DataFrame | None = None  # equipment_id, ewma_limit, train_windows


def effective_since(master: DataFrame, cutoff: Column | None) -> DataFrame:
    """Later of the recency cutoff and the last repair, per equipment; a missing one is ignored."""
    since = F.greatest("repaired_at", cutoff) if cutoff is not None else F.col("repaired_at")
    return master.select("equipment_id", since.alias("since"))


def training_rows(telemetry: DataFrame, master: DataFrame, cutoff: Column | None = None, exclude: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Normal rows after the bound, gaps closed up; all rows, or the newest ``rows`` per equipment."""
    usable = telemetry.where(~F.col("equipment_id").isin(*exclude)) if exclude else telemetry
    # written first, so that its size is known: a small master is not worth moving the readings by equipment
    bounded = usable.join(durable(effective_since(master, cutoff)), "equipment_id", "left")
    keep = F.col("alarm_code").isNull() & (F.col("since").isNull() | (F.col("timestamp") >= F.col("since")))
    normal = Wn.closed_up(bounded.where(keep).select("equipment_id", "process_type", "tick", *K.CHANNELS), F.lit(True))
    return normal if rows is None else durable(T.recent_rows(normal, ["equipment_id"], "pos", rows))


def training_windows(telemetry: DataFrame, master: DataFrame, cutoff: Column | None = None, exclude: Sequence[str] = (),
                     rows: int | None = None, window: int = K.WINDOW, stride: int = K.STRIDE) -> DataFrame:
    """Windows of ``training_rows``."""
    return Wn.window_features(training_rows(telemetry, master, cutoff, exclude, rows), "pos", window, stride, tensor=True)


def enough(windows: DataFrame, least: int = K.MIN_TRAIN_WINDOWS) -> DataFrame:
    """Windows of the process types that have enough of them."""
    n = windows.groupBy("process_type").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return windows.join(n.select("process_type"), "process_type", "left_semi")


def left_out(groups: DataFrame, windows: DataFrame, key: str, least: int) -> DataFrame:
    """(key, n_windows, reason): the groups that ``enough`` and ``calibrate_equipment`` pass over, those without any window too."""
    n = windows.groupBy(key).agg(F.count(F.lit(1)).alias("n_windows"))
    counted = groups.select(key).distinct().join(n, key, "left").withColumn("n_windows", F.coalesce("n_windows", F.lit(0)))
    reason = F.when(F.col("n_windows") == 0, "no window").otherwise(F.concat(F.lit("fewer than "), F.lit(least).cast("string")))
    return counted.where(F.col("n_windows") < least).withColumn("reason", reason)


def accumulated(scores: DataFrame) -> DataFrame:
    clipped = scores.withColumn("_c", F.least(F.col("raw"), F.lit(K.SCORE_CLIP)))
    return S.steady_scores(ewma(clipped, ["equipment_id"], "win", "_c", K.EWMA_ALPHA, "acc"))


def ewma_limit_by_parts(acc: DataFrame, key: str = "process_type", q: float = K.LIMIT_QUANTILE) -> DataFrame:
    """Quantile of scores accumulated per equipment (``accumulated``), pooled by ``key``."""
    return S.limit_quantile(acc, [key], "acc", q, "ewma_limit")


def calibrate_equipment(scores: DataFrame, acc: DataFrame, process_limits: DataFrame, least: int = K.MIN_CALIBRATION_WINDOWS) -> DataFrame:
    """Own limit of each equipment with enough windows, kept within the band around its process limit."""
    n = scores.groupBy("equipment_id", "process_type").agg(F.count(F.lit(1)).alias("train_windows")).where(F.col("train_windows") >= least)
    own = S.limit_quantile(acc, ["equipment_id"], "acc", name="own")
    both = n.join(own, "equipment_id").join(process_limits.select("process_type", "ewma_limit"), "process_type")
    return both.select("equipment_id", S.clamp_limit(F.col("own"), F.col("ewma_limit")).alias("ewma_limit"), "train_windows")


def fit_process_models(telemetry: DataFrame, master: DataFrame, cutoff: Column | None = None, exclude: Sequence[str] = (),
                       old: Fitted | None = None, least: int = K.MIN_TRAIN_WINDOWS) -> Fitted:
    """Fit every process type in one go; a type with too few windows keeps its old model."""
    return fit_windows(durable(training_windows(telemetry, master, cutoff, exclude)), old, least)


def fit_windows(stored: DataFrame, old: Fitted | None = None, least: int = K.MIN_TRAIN_WINDOWS) -> Fitted:
    """Models, limits and calibrations from stored training windows."""
    windows = enough(stored, least)
    pca = D.pca_fit(windows)
    scores = durable(D.pca_score(windows, pca))
    acc = durable(accumulated(scores).select("equipment_id", "process_type", "acc"))
    limits = ewma_limit_by_parts(acc)
    try:
        var = D.var_fit(windows)
        var_limits = ewma_limit_by_parts(accumulated(D.var_score(windows, var))).withColumnRenamed("ewma_limit", "var_ewma_limit")
        limits = limits.join(var_limits, "process_type", "left")
    except np.linalg.LinAlgError:
        var, limits = [], limits.withColumn("var_ewma_limit", F.lit(None).cast("double"))
    n = windows.groupBy("process_type").agg(F.count(F.lit(1)).alias("train_windows"))
    limits = durable(limits.join(n, "process_type"))
    out = Fitted(pca, var, limits, durable(calibrate_equipment(scores, acc, limits)))
    if old is not None:
        done = {s.process_type for s in pca}
        out.pca += [s for s in old.pca if s.process_type not in done]
        out.var += [s for s in old.var if s.process_type not in done]
        out.limits = out.limits.unionByName(old.limits.join(limits, "process_type", "left_anti"))
        out.calibrations = out.calibrations.unionByName(old.calibrations.join(out.calibrations, "equipment_id", "left_anti"))
    return out


def model_by_process_type(master: DataFrame, models: DataFrame) -> DataFrame:
    """Every equipment that a model of its process type exists for, with the model's columns."""
    return master.join(models, "process_type")


def stale_models(models: DataFrame, now: Column, hours: int = K.STALE_HOURS) -> DataFrame:
    return models.where(F.col("fitted_at") < now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def score_series(windows: DataFrame, fitted: Fitted, use_var: bool = True, threshold: float = K.TRANSITION_THRESHOLD,
                 settle: int = K.TRANSITION_SETTLE, k: int = K.CONFIRM_K) -> DataFrame:
    """Fired flag, normalized score and channel for every window, both paths merged."""
    pca = D.pca_score(windows, fitted.pca)
    masked = S.transition_mask(pca, "raw", threshold, settle)
    limited = S.limit_override(masked, fitted.limits, fitted.calibrations)
    a = S.accumulate_normalize(limited, "raw", F.col("limit"))
    a = S.sustained_k(a.withColumn("_over", F.col("score") > 1), "_over", k, "_conf").withColumn(
        "fired", F.col("_conf") & ~F.col("masked"))
    a = a.select("equipment_id", "process_type", "win", "masked", "score", "fired", "channel")
    if not (use_var and fitted.var):
        return a.withColumn("channel", F.when(F.col("fired"), F.col("channel")))
    var = D.var_score(windows, fitted.var).select("equipment_id", "win", F.col("raw").alias("_vr"), F.col("channel").alias("_vc"))
    lim = fitted.limits.select("process_type", "var_ewma_limit")
    b = a.join(var, ["equipment_id", "win"]).join(lim, "process_type", "left")
    b = S.accumulate_normalize(b, "_vr", F.col("var_ewma_limit"), name="_vs")
    b = S.sustained_k(b.withColumn("_vo", F.coalesce(F.col("_vs") > 1, F.lit(False))), "_vo", k, "_vconf").withColumn(
        "_vf", F.col("_vconf") & ~F.col("masked"))
    return merged_score(b)


def merged_score(b: DataFrame) -> DataFrame:
    """Either path fires; the larger score; the channel comes from the path that fired, the first one first."""
    return b.select("equipment_id", "process_type", "win", "masked", F.greatest("score", "_vs").alias("score"),
                    (F.col("fired") | F.col("_vf")).alias("fired"),
                    F.when(F.col("fired"), F.col("channel")).when(F.col("_vf"), F.col("_vc")).alias("channel"))


def score_latest(telemetry: DataFrame, fitted: Fitted, use_var: bool = True, *, lookback: int,
                 window: int = K.WINDOW, stride: int = K.STRIDE, threshold: float = K.TRANSITION_THRESHOLD) -> DataFrame:
    """Last window of each equipment over the newest rows; equipment without model or window is absent."""
    rows = durable(T.recent_rows(telemetry.select("equipment_id", "process_type", "tick", *K.CHANNELS), ["equipment_id"], "tick", lookback))
    series = score_series(durable(Wn.window_features(rows, "tick", window, stride, tensor=True)), fitted, use_var, threshold)
    last = F.max_by(F.struct("win", "fired", "channel", "score"), "win")
    return series.groupBy("equipment_id").agg(last.alias("r")).select("equipment_id", "r.*")


def anomaly_transitions(latest: DataFrame, open_alarms: DataFrame, now: Column, realfire: Sequence[str] = ()) -> DataFrame:
    """Raise where fired and nothing is open, clear where open and not fired; ``sink`` tells real from shadow."""
    active = open_alarms.where(F.col("cleared_at").isNull()).select("equipment_id").distinct().withColumn("_open", F.lit(True))
    both = latest.join(active, "equipment_id", "full_outer")
    fired, is_open = F.coalesce(F.col("fired"), F.lit(False)), F.coalesce(F.col("_open"), F.lit(False))
    action = F.when(fired & ~is_open, "raise").when(is_open & ~fired & F.col("fired").isNotNull(), "clear")
    sink = F.when(F.col("equipment_id").isin(*realfire), "alarm").otherwise("shadow") if realfire else F.lit("shadow")
    return both.select("equipment_id", action.alias("action"), "channel", "score", now.alias("at"), sink.alias("sink")).where("action IS NOT NULL")
