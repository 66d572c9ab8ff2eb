"""Structured Streaming forms of the periodic jobs.

Every job takes a streaming DataFrame and returns either a streaming DataFrame or a ready ``DataStreamWriter``
sink function.  Per-key state is small and fixed in size (an open code, eight readings, twelve readings).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fabsight import constants as K
from fabsight.operators.detectors import _design, feature_channels, whitened_distance, window_feature_matrix
from fabsight.operators.scoring import limit_override
from fabsight.operators.serving import Fitted
from fabsight.operators.windows import ALL_FEATURES
from fabsight.functions.alarms import severity_rank
from fabsight.operators.rules import judge
from fabsight.sources.tables import new_rows

ALARM_KEY = ["equipment_id", "metric"]


def _utc(ts):
    """Timestamp as plain UTC datetime for the state row (NaT becomes None)."""
    if ts is None or pd.isna(ts):
        return None
    ts = pd.Timestamp(ts)
    return (ts.tz_convert(timezone.utc).tz_localize(None) if ts.tzinfo else ts).to_pydatetime()


# ---- tables written by streams -----------------------------------------------------------------

def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """Sink writing each micro-batch into its own partition, so a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    return write


def append_telemetry(readings_path: str, alarms_path: str, transitions: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Readings and the alarm rows they cause, both keyed by the batch number."""
    first, second = append_once(readings_path), append_once(alarms_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        first(batch, batch_id)
        second(transitions(batch), batch_id)
        batch.unpersist()
    return write


def insert_missing(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Insert-if-absent sink: rows whose key the table has are skipped, also after a restart.

    A repeated batch first ignores what it wrote itself the last time, then replaces that partition.
    """
    write = append_once(path)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(path).where(F.col("batch_id") != batch_id)
        except Exception as e:  # noqa: BLE001  the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            stored = None
        write(batch.dropDuplicates(list(keys)) if stored is None else new_rows(stored, batch, keys), batch_id)
    return sink


# ---- notifications -----------------------------------------------------------------------------

def stream_notification_dedup(alarms: DataFrame, late: str = "2 hours", bucket: str = "30 minutes") -> DataFrame:
    """First alarm per (equipment, metric, code, bucket); rows older than the lookback are not notified."""
    grouped = alarms.withWatermark("raised_at", late).groupBy("equipment_id", "metric", "alarm_code", F.window("raised_at", bucket).alias("w")).agg(
        F.min("raised_at").alias("occurred_at"), F.min("alarm_id").alias("source_alarm_id"))
    return grouped.select("equipment_id", "metric", "alarm_code", F.col("w.start").alias("bucket_start"), "occurred_at", "source_alarm_id")


def stream_new_notifications(notifications: DataFrame, lines: DataFrame | None) -> DataFrame:
    """New rows in the scope fixed at subscription: a stream-static semi join."""
    if lines is None:
        return notifications
    return notifications.join(lines.select("line_name").distinct(), "line_name", "left_semi")


# ---- aggregates --------------------------------------------------------------------------------

def stream_bucket_agg(telemetry: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    aggs = []
    for ch in K.CHANNELS:
        aggs += [F.avg(ch).alias(ch), F.min(ch).alias(f"{ch}_min"), F.max(ch).alias(f"{ch}_max")]
    worst = F.min(F.struct((-severity_rank(F.col("alarm_code"))).alias("r"), F.col("alarm_code").alias("code")))
    out = telemetry.withWatermark("timestamp", late).groupBy("equipment_id", F.window("timestamp", width).alias("w")).agg(*aggs, worst.alias("worst"))
    cols = [c for ch in K.CHANNELS for c in (ch, f"{ch}_min", f"{ch}_max")]
    return out.select("equipment_id", F.col("w.start").alias("bucket"), *cols, F.col("worst.code").alias("alarm_code"))


def stream_sliding_features(telemetry: DataFrame, width: str = "60 seconds", slide: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Sliding windows: level, spread, extremes and slope against event time."""
    x = F.unix_micros("timestamp") / 1_000_000.0
    base = telemetry.withWatermark("timestamp", late).withColumn("_x", x)
    aggs = [F.count(F.lit(1)).alias("n")]
    for ch in K.CHANNELS:
        aggs += [F.avg(ch).alias(f"mean_{ch}"), F.stddev_pop(ch).alias(f"std_{ch}"), F.min(ch).alias(f"min_{ch}"), F.max(ch).alias(f"max_{ch}"),
                 (F.regr_slope(F.col(ch), F.col("_x")) * K.INTERVAL_SECONDS).alias(f"slope_{ch}")]
    out = base.groupBy("equipment_id", F.window("timestamp", width, slide).alias("w")).agg(*aggs)
    return out.select("equipment_id", F.col("w.start").alias("start"), *[c for c in out.columns if c not in ("equipment_id", "w")])


def stream_audit_retention(audit: DataFrame, ttl: str = "30 days") -> DataFrame:
    """Append of audit rows; rows beyond the retention time are dropped by the watermark, ids once."""
    return audit.withWatermark("created_at", ttl).dropDuplicatesWithinWatermark(["id"])


# ---- stateful ----------------------------------------------------------------------------------

def stream_alarm_transitions(feed: DataFrame) -> DataFrame:
    """(equipment, metric) -> open code; emits a raise and a clear per change. State resumes after a restart."""
    out = "equipment_id string, metric string, alarm_code string, action string, at timestamp, raised_at timestamp"

    def step(key, batches, state: GroupState):
        code, raised = state.get if state.exists else (None, None)
        # one micro-batch of one (equipment, metric)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        events = []
        for ts, new in zip(rows["ts"], rows["alarm_code"], strict=True):
            new = None if new is None or pd.isna(new) else new
            if new == code:
                continue
            at = _utc(ts)
            if code is not None:
                events.append((*key, code, "clear", at, raised))
            if new is not None:
                events.append((*key, new, "raise", at, at))
            code, raised = new, at if new is not None else None
        state.update((code, raised))
        frame = pd.DataFrame(events, columns=["equipment_id", "metric", "alarm_code", "action", "at", "raised_at"])
        frame["at"], frame["raised_at"] = pd.to_datetime(frame["at"]), pd.to_datetime(frame["raised_at"])
        yield frame

    return feed.groupBy(*ALARM_KEY).applyInPandasWithState(
        step, out, "code string, raised_at timestamp", "append", GroupStateTimeout.NoTimeout)


def stream_rule_judge(telemetry: DataFrame, profiles: dict, default: str) -> DataFrame:
    """Rule judgement of a stream: history from state, bands and priorities as column expressions."""
    from fabsight.operators.rules import profile_value
    cols = ["equipment_id", "log_id", "tick", "process_type", *K.CHANNELS]
    out = ", ".join(["equipment_id string, log_id long, tick long, process_type string",
                     *[f"{c} double" for c in K.CHANNELS], "_n int", *[f"_s_{c} double" for c in K.CHANNELS]])
    vals, keep = list(K.CHANNELS), K.VARIANCE_HISTORY

    def step(key, batches, state: GroupState):
        held = np.array(state.get[0], float).reshape(-1, len(vals)) if state.exists else np.empty((0, len(vals)))
        rows = pd.concat(list(batches)).sort_values("log_id").reset_index(drop=True)
        x = np.vstack([held, rows[vals].to_numpy(float)])
        d = np.diff(x, axis=0)
        ends = len(held) + np.arange(len(rows))
        rows["_n"] = np.minimum(ends, keep)
        deviation = np.full((len(rows), len(vals)), np.nan)
        for i in np.flatnonzero(ends < keep):
            if ends[i]:
                deviation[i] = d[:ends[i]].std(axis=0)
        whole = np.flatnonzero(ends >= keep)
        for at in range(0, len(whole), 65_536):
            some = whole[at:at + 65_536]
            deviation[some] = d[ends[some][:, None] - keep + np.arange(keep)].std(axis=1)
        for j, c in enumerate(vals):
            rows[f"_s_{c}"] = deviation[:, j]
        state.update(([float(v) for v in x[-keep:].ravel()],))
        yield rows[[*cols, "_n", *[f"_s_{c}" for c in vals]]]

    spread = telemetry.select(*cols).groupBy("equipment_id").applyInPandasWithState(
        step, out, "held array<double>", "append", GroupStateTimeout.NoTimeout)
    p = F.col("process_type")
    flags = {c: (F.col("_n") >= K.VARIANCE_MIN_SAMPLES - 1) & ~F.isnan(f"_s_{c}")
             & (F.col(f"_s_{c}") > K.VARIANCE_FACTOR * profile_value(profiles, default, p, c, "sigma")) for c in K.CHANNELS}
    judged = judge(spread, profiles, default, flags)
    return judged.select("equipment_id", "log_id", *[f"alarm_{c}" for c in K.CHANNELS], "alarm_code")


def stream_step_sessions(windows: DataFrame) -> DataFrame:
    """Run number of equal consecutive steps per equipment, for windows arriving in order."""
    out = "equipment_id string, win long, step string, run long"

    def step(key, batches, state: GroupState):
        last, run = state.get if state.exists else (None, -1)
        rows = pd.concat(list(batches)).sort_values("win")
        runs = []
        for s in rows["step"]:
            if run < 0 or s != last:
                last, run = s, run + 1
            runs.append(run)
        state.update((last, run))
        yield pd.DataFrame({"equipment_id": key[0], "win": rows["win"].to_numpy(), "step": rows["step"].to_numpy(), "run": runs})

    return windows.groupBy("equipment_id").applyInPandasWithState(step, out, "step string, run long", "append", GroupStateTimeout.NoTimeout)


def stream_anomaly_score(telemetry: DataFrame, fitted: Fitted, window: int = K.WINDOW, stride: int = K.STRIDE,
                         alpha: float = K.EWMA_ALPHA, clip: float = K.SCORE_CLIP, threshold: float = K.TRANSITION_THRESHOLD,
                         settle: int = K.TRANSITION_SETTLE, k: int = K.CONFIRM_K) -> DataFrame:
    """Score every stride by both models of ``score_series``: components and autoregression, merged.

    One state per equipment: the last ``window`` rows, both accumulated values, both run lengths, the settle counter that both
    paths share, and whether an alarm is open.  Limits are those of the equipment, else of its process type.  ``tick`` is dense, so
    rows that come too early wait in the state until the gap before them is filled, and repeated rows are passed over:
    batches in any order give the result of the whole table, except that windows before the first unmasked one score 0.
    """
    pca = {s.process_type: s for s in fitted.pca}
    var = {s.process_type: (s.lag, np.array(s.coef), np.array(s.whitening), s.limit) for s in fitted.var}
    share = feature_channels(ALL_FEATURES)
    names, wide = np.array(K.CHANNELS), len(K.CHANNELS)
    own = limit_override(telemetry.select("equipment_id", "process_type", "tick", *K.CHANNELS), fitted.limits, fitted.calibrations)
    limited = own.join(fitted.limits.select("process_type", "var_ewma_limit"), "process_type", "left")
    out = "equipment_id string, win long, pca double, var double, score double, fired boolean, channel string, action string"
    schema = "seen long, ring array<double>, waiting array<double>, acc array<double>, runs array<int>, settle int, active boolean"

    def raw_scores(x: np.ndarray, ptype: str):
        """Scores and channels of windows (n, window, channels) by both models."""
        m = pca[ptype]
        z = (window_feature_matrix(x) - np.array(m.mean)) / np.array(m.scale) - np.array(m.center)
        comp = np.array(m.components)
        proj = z @ comp.T
        resid = (z - proj @ comp) ** 2
        first = np.maximum((proj ** 2 / np.array(m.variance)).sum(1) / m.t2_limit, resid.sum(1) / m.spe_limit)
        lag, coef, whitening, limit = var[ptype]
        d, y = _design(x, lag)
        r = y - d @ coef.T
        return first, names[(resid @ share).argmax(1)], whitened_distance(r, whitening).mean(1) / limit, names[np.abs(r).mean(1).argmax(1)]

    def step(key, batches, state: GroupState):
        seen, ring, waiting, acc, runs, left, active = state.get if state.exists else (0, [], [], [], [0, 0], 0, False)
        rows = pd.concat(list(batches))
        ptype, limits = rows["process_type"].iat[0], (rows["limit"].iat[0], rows["var_ewma_limit"].iat[0])
        if ptype not in pca or ptype not in var:
            return
        new = np.vstack([np.array(waiting, float).reshape(-1, wide + 1), rows[["tick", *K.CHANNELS]].to_numpy(float)])
        new = new[np.unique(new[:, 0], return_index=True)[1]]
        new = new[new[:, 0] >= seen]
        ready = new[:, 0] == seen + np.arange(len(new))
        x = np.vstack([np.array(ring, float).reshape(-1, wide), new[ready, 1:]])
        start, end = seen - len(ring) // wide, seen + int(ready.sum())
        firsts = np.array([f for f in range(-(-start // stride) * stride, end - window + 1, stride) if f + window > seen], dtype=int)
        lines = []
        if len(firsts):
            scored = raw_scores(np.stack([x[f - start:f - start + window] for f in firsts]), ptype)
            for f, a, channel, b, other in zip(firsts, *scored):
                jump = threshold > 0 and a >= threshold
                masked = jump or left > 0
                left = settle if jump else max(0, left - 1)
                if not masked:
                    values = [min(float(a), clip), min(float(b), clip)]
                    acc = [alpha * v + (1 - alpha) * y for v, y in zip(values, acc)] if acc else values
                score = [y / lim for y, lim in zip(acc, limits)] if acc else [0.0, 0.0]
                runs = [n + 1 if s > 1 else 0 for n, s in zip(runs, score)]
                fires = [n >= k and not masked for n in runs]
                fired = any(fires)
                action = "raise" if fired and not active else "clear" if active and not fired else None
                active = fired
                lines.append((key[0], int(f) // stride, float(a), float(b), max(score), fired, channel if fires[0] else other if fires[1] else None, action))
        state.update((end, [float(v) for v in x[-window:].ravel()], [float(v) for v in new[~ready].ravel()], acc, [int(n) for n in runs], int(left), active))
        yield pd.DataFrame(lines, columns=["equipment_id", "win", "pca", "var", "score", "fired", "channel", "action"])

    return limited.groupBy("equipment_id").applyInPandasWithState(step, out, schema, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append"):
    """Process what is there and stop; calling it again goes on from the checkpoint."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(sink or append_once(path)).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
