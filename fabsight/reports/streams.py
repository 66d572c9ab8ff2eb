"""Streaming jobs over the given tables, run to completion; each must equal its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fabsight import constants as K
from fabsight.operators import maintenance as M, windows as Wn
from fabsight.registry import query
from fabsight.reports import models as G
from fabsight.reports.relational import _rounded
from fabsight.reports.series import _var_sql, stepped
from fabsight.streaming import jobs as J
from fabsight.views import TEST_PROFILES


def workspace(v) -> str:
    return f"{v.spark.sparkContext.getCheckpointDir()}/streams-{uuid.uuid4().hex}"


#: Rows of a micro-batch, and its files.
BATCH_ROWS, BATCH_FILES = 4_000_000, 8


def source(v, name: str, build, order: str | None = None):
    """A table as a file stream: written once per session next to the checkpoints.

    With ``order``, a table of more than BATCH_ROWS rows arrives in that order, in micro-batches of about as many rows: slices of
    the table are written one after the other, each as BATCH_FILES files, and a stream takes files by the time they were written.
    """
    key = f"stream:{name}"
    if key not in v._stored:
        root = workspace(v)
        path = f"{root}/{name}"
        df = build()
        slices = -(-df.count() // BATCH_ROWS) if order else 1
        if slices > 1:
            df.repartitionByRange(slices, order).withColumn("_slice", F.spark_partition_id()).write.partitionBy("_slice").parquet(f"{root}/slices")
            for i in sorted(r["_slice"] for r in v.spark.read.parquet(f"{root}/slices").select("_slice").distinct().collect()):  # a number a slice
                v.spark.read.schema(df.schema).parquet(f"{root}/slices/_slice={i}").repartition(BATCH_FILES).write.mode("append").parquet(path)
        else:
            df.write.parquet(path)
        v._stored[key] = (path, df.schema, slices)
    path, schema, slices = v._stored[key]
    reader = v.spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", BATCH_FILES) if slices > 1 else reader).parquet(path)


def finish(v, stream, sink=None, mode="append"):
    root = workspace(v)
    return J.run_available(stream, f"{root}/out", f"{root}/ckpt", sink(f"{root}/out") if sink else None, mode).drop("batch_id")


def telemetry(v):
    return source(v, "telemetry", lambda: v.telemetry, "tick")


@query("stream_new_rows", "SELECT event_id, event_type, value FROM events")
def stream_new_rows(v):
    events = v.table("events")
    stream = v.spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    return finish(v, stream.select("event_id", "event_type", "value"))


@query("append_telemetry", "SELECT equipment_id, log_id, temperature, alarm_code FROM telemetry")
def append_telemetry(v):
    root = workspace(v)
    sink = J.append_telemetry(f"{root}/out", f"{root}/alarms", lambda b: b.where("alarm_code IS NOT NULL").select("equipment_id", "log_id", "alarm_code"))
    stream = telemetry(v).select("equipment_id", "log_id", "temperature", "alarm_code")
    return J.run_available(stream, f"{root}/out", f"{root}/ckpt", sink).drop("batch_id")


@query("stream_notification_dedup", "SELECT equipment_id, metric, alarm_code, bucket_start, occurred_at, source_alarm_id FROM notifications")
def stream_notification_dedup(v):
    alarms = source(v, "alarms", lambda: v.alarms)
    return finish(v, J.stream_notification_dedup(alarms), lambda p: J.insert_missing(p, ["equipment_id", "metric", "alarm_code", "bucket_start"]), "update")


@query("stream_alarm_transitions", """SELECT equipment_id, metric, alarm_code, 'raise' AS action, raised_at AS at FROM alarms
UNION ALL SELECT equipment_id, metric, alarm_code, 'clear', cleared_at FROM alarms WHERE cleared_at IS NOT NULL""")
def stream_alarm_transitions(v):
    feed = source(v, "feed", lambda: v.feed)
    return finish(v, J.stream_alarm_transitions(feed)).drop("raised_at")


@query("stream_rule_judge", """SELECT log_id, coalesce(j.first_code, CASE WHEN var_temperature OR var_pressure OR var_rf_power OR var_gas_flow THEN 'WRN-801' END) AS alarm_code
FROM (SELECT log_id, alarm_code AS first_code FROM telemetry) j JOIN (""" + _var_sql() + ") v USING (log_id)")
def stream_rule_judge(v):
    return finish(v, J.stream_rule_judge(telemetry(v), TEST_PROFILES, "P0")).select("log_id", "alarm_code")


# append mode keeps back the last windows, those the watermark has not passed
_LATE = """(SELECT max("timestamp") FROM telemetry) - INTERVAL 10 MINUTES"""


@query("stream_bucket_agg", "SELECT * FROM (SELECT equipment_id, time_bucket(INTERVAL '10 minutes', \"timestamp\") AS bucket, " + ", ".join(
    f"round(avg({c}), 6) AS {c}, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in K.CHANNELS)
    + f", coalesce(min(alarm_code) FILTER (alarm_code LIKE 'ERR%'), min(alarm_code)) AS alarm_code FROM telemetry GROUP BY 1, 2) x WHERE bucket + INTERVAL 10 MINUTES <= {_LATE}")
def stream_bucket_agg(v):
    out = finish(v, J.stream_bucket_agg(telemetry(v), "10 minutes"))
    return out.withColumns({c: F.round(c, 6) for c in K.CHANNELS})


@query("stream_sliding_features", f"""SELECT equipment_id, s AS start, count(*) AS n, round(avg(gas_flow), 6) AS mean_gas_flow, round(stddev_pop(gas_flow), 6) AS std_gas_flow, round(regr_slope(gas_flow, tick), 6) AS slope_gas_flow
FROM (SELECT *, unnest([time_bucket(INTERVAL '30 seconds', "timestamp"), time_bucket(INTERVAL '30 seconds', "timestamp") - INTERVAL 30 SECONDS]) AS s FROM telemetry) x
WHERE s + INTERVAL 60 SECONDS <= {_LATE} GROUP BY 1, 2""")
def stream_sliding_features(v):
    out = finish(v, J.stream_sliding_features(telemetry(v)))
    return out.select("equipment_id", "start", "n", *[F.round(f"{s}_gas_flow", 6).alias(f"{s}_gas_flow") for s in ("mean", "std", "slope")])


@query("stream_new_notifications", "SELECT id, line_name FROM notifications WHERE line_name IN (SELECT code FROM user_lines u JOIN lines l ON u.line_id = l.line_id WHERE u.user_id = 7)")
def stream_new_notifications(v):
    mine = v.user_lines.where("user_id = 7").join(v.lines, "line_id").select(F.col("code").alias("line_name"))
    stream = source(v, "notifications", lambda: v.notifications)
    return finish(v, J.stream_new_notifications(stream, mine)).select("id", "line_name")


@query("stream_step_sessions", "SELECT equipment_id, win, step, CAST(run AS BIGINT) AS run FROM win_runs")
def stream_step_sessions(v):
    return finish(v, J.stream_step_sessions(source(v, "steps", lambda: Wn.window_step_label(stepped(v)))))


@query("stream_audit_retention", """SELECT event_id AS id, event_type AS action FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 20 DAYS
ORDER BY ts DESC, event_id DESC LIMIT 700""")
def stream_audit_retention(v):
    audit = source(v, "audit", lambda: v.table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("created_at")))
    stored = finish(v, J.stream_audit_retention(audit))
    return M.audit_retention(stored, F.lit("2024-01-31").cast("timestamp"), 20, 700).select("id", "action")


@query("stream_anomaly_score", G.sql_series("given", live=True) + """SELECT equipment_id, win, round(pca, 6) AS pca, round(var, 6) AS var, round(score, 6) AS score, fired, channel,
CASE WHEN fired AND NOT coalesce(lag(fired) OVER w, false) THEN 'raise' WHEN NOT fired AND lag(fired) OVER w THEN 'clear' END AS action
FROM series WINDOW w AS (PARTITION BY equipment_id ORDER BY win)""")
def stream_anomaly_score(v):
    """Both paths of given models as a stream, window by window."""
    got = finish(v, J.stream_anomaly_score(telemetry(v), G.fitted(v.spark), threshold=G.JUMP))
    return got.select("equipment_id", "win", *[F.round(c, 6).alias(c) for c in ("pca", "var", "score")], "fired", "channel", "action")
