"""Status, range, paging and time-bucket reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabsight import constants as K
from fabsight.functions.alarms import assess_status, work_type_of_alarm
from fabsight.operators import alarms as A, notifications as N, telemetry as T
from fabsight.registry import query

STATUS_SQL = "CASE WHEN alarm_code IS NULL THEN 'normal' WHEN alarm_code = 'ERR-402' THEN 'critical' ELSE 'warning' END"
LATEST_SQL = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY "timestamp" DESC, log_id DESC) AS rn FROM telemetry) t
  WHERE rn = 1)"""
START, END = "2024-01-01 00:10:00", "2024-01-01 02:00:00"


@query("latest_status", f"""WITH {LATEST_SQL}
SELECT m.equipment_id, m.line_name, alarm_code, "timestamp" AS last_seen, {STATUS_SQL} AS status
FROM master m LEFT JOIN latest l ON m.equipment_id = l.equipment_id""")
def latest_status(v):
    return T.latest_status(v.master, v.telemetry).select(
        "equipment_id", "line_name", "alarm_code", F.col("timestamp").alias("last_seen"), "status")


# an open alarm of the feed plays the open multivariate alarm
@query("status_with_anomaly_overlay", f"""WITH {LATEST_SQL},
active AS (SELECT DISTINCT equipment_id FROM alarms WHERE cleared_at IS NULL AND alarm_code = 'WRN-701'),
s AS (SELECT m.equipment_id, m.line_name, coalesce(l.alarm_code, CASE WHEN a.equipment_id IS NOT NULL THEN 'WRN-901' END) AS alarm_code
  FROM master m LEFT JOIN latest l ON m.equipment_id = l.equipment_id LEFT JOIN active a ON m.equipment_id = a.equipment_id)
SELECT equipment_id, line_name, alarm_code, {STATUS_SQL} AS status FROM s""")
def status_with_anomaly_overlay(v):
    active = A.active_equipment(v.alarms, "WRN-701")
    return T.status_with_anomaly_overlay(T.latest_status(v.master, v.telemetry), active).select(
        "equipment_id", "line_name", "alarm_code", "status")


@query("assess_status", f"""SELECT {STATUS_SQL} AS status, count(*) AS n FROM telemetry GROUP BY 1""")
def assess(v):
    return v.telemetry.groupBy(assess_status(F.col("alarm_code")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_table", "SELECT event_id, event_type, value FROM events")
def scan_table(v):
    return v.table("events").select("event_id", "event_type", "value")


@query("sensor_logs_raw", f"""SELECT equipment_id, log_id, "timestamp", temperature, pressure, alarm_code FROM telemetry
WHERE "timestamp" >= TIMESTAMP '{START}' AND "timestamp" <= TIMESTAMP '{END}' ORDER BY "timestamp" DESC, log_id DESC LIMIT 500""")
def sensor_logs_raw(v):
    return T.sensor_logs_raw(v.telemetry, START, END, K.SENSOR_ROW_BUDGET).select(
        "equipment_id", "log_id", "timestamp", "temperature", "pressure", "alarm_code")


def _bucket_sql(width: float, where: str = "", limit: str = "") -> str:
    us = round(width * 1_000_000)
    cols = ", ".join(f"round(avg({c}), 6) AS {c}, min({c}) AS {c}_min, max({c}) AS {c}_max, round(avg({c}_center), 6) AS {c}_center"
                     for c in K.CHANNELS)
    return f"""SELECT equipment_id,
  make_timestamp(epoch_us(TIMESTAMP '{START}') + CAST(floor((epoch_us("timestamp") - epoch_us(TIMESTAMP '{START}')) / {us}.0) AS BIGINT) * {us}) AS bucket,
  {cols}, coalesce(min(alarm_code) FILTER (alarm_code LIKE 'ERR%'), min(alarm_code)) AS alarm_code
FROM telemetry {where} GROUP BY 1, 2 {limit}"""


def _rounded(df):
    names = [c for ch in K.CHANNELS for c in (ch, f"{ch}_center")]
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("sensor_logs_bucketed", _bucket_sql(600))
def sensor_logs_bucketed(v):
    return _rounded(T.sensor_logs_bucketed(v.telemetry, START, 600))


_SHORT, _SCREEN = "2024-01-01 00:30:00", [c for ch in K.CHANNELS for c in (ch, f"{ch}_center")]
_WIDTH = "(greatest(1, CAST(round(6600000000.0 / (greatest(2, 500 // (SELECT count(*) FROM master)) - 1)) AS BIGINT)))"


@query("sensor_logs_auto", f"""SELECT * FROM (SELECT 'equipment' AS screen, equipment_id, bucket AS at, {", ".join(_SCREEN)}, alarm_code FROM (
{_bucket_sql(6600 / 499, f"""WHERE equipment_id = 'EQP-003' AND "timestamp" >= TIMESTAMP '{START}' AND "timestamp" <= TIMESTAMP '{END}'""", "ORDER BY 2 LIMIT 500")}) a)
UNION ALL SELECT * FROM (SELECT 'all' AS screen, equipment_id, make_timestamp(epoch_us(TIMESTAMP '{START}') + (epoch_us("timestamp") - epoch_us(TIMESTAMP '{START}')) // {_WIDTH} * {_WIDTH}) AS at,
 {", ".join(f"round(avg({c}), 6) AS {c}" for c in _SCREEN)}, coalesce(min(alarm_code) FILTER (alarm_code LIKE 'ERR%'), min(alarm_code)) AS alarm_code
 FROM telemetry WHERE "timestamp" >= TIMESTAMP '{START}' AND "timestamp" <= TIMESTAMP '{END}' GROUP BY 2, 3 ORDER BY 3, 2 LIMIT 500) b
UNION ALL SELECT * FROM (SELECT 'raw' AS screen, equipment_id, "timestamp" AS at, {", ".join(f"round({c}, 6) AS {c}" for c in _SCREEN)}, alarm_code
 FROM telemetry WHERE equipment_id = 'EQP-003' AND "timestamp" >= TIMESTAMP '{START}' AND "timestamp" <= TIMESTAMP '{_SHORT}') c""")
def sensor_logs_auto(v):
    """Three screens: one equipment and all of them over a long range (buckets), one equipment over a short range (its rows)."""
    from datetime import datetime
    start, end, short = (datetime.fromisoformat(x) for x in (START, END, _SHORT))
    out = None
    for screen, until, equipment in (("equipment", end, "EQP-003"), ("all", end, None), ("raw", short, "EQP-003")):
        rows = T.sensor_logs_auto(v.telemetry, v.master, start, until, equipment, limit=K.SENSOR_ROW_BUDGET)
        at = "bucket" if "bucket" in rows.columns else "timestamp"
        rows = rows.select(F.lit(screen).alias("screen"), "equipment_id", F.col(at).alias("at"), *[F.round(c, 6).alias(c) for c in _SCREEN], "alarm_code")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("telemetry_projection", """SELECT equipment_id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS "timestamp", temperature,
temperature_center, pressure, pressure_center, rf_power, rf_power_center, gas_flow, gas_flow_center, alarm_code FROM telemetry""")
def telemetry_projection(v):
    return T.telemetry_projection(v.telemetry)


@query("closed_range", """SELECT alarm_id, raised_at FROM alarms
WHERE raised_at >= TIMESTAMP '2024-01-05' AND raised_at <= TIMESTAMP '2024-01-20 12:00:00'""")
def closed_range(v):
    return v.alarms.where(T.closed_range("raised_at", "2024-01-05", "2024-01-20 12:00:00")).select("alarm_id", "raised_at")


@query("half_open_range", """SELECT id, occurred_at FROM notifications
WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-20'""")
def half_open_range(v):
    return v.notifications.where(T.half_open_range("occurred_at", "2024-01-05", "2024-01-20")).select("id", "occurred_at")


@query("optional_filters", "SELECT alarm_id, equipment_id, alarm_code FROM alarms WHERE alarm_code = 'ERR-402'")
def optional_filters(v):
    return T.optional_filters(v.alarms, equipment_id=None, alarm_code="ERR-402").select("alarm_id", "equipment_id", "alarm_code")


@query("keyset_page", """SELECT id, repaired_at, row_number() OVER (ORDER BY repaired_at DESC, id DESC) > 50 AS overflow FROM (
SELECT id, repaired_at FROM repairs WHERE (repaired_at, id) < (TIMESTAMP '2000-01-01', 5000) ORDER BY repaired_at DESC, id DESC LIMIT 51) p""")
def keyset_page(v):
    return N.keyset_page(v.repairs, "repaired_at", "id", 50, ("2000-01-01", 5000)).select("id", "repaired_at", "overflow")


@query("offset_page", """SELECT id, occurred_at, (SELECT count(*) FROM notifications) AS total
FROM notifications ORDER BY occurred_at DESC, id DESC LIMIT 20 OFFSET 40""")
def offset_page(v):
    rows, info = N.offset_page(v.notifications.select("id", "occurred_at"), [F.desc("occurred_at"), F.desc("id")], 3, 20)
    return rows.withColumn("total", F.lit(info["total"]).cast("long"))


@query("line_scope", """SELECT n.id, n.line_name FROM notifications n WHERE n.line_name IN
(SELECT code FROM user_lines u JOIN lines l ON u.line_id = l.line_id WHERE u.user_id = 7)""")
def line_scope(v):
    mine = v.user_lines.where(F.col("user_id") == 7).join(v.lines, "line_id").select(F.col("code").alias("line_name"))
    return N.line_scope(v.notifications, mine).select("id", "line_name")


@query("soft_delete_filter", "SELECT id, work_type, status FROM work_logs WHERE deleted_at IS NULL")
def soft_delete_filter(v):
    from fabsight.operators.maintenance import live
    return live(v.work_logs).select("id", "work_type", "status")


@query("active_filter_nulls_last", """SELECT code, display_order, row_number() OVER (ORDER BY display_order ASC NULLS LAST, code) AS place
FROM lines WHERE status = 'active'""")
def active_filter_nulls_last(v):
    from fabsight.operators.maintenance import active_lines
    return active_lines(v.lines).select("code", "display_order", "place")


@query("equipment_metadata", "SELECT equipment_id, line_name, process_type, location FROM master WHERE line_name = 'ASIA'")
def equipment_metadata(v):
    return T.optional_filters(v.master, line_name="ASIA").select("equipment_id", "line_name", "process_type", "location")


@query("work_type_of_alarm", """SELECT alarm_code, CASE WHEN alarm_code LIKE 'ERR-%' THEN 'emergency'
WHEN alarm_code IN ('WRN-701','WRN-702','WRN-703','WRN-704') THEN 'preventive' WHEN alarm_code LIKE 'WRN-%' THEN 'repair' ELSE 'etc' END AS work_type,
count(*) AS n FROM alarms GROUP BY 1, 2""")
def work_type(v):
    return v.alarms.groupBy("alarm_code", work_type_of_alarm(F.col("alarm_code")).alias("work_type")).agg(F.count(F.lit(1)).alias("n"))


@query("logs_by_line_semi", """SELECT equipment_id, log_id, temperature FROM telemetry
WHERE equipment_id IN (SELECT equipment_id FROM master WHERE line_name = 'EUROPE')""")
def logs_by_line_semi(v):
    return T.on_line(v.telemetry, v.master, "EUROPE").select("equipment_id", "log_id", "temperature")


@query("logs_by_line_topn_per_equipment", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY "timestamp" DESC, log_id DESC) AS rn
FROM telemetry WHERE "timestamp" >= TIMESTAMP '{START}' AND "timestamp" <= TIMESTAMP '{END}'
 AND equipment_id IN (SELECT equipment_id FROM master WHERE line_name = 'AFRICA'))
SELECT equipment_id, log_id, "timestamp" FROM r WHERE rn <= 500 ORDER BY "timestamp" DESC, log_id DESC LIMIT 500""")
def logs_by_line_topn(v):
    return T.logs_by_line(v.telemetry, v.master, "AFRICA", START, END, K.SENSOR_ROW_BUDGET).select("equipment_id", "log_id", "timestamp")


@query("latched_alarm", """WITH r AS (SELECT t.equipment_id, alarm_code, "timestamp", log_id, row_number() OVER (PARTITION BY t.equipment_id
 ORDER BY CASE WHEN alarm_code LIKE 'ERR%' THEN 2 ELSE 1 END DESC, "timestamp" DESC, log_id DESC) AS rn
 FROM telemetry t JOIN master m ON t.equipment_id = m.equipment_id
 WHERE alarm_code IS NOT NULL AND (alarm_cleared_at IS NULL OR "timestamp" > alarm_cleared_at))
SELECT equipment_id, alarm_code, "timestamp", log_id FROM r WHERE rn = 1""")
def latched_alarm(v):
    return A.latched_alarm(v.telemetry, v.master)


@query("latest_per_key", f"WITH {LATEST_SQL} SELECT equipment_id, log_id, temperature, alarm_code FROM latest")
def latest_per_key(v):
    return T.latest_per_key(v.telemetry, ["equipment_id"], ["timestamp", "log_id"], ["log_id", "temperature", "alarm_code"])


@query("alarm_history", """SELECT alarm_code, count(*) AS occurrences, min(raised_at) AS first_at, max(raised_at) AS last_at FROM alarms GROUP BY 1""")
def alarm_history(v):
    return A.alarm_history(v.alarms)


@query("alarm_sensor_summary", """SELECT metric, count(*) AS occurrences, min(raised_at) AS first_at, max(raised_at) AS last_at FROM alarms GROUP BY 1""")
def alarm_sensor_summary(v):
    return A.alarm_sensor_summary(v.alarms)


@query("active_anomaly_equipment", "SELECT DISTINCT equipment_id FROM alarms WHERE alarm_code = 'ERR-402' AND cleared_at IS NULL")
def active_anomaly_equipment(v):
    return A.active_equipment(v.alarms, "ERR-402")


@query("lines_with_counts", "SELECT line_name, count(*) AS equipments FROM master GROUP BY 1")
def lines_with_counts(v):
    return v.master.groupBy("line_name").agg(F.count(F.lit(1)).alias("equipments"))


@query("count_notifications", "SELECT count(*) AS n FROM notifications WHERE line_name IN ('ASIA','EUROPE') AND occurred_at >= TIMESTAMP '2024-01-10'")
def count_notifications(v):
    rows = N.line_scope(v.notifications.where(T.half_open_range("occurred_at", "2024-01-10", None)), ["ASIA", "EUROPE"])
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("available_dates", "SELECT DISTINCT CAST(occurred_at + INTERVAL 9 HOURS AS DATE) AS local_date FROM notifications")
def available_dates(v):
    return N.available_dates(v.notifications, "occurred_at")


@query("notification_groups", "SELECT equipment_id, line_name, metric, alarm_code, bucket_start, occurred_at, source_alarm_id FROM notifications")
def notification_groups(v):
    return N.notification_groups(v.alarms.join(v.master.select("equipment_id", "line_name"), "equipment_id", "left"))


@query("data_window", """SELECT equipment_id, min("timestamp") AS first_at, max("timestamp") AS last_at,
round(date_diff('second', min("timestamp"), max("timestamp")) / 86400.0, 6) AS span_days FROM telemetry GROUP BY GROUPING SETS ((equipment_id), ())""")
def data_window(v):
    return T.data_window(v.telemetry).withColumn("span_days", F.round("span_days", 6))


@query("alarm_transitions", "SELECT equipment_id, metric, alarm_code, raised_at, cleared_at FROM alarms")
def alarm_transitions(v):
    return A.alarm_transitions(v.feed, ["equipment_id", "metric"], "pos", "ts", "alarm_code")


@query("confirm_two_ticks", """SELECT event_id, CASE WHEN alarm_code = lag(alarm_code) OVER (PARTITION BY equipment_id, metric ORDER BY ts, event_id)
THEN alarm_code END AS confirmed FROM feed""")
def confirm_two_ticks(v):
    return A.confirm_two_ticks(v.feed, ["equipment_id", "metric"], "pos", "alarm_code").select("event_id", "confirmed")


@query("is_read_flag", """SELECT n.id, r.notification_id IS NOT NULL AS is_read FROM notifications n
LEFT JOIN (SELECT DISTINCT notification_id FROM reads WHERE user_id = 1) r ON n.id = r.notification_id""")
def is_read_flag(v):
    return N.is_read_flag(v.notifications, v.reads, 1).select("id", "is_read")


@query("unread_only", "SELECT id, equipment_id FROM notifications WHERE id NOT IN (SELECT notification_id FROM reads WHERE user_id = 1)")
def unread_only(v):
    return N.unread_only(v.notifications, v.reads, 1).select("id", "equipment_id")


@query("incident_nearest", """WITH p AS (SELECT o_orderkey AS id, 'EQP-' || lpad(CAST(o_custkey % 20 AS VARCHAR), 3, '0') AS equipment_id,
  TIMESTAMP '2024-01-01 00:00:02.5' + to_seconds(CAST(o_orderkey * 3 AS BIGINT)) AS occurred_at FROM orders),
c AS (SELECT id, t."timestamp", log_id, temperature, alarm_code, row_number() OVER (PARTITION BY id
  ORDER BY abs(epoch_us(t."timestamp") - epoch_us(occurred_at)), t."timestamp", log_id) AS rn
  FROM p JOIN telemetry t ON p.equipment_id = t.equipment_id AND t."timestamp" BETWEEN occurred_at - INTERVAL 5 MINUTES AND occurred_at + INTERVAL 5 MINUTES)
SELECT id, "timestamp", log_id, temperature, alarm_code FROM c WHERE rn = 1""")
def incident_nearest(v):
    return T.incident_nearest(points(v), v.telemetry).select("id", "timestamp", "log_id", "temperature", "alarm_code")


@query("incident_baseline", """WITH p AS (SELECT o_orderkey AS id, 'EQP-' || lpad(CAST(o_custkey % 20 AS VARCHAR), 3, '0') AS equipment_id,
  TIMESTAMP '2024-01-01 00:00:02.5' + to_seconds(CAST(o_orderkey * 3 AS BIGINT)) AS occurred_at FROM orders),
c AS (SELECT id, log_id, pressure, row_number() OVER (PARTITION BY id ORDER BY t."timestamp" DESC, log_id DESC) AS rn
  FROM p JOIN telemetry t ON p.equipment_id = t.equipment_id AND t."timestamp" >= occurred_at - INTERVAL 30 MINUTES AND t."timestamp" < occurred_at
  WHERE t.alarm_code IS NULL)
SELECT id, log_id, pressure FROM c WHERE rn <= 20""")
def incident_baseline(v):
    return T.incident_baseline(points(v), v.telemetry).select("id", "log_id", "pressure")


def points(v):
    """Incidents on the time axis of the readings, one per order."""
    from fabsight.views import ORIGIN, equipment_name
    start = F.unix_micros(F.lit(ORIGIN).cast("timestamp")) + 2_500_000
    return v.table("orders").select(
        F.col("o_orderkey").alias("id"), equipment_name(F.col("o_custkey") % 20).alias("equipment_id"),
        F.timestamp_micros(start + F.col("o_orderkey") * 3_000_000).alias("occurred_at"))


@query("incident_context", f"""WITH {LATEST_SQL},
p AS (SELECT o_orderkey AS id, 'EQP-' || lpad(CAST(o_custkey % 20 AS VARCHAR), 3, '0') AS equipment_id,
  TIMESTAMP '2024-01-01 00:00:02.5' + to_seconds(CAST(o_orderkey * 3 AS BIGINT)) AS occurred_at FROM orders),
c AS (SELECT id, temperature, row_number() OVER (PARTITION BY id ORDER BY abs(epoch_us(t."timestamp") - epoch_us(occurred_at)), t."timestamp", log_id) AS rn
  FROM p JOIN telemetry t ON p.equipment_id = t.equipment_id AND t."timestamp" BETWEEN occurred_at - INTERVAL 5 MINUTES AND occurred_at + INTERVAL 5 MINUTES),
b AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY t."timestamp" DESC, log_id DESC) AS rn
  FROM p JOIN telemetry t ON p.equipment_id = t.equipment_id AND t."timestamp" >= occurred_at - INTERVAL 30 MINUTES AND t."timestamp" < occurred_at
  WHERE t.alarm_code IS NULL),
n AS (SELECT id, count(*) AS k FROM b WHERE rn <= 20 GROUP BY id)
SELECT p.id, p.equipment_id, m.line_name, c.temperature AS incident_temperature, coalesce(n.k, 0) AS baseline_rows, l.temperature AS latest_temperature
FROM p LEFT JOIN c ON p.id = c.id AND c.rn = 1 LEFT JOIN n ON p.id = n.id LEFT JOIN latest l ON p.equipment_id = l.equipment_id
LEFT JOIN master m ON p.equipment_id = m.equipment_id""")
def incident_context(v):
    p = points(v).withColumns({"alarm_code": F.lit("ERR-401"), "message": F.lit("")})
    return T.incident_context(p, v.master, v.telemetry).select(
        "id", "equipment_id", "equipment.line_name", F.col("incident.temperature").alias("incident_temperature"),
        F.size("baseline").cast("long").alias("baseline_rows"), F.col("latest.temperature").alias("latest_temperature"))
