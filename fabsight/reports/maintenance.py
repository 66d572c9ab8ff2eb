"""Repairs, users, work logs, notification jobs and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabsight import constants as K
from fabsight.operators import alarms as A, maintenance as M, notifications as N, telemetry as T
from fabsight.registry import query
from fabsight.sources import tables as S

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("repairs_with_user", "SELECT r.id, r.equipment_id, u.name AS repaired_by_name FROM repairs r LEFT JOIN users u ON r.repaired_by = u.id")
def repairs_with_user(v):
    return M.repairs_with_user(v.repairs, v.users).select("id", "equipment_id", "repaired_by_name")


@query("users_with_lines", """SELECT u.id, u.name, coalesce(string_agg(l.code, ',' ORDER BY l.code), '') AS lines FROM users u
LEFT JOIN user_lines ul ON u.id = ul.user_id LEFT JOIN lines l ON ul.line_id = l.line_id GROUP BY 1, 2""")
def users_with_lines(v):
    return M.users_with_lines(v.users, v.user_lines, v.lines).select("id", "name", F.array_join("lines", ",").alias("lines"))


@query("assigned_lines", "SELECT user_id, code FROM user_lines ul JOIN lines l ON ul.line_id = l.line_id")
def assigned_lines(v):
    return M.assigned_lines(v.user_lines, v.lines)


@query("missing_keys", "SELECT DISTINCT repaired_by AS id FROM repairs WHERE repaired_by NOT IN (SELECT id FROM users)")
def missing_keys(v):
    return M.missing_keys(v.repairs.select(F.col("repaired_by").alias("id")), v.users, "id")


@query("id_set_diff", "SELECT o_orderkey % 2000 AS id FROM orders EXCEPT SELECT id FROM users")
def id_set_diff(v):
    return v.table("orders").select((F.col("o_orderkey") % 2000).alias("id")).subtract(v.users.select("id"))


@query("maintenance_summary", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY repaired_at DESC, id DESC) AS rn FROM repairs),
t AS (SELECT * FROM r WHERE rn <= 100), c AS (SELECT equipment_id, alarm_code_before, count(*) AS n FROM t WHERE alarm_code_before IS NOT NULL GROUP BY 1, 2)
SELECT t.equipment_id, count(*) AS repair_count, max(repaired_at) AS last_repaired_at,
 (SELECT string_agg(alarm_code_before || '=' || n, ',' ORDER BY alarm_code_before) FROM c WHERE c.equipment_id = t.equipment_id) AS alarm_code_counts
FROM t GROUP BY t.equipment_id""")
def maintenance_summary(v):
    out = M.maintenance_summary(v.repairs, K.SUMMARY_REPAIRS)
    pairs = F.transform(F.array_sort(F.map_entries("alarm_code_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.withColumn("alarm_code_counts", F.array_join(pairs, ","))


@query("check_constraints", """SELECT 'status' AS rule, count(*) FILTER (status NOT IN ('done','open')) AS violations FROM work_logs
UNION ALL SELECT 'work_type', count(*) FILTER (work_type NOT IN ('emergency','preventive','repair','inspection')) FROM work_logs
UNION ALL SELECT 'cost', count(*) FILTER (cost > 400000) FROM work_logs
UNION ALL SELECT 'deleted_after_start', count(*) FILTER (deleted_at < started_at) FROM work_logs""")
def check_constraints(v):
    return M.check_constraints(v.work_logs, {
        "status": F.col("status").isin("done", "open"),
        "work_type": F.col("work_type").isin("emergency", "preventive", "repair", "inspection"),
        "cost": F.col("cost") <= 400000, "deleted_after_start": F.col("deleted_at") >= F.col("started_at")})


@query("topk_global", "SELECT id, repaired_at FROM repairs ORDER BY repaired_at DESC, id DESC LIMIT 100")
def topk_global(v):
    return v.repairs.orderBy(F.desc("repaired_at"), F.desc("id")).limit(100).select("id", "repaired_at")


@query("topk_per_group", """SELECT id, equipment_id FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY repaired_at DESC, id DESC) AS rn
FROM repairs) r WHERE rn <= 5""")
def topk_per_group(v):
    return T.top_n_per_key(v.repairs, ["equipment_id"], [F.desc("repaired_at"), F.desc("id")], 5).select("id", "equipment_id")


@query("multi_key_sort", "SELECT equipment_id, row_number() OVER (ORDER BY line_name, display_order ASC NULLS LAST, equipment_id) - 1 AS place FROM master")
def multi_key_sort(v):
    from fabsight.plans.series import number_rows
    return number_rows(v.master.select("equipment_id", "line_name", "display_order"), [],
                       [F.asc_nulls_last("line_name"), F.asc_nulls_last("display_order"), F.asc("equipment_id")], "place").select("equipment_id", "place")


@query("sort_nulls_last", "SELECT code, display_order FROM lines ORDER BY display_order ASC NULLS LAST, code")
def sort_nulls_last(v):
    return v.lines.orderBy(F.asc_nulls_last("display_order"), "code").select("code", "display_order")


@query("replace_set", """SELECT user_id, line_id FROM user_lines WHERE user_id <> 7 UNION ALL
SELECT DISTINCT 7, CAST(n_regionkey AS BIGINT) FROM nation WHERE n_nationkey >= 3""")
def replace_set(v):
    fresh = v.table("nation").where("n_nationkey >= 3").select(F.col("n_regionkey").cast("long").alias("line_id"))
    return M.replace_set(v.user_lines, 7, fresh)


@query("entity_union", """WITH a AS (SELECT equipment_id AS k, alarm_code AS c FROM alarms WHERE alarm_code IS NOT NULL
UNION SELECT equipment_id, alarm_code_before FROM repairs WHERE alarm_code_before IS NOT NULL)
SELECT k AS equipment_id, string_agg(DISTINCT c, ',' ORDER BY c) AS codes FROM a GROUP BY k""")
def entity_union(v):
    a = v.alarms.groupBy("equipment_id").agg(F.collect_set("alarm_code").alias("codes"))  # sets over a fixed vocabulary
    b = v.repairs.groupBy("equipment_id").agg(F.collect_set("alarm_code_before").alias("codes"))
    out = M.entity_union(a, b, "equipment_id", "codes").where(F.size("codes") > 0)
    return out.select("equipment_id", F.array_join("codes", ",").alias("codes"))


@query("common_ids", "SELECT l_suppkey AS id FROM lineitem INTERSECT SELECT o_custkey FROM orders")
def common_ids(v):
    return v.table("lineitem").select(F.col("l_suppkey").alias("id")).intersect(v.table("orders").select("o_custkey"))


@query("concat_parts", "SELECT equipment_id, raised_at AS at FROM alarms UNION ALL SELECT equipment_id, repaired_at FROM repairs")
def concat_parts(v):
    return v.alarms.select("equipment_id", F.col("raised_at").alias("at")).unionByName(
        v.repairs.select("equipment_id", F.col("repaired_at").alias("at")))


@query("distinct_values", "SELECT DISTINCT alarm_code, severity FROM alarms")
def distinct_values(v):
    return v.alarms.select("alarm_code", "severity").distinct()


@query("entity_ref_backfill", "SELECT w.id, m.line_name FROM work_logs w LEFT JOIN master m ON w.equipment_id = m.equipment_id")
def entity_ref_backfill(v):
    logs = v.work_logs.withColumn("line_name", F.lit(None).cast("string"))
    return M.entity_ref_backfill(logs, v.master, "equipment_id", "line_name").select("id", "line_name")


@query("crossjoin_backfill", """WITH f AS (SELECT id FROM notifications WHERE alarm_code = 'ERR-402'),
pairs AS (SELECT u.id AS user_id, f.id AS nid FROM users u CROSS JOIN f UNION SELECT user_id, notification_id FROM reads)
SELECT u.id AS user_id, count(nid) AS n_read FROM users u LEFT JOIN pairs p ON u.id = p.user_id GROUP BY 1""")
def crossjoin_backfill(v):
    return M.global_read_counts(v.notifications, v.reads, v.users, F.col("alarm_code") == "ERR-402")


@query("upsert_by_key", "SELECT c_custkey AS id, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 100 ELSE 0 END AS balance FROM customer")
def upsert_by_key(v):
    base = v.users.select("id", "balance")
    return S.upsert_by_key(base, base.where("id % 3 = 0").withColumn("balance", F.col("balance") + 100), ["id"])


@query("insert_if_absent", "SELECT DISTINCT o_custkey % 3000 AS id FROM orders WHERE o_custkey % 3000 NOT IN (SELECT id FROM users WHERE id % 2 = 0)")
def insert_if_absent(v):
    return S.new_rows(v.users.where("id % 2 = 0"), v.table("orders").select((F.col("o_custkey") % 3000).alias("id")), ["id"])


@query("replace_partition", """SELECT doc_id, n_chars FROM documents WHERE lang <> 'en'
UNION ALL SELECT doc_id, n_chars + 1 FROM documents WHERE lang = 'en'""")
def replace_partition(v):
    d = v.table("documents").select("doc_id", "n_chars", "lang")
    fresh = d.where("lang = 'en'").withColumn("n_chars", F.col("n_chars") + 1)
    return S.replace_partition(d, fresh).select("doc_id", "n_chars")


@query("purge_except", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def purge_except(v):
    return S.purge_except(v.table("documents").select("doc_id", "lang"), v.table("labels").select("doc_id"))


@query("notification_sync", """SELECT n.equipment_id, n.metric, n.alarm_code, n.bucket_start, n.source_alarm_id FROM notifications n
WHERE n.id NOT IN (SELECT id FROM notifications WHERE occurred_at < TIMESTAMP '2024-01-15')""")
def notification_sync(v):
    stored = v.notifications.where(F.col("occurred_at") < "2024-01-15")
    return N.notification_sync(v.alarms, v.master, stored, "en").select("equipment_id", "metric", "alarm_code", "bucket_start", "source_alarm_id")


@query("mark_read", """SELECT user_id, count(*) AS n FROM (SELECT notification_id, user_id FROM reads
UNION SELECT id, 1 FROM notifications WHERE line_name = 'ASIA') x GROUP BY 1""")
def mark_read(v):
    out = N.mark_read(v.reads, N.line_scope(v.notifications, ["ASIA"]), 1, now())
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("mark_unread", """SELECT notification_id, user_id FROM reads WHERE NOT (user_id = 1 AND notification_id IN
(SELECT id FROM notifications WHERE line_name = 'ASIA'))""")
def mark_unread(v):
    return N.mark_unread(v.reads, N.line_scope(v.notifications, ["ASIA"]), 1).select("notification_id", "user_id")


@query("mark_all_read", "SELECT DISTINCT notification_id FROM (SELECT notification_id FROM reads WHERE user_id = 2 UNION ALL SELECT id FROM notifications)")
def mark_all_read(v):
    return N.mark_read(v.reads, v.notifications, 2, now()).where("user_id = 2").select("notification_id")


@query("alarm_clear", f"""SELECT alarm_id, CASE WHEN cleared_at IS NULL AND equipment_id IN (SELECT equipment_id FROM master WHERE line_name = 'ASIA')
THEN TIMESTAMP '{NOW}' ELSE cleared_at END AS cleared_at FROM alarms""")
def alarm_clear(v):
    return A.alarm_clear(v.master, v.alarms, v.master.where("line_name = 'ASIA'"), now())[1].select("alarm_id", "cleared_at")


@query("apply_repairs", """WITH r AS (SELECT o_orderkey AS id, 'EQP-' || lpad(CAST(o_custkey % 20 AS VARCHAR), 3, '0') AS equipment_id,
  TIMESTAMP '2024-01-01 00:00:02.5' + to_seconds(CAST(o_orderkey * 3 AS BIGINT)) AS repaired_at FROM orders)
SELECT r.id, t.alarm_code AS alarm_code_snapshot FROM r ASOF LEFT JOIN telemetry t ON r.equipment_id = t.equipment_id AND r.repaired_at >= t."timestamp" """)
def apply_repairs(v):
    from fabsight.reports.relational import points
    repairs = points(v).select("id", "equipment_id", F.col("occurred_at").alias("repaired_at"))
    return M.apply_repairs(repairs, v.telemetry, v.master)[0].select("id", "alarm_code_snapshot")


@query("complete_work_logs", f"""SELECT m.equipment_id, CASE WHEN m.equipment_id IN (SELECT equipment_id FROM work_logs WHERE status = 'open'
AND work_type IN ('preventive','inspection')) THEN DATE '2024-02-01' END AS last_inspection_at,
(SELECT count(*) FROM work_logs w WHERE w.equipment_id = m.equipment_id AND status = 'open' AND work_type IN ('emergency','repair')) AS new_repairs
FROM master m""")
def complete_work_logs(v):
    done = v.work_logs.where("status = 'open'").select("id")
    _, repairs, master = M.complete_work_logs(v.work_logs, done, v.telemetry, v.master, now())
    n = repairs.groupBy("equipment_id").agg(F.count(F.lit(1)).alias("new_repairs"))
    return master.join(n, "equipment_id", "left").select("equipment_id", "last_inspection_at", F.coalesce("new_repairs", F.lit(0)).alias("new_repairs"))


def _requests(v):
    return v.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("source_notification_id"),
        F.lit(None).cast("string").alias("equipment_id"))


@query("work_log_from_notification", "SELECT o_orderkey AS id, n.equipment_id, n.alarm_code FROM orders JOIN notifications n ON o_orderkey = n.id")
def work_log_from_notification(v):
    kept, _ = M.work_log_from_notification(_requests(v), v.notifications)
    return kept.select("id", "equipment_id", "alarm_code")


@query("work_log_rejects", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM notifications)")
def work_log_rejects(v):
    return M.work_log_from_notification(_requests(v), v.notifications)[1].select("id")


@query("soft_delete", f"""SELECT id, CASE WHEN deleted_at IS NULL AND owner % 4 = 1 THEN TIMESTAMP '{NOW}' ELSE deleted_at END AS deleted_at FROM work_logs""")
def soft_delete(v):
    targets = v.work_logs.select("id", F.when(F.col("owner") % 4 == 1, F.col("owner")).otherwise(-1).alias("owner"))
    return M.soft_delete(v.work_logs, targets, "owner", now()).select("id", "deleted_at")


@query("partial_update", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'operator' ELSE c_mktsegment END AS role,
CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer""")
def partial_update(v):
    patch = v.users.where("id % 2 = 0").select("id", F.lit("operator").alias("role"), F.lit(None).cast("double").alias("balance"),
                                               F.when(F.col("id") % 10 == 0, F.array(F.lit("role"), F.lit("balance"))).otherwise(F.array(F.lit("role"))).alias("given"))
    return M.partial_update(v.users.select("id", "role", "balance"), patch, "id", ["role", "balance"])


@query("delete_cascade", """SELECT 'links' AS part, count(*) AS n FROM user_lines WHERE line_id NOT IN (SELECT line_id FROM lines WHERE status = 'inactive')
UNION ALL SELECT 'orphaned', count(*) FROM repairs WHERE repaired_by NOT IN (SELECT id FROM users)""")
def delete_cascade(v):
    _, links = M.delete_cascade(v.lines, v.user_lines, v.lines.where("status = 'inactive'").select("line_id"))
    orphans = M.null_missing_reference(v.repairs, "repaired_by", v.users).where(F.col("repaired_by").isNull())
    return links.select(F.lit("links").alias("part")).unionByName(orphans.select(F.lit("orphaned").alias("part"))).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"))


@query("time_reanchor", f"""SELECT alarm_id, raised_at + (TIMESTAMP '{NOW}' - (SELECT max(raised_at) FROM alarms)) AS raised_at,
cleared_at + (TIMESTAMP '{NOW}' - (SELECT max(raised_at) FROM alarms)) AS cleared_at FROM alarms""")
def time_reanchor(v):
    return T.time_reanchor(v.alarms, ["raised_at", "cleared_at"], "raised_at", now()).select("alarm_id", "raised_at", "cleared_at")


@query("rebucket", """SELECT equipment_id, metric, alarm_code, time_bucket(INTERVAL '1 hour', raised_at) AS bucket_start, min(alarm_id) AS alarm_id
FROM alarms GROUP BY 1, 2, 3, 4""")
def rebucket(v):
    return N.rebucket(v.alarms, "raised_at", 3600, ["equipment_id", "metric", "alarm_code"], "alarm_id").select(
        "equipment_id", "metric", "alarm_code", "bucket_start", "alarm_id")


@query("dedup_keep_first", """SELECT id, equipment_id, alarm_code, bucket_start FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id, alarm_code, bucket_start
ORDER BY occurred_at, id) AS rn FROM notifications) x WHERE rn = 1""")
def dedup_keep_first(v):
    rows = v.notifications.select("id", "equipment_id", "alarm_code", "bucket_start", "occurred_at")
    return N.dedup_keep_first(rows, ["equipment_id", "alarm_code", "bucket_start"], ["occurred_at", "id"]).drop("occurred_at")


@query("rename_values", "SELECT c_custkey AS id, CASE WHEN c_mktsegment LIKE '%ING' THEN replace(c_mktsegment, 'ING', '라인') ELSE c_mktsegment END AS role FROM customer")
def rename_values(v):
    return M.rename_values(v.users, "role", "ING", "라인").select("id", "role")


def _audit(v):
    return v.table("events").select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), (F.col("event_type") != "error").alias("success"),
        F.col("ts").cast("timestamp").alias("created_at"))


@query("audit_recent", """SELECT event_id AS id, ts AS created_at FROM events WHERE ts > TIMESTAMP '2024-01-17' AND event_type = 'error'
ORDER BY ts DESC, event_id DESC LIMIT 50""")
def audit_recent(v):
    return M.audit_recent(_audit(v), F.lit("2024-01-31").cast("timestamp"), 14, 50, success=False).select("id", "created_at")


@query("audit_cap", "SELECT event_id AS id, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def audit_cap(v):
    return M.audit_cap(_audit(v), 2000).select("id", "action")
