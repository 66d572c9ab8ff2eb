"""Files in and out, and the tool functions offered to SQL users."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from fabsight import constants as K, tools
from fabsight.operators import conversations as C, evaluate as E
from fabsight.registry import query
from fabsight.reports.conversations import answers
from fabsight.reports.evaluation import matched
from fabsight.sources import tables as S


def folder(v) -> str:
    return f"{v.spark.sparkContext.getCheckpointDir()}/exchange-{uuid.uuid4().hex}"


def eval_set(v) -> str:
    """Evaluation set of the readings written with the package's own writer, once per session."""
    if "eval_set" not in v._stored:
        root = folder(v)
        cols = ["equipment_id", "tick", F.lit("mixed").alias("scenario"), "alarm_code", *K.CHANNELS, *[f"alarm_{c}" for c in K.CHANNELS]]
        labels = v.incidents.select("equipment_id", "kind", F.array(F.lit("temperature"), F.lit("pressure")).alias("variables"), "start_tick", "end_tick")
        S.write_eval_set(v.telemetry.select(*cols), v.normal.select(*cols), labels, root)
        # the nested run configuration, one document with one segment per equipment
        seg = v.master.agg(F.to_json(F.struct(F.struct(F.struct(F.array_sort(F.collect_list(F.struct("equipment_id", "process_type"))).alias("segments")).alias("eval")).alias("config"))).alias("value"))
        seg.coalesce(1).write.text(f"{root}/manifest.json")
        v._stored["eval_set"] = root
    return v._stored["eval_set"]


@query("write_eval_set", "SELECT 'eval' AS part, count(*) AS n FROM telemetry UNION ALL SELECT 'train', count(*) FROM telemetry WHERE alarm_code IS NULL UNION ALL SELECT 'events', count(*) FROM incidents")
def write_eval_set(v):
    root = eval_set(v)
    parts = [S.scan_eval_parquet(v.spark, root).select(F.lit("eval").alias("part")), S.scan_eval_parquet(v.spark, root, "train_normal").select(F.lit("train").alias("part")),
             S.scan_events_json(v.spark, root, True).select(F.lit("events").alias("part"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("scan_eval_parquet", "SELECT equipment_id, tick, alarm_code, temperature FROM telemetry")
def scan_eval_parquet(v):
    return S.scan_eval_parquet(v.spark, eval_set(v)).select("equipment_id", "tick", "alarm_code", "temperature")


@query("scan_events_json", "SELECT equipment_id, kind, start_tick, end_tick, unnest(['temperature', 'pressure']) AS variable FROM incidents")
def scan_events_json(v):
    return S.scan_events_json(v.spark, eval_set(v), True).select("equipment_id", "kind", "start_tick", "end_tick", F.explode("variables").alias("variable"))


@query("scan_manifest_map", "SELECT equipment_id, process_type FROM master")
def scan_manifest_map(v):
    return S.scan_manifest_map(v.spark, eval_set(v))


@query("scan_golden_cases", "SELECT CAST(item_id AS VARCHAR) AS id, length(text) AS n FROM benchmark WHERE item_id % 3 = 0")
def scan_golden_cases(v):
    """Cases written as JSON lines; those with expected documents are read back."""
    path = f"{folder(v)}/cases"
    docs = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("d1"))).otherwise(F.array().cast("array<string>"))
    v.table("benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.struct(docs.alias("rag_hit_docs")).alias("expect")).write.json(path)
    return S.scan_golden_cases(v.spark, path, "rag_hit_docs").select("id", F.length("query").alias("n"))


@query("experiment_snapshot", "SELECT kind, round(avg(CAST(detected AS INT)), 8) AS recall, 3 AS grace FROM matched GROUP BY ROLLUP (kind)")
def experiment_snapshot(v):
    path = f"{folder(v)}/runs"
    metrics = E.recall_by_kind(matched(v)).select("kind", F.round("recall", 8).alias("recall"))
    S.experiment_snapshot(metrics, json.dumps({"grace": 3}), "2024-02-01 00:00:00", path)
    return v.spark.read.parquet(path).select("kind", "recall", F.get_json_object("config", "$.grace").cast("long").alias("grace"))


_PAIRS = """(SELECT b.id || '-' || b.rep AS id, b.category, b.answer AS ab, a.answer AS aa FROM (SELECT * FROM answers WHERE config = 'before') b
JOIN (SELECT * FROM answers WHERE config = 'after') a ON a.id = b.id AND a.rep = b.rep)"""


def sheet(v):
    """Every repetition of every case as a blinded pair, written once per session."""
    if "sheet" not in v._stored:
        rows = answers(v).withColumn("id", F.concat_ws("-", F.col("id").cast("string"), F.col("rep").cast("string")))
        pairs = C.judge_case_join(rows.where("config = 'before'"), rows.where("config = 'after'"), rows.select("id", "category").distinct())
        pairs = pairs.withColumn("query", F.concat(F.lit("q"), F.col("id")))
        root = folder(v)
        S.spotcheck_export(*C.spotcheck_rows(pairs), root)
        v._stored["sheet"] = root
    return v._stored["sheet"]


@query("spotcheck_import", f"SELECT id, category, length(ab) + length(aa) AS n FROM {_PAIRS} p")
def spotcheck_import(v):
    # answers keep their line breaks through the quoted sheet; both slots together hold both texts
    back = S.spotcheck_import(v.spark, sheet(v))
    return back.select("id", "category", (F.length("answer_slot1") + F.length("answer_slot2")).alias("n"))


@query("spotcheck_export", f"SELECT id, true AS swapped_once FROM {_PAIRS} p")
def spotcheck_export(v):
    key = v.spark.read.schema("id string, slot1 string, slot2 string").json(f"{sheet(v)}/key")
    return key.select("id", (F.col("slot1") != F.col("slot2")).alias("swapped_once"))


_ASKED = "Data model of the pressure and the gas flow, how many records does it hold?"
_LETTERS = "list_transform(string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z', ','), lambda l: CAST(len(lower({0})) - len(replace(lower({0}), l, '')) AS DOUBLE))"
_SCALED = "greatest(CASE WHEN max(score) OVER () <= min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END, 1e-6)"
_WEEK = "TIMESTAMP '2024-01-10'", "TIMESTAMP '2024-01-20'"


@query("tool_functions", f"""WITH q AS (SELECT '{_ASKED}' AS text),
sparse AS (SELECT chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT sum(tf) / count(DISTINCT chunk_id) FROM posts)))) AS score
 FROM (SELECT term, count(*) AS qtf FROM (SELECT unnest(string_split(text, ' ')) AS term FROM q) x GROUP BY 1) w JOIN posts USING (term) JOIN idfs USING (term) GROUP BY 1 HAVING score > 0 ORDER BY round(score, 9) DESC, chunk_id LIMIT 10),
cos AS (SELECT chunk_id, list_cosine_similarity(v, {_LETTERS.format("text")}) AS score FROM chunk_vecs, q WHERE chunk_index_of(chunk_id) % 3 = 1 ORDER BY round(score, 9) DESC, chunk_id LIMIT 10),
b AS (SELECT chunk_id, ds, dn, ss, sn FROM (SELECT chunk_id, score AS ds, {_SCALED} AS dn FROM cos WHERE score >= 0.2) d FULL JOIN (SELECT chunk_id, score AS ss, {_SCALED} AS sn FROM sparse) s USING (chunk_id)),
f AS (SELECT chunk_id, CASE WHEN max(sn) OVER () IS NULL THEN ds WHEN max(dn) OVER () IS NULL THEN ss ELSE 0.5 * coalesce(dn, 0) + 0.5 * coalesce(sn, 0) END AS score, dn IS NULL AS side, coalesce(ds, ss) AS own FROM b),
top AS (SELECT chunk_id, score FROM f ORDER BY round(score, 9) DESC, side, round(own, 9) DESC, chunk_id LIMIT 10),
newest AS (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY repaired_at DESC, id DESC) AS rn FROM repairs),
counts AS (SELECT equipment_id, alarm_code_before AS code, count(*) AS n FROM newest WHERE rn <= 100 GROUP BY 1, 2)
SELECT 'get_equipment_metadata' AS tool, equipment_id AS name, process_type || '/' || line_name || '/' || location AS said, 0.0 AS n FROM master
UNION ALL SELECT 'get_repair_history', CAST(r.id AS VARCHAR), equipment_id || '/' || coalesce(alarm_code_before, '-') || '/' || coalesce(name, '-'), epoch(repaired_at) FROM newest r LEFT JOIN users u ON u.id = r.repaired_by
 WHERE rn <= 5 AND repaired_at >= TIMESTAMP '1995-01-01'
UNION ALL SELECT 'get_maintenance_summary', equipment_id, coalesce(string_agg(code || '=' || n, ',' ORDER BY code), ''), sum(n) FROM counts GROUP BY equipment_id
UNION ALL SELECT 'get_maintenance_summary', 'nowhere', '', 0
UNION ALL SELECT 'get_alarm_history', alarm_code, strftime(min(raised_at), '%Y-%m-%d %H:%M:%S') || '/' || strftime(max(raised_at), '%Y-%m-%d %H:%M:%S'), count(*) FROM alarms WHERE raised_at >= {_WEEK[0]} AND raised_at <= {_WEEK[1]} GROUP BY 2
UNION ALL SELECT 'get_sensor_logs', equipment_id || ' ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S'), coalesce(alarm_code, '-'), temperature FROM telemetry
 WHERE equipment_id = 'EQP-003' AND "timestamp" >= TIMESTAMP '2024-01-01 00:10:00' AND "timestamp" <= TIMESTAMP '2024-01-01 00:30:00'
UNION ALL SELECT 'search_manuals', chunk_id, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS VARCHAR), round(score, 6) FROM top QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) <= 5
""".replace("chunk_index_of(chunk_id)", "CAST(split_part(chunk_id, '#', 2) AS INT)"))
def tool_functions(v):
    """All six SQL table functions, called and put into one report."""
    from fabsight.reports.retrieval import chunk_vecs, lexical
    manuals = chunk_vecs(v).select("chunk_id", "doc_id", "content", (F.col("chunk_index") % 3).cast("string").alias("tag"), "embedding")
    tools.register(v.spark, v.telemetry, v.alarms, v.master, v.repairs, v.users, manuals, lexical(v))
    low = _ASKED.lower()
    encoded = ", ".join(f"{low.count(c)}D" for c in "abcdefghijklmnopqrstuvwxyz")
    when = "date_format({0}, 'yyyy-MM-dd HH:mm:ss')"
    return v.spark.sql(f"""SELECT 'get_equipment_metadata' AS tool, equipment_id AS name, concat_ws('/', process_type, line_name, location) AS said, 0D AS n FROM get_equipment_metadata(NULL, NULL)
UNION ALL SELECT 'get_repair_history', CAST(id AS STRING), concat_ws('/', equipment_id, coalesce(alarm_code_before, '-'), coalesce(repaired_by_name, '-')), CAST(unix_timestamp(repaired_at) AS DOUBLE)
 FROM get_repair_history(NULL, NULL, NULL, 5) WHERE repaired_at >= TIMESTAMP '1995-01-01'
UNION ALL SELECT 'get_maintenance_summary', equipment_id, array_join(transform(array_sort(map_entries(alarm_code_counts)), e -> concat(e.key, '=', e.value)), ','), CAST(repair_count AS DOUBLE)
 FROM (SELECT * FROM get_maintenance_summary(NULL) UNION ALL SELECT * FROM get_maintenance_summary('nowhere')) m
UNION ALL SELECT 'get_alarm_history', alarm_code, concat({when.format("first_at")}, '/', {when.format("last_at")}), CAST(occurrences AS DOUBLE) FROM get_alarm_history(NULL, {_WEEK[0]}, {_WEEK[1]}, NULL)
UNION ALL SELECT 'get_sensor_logs', concat(equipment_id, ' ', {when.format("at")}), coalesce(alarm_code, '-'), temperature
 FROM get_sensor_logs(TIMESTAMP '2024-01-01 00:10:00', TIMESTAMP '2024-01-01 00:30:00', 'EQP-003', NULL)
UNION ALL SELECT 'search_manuals', chunk_id, CAST(rank AS STRING), round(score, 6) FROM search_manuals('{_ASKED}', array({encoded}), 5, '1')""")
