"""Declared tables: schemas, scans and keyed writes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

_CH = "temperature {0}, pressure {1}, rf_power {2}, gas_flow {3}".format(
    "decimal(5,2)", "decimal(5,2)", "decimal(6,2)", "decimal(7,2)")

# Domain tables a user brings: parquet with exactly these columns.
SCHEMAS: dict[str, str] = {
    "equipment_masters": "equipment_id string, line_name string, process_type string, location string, manager_dept string, "
    "manager_name string, manager_user_id long, last_inspection_at date, alarm_cleared_at timestamp, repaired_at timestamp, "
    "display_order int, shape string, bay_zone string, position_x decimal(6,3), position_y decimal(6,3), "
    "position_z decimal(6,3), rotation_y decimal(17,15)",
    "equipment_telemetries": f"log_id long, equipment_id string, timestamp timestamp, {_CH}, "
    "temperature_center decimal(5,2), pressure_center decimal(5,2), rf_power_center decimal(6,2), "
    "gas_flow_center decimal(7,2), alarm_code string",
    "equipment_alarms": "alarm_id long, equipment_id string, metric string, alarm_code string, severity string, "
    "raised_at timestamp, cleared_at timestamp",
    "notifications": "id long, occurred_at timestamp, equipment_id string, line_name string, metric string, "
    "alarm_code string, message string, bucket_start timestamp, source_alarm_id long, created_at timestamp",
    "notification_reads": "id long, notification_id long, user_id long, read_at timestamp",
    "lines": "id long, code string, name string, description string, display_order int, status string, "
    "created_at timestamp, updated_at timestamp",
    "user_lines": "id long, user_id long, line_id long",
    "equipment_repairs": "id long, equipment_id string, repaired_by long, repaired_at timestamp, "
    "alarm_code_before string, note string, created_at timestamp",
    "work_logs": "id long, owner_sub string, work_type string, worker_name string, source_notification_id long, "
    "equipment_id string, alarm_code string, started_at timestamp, ended_at timestamp, plan string, completion string, "
    "completed_at timestamp, status string, deleted_at timestamp, created_at timestamp",
    "users": "id long, email string, name string, role string, status string, last_login_at timestamp, "
    "created_at timestamp, updated_at timestamp",
    "audit_logs": "id long, user_id long, action string, method string, path string, status_code int, ip_address string, "
    "user_agent string, success boolean, error_message string, created_at timestamp",
    "chat_session": "session_id string, user_sub string, equipment_id string, created_at timestamp, deleted_at timestamp",
    "chat_message": "message_id long, session_id string, role string, content string, trace string, created_at timestamp",
    "knowledge_chunks": "chunk_id long, doc_id string, chunk_index int, equipment_type string, alarm_code string, "
    "content string, embedding array<float>, created_at timestamp",
    "eval": "equipment_id string, tick long, scenario string, alarm_code string, temperature double, pressure double, "
    "rf_power double, gas_flow double, alarm_temperature string, alarm_pressure string, alarm_rf_power string, "
    "alarm_gas_flow string",
    "events_labels": "equipment_id string, kind string, variables array<string>, start_tick long, end_tick long",
}


def scan_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Read a declared table; the schema is stated, not inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_eval_parquet(spark: SparkSession, root: str, which: str = "eval") -> DataFrame:
    return spark.read.parquet(f"{root}/{which}.parquet")


def scan_events_json(spark: SparkSession, root: str, per_line: bool) -> DataFrame:
    """Labelled events: one array of objects, or an object per line, as this package writes them (``per_line``)."""
    path = f"{root}/events.json"
    return spark.read.schema(SCHEMAS["events_labels"]).option("multiLine", not per_line).json(path)


def scan_manifest_map(spark: SparkSession, root: str) -> DataFrame:
    """equipment_id -> process_type out of the nested run configuration."""
    schema = "config struct<eval: struct<segments: array<struct<equipment_id: string, process_type: string>>>>"
    manifest = spark.read.schema(schema).option("multiLine", True).json(f"{root}/manifest.json")
    return manifest.select(F.explode("config.eval.segments").alias("s")).select("s.equipment_id", "s.process_type").distinct()


GOLDEN_SCHEMA = (
    "id string, category string, title string, query string, seed_scenario string, expect struct<"
    "tools_called_any: array<string>, tools_called_all: array<string>, tools_forbidden: array<string>, "
    "answer_contains_any: array<string>, answer_contains_all: array<string>, citations_include: array<string>, "
    "rag_hit_docs: array<string>, must_not_contain: array<string>, no_tools: boolean, expect_honest_empty: boolean>, "
    "answer_gist string")


def scan_golden_cases(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """Case file (JSON lines); with ``label`` keep the cases whose expectation array of that name is filled."""
    cases = spark.read.schema(GOLDEN_SCHEMA).json(path)
    return cases.where(F.size(F.col(f"expect.{label}")) > 0) if label else cases


def write_eval_set(eval_df: DataFrame, train_df: DataFrame, labels: DataFrame, root: str) -> None:
    eval_df.write.mode("overwrite").parquet(f"{root}/eval.parquet")
    train_df.write.mode("overwrite").parquet(f"{root}/train_normal.parquet")
    labels.write.mode("overwrite").json(f"{root}/events.json")


def experiment_snapshot(metrics: DataFrame, config: str, run_at: str, path: str) -> DataFrame:
    """Append flat metric rows with their configuration (JSON text) and run time."""
    rows = metrics.withColumn("config", F.lit(config)).withColumn("run_at", F.lit(run_at).cast("timestamp"))
    rows.write.mode("append").parquet(path)
    return rows


def upsert_by_key(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New snapshot in which the source rows replace target rows of the same key."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti").unionByName(source, allowMissingColumns=True)


def new_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` whose key is not in ``target`` yet, one per key (NULL keys equal each other)."""
    fresh = source.dropDuplicates(list(keys)).alias("s")
    have = target.select(*keys).distinct().alias("t")
    cond = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    return fresh.join(have, cond, "left_anti")


def insert_if_absent(target: DataFrame, source: DataFrame, keys: Sequence[str], path: str) -> int:
    """Append the missing rows to the table at ``path`` and return how many there were."""
    seen = Observation()
    rows = new_rows(target, source, keys).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("append").parquet(path)
    return int(seen.get["n"])


def replace_partition(target: DataFrame, source: DataFrame, key: str = "doc_id") -> DataFrame:
    """Idempotent reload: every row of an incoming key is replaced as a whole."""
    return target.join(source.select(key).distinct(), key, "left_anti").unionByName(source)


def purge_except(target: DataFrame, keep: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keep only rows whose key is in ``keep``; an empty keep set deletes nothing."""
    if keep.isEmpty():
        return target
    return target.join(keep.select(key).distinct(), key, "left_semi")


def spotcheck_export(sheet: DataFrame, key: DataFrame, root: str) -> None:
    sheet.write.mode("overwrite").option("header", True).csv(f"{root}/sheet")
    key.write.mode("overwrite").json(f"{root}/key")


def spotcheck_import(spark: SparkSession, root: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in
                           ("id", "category", "query", "answer_slot1", "answer_slot2", "human_pick", "note")])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(f"{root}/sheet")
