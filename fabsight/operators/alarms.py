"""Alarm journal: confirmation, transitions, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fabsight import constants as K
from fabsight.functions.alarms import severity_rank
from fabsight.plans.series import neighbours, running_sums


def confirm_two_ticks(df: DataFrame, keys: Sequence[str], pos: str, code: str, name: str = "confirmed") -> DataFrame:
    """A code counts only when the previous tick had the same one."""
    return neighbours(df, keys, pos, {name: lambda w: F.when(F.col(code) == F.lag(code).over(w), F.col(code))}, before=1)


def alarm_transitions(df: DataFrame, keys: Sequence[str], pos: str, ts: str, code: str,
                      carry: Sequence[str] = ()) -> DataFrame:
    """Intervals (code, raised_at, cleared_at) from a code per tick; the last one stays open.

    Two bounded look-ups, each over pieces of a series: the previous code marks the changes, and the next
    change closes an interval.
    """
    columns = list(dict.fromkeys([*keys, pos, ts, code, *carry]))
    changed = neighbours(df.select(*columns), keys, pos,
                         {"_change": lambda w: ~F.col(code).eqNullSafe(F.lag(code).over(w))}, before=1)
    numbered = running_sums(changed, keys, pos, {"_no": F.col("_change").cast("long")}).where("_change")
    closed = neighbours(numbered, keys, "_no", {"cleared_at": lambda w: F.lead(ts).over(w)}, after=1)
    return closed.where(F.col(code).isNotNull()).select(
        *keys, code, F.col(ts).alias("raised_at"), "cleared_at", *carry)


def alarm_history(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy("alarm_code").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("raised_at").alias("first_at"), F.max("raised_at").alias("last_at")
    ).orderBy(F.desc("occurrences"), "alarm_code")


def alarm_sensor_summary(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy("metric").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("raised_at").alias("first_at"), F.max("raised_at").alias("last_at")
    ).orderBy(F.desc("occurrences"), "metric")


def active_equipment(alarms: DataFrame, code: str = K.ANOMALY_CODE) -> DataFrame:
    return alarms.where((F.col("alarm_code") == code) & F.col("cleared_at").isNull()).select("equipment_id").distinct()


def latched_alarm(telemetry: DataFrame, master: DataFrame) -> DataFrame:
    """Worst, then newest alarm after the equipment's last clearing."""
    cleared = master.select("equipment_id", "alarm_cleared_at")
    open_rows = telemetry.where(F.col("alarm_code").isNotNull()).join(cleared, "equipment_id").where(
        F.col("alarm_cleared_at").isNull() | (F.col("timestamp") > F.col("alarm_cleared_at")))
    best = F.max_by(F.struct("alarm_code", "timestamp", "log_id"),
                    F.struct(severity_rank(F.col("alarm_code")), "timestamp", "log_id"))
    return open_rows.groupBy("equipment_id").agg(best.alias("b")).select("equipment_id", "b.*")


def alarm_clear(master: DataFrame, alarms: DataFrame, equipment: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Set the clear time on the given equipment and close all of its open alarms."""
    keys = equipment.select("equipment_id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    new_master = master.join(keys, "equipment_id", "left").withColumn(
        "alarm_cleared_at", F.when(hit, now).otherwise(F.col("alarm_cleared_at"))).drop("_hit")
    new_alarms = alarms.join(keys, "equipment_id", "left").withColumn(
        "cleared_at", F.when(hit & F.col("cleared_at").isNull(), now).otherwise(F.col("cleared_at"))).drop("_hit")
    return new_master, new_alarms
