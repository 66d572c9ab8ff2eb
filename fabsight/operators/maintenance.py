"""Repairs, work logs, users, lines: joins, reports and table-to-table maintenance jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fabsight.operators.telemetry import top_n_per_key
from fabsight.plans.asof import asof_backward
from fabsight.plans.series import number_rows

REPAIR_TYPES = ("emergency", "repair")
INSPECTION_TYPES = ("preventive", "inspection")


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def active_lines(lines: DataFrame) -> DataFrame:
    """Active lines with their place in display order (NULLs last, then code)."""
    order = [F.asc_nulls_last("display_order"), F.asc("code")]
    active = lines.where(F.col("status") == "active")
    # the line list is a handful of rows per site; one window over it is its sort
    return active.withColumn("place", F.row_number().over(W.orderBy(*order))).orderBy(*order)


def repairs_with_user(repairs: DataFrame, users: DataFrame) -> DataFrame:
    names = users.select(F.col("id").alias("repaired_by"), F.col("name").alias("repaired_by_name"))
    return repairs.join(names, "repaired_by", "left")


def users_with_lines(users: DataFrame, user_lines: DataFrame, lines: DataFrame) -> DataFrame:
    """Sorted line codes per user; users without a line get an empty list."""
    named = user_lines.join(lines.select("line_id", "code"), "line_id")
    # distinct codes per user: bounded by the number of lines
    lists = named.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_set("code")).alias("lines"))
    return users.join(lists, "id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))


def assigned_lines(user_lines: DataFrame, lines: DataFrame) -> DataFrame:
    return user_lines.join(lines.select("line_id", "code"), "line_id").select("user_id", "code")


def missing_keys(requested: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(existing.select(key), key, "left_anti")


def maintenance_summary(repairs: DataFrame, window: int | None = None) -> DataFrame:
    """Over all, or the newest ``window``, repairs per equipment: count, last time, recurrences per prior code as a map."""
    recent = repairs if window is None else top_n_per_key(repairs, ["equipment_id"], [F.desc("repaired_at"), F.desc("id")], window)
    per_code = recent.groupBy("equipment_id", "alarm_code_before").agg(
        F.count(F.lit(1)).alias("n"), F.max("repaired_at").alias("last"))
    entry = F.when(F.col("alarm_code_before").isNotNull(), F.struct("alarm_code_before", "n"))
    return per_code.groupBy("equipment_id").agg(
        F.sum("n").alias("repair_count"), F.max("last").alias("last_repaired_at"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("alarm_code_counts"))


def check_constraints(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Number of rows violating each rule (a rule that is NULL holds, as in SQL checks)."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in rules)
    return counts.select(F.expr(f"stack({len(rules)}, {pairs}) AS (rule, violations)"))


def replace_set(user_lines: DataFrame, user_id: int, line_ids: DataFrame) -> DataFrame:
    mine = line_ids.select(F.lit(user_id).cast("long").alias("user_id"), "line_id").dropDuplicates(["user_id", "line_id"])
    return user_lines.where(F.col("user_id") != user_id).unionByName(mine)


def entity_union(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Sorted union of two id arrays per key."""
    both = left.select(key, F.col(column).alias("a")).join(right.select(key, F.col(column).alias("b")), key, "full_outer")
    empty = F.array().cast("array<string>")
    return both.select(key, F.array_sort(F.array_union(F.coalesce("a", empty), F.coalesce("b", empty))).alias(column))


def apply_repairs(repairs: DataFrame, telemetry: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair rows with the alarm standing before them, and the master with the latest repair times.

    The as-of look-up merges both tables on one time line (see ``plans.asof``).
    """
    snap = asof_backward(repairs, telemetry, "equipment_id", "repaired_at", "timestamp", ["alarm_code"])
    out = snap.withColumnRenamed("alarm_code", "alarm_code_snapshot")
    latest = repairs.groupBy("equipment_id").agg(F.max("repaired_at").alias("_at"))
    new_master = master.join(latest, "equipment_id", "left").withColumns({
        "repaired_at": F.greatest("repaired_at", "_at"), "alarm_cleared_at": F.greatest("alarm_cleared_at", "_at"),
        "last_inspection_at": F.to_date("_at")}).drop("_at")
    return out, new_master


def complete_work_logs(logs: DataFrame, completed: DataFrame, telemetry: DataFrame, master: DataFrame, now: Column):
    """Close the given logs: repair kinds yield repair rows, inspection kinds an inspection date."""
    done = logs.join(completed.select("id"), "id", "left_semi")
    repairs = done.where(F.col("work_type").isin(*REPAIR_TYPES)).select(
        "id", "equipment_id", F.col("owner").alias("repaired_by"), now.alias("repaired_at"))
    inspected = done.where(F.col("work_type").isin(*INSPECTION_TYPES)).select("equipment_id").distinct().withColumn("_i", F.lit(True))
    new_master = master.join(inspected, "equipment_id", "left").withColumn(
        "last_inspection_at", F.when(F.col("_i"), F.to_date(now))).drop("_i")
    hit = completed.select("id", F.lit(True).alias("_hit"))
    new_logs = logs.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit"), "done").otherwise(F.col("status"))).drop("_hit")
    return new_logs, repairs, new_master


def work_log_from_notification(requests: DataFrame, notifications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with the notification's equipment and code copied, and the requests naming unknown ids."""
    src = notifications.select(F.col("id").alias("source_notification_id"), F.col("equipment_id").alias("_e"), F.col("alarm_code").alias("_c"))
    joined = requests.join(src, "source_notification_id", "left")
    unknown = F.col("source_notification_id").isNotNull() & F.col("_e").isNull()
    kept = joined.where(~unknown).withColumns({"equipment_id": F.coalesce("_e", "equipment_id"), "alarm_code": F.col("_c")})
    return kept.drop("_e", "_c"), joined.where(unknown).select(*requests.columns)


def soft_delete(df: DataFrame, targets: DataFrame, owner: str, now: Column) -> DataFrame:
    """Mark the rows (id, owner) as deleted; rows of other owners stay."""
    hit = targets.select("id", owner).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, ["id", owner], "left").withColumn(
        "deleted_at", F.when(F.col("_hit") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).drop("_hit")


def partial_update(df: DataFrame, patch: DataFrame, key: str, fields: Sequence[str], given: str = "given") -> DataFrame:
    """Overwrite only the fields named in the patch row's ``given`` array (so NULL can be set on purpose)."""
    p = patch.select(key, F.col(given).alias("_given"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    joined = df.join(p, key, "left")
    return joined.withColumns({
        f: F.when(F.array_contains("_given", f), F.col(f"_n_{f}")).otherwise(F.col(f)) for f in fields}).select(*df.columns)


def delete_cascade(lines: DataFrame, user_lines: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return lines.join(gone, "line_id", "left_anti"), user_lines.join(gone, "line_id", "left_anti")


def null_missing_reference(df: DataFrame, column: str, users: DataFrame) -> DataFrame:
    """Set references to removed users to NULL."""
    have = users.select(F.col("id").alias(column), F.lit(True).alias("_have")).distinct()
    return df.join(have, column, "left").withColumn(column, F.when(F.col("_have"), F.col(column))).drop("_have")


def entity_ref_backfill(df: DataFrame, master: DataFrame, key: str, column: str) -> DataFrame:
    fresh = master.select(key, F.col(column).alias("_new"))
    return df.join(fresh, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def global_read_counts(notifications: DataFrame, reads: DataFrame, users: DataFrame, flag: Column) -> DataFrame:
    """Read count per user when flagged notifications count as read by everyone.

    The global flag stays one row per notification instead of one per user, so no product of users and
    notifications is written; each user's own reads outside the flagged set are added.
    """
    flagged = notifications.where(flag)
    total = flagged.agg(F.count(F.lit(1)).alias("_all"))
    own = reads.join(flagged.select(F.col("id").alias("notification_id")), "notification_id", "left_anti")
    mine = own.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("_own"))
    return users.select("id").join(mine, "id", "left").select(
        F.col("id").alias("user_id"), (total.scalar() + F.coalesce("_own", F.lit(0))).alias("n_read"))


def rename_values(df: DataFrame, column: str, suffix: str, replacement: str) -> DataFrame:
    c = F.col(column)
    return df.withColumn(column, F.when(c.endswith(suffix), F.replace(c, F.lit(suffix), F.lit(replacement))).otherwise(c))


def audit_recent(audit: DataFrame, now: Column, ttl_days: int, n: int, **equals) -> DataFrame:
    """Newest ``n`` entries inside the retention time, by any of user, success, status, action."""
    cond = [F.col("created_at") > now - F.make_dt_interval(F.lit(ttl_days)), *[F.col(k) == v for k, v in equals.items()]]
    return audit.where(reduce(lambda a, b: a & b, cond)).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def audit_cap(audit: DataFrame, most: int) -> DataFrame:
    """Retention: keep the newest ``most`` entries.

    Counts per day tell the day that the cap cuts; later days stay whole, and only that day is put in order, over all tasks.
    """
    day = F.to_date("created_at")
    newer = W.orderBy(F.desc_nulls_last("_day")).rowsBetween(W.unboundedPreceding, -1)
    days = audit.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(newer), F.lit(0)))  # a row a day
    border = days.where((F.col("_before") <= most) & (F.col("_before") + F.col("_n") > most)).first()
    if border is None:
        return audit
    last = F.lit(border["_day"]).cast("date")
    cut = number_rows(audit.where(day.eqNullSafe(last)), [], [F.desc("created_at"), F.desc("id")], "_pos").where(F.col("_pos") < most - border["_before"])
    whole = audit.where(day > last) if border["_day"] else audit.where(day.isNotNull())
    return whole.unionByName(cut.drop("_pos"))


def audit_retention(audit: DataFrame, now: Column, ttl_days: int, most: int) -> DataFrame:
    """What a compaction keeps: entries inside the retention time (a table by day drops whole days), the newest ``most`` of them."""
    return audit_cap(audit.where(F.col("created_at") > now - F.make_dt_interval(F.lit(ttl_days))), most)
