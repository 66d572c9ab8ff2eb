"""Notifications: 30-minute grouping, idempotent sync, scopes, paging, read flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fabsight import constants as K
from fabsight.functions.alarms import alarm_message
from fabsight.functions.dates import date_bin
from fabsight.sources.tables import new_rows

BUCKET_KEY = ["equipment_id", "metric", "alarm_code", "bucket_start"]


def bucket_start(ts: Column, seconds: int = K.NOTIFICATION_BUCKET_SECONDS) -> Column:
    return date_bin(ts, seconds)


def notification_groups(alarms: DataFrame) -> DataFrame:
    """One row per (equipment, line, metric, code, bucket): first time and first alarm id."""
    return alarms.groupBy("equipment_id", "line_name", "metric", "alarm_code",
                          bucket_start(F.col("raised_at")).alias("bucket_start")).agg(
        F.min("raised_at").alias("occurred_at"), F.min("alarm_id").alias("source_alarm_id"))


def notification_sync(alarms: DataFrame, master: DataFrame, existing: DataFrame, locale: str = K.DEFAULT_LOCALE) -> DataFrame:
    """Notifications that are due for ``alarms`` and not stored yet; append them to make the job idempotent."""
    lined = alarms.join(master.select("equipment_id", "line_name"), "equipment_id", "left")
    due = notification_groups(lined).withColumn("message", alarm_message(F.col("equipment_id"), F.col("alarm_code"), locale))
    return new_rows(existing, due, BUCKET_KEY)


def line_scope(df: DataFrame, lines: Sequence[str] | DataFrame | None) -> DataFrame:
    """None: every row; an empty list: nothing; otherwise only the given lines."""
    if lines is None:
        return df
    if isinstance(lines, DataFrame):
        return df.join(lines.select("line_name").distinct(), "line_name", "left_semi")
    return df.where(F.col("line_name").isin(*lines)) if lines else df.where(F.lit(False))


def offset_page(df: DataFrame, order: Sequence[Column], page: int, size: int) -> tuple[DataFrame, dict]:
    """Page rows plus total, page (clamped to the last one), page count and whether more follow."""
    total = df.count()
    page_count = max(1, -(-total // size))
    page = min(max(1, page), page_count)
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows, {"total": total, "page": page, "page_count": page_count, "has_more": page < page_count}


def keyset_page(df: DataFrame, ts: str, key: str, size: int, cursor: tuple | None = None) -> DataFrame:
    """Newest rows before the cursor, one extra row flagged ``overflow`` to tell whether more follow.

    The row-value comparison is not pushed to the files, so the implied bound on the time alone is added.
    """
    if cursor is not None:
        at, last = F.lit(cursor[0]).cast(df.schema[ts].dataType), F.lit(cursor[1]).cast(df.schema[key].dataType)
        df = df.where(F.col(ts) <= at).where((F.col(ts) < at) | (F.col(key) < last))
    top = df.orderBy(F.desc(ts), F.desc(key)).limit(size + 1)
    rn = F.row_number().over(W.orderBy(F.desc(ts), F.desc(key)))  # at most size + 1 rows
    return top.withColumn("overflow", rn > size)


def is_read_flag(notifications: DataFrame, reads: DataFrame, user_id: int) -> DataFrame:
    mine = reads.where(F.col("user_id") == user_id).select(F.col("notification_id").alias("id")).distinct()
    return notifications.join(mine.withColumn("_r", F.lit(True)), "id", "left").withColumn(
        "is_read", F.coalesce(F.col("_r"), F.lit(False))).drop("_r")


def unread_only(notifications: DataFrame, reads: DataFrame, user_id: int) -> DataFrame:
    mine = reads.where(F.col("user_id") == user_id).select(F.col("notification_id").alias("id"))
    return notifications.join(mine, "id", "left_anti")


def mark_read(reads: DataFrame, notifications: DataFrame, user_id: int, now: Column) -> DataFrame:
    """Reads snapshot after the user read every notification of ``notifications`` (given in scope)."""
    wanted = notifications.select(F.col("id").alias("notification_id"), F.lit(user_id).cast("long").alias("user_id"),
                                  now.alias("read_at")).distinct()
    return reads.unionByName(new_rows(reads, wanted, ["notification_id", "user_id"]))


def mark_unread(reads: DataFrame, notifications: DataFrame, user_id: int) -> DataFrame:
    gone = notifications.select(F.col("id").alias("notification_id"), F.lit(user_id).cast("long").alias("user_id"))
    return reads.join(gone.distinct(), ["notification_id", "user_id"], "left_anti")


def available_dates(df: DataFrame, ts: str, zone: str = K.LOCAL_ZONE) -> DataFrame:
    return df.select(F.to_date(F.from_utc_timestamp(ts, zone)).alias("local_date")).distinct()


def rebucket(df: DataFrame, ts: str, seconds: int, keys: Sequence[str], tie: str) -> DataFrame:
    """Recompute the bucket column, then keep the first row of each key and bucket."""
    moved = df.withColumn("bucket_start", date_bin(F.col(ts), seconds))
    return dedup_keep_first(moved, [*keys, "bucket_start"], [ts, tie])


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by ``order``: an aggregate with map-side combine, no group is ever sorted."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, "_r.*").select(*df.columns)
