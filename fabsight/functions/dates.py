"""Time arithmetic under a UTC session."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fabsight import constants as K


def date_bin(ts: Column, seconds: float, origin: Column | None = None) -> Column:
    """Floor to a multiple of ``seconds`` from the origin (the epoch when none is given)."""
    width = F.lit(int(seconds * 1_000_000))
    base = F.lit(0) if origin is None else F.unix_micros(origin)
    return F.timestamp_micros(base + F.floor((F.unix_micros(ts) - base) / width) * width)


def local_date(ts: Column, zone: str = K.LOCAL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def iso_time(text: Column) -> Column:
    """ISO-8601 text as a timestamp; without an offset it means UTC, unreadable text gives NULL."""
    return F.expr("try_cast(%s AS timestamp)" % text) if isinstance(text, str) else F.try_to_timestamp(text)
