"""Helpers shared by the training-data operators."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fabsight.session import durable, prepare  # noqa: F401  (durable is used by the operators)

#: Rows of one Arrow batch: a batch of the longest texts still fits a Python worker.
BATCH_ROWS = 1000


def session(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: UTC, a checkpoint folder and small Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{folder}/{name}.parquet")


def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of every batch as Python lists."""
    for b in batches:
        yield [c.to_pylist() for c in b.columns]


def uint32_bytes(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def text_or_empty(name: str):
    return F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name)
