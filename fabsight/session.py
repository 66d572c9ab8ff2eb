"""Session helpers: settings the operators rely on and durable materialization."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of input for a range partition, so few that its rows are sorted in memory (stored tables are packed about five times as
#: densely as rows in a sort); sources without statistics claim more than UNKNOWN bytes and do not count.
PARTITION_BYTES, UNKNOWN = 32 << 20, 1 << 60


def prepare(spark: SparkSession) -> SparkSession:
    """Use UTC and make sure a checkpoint folder is known.

    The folder is the one that ``spark.checkpoint.dir`` names, shared storage on a cluster.  Without that setting a session
    of one machine uses a folder beside its warehouse; any other refuses to run.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(sc.master, spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir")))
    return spark


def shared_folder(master: str, configured: str | None, warehouse: str) -> str:
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/checkpoints"


def durable(df: DataFrame, rows: int = 0, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from the written copy.

    Used where later steps must see one fixed assignment (range partition numbers) or where a result feeds
    several steps.  The copy survives the loss of executors, is columnar, so later steps read only the
    columns they need, and has a known size, so the planner broadcasts it only when it is small.  A reader holds thousands of
    rows of a file at once: ``rows`` bounds those of a file, where rows are large.  ``codec`` is for large tables of texts.
    """
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def durable_parts(parts: Iterable[tuple[DataFrame, Callable[[], None]]]) -> DataFrame:
    """Like ``durable``, of at least one part of the same columns, each written before the next is asked for and then let go by its function."""
    path, out = None, None
    for df, done in parts:
        if path is None:
            path, out = f"{prepare(df.sparkSession).sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}", df
        df.write.mode("append").parquet(path)
        done()
    return out.sparkSession.read.schema(out.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_partitions(df: DataFrame) -> int:
    """Range partitions for ``df``: about PARTITION_BYTES of the tables it reads in each, no fewer than the session's.

    Range partitions are numbered, so adaptive execution must not merge or split them; their number follows the data.
    """
    return max(shuffle_partitions(df.sparkSession), partitions_for(stored_bytes(df)))


def partitions_for(size: int) -> int:
    return -(-size // PARTITION_BYTES)


#: Stored bytes and rows that one task works on after ``spread`` (texts that repeat are stored much smaller than they are), and tasks
#: from which on their number grows by PARTITION_BYTES only; an input of one file for NEAR such tasks is not dealt again.
TASK_BYTES, TASK_ROWS, TASKS, NEAR = 2 << 20, 4_096, 8_192, 4


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, of those that know them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN)


def spread(df: DataFrame, times: int = 1) -> DataFrame:
    """Deal the rows over all cores, about TASK_BYTES of input or TASK_ROWS a task (or so many ``times`` that), before heavy work per row.

    An input of about as many files, or of about as many splits with rows in them, no fewer than the cores, stays as it is.  Splits
    count by their rows: a file of one row group is read by one task, whatever its size.
    """
    size, cores = stored_bytes(df), df.sparkSession.sparkContext.defaultParallelism
    read = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]  # a row per split
    parts = max(-(-size // (TASK_BYTES * times)), -(-sum(read) // (TASK_ROWS * times)))
    wanted = max(cores, min(TASKS, parts), partitions_for(size))
    least = max(cores, wanted // NEAR)
    even = bool(read) and max(read) * least <= NEAR * sum(read)
    return df if len(df.inputFiles()) >= least or even and len(read) >= least else df.repartition(wanted)
