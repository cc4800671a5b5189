"""Shared scratch space, table access and bounded broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when a count shows it holds no more rows than this.
BROADCAST_ROWS = 200_000

# Rows dealt to a task by spread, and the most tasks it makes (more rows each beyond that).
ROWS_PER_TASK, SPREAD_TASKS = 5_000, 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Taken from ``spark.checkpoint.dir``; without it, a folder in the session's warehouse, which
    executors share too. Never a machine-local temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has written to yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The same rows dealt evenly over tasks, however few row groups or files hold them.

    For narrow rows that expensive work follows: Spark divides a small file between few tasks, or none, so all the work
    on its rows would lie in those. Counting reads no data of parquet files. The tasks are a fixed number, since Spark
    would merge them again by their bytes.
    """
    rows = df.count()
    if rows <= rows_per_task:
        return df
    return df.repartition(min(-(-rows // rows_per_task), SPREAD_TASKS))


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast if a bounded count proves it small; otherwise leave the join to AQE."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
