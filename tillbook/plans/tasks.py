"""Joins and groups of large tables that come in few files: dealt out, where Spark would broadcast one side after the other to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one task takes of a wide table.
TASK_ROWS = 1 << 16


def tasks_for(df: DataFrame, rows: int | None = None) -> int | None:
    """How many tasks of some ``TASK_ROWS`` rows ``df`` needs; None: fewer than the cores anyway."""
    n = -(-(df.count() if rows is None else rows) // TASK_ROWS)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else None


def looked_up(df: DataFrame, key: Column, row_id: str, table: DataFrame, table_key: str, tasks: int | None) -> DataFrame:
    """``df`` left-joined with ``table`` where ``key`` is its ``table_key`` (dropped); where it needs ``tasks`` (``tasks_for``), by a merge join.

    Several broadcast sides lie in the memory of each task, and a file's rows would stay in one. Rows without a key match nothing; they
    are dealt by ``row_id``, so they do not meet in one task.
    """
    table = table.withColumnRenamed(table_key, "_table_key")
    if tasks is None:
        return df.join(table, key == F.col("_table_key"), "left").drop("_table_key")
    probe = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.concat(F.lit("?"), F.col(row_id).cast("string")), F.lit("?"))
    table = table.withColumn("_table_key", F.concat(F.lit("="), F.col("_table_key").cast("string")))
    return df.withColumn("_probe", probe).join(table.hint("merge"), F.col("_probe") == F.col("_table_key"), "left").drop("_probe", "_table_key")
