"""Joins with dimension tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a side (a few short columns each) up to which it is broadcast; beyond, Spark joins by a shuffle.
BROADCAST_ROWS = 500_000


def side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A dimension table for a join: broadcast if it is small by its known or counted rows."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder (on one machine a new one where none is set)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stratoframe-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that all share: iterative plans stay short and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: str, name: str, few: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """The rows with their places (from 0) in the order of a column of distinct values, and how many there are.

    Few rows are ordered in one task. Others are dealt by ranges of the order and counted; a row's place is that in its range after the rows of the ranges before, of which the driver sees the counts.
    """
    if (n := df.limit(few + 1).count()) <= few:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(order)) - 1).cast("long")), n
    ranges = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id()))
    counts = sorted(ranges.groupBy("_range").count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + F.col("_before")
    return ranges.join(F.broadcast(table), "_range").withColumn(name, place).drop("_range", "_before"), total
