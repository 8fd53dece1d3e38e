"""Streaming forms of windowed sampling: event-time windows with a watermark, repeats dropped, new dates appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratoframe.functions.timegrammar import DEFAULT_WINDOW, Window


def timed(stream: DataFrame, delay: str) -> DataFrame:
    """With event_time (ts to the second) and its watermark; a stream that has them is left as it is."""
    if "event_time" in stream.columns:
        return stream
    at = F.date_trunc("second", F.col("ts") + F.expr("interval '0.5' second"))
    return stream.withColumn("event_time", at.cast("timestamp")).withWatermark("event_time", delay)


def window_counts(stream: DataFrame, width: str, slide: str, delay: str, window: Window = DEFAULT_WINDOW, values: tuple[str, ...] = ()) -> DataFrame:
    """start, end, n and sums per window. Spark's windows hold their start but not their end; those that hold their end begin one second later (times are whole seconds)."""
    late = 1 if window.end_closed and not window.start_closed else 0
    sums: list[Column] = [F.sum(v).alias(v) for v in values]
    found = timed(stream, delay).groupBy(F.window("event_time", width, slide, f"{late} seconds")).agg(F.count("*").alias("n"), *sums)
    shift = F.expr(f"interval {late} seconds")
    return found.select((F.col("window.start") - shift).alias("start"), (F.col("window.end") - shift).alias("end"), "n", *values)


def without_repeats(stream: DataFrame, delay: str, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Rows that repeat an earlier one within the watermark go; event_time stays for windows that follow."""
    return timed(stream, delay).dropDuplicatesWithinWatermark(list(keys or stream.columns))


def append_once(path: str):  # noqa: ANN201
    """For foreachBatch: a batch's rows go to its own partition of the table, so that a repeated batch replaces itself, late rows of stored dates stay, and nothing stored is read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
