"""Accumulations over periods from whatever intervals an index of messages or a table of fields holds, with or without bases.

What is available is read from the table itself: its distinct (start, end, base). Each period that is needed meets the
intervals in its reach by an equi-join on days; its candidates are one row, as their number depends on the reach and not on the table. The cheapest signed chain of them
(``derived.cover``) is sought in each task, and becomes the plan by which fields are summed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratoframe.functions.timegrammar import frequency
from stratoframe.operators.cube import stamp
from stratoframe.operators.derived import Interval, accumulate_planned, cover
from stratoframe.operators.side import cut

DAY = 86_400
PLAN = "date timestamp_ntz, start timestamp_ntz, end timestamp_ntz, base timestamp_ntz, sign int"


def periods(messages: DataFrame, valid: str = "valid_datetime", first: str | None = "startStep", last: str = "endStep", base: str | None = None) -> DataFrame:
    """Messages with start, end and base of what they accumulate: steps are hours since the base, which is a column or else the valid time less the last step.

    Without a column of first steps the period starts at the base.
    """
    hours = lambda c: F.make_dt_interval(hours=F.col(c).cast("int"))
    at = F.col(base).cast("timestamp_ntz") if base else F.col(valid).cast("timestamp_ntz") - hours(last)
    return messages.withColumns({"base": at, "start": at + hours(first) if first else at, "end": at + hours(last)})


def available(fields: DataFrame) -> DataFrame:
    """start, end, base (null where fields have none) of the intervals that are there."""
    base = F.col("base").cast("timestamp_ntz") if "base" in fields.columns else F.lit(None).cast("timestamp_ntz")
    return fields.select("start", "end", base.alias("base")).distinct()


def needed(spark: SparkSession, dates: DataFrame | Sequence[datetime], period: str | int | timedelta) -> DataFrame:
    """date, lo, hi: the periods that end at dates."""
    if not isinstance(dates, DataFrame):
        dates = spark.createDataFrame([(str(d),) for d in dates], "d string").select(F.col("d").cast("timestamp_ntz").alias("date"))
    length = F.make_dt_interval(secs=F.lit(int(frequency(period).total_seconds())).cast("decimal(18,6)"))
    return dates.select("date", (F.col("date") - length).alias("lo"), F.col("date").alias("hi"))


def plan(wanted: DataFrame, held: DataFrame, reach: str | int | timedelta = "1d", missing: str = "error") -> DataFrame:
    """date, start, end, base, sign of the intervals that cover each wanted period (date, lo, hi).

    Intervals within ``reach`` before and after a period count. A period that they don't cover is an error when the plan is
    read, or is left out (``missing="skip"``).
    """
    if missing not in ("error", "skip"):
        raise ValueError(f"unknown way with missing intervals: {missing!r}")
    within = frequency(reach)
    seconds = F.make_dt_interval(secs=F.lit(int(within.total_seconds())).cast("decimal(18,6)"))
    day = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / DAY)
    reached = wanted.select("date", "lo", "hi", (F.col("lo") - seconds).alias("from"), (F.col("hi") + seconds).alias("to"))
    by_day = reached.withColumn("day", F.explode(F.sequence(day(F.col("from")), day(F.col("to")))))
    near = by_day.join(held.withColumn("day", day(F.col("start"))), "day").filter((F.col("start") >= F.col("from")) & (F.col("end") <= F.col("to")))
    listed = near.groupBy("date").agg(F.collect_list(F.struct("start", "end", "base")).alias("intervals"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for date, lo, hi, intervals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # of chains that cost the same the one by later bases counts, then the one of earlier intervals
                known = sorted((Interval(i["start"], i["end"], i["base"]) for i in intervals or ()), key=lambda i: (datetime.max - (i.base or datetime.min), i.start, i.end))
                touching: dict[datetime, list[Interval]] = {}
                for i in known:
                    touching.setdefault(i.start, []).append(i)
                    touching.setdefault(i.end, []).append(i)
                try:
                    rows += [(date, i.start, i.end, i.base, i.sign) for i in cover(lo, hi, lambda at, touching=touching: touching.get(at, ()), within)]
                except ValueError:
                    if missing == "error":
                        raise
            kinds = [pa.timestamp("us")] * 4 + [pa.int32()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["date", "start", "end", "base", "sign"])

    return reached.join(listed, "date", "left").select("date", "lo", "hi", "intervals").mapInArrow(chained, PLAN)


def accumulate(fields: DataFrame, dates: DataFrame | Sequence[datetime], period: str | int | timedelta, keys: Sequence[str], values: Sequence[str], index: DataFrame | None = None, reach: str | int | timedelta = "1d", missing: str = "error") -> DataFrame:
    """date, keys, values: sums over the periods that end at dates, of fields (start, end, base, keys, values) chosen by what an index (else the fields) holds."""
    spark = fields.sparkSession
    fields = fields if "base" in fields.columns else fields.withColumn("base", F.lit(None).cast("timestamp_ntz"))
    found = cut(plan(needed(spark, dates, period), available(fields if index is None else index), reach, missing))
    bounds = found.agg(F.min("start"), F.max("end")).first()
    if bounds[0] is None:
        return fields.select(F.col("start").alias("date"), *keys, *values).limit(0)
    return accumulate_planned(fields.filter(F.col("start").between(stamp(bounds[0]), stamp(bounds[1]))), found, keys, values)


