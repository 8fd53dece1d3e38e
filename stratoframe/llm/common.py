"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the licence and contamination operators is a run of other characters than these (letters in either case).
WORD_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or (on one machine, as in tests) a new one where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stratoframe-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that executors share; a lost executor doesn't lose them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read again: less disk than ``cut_lineage`` for tables that grow with the input."""
    folder = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the input doesn't have: extra columns may have any name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def lowered_ascii(text: Column) -> Column:
    """Lower case for matching ASCII words. Two letters beyond ASCII have ASCII in their lower case; they give way to another such letter first, so that only A-Z become a-z."""
    return F.lower(F.translate(text, "İK", "éé"))


def words_of(text: Column) -> Column:
    """The words of a text (see WORD_BREAKS) as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAKS), "")


def literal_array(values: Sequence[str | int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn for a costly value with several uses: made by a generator, it isn't copied into each of them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """For a join: the side is broadcast if it has at most so many (short) rows; else Spark joins by a shuffle and splits skewed keys. The side should be cut off before."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, hot: int = 1_000) -> DataFrame:
    """rows joined with a table that has one row for each of their keys, and in ``weight`` how many of the rows have it.

    Keys of over one ``hot``-th of all rows, of which there are fewer than ``hot``, are joined by a broadcast, the others by a
    shuffle: no key of that shuffle is large. The table should be cut off before; both are read twice.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    others = [c for c in table.columns if c not in (*keys, weight)]
    heavy = table.filter(F.col(weight) * hot > total).select(*keys, F.struct(*others).alias("found_there"))
    marked = rows.join(F.broadcast(heavy), list(keys), "left")
    here = marked.filter("found_there is not null").select(*rows.columns, "found_there.*")
    light = table.filter(F.col(weight) * hot <= total).select(*keys, *others)
    return here.unionByName(marked.filter("found_there is null").select(*rows.columns).join(light, list(keys)).select(*rows.columns, *others))


def spread_lookup(rows: DataFrame, key: str, table: DataFrame, of: str, by: str, per: int = 100_000) -> DataFrame:
    """rows left-joined by a shuffle with a table that has one row for each key (``of``; nulls are equal).

    A key of more than ``per`` rows is dealt, by a hash of a column, to as many copies of its table row as it takes for each to meet that many; such keys are at most one for each ``per`` rows.
    """
    large, copies, salt, copy = (free_name(rows.join(table.limit(0), F.lit(False), "left"), x) for x in ("large_key", "copies", "salt", "copy"))
    sizes = rows.groupBy(F.col(key).alias(large)).agg(F.ceil(F.count("*") / per).cast("int").alias(copies)).filter(F.col(copies) > 1)
    sizes = broadcast_if_small(cut_lineage(sizes))
    dealt = rows.join(sizes, F.col(key).eqNullSafe(F.col(large)), "left").withColumn(salt, F.pmod(F.xxhash64(by), F.coalesce(copies, F.lit(1))).cast("int")).drop(large, copies)
    copied = table.join(sizes, F.col(of).eqNullSafe(F.col(large)), "left").withColumn(copy, F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1))).drop(large, copies)
    return dealt.join(copied, F.col(key).eqNullSafe(F.col(of)) & (F.col(salt) == F.col(copy)), "left").drop(salt, copy)
