"""Mixing sources to target weights by Pareto order sampling.

Targets: each source's weight gives its share of the total; a target over ``most`` times the source's size stops there and
the excess is shared again by weight among the others until none is above. (Sorted by size over weight this is one pass of
sums, done on one row for each source.)

Within a source with target T and size S every document gets ``floor(T / S)`` whole copies; these are certain. The rest,
f = T / S - floor(T / S) of the source's words, is sampled: a document's inclusion probability p is proportional to the
square root of its size (long documents are likelier, but less so than in proportion), scaled so that the expected words are
the rest, and those that would be over ``CERTAIN`` are held there. Each draws u from the hash of the seed and its id and is
ranked by (u / (1 - u)) / (p / (1 - p)), ascending: Pareto order sampling. The sample is fixed in size: documents are taken
in that order as long as the words taken so far plus half of the next document's fit into the rest.

The running sum is spread: a histogram of words by rank value finds in which bin the rest runs out, lower bins are taken
whole, and only that bin's documents are ordered. A source of a third of all rows is 2 ** 16 bins.

Ties in rank are ordered by id and text hash; rows equal in id, source and text are taken alike, as one unit. Null texts
have size 0, a null source is a source of its own (the last). No row is lost: documents that are not taken have 0 copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratoframe.llm.common import broadcast_if_small, cut_lineage, free_name

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 7
CERTAIN = 0.999
BINS = 1 << 16


def size_of(text: Column) -> Column:
    """Words (runs of other characters than ASCII white space)."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def weighed(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """source, source_size, weight: weights repeat over the sources in order, null last. One row for each source: the order is taken on few rows."""
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))).drop("k")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target. Sources stop at ``most`` times their size in the order of size over weight."""
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    summed = weighed(sizes, weights).withColumns(
        {"total": F.sum("source_size").over(everything), "stopped": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)), "open_weight": F.sum("weight").over(after)}
    )
    fair = (F.col("total") - F.col("stopped")) / F.col("open_weight")
    judged = summed.withColumn("fair", fair).withColumn("stops", most * F.col("source_size") < F.col("fair") * F.col("weight"))
    # sources that stop come first in this order; the first that doesn't gives the share that all open ones have
    share = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "fair"))).over(everything)["fair"]
    return judged.select("source", "source_size", F.when(F.col("stops"), most * F.col("source_size").cast("double")).otherwise(share * F.col("weight")).alias("target"))


def uniform(seed: int, doc_id: Column) -> Column:
    """A number strictly between 0 and 1 from the id: the same in each run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id, key (of its text), size, source, source_size, target, copies."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("key"), size_of(F.col(text)).alias("size"))
    rows = cut_lineage(rows.groupBy("doc_id", "source", "key", "size").agg(F.count("*").cast("int").alias("repeats")).withColumn("words", F.col("size") * F.col("repeats")))
    sizes = rows.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum(F.col("words") * F.sqrt("size")).alias("sized_roots"))
    goal = targets(sizes.select("source", "source_size"), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of_source = (
        goal.join(sizes.select(F.col("source").alias("of"), "sized_roots"), F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("whole", F.floor(ratio + 1e-9))
        .withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
        .withColumn("scale", F.when(F.col("sized_roots") > 0, F.col("rest") / F.col("sized_roots")).otherwise(0.0))
        .select(F.col("source").alias("of"), "source_size", "target", "whole", "rest", "scale")
    )
    of_source = cut_lineage(of_source)
    chance = F.least(F.col("scale") * F.sqrt("size"), F.lit(CERTAIN))
    odds = lambda p: p / (1 - p)
    u = uniform(seed, F.col("doc_id"))
    # p = 0: nothing of the source, or of this document, is sampled; it comes last
    ranked = (
        rows.join(broadcast_if_small(of_source), F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("rank", F.when(chance > 0, odds(u) / odds(chance)))
        .withColumn("bin", F.coalesce(F.floor(F.col("rank") / (1 + F.col("rank")) * BINS), F.lit(BINS)).cast("int"))
    )
    by_bin = ranked.groupBy("source", "bin").agg(F.sum("words").alias("words"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rests = of_source.select("of", "rest")
    sums = by_bin.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).join(broadcast_if_small(rests), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # the bin in which the rest runs out; documents of lower bins are taken, of higher ones not
    last = sums.filter((F.col("before") < F.col("rest")) & (F.col("bin") < BINS)).groupBy("source").agg(F.max(F.struct("bin", "before")).alias("edge"))
    last = cut_lineage(last.select(F.col("source").alias("of"), F.col("edge.bin").alias("edge"), F.col("edge.before").alias("before")))
    placed = ranked.join(broadcast_if_small(last), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    in_order = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = placed.filter(F.col("bin") == F.col("edge")).withColumn("so_far", F.col("before") + F.coalesce(F.sum("words").over(in_order), F.lit(0)))
    at_edge = at_edge.withColumn("extra", F.when(F.col("so_far") + F.col("words") / 2 <= F.col("rest"), 1).otherwise(0)).drop("so_far")
    away = placed.filter(~F.coalesce(F.col("bin") == F.col("edge"), F.lit(False))).withColumn("extra", F.when(F.coalesce(F.col("bin") < F.col("edge"), F.lit(False)), 1).otherwise(0))
    return at_edge.unionByName(away).select("doc_id", "key", "size", "source", "source_size", "target", "repeats", (F.col("whole") + F.col("extra")).cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options: object) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies."""
    found = copies(docs, doc_id, text, source, **options)
    return found.withColumn("repeat", F.explode(F.array_repeat(F.lit(0), F.col("repeats")))).select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options: object) -> DataFrame:
    """The documents' rows and columns, each as many times as the mix takes it."""
    names = [free_name(docs, f"mix_{c}") for c in ("id", "source", "key", "copies", "copy")]
    taken = copies(docs, doc_id, text, source, **options).filter("copies > 0").select("doc_id", "source", "key", "copies").toDF(*names[:4])
    same = F.col(doc_id).eqNullSafe(F.col(names[0])) & F.col(source).eqNullSafe(F.col(names[1])) & (F.xxhash64(text) == F.col(names[2]))
    return docs.join(taken, same).withColumn(names[4], F.explode(F.array_repeat(F.lit(0), F.col(names[3])))).drop(*names)
