"""Line dedup by site-relative frequency.

For each host (here: the source of a document) the pages that hold a line, divided by the host's pages, give the line's
ratio. Lines at or over ``ratio`` that recur at all (on ``least_pages`` pages or more) are boilerplate of that host and leave
its pages, whatever remains of them. Pages with the same text count once, on both sides of the division: copies of a page
don't make its lines boilerplate. ``most`` is off; set, a page that would lose more than that share of its characters stays whole.

Lines are compared whole, without spaces at their ends; blank lines are never boilerplate. In the aggregation a line is the
64-bit XXH64 of its text and length, so no text is shuffled. A host has at most ``mean distinct lines per page / ratio``
boilerplate lines, whatever its number of pages. The table of all of them is cut off once; if it is short (its rows are
counted) it is broadcast, else it is joined on the host, a host of many pages by as many copies of its list as its pages need. A page's
lines meet its host's list as hashed sets (array_intersect), in time linear in both.

Null texts stay null and have no lines; a null host is a host of its own. Repeated rows each give a row. Columns of the
input that aren't asked for are passed through by ``drop_lines`` as they are; those named by ``counts`` are replaced. An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratoframe.llm.common import cut_lineage, free_name, spread_lookup

RATIO = 0.02
LEAST_PAGES = 3
#: Boilerplate tables of more rows than this (8 bytes and the host's name each) are joined by a shuffle.
BROADCAST_LINES = 200_000


def digest(line: Column) -> Column:
    return F.xxhash64(line, F.length(line))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, line (its digest), n_pages, host_pages, ratio of the lines to drop."""
    rows = pages.select(F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("page", digest(F.col("text")))
    totals = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    trimmed = F.filter(F.transform(lines_of(F.col("text")), lambda x: F.trim(x)), lambda x: x != "")
    each = rows.select("host", "page", F.explode(F.array_distinct(F.transform(trimmed, digest))).alias("line")).distinct()
    counted = each.groupBy("host", "line").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= least_pages)
    joined = counted.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).drop("of")
    return joined.withColumn("ratio", F.col("n_pages") / F.col("host_pages")).filter(F.col("ratio") >= ratio)


def drop_lines(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, most: float | None = None, counts: tuple[str, str] | None = None
) -> DataFrame:
    """The input's rows and columns, the text without boilerplate lines; with counts: two more columns of these names, the lines and those dropped."""
    found = cut_lineage(boilerplate(pages, host, text, ratio, least_pages))
    of, drop, kept, here = (free_name(pages, x) for x in ("of", "drop_set", "kept", "here"))
    by_host = found.groupBy(F.col("host").alias(of)).agg(F.collect_set("line").alias(drop))
    same = F.col(host).eqNullSafe(F.col(of))
    if found.count() <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(by_host), same, "left")
    else:
        joined = spread_lookup(pages, host, by_host, of, text)
    lines = lines_of(F.col(text))
    judged = joined.withColumn(here, F.array_intersect(F.transform(lines, lambda x: digest(F.trim(x))), F.col(drop)))
    without = F.array_join(F.filter(lines, lambda x: ~F.array_contains(F.col(here), digest(F.trim(x)))), "\n")
    untouched = F.coalesce(F.size(here) <= 0, F.lit(True))
    judged = judged.withColumn(kept, F.when(untouched, F.col(text)).otherwise(without))
    if most is not None:
        judged = judged.withColumn(kept, F.when(F.length(kept) < (1 - most) * F.length(text), F.col(text)).otherwise(F.col(kept)))
    if counts:
        dropped = F.size(F.filter(lines, lambda x: F.array_contains(F.col(here), digest(F.trim(x)))))
        judged = judged.withColumn(counts[1], F.when(untouched | (F.col(kept) == F.col(text)), F.lit(0)).otherwise(dropped).cast("long"))
        judged = judged.withColumn(counts[0], F.greatest(F.coalesce(F.size(lines), F.lit(0)), F.lit(0)).cast("long"))
    return judged.withColumn(text, F.col(kept)).drop(of, drop, kept, here)
