"""A sorted store of observations to which fragments are appended in any order of time.

An append encodes its rows (seconds, longitudes, repeats), sorts them by time and writes them as a fragment with its time range.
Fragments may overlap. ``finalise`` removes the overlaps without sorting anew what is in order already: from the ranges
alone it finds the stretches of time that several fragments share, rewrites the rows in those (merged, repeats dropped, cut
into pieces at quantiles of time), and lets the old fragments count only outside of them. A fragment that overlaps with none isn't touched, and of one that does only the
shared stretch is read and written. Then the pieces are chained: each has the number of rows before it.

A piece is a folder and a half-open range of time, in the metadata's version (see ``stored``), so older versions can still be read
and a finalisation that is cut off changes nothing. Rows are never collected; the driver sees one entry for each piece.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratoframe.functions.timegrammar import Window
from stratoframe.operators.cube import stamp
from stratoframe.operators.side import side
from stratoframe.operators.tabular import Observations, encode
from stratoframe.plans import stored

SECOND = timedelta(seconds=1)
#: Rows that a rewritten piece should have about.
PIECE_ROWS = 5_000_000
Range = tuple[datetime, datetime]


def shared_stretches(ranges: list[Range]) -> list[Range]:
    """The stretches (half-open) of time that two or more of some half-open ranges share, joined where they touch: a sweep over their ends."""
    events = sorted([(a, 1) for a, _ in ranges] + [(b, -1) for _, b in ranges])
    found: list[Range] = []
    depth = 0
    for k, (at, step) in enumerate(events):
        depth += step
        following = events[k + 1][0] if k + 1 < len(events) else at
        if depth >= 2 and following > at:
            if found and found[-1][1] == at:
                found[-1] = (found[-1][0], following)
            else:
                found.append((at, following))
    return found


def outside(whole: Range, stretches: list[Range]) -> list[Range]:
    """What is left of a range without some stretches (sorted, disjoint)."""
    left, at = [], whole[0]
    for a, b in stretches:
        if b <= at or a >= whole[1]:
            continue
        if a > at:
            left.append((at, a))
        at = max(at, b)
    return [*left, (at, whole[1])] if at < whole[1] else left


@dataclass
class Fragments:
    """The store in a folder."""

    spark: SparkSession
    path: str

    def body(self) -> dict:
        found = stored.metadata(self.spark, self.path)
        return found or {"path": self.path, "version": 0, "layout": "tabular", "pieces": [], "finalised": True}

    def append(self, rows: DataFrame, view: dict | None = None) -> int:
        """Adds rows (ts, latitude, longitude, variables) as a fragment; the version's number. Without rows nothing changes."""
        body = self.body()
        fresh = encode(rows)
        if body["pieces"] and sorted(fresh.columns) != sorted(f["name"] for f in body["schema"]["fields"]):
            raise ValueError(f"columns {fresh.columns} aren't those of the stored fragments")
        names = [f["name"] for f in body["schema"]["fields"]] if body["pieces"] else fresh.columns
        fresh = fresh.select(*names)
        variables = [c for c in names if c not in ("ts", "latitude", "longitude")]
        piece = stored.write_piece(fresh, self.path, names, variables)
        if piece is None:
            return body["version"]
        piece |= {"from": piece["first"], "to": str(_at(piece["last"]) + SECOND), "whole": True}
        body |= {"schema": fresh.schema.jsonValue(), "variables": variables, "pieces": [*body["pieces"], piece], "finalised": False} | (view or {})
        return stored.commit(self.spark, self.path, body, body["version"])

    def finalise(self, piece_rows: int = PIECE_ROWS) -> int:
        """Makes the pieces disjoint, in order of time and chained; the version's number (no new one where they are so already)."""
        body = self.body()
        pieces = body["pieces"]
        ranges = [(_at(p["from"]), _at(p["to"])) for p in pieces]
        stretches = shared_stretches(ranges)
        if body.get("finalised") or not pieces:
            return body["version"]
        kept = []
        for p, own in zip(pieces, ranges, strict=True):
            rest = outside(own, stretches)
            kept += [p if r == own else {"folder": p["folder"], "from": str(r[0]), "to": str(r[1]), "whole": False} for r in rest]
        fresh = self._rewritten(body, stretches, piece_rows) if stretches else []
        chained = sorted(self._counted(body, kept) + fresh, key=lambda p: p["from"])
        offset = 0
        for p in chained:
            p["offset"] = offset
            offset += p["rows"]
        return stored.commit(self.spark, self.path, body | {"pieces": chained, "finalised": True}, body["version"])

    def _rewritten(self, body: dict, stretches: list[Range], piece_rows: int) -> list[dict]:
        """New pieces with the rows in the shared stretches: each stretch's rows merged, without repeats, sorted, cut where so many rows are full."""
        names, spark = [f["name"] for f in body["schema"]["fields"]], self.spark
        touched = [p for p in body["pieces"] if any(a < _at(p["to"]) and b > _at(p["from"]) for a, b in stretches)]
        rows = self._read(body, touched)
        # one row for each stretch; which stretch a time lies in is a search in their sorted starts
        table = spark.createDataFrame([(k, str(a), str(b)) for k, (a, b) in enumerate(stretches)], "stretch int, a string, b string")
        table = table.select("stretch", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
        inside = rows.filter(F.col("ts").between(stamp(stretches[0][0]), stamp(stretches[-1][1]))).join(side(table, len(stretches)), (F.col("ts") >= F.col("a")) & (F.col("ts") < F.col("b")))
        merged = inside.select("stretch", *names).distinct()
        name = f"rows/merged-{datetime.now().strftime('%Y%m%d%H%M%S%f')}"
        parts = max(1, -(-merged.count() // piece_rows))
        # cut at seconds, never within one, so that pieces' ranges stay disjoint
        merged.repartitionByRange(parts, "stretch", "ts").sortWithinPartitions("stretch", *names).withColumn("piece", F.spark_partition_id()).write.partitionBy("stretch", "piece").parquet(f"{self.path}/{name}")
        schema = StructType.fromJson(body["schema"])
        written = spark.read.schema(schema.add("stretch", "integer").add("piece", "integer")).parquet(f"{self.path}/{name}")
        found = []
        for r in written.groupBy("stretch", "piece").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).collect():
            found.append({"folder": f"{name}/stretch={r['stretch']}/piece={r['piece']}", "first": str(r["a"]), "last": str(r["b"]), "from": str(r["a"]), "to": str(r["b"] + SECOND), "rows": r["n"], "whole": True})
        return found

    def _counted(self, body: dict, kept: list[dict]) -> list[dict]:
        """The pieces with their numbers of rows and the times of their first and last: of those that are cut by one aggregation over their rows; cut pieces without rows go."""
        cut = [p for p in kept if not p["whole"] and "rows" not in p]
        if not cut:
            return kept
        counts = {(r["folder"], str(r["a"])): r for r in self._bounded(body, cut).groupBy("folder", "a").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).collect()}
        found = []
        for p in kept:
            if p["whole"] or "rows" in p:
                found.append(p)
            elif r := counts.get((p["folder"], p["from"])):
                found.append(p | {"rows": r["n"], "first": str(r["first"]), "last": str(r["last"])})
        return found

    def _bounded(self, body: dict, pieces: list[dict]) -> DataFrame:
        """Rows of pieces that count within their ranges, with folder and a (the range's start): one scan of their folders, joined with their table."""
        schema = StructType.fromJson(body["schema"])
        folders = sorted({p["folder"] for p in pieces})
        low, high = min(_at(p["from"]) for p in pieces), max(_at(p["to"]) for p in pieces)
        scan = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]).filter((F.col("ts") >= stamp(low)) & (F.col("ts") < stamp(high)))
        file = F.col("_metadata.file_path")
        named = scan.withColumn("folder", F.regexp_extract(file, r"(rows/.+)/[^/]+$", 1))
        table = self.spark.createDataFrame([(p["folder"], p["from"], p["to"]) for p in pieces], "folder string, a string, b string")
        table = table.select("folder", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
        return named.join(side(table, len(pieces)), "folder").filter((F.col("ts") >= F.col("a")) & (F.col("ts") < F.col("b")))

    def _read(self, body: dict, pieces: list[dict]) -> DataFrame:
        schema = StructType.fromJson(body["schema"])
        whole, cut = [p for p in pieces if p["whole"]], [p for p in pieces if not p["whole"]]
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{p['folder']}" for p in whole]) if whole else None
        if cut:
            bounded = self._bounded(body, cut).select(*schema.names)
            rows = bounded if rows is None else rows.unionByName(bounded)
        return self.spark.createDataFrame([], schema) if rows is None else rows

    def rows(self) -> DataFrame:
        """All rows: of whole fragments one plain scan, of cut ones one with their ranges. Repeats across fragments that aren't finalised are in it."""
        body = self.body()
        return self._read(body, body["pieces"])

    def pieces(self) -> DataFrame:
        """folder, first, last, rows, offset of each piece, in order of time."""
        rows = [(p["folder"], _at(p["first"]), _at(p["last"]), p["rows"], p.get("offset")) for p in sorted(self.body()["pieces"], key=lambda p: p["from"])]
        return self.spark.createDataFrame(rows, "folder string, first timestamp_ntz, last timestamp_ntz, rows long, offset long")

    def problems(self) -> DataFrame:
        """rule, piece: what pieces break: their ranges and numbers of rows must be those of their rows, they must not overlap, and their offsets must chain."""
        body = self.body()
        pieces = sorted(body["pieces"], key=lambda p: p["from"])
        found: list[tuple[str, str]] = []
        for a, b in zip(pieces, pieces[1:], strict=False):
            if _at(b["from"]) < _at(a["to"]):
                found.append(("pieces don't overlap", b["folder"]))
            if body.get("finalised") and b["offset"] != a["offset"] + a["rows"]:
                found.append(("offsets chain", b["folder"]))
        schema = "rule string, piece string"
        if not pieces:
            return self.spark.createDataFrame(found, schema)
        real = self._bounded(body, pieces).groupBy("folder", F.col("a").cast("string").alias("a")).agg(F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))
        said = self.spark.createDataFrame([(p["folder"], p["from"], p["rows"], p["first"], p["last"]) for p in pieces], "folder string, a string, said long, first string, last string")
        said = said.select("folder", F.date_format(F.col("a").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("a"), "said", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")])
        joined = said.join(real.withColumn("a", F.date_format(F.col("a").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")), ["folder", "a"], "left")
        wrong = F.array_compact(F.array(F.when(~F.coalesce(F.col("said") == F.col("n"), F.lit(False)), "numbers of rows agree"), F.when(~F.coalesce((F.col("first") == F.col("low")) & (F.col("last") == F.col("high")), F.lit(False)), "ranges agree")))
        return joined.select(F.explode(wrong).alias("rule"), F.col("folder").alias("piece")).unionByName(self.spark.createDataFrame(found, schema))


def _at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def opened_observations(spark: SparkSession, body: dict) -> Observations:
    """The stored observations as a dataset; their range is that of the pieces, so no row is read."""
    store = Fragments(spark, body["path"])
    rows = store._read(body, body["pieces"])
    options = {"frequency": timedelta(seconds=body["frequency"]), "window": Window(*body["window"])} if "window" in body else {}
    return Observations(rows, tuple(body["variables"]), min(_at(p["first"]) for p in body["pieces"]), max(_at(p["last"]) for p in body["pieces"]), **options)
