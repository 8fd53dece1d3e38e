"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraph digests.

A text is cut into pieces: at line ends, after sentence ends, and in longer runs of words at content-defined places (a word
whose hash has low bits zero), so that an edit leaves the pieces elsewhere as they are. A piece's digest is the XXH64 of the
piece and of how many equal pieces came before it, so repeated pieces count. The sketch is a table of cells (count, xor of
digests, xor of their checks) in three parts of a power of two; each digest goes into one cell of each part. Tables of one size
subtract cell by cell; what both texts share cancels, and peeling cells of count 1 or -1 recovers the digests that only one
text has. A larger table folds to a smaller size, since places are the low bits of hashes.

The fingerprint that is returned suffices for every comparison: its table has at least ``ROOM`` cells for each digest (more,
if peeling needs it), so it can be read back whole. Two fingerprints are compared at the size of the smaller one first. If
peeling stalls, their digests are read back and laid into larger tables, twice as large each time, until it succeeds. So the
difference is always exact and comes from the two fingerprints alone, never from the texts.

The likeness of two texts is 1 - differing digests / digests of both (1 for two texts without pieces). Equal texts have equal
fingerprints. All tables of a batch of texts lie in one array and are made, folded and peeled together.

For the neighbours query documents are dealt by ranges of (id, text hash) and sorted within them; each range also gets the
first row of the next one, so every row meets its successor. Ranges are cut on ids and hashes alone (one row for each range
comes to the driver); texts are shuffled once.

Ids may be of any type that can be ordered. Null texts count as empty: no pieces. Rows without an id come first (by text
hash); rows of equal ids follow each other by text hash. An empty table gives no rows; a single document is its own
successor. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratoframe.llm.common import cut_lineage

#: Least cells of a part; cells for each digest; bytes up to which a sentence is one piece; words after which a longer run is cut at the latest.
LEAST_THIRD = 8
ROOM = 1.5
LONG = 192
RUN = 24
#: Texts, and their code points, that are sketched together.
TEXTS, CHARACTERS = 400, 4_000_000
#: Rounds of peeling before a table counts as stalled; a chain of digests takes one round for each link.
ROUNDS = 400
_PIECE = re.compile(rb"[^\n]*?[.!?](?=\s)|[^\n]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HASHES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def pieces_of(text: bytes) -> list[bytes]:
    out = []
    for piece in _PIECE.findall(text):
        if not (piece := piece.strip()):
            continue
        if len(piece) <= LONG:
            out.append(piece)
            continue
        run: list[bytes] = []
        for word in piece.split():
            run.append(word)
            if len(run) >= 4 and (xxhash.xxh64_intdigest(word) & 7 == 0 or len(run) >= RUN):
                out.append(b" ".join(run))
                run = []
        if run:
            out.append(b" ".join(run))
    return out


def digests_of(text: bytes) -> np.ndarray:
    seen: dict[bytes, int] = {}
    out = []
    for piece in pieces_of(text):
        seen[piece] = k = seen.get(piece, -1) + 1
        out.append(xxhash.xxh64_intdigest(piece, k))
    return np.array(sorted(set(out)), np.uint64)


def check_of(digests: np.ndarray) -> np.ndarray:
    """32 bits each."""
    return ((digests ^ (digests >> np.uint64(29))) * _MIX) >> np.uint64(32)


class Tables(NamedTuple):
    """Tables one after the other; table t has three parts of thirds[t] cells."""

    count: np.ndarray
    key: np.ndarray
    check: np.ndarray
    thirds: np.ndarray

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(3 * self.thirds)]).astype(np.int64)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.thirds)), 3 * self.thirds)

    def chosen(self, which: np.ndarray) -> Tables:
        starts = self.starts()
        cells = np.concatenate([np.arange(starts[t], starts[t + 1]) for t in which]) if len(which) else np.zeros(0, np.int64)
        return Tables(self.count[cells], self.key[cells], self.check[cells], self.thirds[which])


def gathered(at: np.ndarray, count: np.ndarray, key: np.ndarray, check: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of counts and xors of keys and checks by place."""
    keys, checks = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    if len(at):
        order = np.argsort(at, kind="stable")
        ordered = at[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        keys[ordered[first]] = np.bitwise_xor.reduceat(key[order], first)
        checks[ordered[first]] = np.bitwise_xor.reduceat(check[order], first)
    return np.bincount(at, count, size).astype(np.int64), keys, checks


def laid(digests: np.ndarray, owner: np.ndarray, sign: np.ndarray, thirds: np.ndarray) -> Tables:
    """Each digest in its three cells of its owner's table."""
    starts = np.concatenate([[0], np.cumsum(3 * thirds)]).astype(np.int64)
    third = thirds[owner]
    places = [starts[owner] + k * third + ((digests * m) >> np.uint64(32)).astype(np.int64) % np.maximum(third, 1) for k, m in enumerate(_HASHES)]
    checks = check_of(digests)
    return Tables(*gathered(np.concatenate(places), np.tile(sign, 3), np.tile(digests, 3), np.tile(checks, 3), int(starts[-1])), thirds)


def folded(tables: Tables, thirds: np.ndarray) -> Tables:
    """The same tables at smaller sizes."""
    if np.array_equal(tables.thirds, thirds):
        return tables
    starts, owner = np.concatenate([[0], np.cumsum(3 * thirds)]).astype(np.int64), tables.owners()
    part, place = np.divmod(np.arange(len(owner)) - tables.starts()[owner], tables.thirds[owner])
    at = starts[owner] + part * thirds[owner] + place % thirds[owner]
    return Tables(*gathered(at, tables.count, tables.key, tables.check, int(starts[-1])), thirds)


def peel(tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each table whether all of it could be read; then the digests read, their tables and their signs."""
    count, key, check, thirds = tables
    owner = tables.owners()
    digests, owners, signs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _ in range(ROUNDS):
        pure = np.flatnonzero((np.abs(count) == 1) & (check_of(key) == check))
        if not len(pure):
            break
        _, first = np.unique(key[pure] ^ (owner[pure].astype(np.uint64) * _MIX), return_index=True)
        pure = pure[first]
        digests.append(key[pure])
        owners.append(owner[pure])
        signs.append(count[pure])
        gone = laid(digests[-1], owners[-1], signs[-1], thirds)
        count, key, check = count - gone.count, key ^ gone.key, check ^ gone.check
    left = np.bincount(owner, ((count != 0) | (key != 0) | (check != 0)).astype(float), len(thirds))
    return left == 0, np.concatenate(digests), np.concatenate(owners), np.concatenate(signs)


def thirds_for(n: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_THIRD, 1 << np.ceil(np.log2(np.maximum(1.0, ROOM * n / 3))).astype(np.int64))


class Sketches(NamedTuple):
    """Fingerprints of texts: numbers of digests, and tables that can be read back."""

    n: np.ndarray
    tables: Tables

    def texts(self) -> list[str]:
        """In hex: digests, size of a part, then all counts, keys and checks."""
        starts = self.tables.starts()
        out = []
        for t, (n, third) in enumerate(zip(self.n, self.tables.thirds, strict=True)):
            own = slice(starts[t], starts[t + 1])
            out.append(f"{n:08x}{third:08x}" + self.tables.count[own].astype(">u4").tobytes().hex() + self.tables.key[own].astype(">u8").tobytes().hex() + self.tables.check[own].astype(">u4").tobytes().hex())
        return out

    def chosen(self, which: np.ndarray) -> Sketches:
        return Sketches(self.n[which], self.tables.chosen(which))


def sketched(digests: Sequence[np.ndarray]) -> Sketches:
    n = np.array([len(d) for d in digests], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *digests])
    owner = np.repeat(np.arange(len(n)), n)
    thirds = thirds_for(n)
    while True:
        tables = laid(flat, owner, np.ones(len(flat), np.int64), thirds)
        whole = peel(tables)[0]
        if whole.all():
            return Sketches(n, tables)
        thirds = np.where(whole, thirds, 2 * thirds)


def read_fingerprint(text: str) -> Sketches:
    """One fingerprint from its hex digits."""
    raw = bytes.fromhex(text)
    n, third = (int.from_bytes(raw[k : k + 4], "big") for k in (0, 4))
    sizes = np.cumsum([8, 12 * third, 24 * third, 12 * third])
    count, key, check = (np.frombuffer(raw[a:b], kind) for a, b, kind in zip(sizes[:-1], sizes[1:], (">u4", ">u8", ">u4"), strict=True))
    return Sketches(np.array([n]), Tables(count.astype(np.int64), key.astype(np.uint64), check.astype(np.uint64), np.array([third])))


def differences(a: Sketches, b: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of fingerprints: the cells that each took; then the digests that only one of a pair has, the pair's number, 1 for a and -1 for b."""
    thirds = np.minimum(a.tables.thirds, b.tables.thirds)
    one, two = folded(a.tables, thirds), folded(b.tables, thirds)
    whole, digests, pair, sign = peel(Tables(one.count - two.count, one.key ^ two.key, one.check ^ two.check, thirds))
    done = [(digests[whole[pair]], pair[whole[pair]], sign[whole[pair]])]
    cells = 3 * thirds
    open_ = np.flatnonzero(~whole)
    if len(open_):
        sides = [peel(x.tables.chosen(open_))[1:3] for x in (a, b)]
        flat = np.concatenate([d for d, _ in sides])
        owner = open_[np.concatenate([o for _, o in sides])]
        side = np.repeat([1, -1], [len(d) for d, _ in sides])
        thirds = np.maximum(a.tables.thirds, b.tables.thirds)
        while len(open_):
            number = np.zeros(len(thirds), np.int64)
            number[open_] = np.arange(len(open_))
            mine = np.isin(owner, open_)
            whole, digests, pair, sign = peel(laid(flat[mine], number[owner[mine]], side[mine], thirds[open_]))
            cells[open_] = 3 * thirds[open_]
            done.append((digests[whole[pair]], open_[pair[whole[pair]]], sign[whole[pair]]))
            open_ = open_[~whole]
            thirds = 2 * thirds
    return cells, *(np.concatenate([d[k] for d in done]) for k in range(3))


def likeness(a: Sketches, b: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs: 1 less the share of differing digests, and the cells it took."""
    cells, _, pair, _ = differences(a, b)
    return 1 - np.bincount(pair, minlength=len(a.n)) / np.maximum(1, a.n + b.n), cells


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def compared(rows: list[tuple[object, str]], following: str) -> list[tuple]:
    """Results of rows (id, text) that follow each other; the last one's successor has the text ``following``."""
    texts = [t for _, t in rows] + [following]
    edits = [edited_text(t, u) for t, u in zip(texts, texts[1:], strict=False)]
    all_sketches = sketched([digests_of(t.encode()) for t in texts + edits])
    k = np.arange(len(rows))
    own, edited, after = all_sketches.chosen(k), all_sketches.chosen(len(texts) + k), all_sketches.chosen(k + 1)
    (near_edited, cells), (near_next, _) = likeness(own, edited), likeness(own, after)
    digests = [hashlib.sha256(e.encode()).hexdigest() for e in edits]
    return list(zip([i for i, _ in rows], map(len, texts), digests, own.texts(), edited.texts(), near_edited.tolist(), near_next.tolist(), cells.tolist(), strict=False))


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, cells (those the edit's difference took)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("key"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    ids = cut_lineage(rows.select("doc_id", "key").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "key"))
    known = lambda r: (r["known"], r["doc_id"] if r["known"] else 0, r["key"])
    firsts = sorted(known(r["first"]) for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min(place).alias("first")).collect())
    kind = docs.schema[doc_id].dataType
    # rows with a range's first place also go to the range before it (the first range's to the last), as successors only
    n = max(len(firsts), 1)
    # numbers that hash partitioning deals to a task each
    dealt_to = {r["to"]: r["id"] for r in spark.range(40 * n).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("to")).agg(F.min("id").alias("id")).collect()} if n > 1 else {}
    # the ranges are one row a task: sent to executors as a broadcast and searched there, so the plan doesn't grow with them
    sent = spark.sparkContext.broadcast((firsts, [int(dealt_to.get(k, 40 * n + k)) for k in range(n)]))

    @F.pandas_udf("part int, before int")
    def where(has_id: pd.Series, doc: pd.Series, key: pd.Series) -> pd.DataFrame:
        bounds, names = sent.value
        found = []
        for has, d, k in zip(has_id.tolist(), doc.tolist(), key.tolist(), strict=True):
            here = (has, d if has else 0, k)
            number = max(bisect_right(bounds, here), 1) - 1
            found.append((names[number], names[number - 1] if bounds and bounds[number] == here else None))
        return pd.DataFrame({"part": [p for p, _ in found], "before": pd.array([b for _, b in found], dtype="Int32")})

    # null ids go as zero with a mark, since pandas would turn whole numbers with nulls among them into fractions
    dealt_rows = rows.withColumn("to", where(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0).cast(kind)), F.col("key")))
    own, before = F.struct(F.col("to.part").alias("part"), F.lit(0).alias("after")), F.struct(F.col("to.before").alias("part"), F.lit(1).alias("after"))
    dealt = dealt_rows.select("doc_id", "key", "text", F.explode(F.when(F.col("to.before").isNotNull(), F.array(own, before)).otherwise(F.array(own))).alias("at"))
    dealt = dealt.select("at.part", "at.after", "doc_id", "key", "text")
    ranged = dealt.repartition(n, "part").sortWithinPartitions("part", "after", F.col("doc_id").asc_nulls_first(), "key")

    def out(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*found, strict=True)] if found else [[]] * 8
        kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "cells"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, str]] = []  # rows of the range that follow each other; the last one's successor is awaited
        size, at, ended = 0, None, False
        for batch in batches:
            id_type = batch.schema.field(2).type
            for part, after, doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if part != at:
                    at, held, size, ended = part, [], 0, False
                if ended:
                    continue  # further rows of the next range's first place
                body = body.as_py()
                if held and (after or len(held) >= TEXTS or size >= CHARACTERS):
                    yield out(compared(held, body), id_type)
                    held, size = [], 0
                ended = bool(after)
                held.append((doc, body))
                size += len(body)

    return ranged.select("part", "after", "doc_id", "text").mapInArrow(streamed, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, cells long")
