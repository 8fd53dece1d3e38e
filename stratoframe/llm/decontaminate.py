"""Benchmark decontamination: a prefix-filtered join of documents with the windows of benchmark items.

An item's windows are its runs of ``window`` (13) consecutive words, or all of them if it has fewer. A window is a set of
shingles (runs of ``shingle`` consecutive words with their place in the window); a place of a document holds the window if it
holds all of them, so the necessary prefix is one shingle: the window's rarest by the documents' counts. Documents are
joined with windows on that shingle alone. The length bound (the document has room for the window around that place) and the
positional bound (the window starts ``offset`` words before the shingle) leave one start for each hit, and the words there
are compared exactly. Frequent shingles are thus never joined, unless every shingle of a window is frequent.

Both passes over the documents work in Arrow batches on whole texts, with words as in the contract (bytes of UTF-8, A-Z
lower-cased). The windows go to the tasks by blocks of items of at most ``BLOCK_WORDS`` words, so what is sent has a fixed
bound; a larger benchmark takes more blocks, each against all documents, and the hits are merged.

Null texts have no words: such a document is clean, such an item has no windows. Items without an id are left out. An empty table on either side gives no hits.
Repeated items count once for each distinct id; repeated documents each give a row. Extra columns are ignored by ``judge``
and passed through by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratoframe.llm.common import broadcast_if_small, cut_lineage, free_name, once

WINDOW = 13
SHINGLE = 3
#: Words of the benchmark in one block: an index takes about 390 bytes a word with its words (measured), so some 100 MB in a task.
BLOCK_WORDS = 250_000
#: A document is contaminated if hits cover at least this share of its words (1 in 20).
SHARE = 20

_KEPT = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
_FOLD = bytes(b if b in _KEPT else 32 for b in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Windows(NamedTuple):
    """A block's windows by their prefix shingle."""

    by_shingle: dict[bytes, list[tuple[int, tuple[bytes, ...]]]]  # offset of the shingle in the window, the window
    items: dict[tuple[bytes, ...], tuple[int, ...]]  # whose window it is


def item_windows(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def shingles_of(words: Iterable[bytes], shingle: int) -> list[bytes]:
    words = list(words)
    return [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]


def prefix_length(window: tuple[bytes, ...], shingle: int) -> int:
    return min(shingle, len(window))


def counted_shingles(docs: DataFrame, text: str, wanted: set[bytes], sizes: list[int]) -> Counter[bytes]:
    """How often each wanted shingle occurs in the documents: one row for each comes to the driver, whatever the documents' number."""
    spread = docs.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0):
                words = words_of(t.as_py())
                for size in sizes:
                    found = words if size == 1 else map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
                    seen.update(spread.value.intersection(found))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["shingle", "n"])

    rows = docs.select(text).mapInArrow(count, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return Counter({bytes(r["shingle"]): r["n"] for r in rows})


def blocks_of(items: Iterable[tuple[int, list[bytes]]], window: int, limit: int) -> Iterator[dict[tuple[bytes, ...], tuple[int, ...]]]:
    """Windows and the items they belong to, a bounded block at a time."""
    block: dict[tuple[bytes, ...], set[int]] = {}
    size = 0
    for item, words in items:
        if block and size + len(words) > limit:
            yield {w: tuple(sorted(i)) for w, i in block.items()}
            block, size = {}, 0
        for w in item_windows(words, window):
            block.setdefault(w, set()).add(item)
        size += len(words)
    if block:
        yield {w: tuple(sorted(i)) for w, i in block.items()}


def index(block: dict[tuple[bytes, ...], tuple[int, ...]], counts: Counter[bytes], shingle: int) -> Windows:
    by_shingle: dict[bytes, list[tuple[int, tuple[bytes, ...]]]] = {}
    for window in block:
        parts = shingles_of(window, prefix_length(window, shingle))
        offset = min(range(len(parts)), key=lambda k: (counts[parts[k]], parts[k], k))
        by_shingle.setdefault(parts[offset], []).append((offset, window))
    return Windows(by_shingle, block)


def hits_in(words: list[bytes], windows: Windows, sizes: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
    """Spans (start, end) of the windows that occur, and the items they belong to."""
    spans, items = [], set()
    for size in sizes:
        found = words if size == 1 else list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))
        if not (shared := windows.by_shingle.keys() & set(found)):
            continue
        for place, part in enumerate(found):
            if part in shared:
                for offset, window in windows.by_shingle[part]:
                    start = place - offset
                    if start >= 0 and start + len(window) <= len(words) and prefix_length(window, size) == size and tuple(words[start : start + len(window)]) == window:
                        spans.append((start, start + len(window)))
                        items.update(windows.items[window])
    return spans, items


def benchmark_blocks(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int, shingle: int, limit: int) -> Iterator[tuple[Broadcast, list[int]]]:
    """Each block's index, sent to the executors, and the sizes of its prefix shingles. The benchmark is read partition by partition."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i is not null").toLocalIterator()
    for block in blocks_of(((r["i"], words_of(r["t"])) for r in rows), window, limit):
        sizes = sorted({prefix_length(w, shingle) for w in block})
        counts = counted_shingles(docs, text, {s for w in block for s in shingles_of(w, prefix_length(w, shingle))}, sizes)
        yield docs.sparkSession.sparkContext.broadcast(index(block, counts, shingle)), sizes


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, stop in sorted(set(map(tuple, spans))):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def merged_spans(spans: Column) -> Column:
    """The same for a column of spans of several blocks."""

    def joined(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], span[1]))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))[1] >= span[0]), longer).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<array<bigint>>"), joined)


def scanned(rows: DataFrame, block: Broadcast | None, sizes: list[int], item_type: str, every: bool) -> DataFrame:
    """doc_id, key, n_words, spans, items; with ``every`` for all rows, else for those with hits."""
    arrow_item = pa.string() if item_type == "string" else pa.int64()
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(arrow_item))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, out = [], []
            for k, (key, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                words = words_of(t.as_py())
                spans, items = hits_in(words, block.value, sizes) if block else ([], set())
                if every or spans:
                    kept.append(k)
                    out.append((key, len(words), merged(spans), sorted(items)))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), *[pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]], names=["doc_id", "key", "n_words", "spans", "items"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, key long, n_words long, spans array<array<long>>, items array<{item_type}>")


def judge(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, limit: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document: doc_id, key (of its text), n_words, n_hit, items (ids), spans (merged hit spans, in words), contaminated."""
    item_type = "string" if benchmark.schema[item_id].dataType.simpleString() == "string" else "bigint"
    # the key tells documents with equal ids apart when hits of several blocks are merged
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    found = None
    for number, (block, sizes) in enumerate(benchmark_blocks(docs, benchmark, text, item_id, item_text, window, shingle, limit)):
        if number == 0:
            found = scanned(rows, block, sizes, item_type, every=True)
            continue
        if number == 1:
            found = cut_lineage(found.withColumn("first", F.lit(1)))
        more = scanned(rows, block, sizes, item_type, every=False).withColumn("first", F.lit(0))
        found = found.unionByName(cut_lineage(more))
    if found is None:
        found = scanned(rows, None, [], item_type, every=True)
    if "first" in found.columns:
        by_row = found.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.collect_set("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.sum("first").cast("int").alias("repeats"))
        by_row = by_row.withColumn("repeat", F.explode(F.array_repeat(F.lit(0), F.col("repeats")))).drop("repeat", "repeats")
        found = once(by_row.withColumn("parts", F.flatten("spans")).drop("spans"), "spans", merged_spans(F.col("parts"))).drop("parts")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return once(found, "n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """The input's rows and columns without contaminated documents. Only the contaminated ones' ids and keys are joined."""
    names = [free_name(docs, f"bad_{c}") for c in ("id", "key")]
    bad = judge(docs, benchmark, doc_id, text, **options).filter("contaminated").select("doc_id", "key").toDF(*names).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(names[0])) & (F.xxhash64(text) == F.col(names[1]))
    return docs.join(broadcast_if_small(cut_lineage(bad), 1_000_000), same, "left_anti")


def digest_of_items(items: str) -> F.Column:
    """SHA-256 of the ids, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform(F.col(items), lambda i: i.cast("string"))), ","), 256)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """The contract's result for a few rows, for tests: doc_id -> n_words, n_hit, n_items, items_sha256."""
    out = {}
    all_windows = [(i, w) for i, t in items for w in item_windows(words_of(t), window)]
    for doc, text in docs:
        words = words_of(text)
        hit, found = set(), set()
        for item, w in all_windows:
            for start in range(len(words) - len(w) + 1):
                if tuple(words[start : start + len(w)]) == w:
                    hit.update(range(start, start + len(w)))
                    found.add(item)
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
    return out
