"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprints: 64 bits of the 4-word shingles' XXH64, computed in Arrow batches. Equal fingerprints are one node from there
on, so a group of exact copies costs one row, however large it is.

Candidates: a fingerprint's bits fall into 32 segments of two bits; the vector of their bit counts is its embedding. Two
fingerprints at Hamming distance d have embeddings at Manhattan distance at most d (each bit moves one count by one), so
that distance is a lower bound. The grid: the embedding's two halves of 16 segments. A cell holds the count of one segment in four
(``COUNTED``) and, finer than the embedding, which bits of the others are set; each flipped bit is at most one step between cells. Of
at most ``distance`` (4) flipped bits one half has at most two, so there a cell lies between the two, at most one step from each. A
fingerprint goes to the cells of its own halves and to all that are one step away (at most 33 a half, 31 on average); so every
linked pair meets in a cell. Pairs that meet are dropped if their whole embeddings are farther apart than 4; the others are
verified on the bits. (Unrelated fingerprints meet with a chance of some 0.000004, so pairs to look at grow with the square of
the distinct fingerprints, by that factor; cells of counts alone would make it 0.00008.)

Cells of more than ``CELL`` fingerprints are cut into chunks of that many, and each pair of chunks is compared by itself, so
no task holds a whole cell. Each comparison returns a spanning forest of its links, not all pairs: nothing is lost for the
components, and output stays below the number of rows read. Components then come from alternating large-star and small-star
rounds over those links, each round written to the checkpoint folder.

Null and empty texts have no words: fingerprint zero, linked as any other. Repeated rows are equal nodes. Columns of the
input other than the id and the text are ignored.

Beyond the few bits of such links, ``similar_texts`` groups texts by the exact Jaccard similarity of their word shingles: a
pair at similarity 0.8 differs by 9 or 10 bits on average, more than the grid's blocks allow for. Its candidates are the links of the
same fingerprints, embedding and grid, and for pairs of more bits the texts that share a cell of a second kind: ``BANDS`` bands of
``BAND`` minimum hashes of the shingles each (a pair at 0.8 misses all of them with a chance of 0.0007, a closer one less).
Texts that either connects are candidates; each connected group's texts are gathered once, in chunks of ``CHUNK`` characters
that meet pairwise, and only pairs whose shingle sets are similar enough become links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratoframe.llm.common import broadcast_if_small, cut_lineage, free_name

SHINGLE = 4
DISTANCE = 4
SEED = 42
CELL = 512
#: Fingerprints that a task deals to cells.
NODES = 100_000
#: Up to so many crowded cells (12 bytes each) are broadcast to the pass that picks their rows; more are joined by a shuffle.
BROADCAST_CELLS = 200_000
#: Minimum hashes of the wide search: so many bands of so many each.
BANDS, BAND = 24, 6
#: Words of a shingle of the wide search.
WIDE = 5
#: Candidates' characters in a chunk; a text counts as ``LEAST_CHARS`` at least.
CHUNK, LEAST_CHARS = 2_000_000, 2_000
#: Rounds of the component search before it stops with an error; each round shortens chains to a fraction.
ROUNDS = 60


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: bit k is set where it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    starts = range(max(1, len(words) - shingle + 1))
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in starts), np.uint64, len(starts))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (total * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(hashed, f"doc_id {kind}, fp long")


#: Bit pairs' counts: 0 -> 0, 1 and 2 -> 1, 3 -> 2, so that two bits still hold each count.
EVEN = np.uint64(0x5555555555555555)
#: The segments of which a cell of the grid holds the count; of the others it holds the bits.
COUNTED = np.uint64(0x0303030303030303)


def embedding(fp: np.ndarray) -> np.ndarray:
    """Per 2-bit segment its number of set bits, kept in the segment's two bits."""
    return (fp & EVEN) + ((fp >> np.uint64(1)) & EVEN)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings: counts differ by 0, 1 or 2; thermometer codes make that a popcount."""

    def thermometer(x: np.ndarray) -> np.ndarray:
        high = (x >> np.uint64(1)) & EVEN
        return (((x & EVEN) | high) << np.uint64(1)) | high

    return np.bitwise_count(thermometer(a) ^ thermometer(b))


def lower_bound(a: Column, b: Column) -> Column:
    """Manhattan distance of the embeddings of two columns: segments with a bit set on one side only, and with both set on one side only."""
    even = F.lit(int(EVEN))

    def some(x: Column) -> Column:
        return x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(even)

    def both(x: Column) -> Column:
        return x.bitwiseAND(F.shiftrightunsigned(x, 1)).bitwiseAND(even)

    return F.bit_count(some(a).bitwiseXOR(some(b))) + F.bit_count(both(a).bitwiseXOR(both(b)))


def cells(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """cell, fp: each distinct fingerprint in the cells of its halves and in those one step away."""
    if distance > 5:
        raise ValueError("halves one step apart from a common cell hold distances up to 5")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            places = (embedding(fp) & COUNTED) | (fp & ~COUNTED)
            for half in range(2):
                vector = ((places >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)) | np.uint64(half << 32)
                near = [(vector, fp)]
                for k in range(0, 32, 2):
                    if int(COUNTED) >> k & 1:
                        step, count = np.uint64(1 << k), (vector >> np.uint64(k)) & np.uint64(3)
                        more, less = count < 2, count > 0
                        near += [(vector[more] + step, fp[more]), (vector[less] - step, fp[less])]
                    else:
                        near += [(vector ^ np.uint64(1 << j), fp) for j in (k, k + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[side] for x in near]).view(np.int64)) for side in (0, 1)], names=["cell", "fp"])

    return nodes.select("fp").mapInArrow(dealt, "cell long, fp long")


def forest(a: np.ndarray, b: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs (one of a, one of b) within the distance."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    links = []
    ua, ub = a.view(np.uint64), b.view(np.uint64)
    ea, eb = embedding(ua), embedding(ub)
    for i in range(len(a)):
        near = np.flatnonzero(manhattan(ea[i], eb) <= distance)
        near = near[np.bitwise_count(ua[i] ^ ub[near]) <= distance]
        for j in near:
            x, y = root(int(a[i])), root(int(b[j]))
            if x != y:
                parent[y] = x
                links.append((int(a[i]), int(b[j])))
    return links


def links(nodes: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """a, b: links between distinct fingerprints within the distance that connect whatever all such links connect."""
    # few short rows become many: they are spread by their number first
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // NODES))
    dealt = cells(nodes.select("fp").repartition(tasks, "fp"), distance)
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("lowest"), F.max("fp").alias("highest")).filter("n > 1")
    sizes = cut_lineage(sizes)
    pairs = sizes.filter("n = 2").select(F.col("lowest").alias("a"), F.col("highest").alias("b"))
    direct = pairs.filter(lower_bound(F.col("a"), F.col("b")) <= distance).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    crowded = sizes.filter("n > 2").select("cell", F.ceil(F.col("n") / cell).cast("int").alias("chunks"))
    if crowded.count() <= BROADCAST_CELLS:
        crowded = F.broadcast(crowded)
    rows = dealt.join(crowded, "cell").withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    rows = rows.select("cell", "fp", "chunk", other).select("cell", "fp", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk")
    gathered = rows.groupBy("cell", "low", "high").agg(F.collect_list(F.when(F.col("chunk") == F.col("low"), F.col("fp"))).alias("a"), F.collect_list(F.when(F.col("chunk") == F.col("high"), F.col("fp"))).alias("b"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                found += forest(np.array(a.values, np.int64), np.array(b.values, np.int64), distance)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    near = gathered.select("a", "b").mapInArrow(compared, "a long, b long")
    return direct.unionByName(near).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, root (the component's least node) for every node of a link (a, b), by large-star and small-star rounds."""

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = cut_lineage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = cut_lineage(small)
        before, last = mark(edges), before
        if before == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components not settled after {rounds} rounds")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row for each document: doc_id, fp (signed long), component_id: the least doc_id that links reach."""
    marked = cut_lineage(fingerprints(docs, doc_id, text, shingle))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes, distance)).withColumnsRenamed({"node": "fp"})
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(lowest, "root").select(F.col("fp").alias("node"), "component_id")
    return marked.join(by_fp, F.col("fp") == F.col("node")).select("doc_id", "fp", "component_id")


_MIX = np.uint64(0xBF58476D1CE4E5B9)
_RANDOM = np.random.default_rng(SEED)
_PLACES = _RANDOM.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_FLIPS, _FACTORS = _RANDOM.integers(0, 1 << 64, (BANDS * BAND, 1), np.uint64), _RANDOM.integers(0, 1 << 64, (BANDS * BAND, 1), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = WIDE) -> np.ndarray:
    """64-bit hashes of the text's distinct shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(min(1, len(words)), len(words) - shingle + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(words))):
        total += hashes[k : k + n] * _PLACES[k]
    total = (total ^ (total >> np.uint64(31))) * _MIX
    return np.unique(total ^ (total >> np.uint64(29)))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """The cells of a shingle set."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 13):
        least = np.minimum(least, ((shingles[at : at + (1 << 13)] ^ _FLIPS) * _FACTORS).min(axis=1))
    cell = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(BAND):
        cell = (cell ^ least[k::BAND]) * _MIX
        cell ^= cell >> np.uint64(31)
    return cell.view(np.int64)


def similar_pairs(sets: list[frozenset[int]], first: list[bool] | None, similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs at or over the similarity; with ``first`` only pairs of one that is first and one that isn't."""

    def similar(a: frozenset[int], b: frozenset[int]) -> bool:
        if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
            return False
        both = len(a & b)
        return both >= similarity * (len(a) + len(b) - both) - 1e-9

    links, clusters = [], []
    for i, own in enumerate(sets):
        mine, others = [i], []
        for cluster in clusters:
            j = next((j for j in cluster if (first is None or first[i] != first[j]) and similar(sets[j], own)), None)
            if j is None:
                others.append(cluster)
            else:
                links.append((j, i))
                mine += cluster
        clusters = [*others, mine]
    return links


def grid_links(rows: DataFrame, shingle: int, distance: int) -> DataFrame:
    """a, b: nodes of rows (node, text) that equal fingerprints and the grid's links connect."""
    marked = cut_lineage(fingerprints(rows, "node", "text", shingle))
    firsts = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    same = marked.join(firsts, "fp").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    near = links(firsts, distance).join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))).filter("a <> b")


def similar_texts(docs: DataFrame, similarity: float, doc_id: str = "doc_id", text: str = "text", shingle: int = WIDE, chunk: int = CHUNK, distance: int = DISTANCE) -> DataFrame:
    """doc_id, component_id (the least doc_id that links of at least the similarity reach) for each distinct id; an id stands for one text and is a long."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {k: t for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)}
            found = [bands_of(shingle_set(t.as_py(), shingle)) for t in keys.values()]
            cell = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.repeat(np.fromiter(keys, np.int64, len(keys)), BANDS))], names=["cell", "node"])

    rows = docs.select(F.col(doc_id).alias("node"), F.col(text).alias("text"))
    in_cells = cut_lineage(rows.mapInArrow(dealt, "cell long, node long").distinct())
    shared = cut_lineage(in_cells.groupBy("cell").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a <> most").select("cell", "a"))
    star = in_cells.join(F.broadcast(shared) if shared.count() <= BROADCAST_CELLS else shared, "cell").filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    near = cut_lineage(components(grid_links(rows, shingle, distance).unionByName(star)))
    nodes = in_cells.select("node").distinct()

    weight = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(LEAST_CHARS)).cast("long")
    sizes = rows.select("node", weight.alias("weight")).distinct().join(near, "node").groupBy("root").agg(F.ceil(F.sum("weight") / chunk).cast("int").alias("chunks")).filter("chunks > 1")
    crowded = broadcast_if_small(cut_lineage(sizes))
    texts = rows.join(near, "node").dropDuplicates(["node"]).join(crowded, "root", "left")
    texts = texts.withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int"))
    met = texts.select("root", "node", "text", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    met = met.select("root", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "node", (F.col("chunk") <= F.col("other")).alias("first"), "text")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, sets, first = None, [], [], []

        def out() -> pa.RecordBatch:
            found = similar_pairs(sets, first if at and at[1] != at[2] else None, similarity)
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in found], pa.int64()), pa.array([keys[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *group, key, side, body in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5), strict=True):
                if group != at:
                    yield out()
                    at, keys, sets, first = group, [], [], []
                keys.append(key)
                sets.append(frozenset(shingle_set(body.as_py(), shingle).tolist()))
                first.append(side)
        yield out()

    group = ["root", "low", "high"]
    pairs = met.repartition(*group).sortWithinPartitions(*group).mapInArrow(verified, "a long, b long")
    roots = components(pairs.distinct())
    return nodes.join(roots, "node", "left").select(F.col("node").alias("doc_id"), F.coalesce("root", "node").alias("component_id"))


def hex_digits(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float | None = None, **options: int) -> DataFrame:
    """The input's rows and columns: of each group of near-duplicates (by fingerprints or, with ``similarity``, by ``similar_texts``) the row with the least id (without any id: one of its rows).

    Groups are of texts: rows whose ids are null or repeated but whose texts are in different groups all stay.
    """
    key, group, mark = (free_name(docs, x) for x in ("text_key", "text_group", "kept_mark"))
    keyed = docs.withColumn(key, F.xxhash64(text))
    groups = near_duplicates(keyed, key, text, **options) if similarity is None else similar_texts(keyed, similarity, key, text, **options)
    found = groups.select(F.col("doc_id").alias(key), F.col("component_id").alias(group)).distinct()
    marked = F.xxhash64(F.col(key), F.col(doc_id).isNull(), F.col(doc_id).cast("string"))
    each = keyed.select(key, F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), marked.alias("mark")).alias("row")).distinct()
    kept = each.join(found, key).groupBy(group).agg(F.min("row").alias("row")).select(F.col("row.mark").alias(mark))
    # the join leaves rows dealt and sorted by the mark, so dropping repeated rows needs no shuffle of its own
    return keyed.withColumn(mark, marked).join(kept, mark).dropDuplicates([mark]).drop(key, mark)
