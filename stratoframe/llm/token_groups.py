"""Exact Jaccard join of documents' word n-grams by a token-group matrix.

A document is the set of its distinct shingles of ``SHINGLE`` words (64-bit hashes; fewer words are one shingle). Documents of
equal sets are one node, so exact copies cost one row each. Two nodes link when 100 * intersection >= percent * union.

*Groups.* Similar nodes are dealt to groups by blocks: the token space is cut into k parts, and a block is what a set has in one part.
Two linked sets of sizes a and b differ in at most d = (a + b)(100 - percent)/(100 + percent) tokens, so of k = d + 1 parts one
holds the same tokens of both: linked sets always share a block, and unrelated ones hardly ever do, even where they share a passage.
k follows from a class of sizes; a set also cuts itself as the class below does if it may be the larger partner there. A node's
group is the least node that it shares a block with; groups that blocks connect are a family.

*Matrix.* A bin (one task's work) holds a family, or whole groups of one, up to about ``BIN`` tokens; a larger group is cut into several bins, and
its least member (the pivot) is in all of them. The bin's matrix says which of its groups have which token (the groups' token unions). A set is
looked up there: its overlap with a group's union bounds its overlap with any member, and a group is opened only where that
bound reaches percent of the set's size. In an opened group the set's overlap with each member is counted exactly. In the first pass
all sets of a bin are looked up in it. The second pass is for families of several bins: a node that shares a block
with a node of another bin, to which no links connect it yet, is looked up there, once for each such bin. Together they compare
every pair that shares a block and isn't connected yet, so no link between different components is lost, and copies are never
expanded into pairs. A family whose nodes share blocks but don't link costs
each of them one lookup for each bin that it shares a block with.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; repeated rows are one
node; ties of ids don't matter; a null id is linked as any other, and a component's least id is null only if it has no other; columns other than
the id and the text are ignored. Two different sets are taken for one if 64-bit digests of theirs are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratoframe.llm.common import broadcast_if_small, cut_lineage, has_rows, spread_join
from stratoframe.llm.simhash import components, shingle_set

SHINGLE = 3
PERCENT = 90
#: Tokens of a bin; a set counts as ``LEAST`` at least.
BIN, LEAST = 1_000_000, 50
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Cuts:
    """Classes of set sizes, and into how many parts the token space is cut for each."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.highest = [1]

    def largest_partner(self, size: int) -> int:
        return size * 100 // self.percent

    def class_of(self, size: int) -> int:
        while self.highest[-1] < size:
            # a class is wide enough to hold the largest partner of the class below
            self.highest.append(max(self.largest_partner(self.highest[-1]), self.highest[-1] * 10 // 7, self.highest[-1] + 1))
        return int(np.searchsorted(self.highest, size))

    def parts(self, level: int) -> int:
        top = self.highest[level]
        return (top + self.largest_partner(top)) * (100 - self.percent) // (100 + self.percent) + 1

    def levels_of(self, size: int) -> list[int]:
        own = self.class_of(size)
        return [own, own - 1] if own and size <= self.largest_partner(self.highest[own - 1]) else [own]


def blocks_of(tokens: np.ndarray, cuts: Cuts) -> np.ndarray:
    """Digests of what a set has in each part, for each class that cuts it."""
    found = []
    mixed = (tokens ^ (tokens >> np.uint64(29))) * _MIX
    for level in cuts.levels_of(len(tokens)):
        k = cuts.parts(level)
        sums = np.zeros(k, np.uint64)
        np.add.at(sums, ((mixed >> np.uint64(33)) % np.uint64(k)).astype(np.intp), mixed ^ (mixed >> np.uint64(31)))
        names = np.arange(k, dtype=np.uint64) + np.uint64(level << 40)
        digest = (sums ^ (names * _MIX)) * np.uint64(0xD6E8FEB86659FD93)
        found.append(digest ^ (digest >> np.uint64(32)))
    return np.concatenate(found).view(np.int64)


def node_of(tokens: np.ndarray) -> int:
    """The signed 64-bit digest of a set."""
    digest = xxhash.xxh64_intdigest(tokens.tobytes())
    return digest - (1 << 64) if digest >> 63 else digest


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of several half-open ranges, one range after the other."""
    sizes = high - low
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(low - before, sizes)


class Matrix:
    """Which groups of sets have which tokens, and in each group which sets."""

    def __init__(self, sets: list[np.ndarray], groups: list[int], percent: int) -> None:
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, group = np.unique(np.array(groups, np.int64), return_inverse=True)
        self.number = int(group.max(initial=-1)) + 1
        tokens, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), self.sizes)
        self.known, token = np.unique(tokens, return_inverse=True)
        cells = np.unique(token.astype(np.int64) * max(self.number, 1) + group[owner])
        self.cells, self.first = cells % max(self.number, 1), np.searchsorted(cells // max(self.number, 1), np.arange(len(self.known) + 1))
        order = np.lexsort((token, group[owner]))
        self.token, self.owner = token[order], owner[order]
        self.starts = np.searchsorted(group[owner][order], np.arange(self.number + 1))

    def linked(self, tokens: np.ndarray) -> np.ndarray:
        """Numbers of the sets that a set links with (itself too, if it is one of them)."""
        if not len(self.known):
            return np.zeros(0, np.int64)
        size, percent = len(tokens), self.percent
        at = np.minimum(np.searchsorted(self.known, tokens), len(self.known) - 1)
        at = at[self.known[at] == tokens]
        bound = np.bincount(self.cells[_ranges(self.first[at], self.first[at + 1])], minlength=self.number)
        found = [np.zeros(0, np.int64)]
        for g in np.flatnonzero(100 * bound >= percent * size):
            low, high = self.starts[g], self.starts[g + 1]
            mine = self.token[low:high]
            places = _ranges(np.searchsorted(mine, at, "left"), np.searchsorted(mine, at, "right"))
            member, both = np.unique(self.owner[low:high][places], return_counts=True)
            found.append(member[100 * both >= percent * (size + self.sizes[member] - both)])
        return np.concatenate(found)


def spanning(matrix: Matrix, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of numbers of a matrix's sets that connect whatever its links connect."""
    label, pairs = np.arange(len(sets)), []
    for i, tokens in enumerate(sets):
        near = matrix.linked(tokens)
        labels, where = np.unique(label[near], return_index=True)
        if len(labels) > 1:
            pairs += [(i, int(near[w])) for w, other in zip(where, labels, strict=True) if other != label[i]]
            label[np.isin(label, labels)] = labels[0]
    return pairs


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def marked(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """doc_id, node, n_shingles, key (of the text) and, for the first row of each node in a task, its blocks."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, seen = Cuts(percent), set()
        for batch in batches:
            nodes, sizes, blocks = [], [], []
            for body in batch.column(1):
                tokens = shingle_set(body.as_py(), shingle)
                node = node_of(tokens) if len(tokens) else None
                nodes.append(node)
                sizes.append(len(tokens))
                blocks.append(None if node is None or node in seen else blocks_of(tokens, cuts))
                seen.add(node)
            columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), batch.column(2), pa.array(blocks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n_shingles", "key", "blocks"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("key")).mapInArrow(made, f"doc_id {kind}, node long, n_shingles long, key long, blocks array<bigint>")


def one_text_each(texts: DataFrame) -> DataFrame:
    """node, text without the repeats of a node within a task: what is left of exact copies is one row for each task at most."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for node in batch.column(0).to_pylist():
                fresh.append(node not in seen)
                seen.add(node)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    return texts.mapInArrow(kept, "node long, text string")


def placed(nodes: DataFrame, size: int) -> DataFrame:
    """Nodes (node, grp, family, n_shingles) with bin and, for the pivots of groups of several bins, bins (all of them; else null).

    A small family is one bin; of a larger one each small group is in one of its bins, a large group has bins of its own.
    """
    weight = F.sum(F.greatest("n_shingles", F.lit(LEAST)))
    families = nodes.groupBy("family").agg(F.ceil(weight / size).cast("int").alias("shares")).filter("shares > 1")
    groups = nodes.groupBy("grp").agg(F.ceil(weight / size).cast("int").alias("pieces"), F.min("node").alias("pivot")).filter("pieces > 1")
    rows = nodes.join(broadcast_if_small(cut_lineage(families)), "family", "left").join(broadcast_if_small(cut_lineage(groups)), "grp", "left")
    own = F.when(F.col("pieces").isNotNull(), F.xxhash64("grp", F.pmod(F.xxhash64("node", F.lit(7)), F.col("pieces")).cast("int")))
    shared = F.pmod(F.xxhash64("grp"), F.coalesce(F.col("shares"), F.lit(1))).cast("long")
    everywhere = F.when(F.col("node") == F.col("pivot"), F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: F.xxhash64("grp", k)))
    return rows.select("node", "grp", "family", F.coalesce(own, shared).alias("bin"), everywhere.alias("bins"), F.col("shares").isNotNull().alias("divided"))


def links_within(places: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """First pass: a, b that connect whatever links connect within each bin."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, groups, sets, seen = None, [], [], [], set()

        def out() -> pa.RecordBatch:
            found = spanning(Matrix(sets, groups, percent), sets) if len(sets) > 1 else []
            return _links([(nodes[i], nodes[j]) for i, j in found])

        for batch in batches:
            for *where, group, node, body in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                if where != at:
                    yield out()
                    at, nodes, groups, sets, seen = where, [], [], [], set()
                if node in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                groups.append(group)
                sets.append(shingle_set(body.as_py(), shingle))
        yield out()

    where = broadcast_if_small(places.select("family", F.coalesce("bins", F.array("bin")).alias("bins"), "grp", "node"))
    rows = texts.join(where, "node").withColumn("bin", F.explode("bins"))
    rows = rows.select("family", "bin", "grp", "node", "text").repartition("family", "bin").sortWithinPartitions("family", "bin")
    return rows.mapInArrow(looked_up, "a long, b long").distinct()


def links_across(places: DataFrame, texts: DataFrame, shared: DataFrame, roots: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Second pass: links between bins of one family, of nodes that share a block and aren't connected yet (shared: block, node; roots: node, root)."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, nodes, groups, roots_of, matrix = None, [], [], [], [], None
        for batch in batches:
            found = []
            for *where, asks, group, node, root, body in zip(*(c.to_pylist() for c in batch.columns[:6]), batch.column(6), strict=True):
                if where != at:
                    at, sets, nodes, groups, roots_of, matrix = where, [], [], [], [], None
                tokens = shingle_set(body.as_py(), shingle)
                if not asks:
                    sets.append(tokens)
                    nodes.append(node)
                    groups.append(group)
                    roots_of.append(root)
                    continue
                matrix = matrix or Matrix(sets, groups, percent)
                found += {roots_of[i]: (nodes[i], node) for i in matrix.linked(tokens).tolist()}.values()
            yield _links(found)

    rooted = cut_lineage(places.filter("divided").join(roots, "node", "left").select("node", "grp", "family", "bin", F.coalesce("root", "node").alias("root")))
    held = shared.join(rooted, "node")
    holders = held.groupBy("block", "family", "bin").agg(F.min("root").alias("lowest"), F.max("root").alias("highest"))
    # of the two nodes of a pair the one in the bin of the larger number asks
    there = holders.select("block", F.col("bin").alias("other"), "lowest", "highest")
    met = held.join(there, "block").filter("other < bin and (lowest <> root or highest <> root)")
    asked = cut_lineage(met.select("family", F.col("other").alias("bin"), "grp", "node", "root").distinct())
    members = rooted.join(broadcast_if_small(asked.select("family", "bin").distinct()), ["family", "bin"], "left_semi")
    names = ("family", "bin", "asks", "grp", "node", "root")
    rows = members.withColumn("asks", F.lit(False)).select(*names).unionByName(asked.withColumn("asks", F.lit(True)).select(*names))
    rows = rows.join(texts, "node").select(*names, "text").repartition("family", "bin").sortWithinPartitions("family", "bin", "asks")
    return rows.mapInArrow(looked_up, "a long, b long").distinct()


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, size: int = BIN) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    rows = cut_lineage(marked(docs, doc_id, text, shingle, percent))
    block = Window.partitionBy("block")
    blocks = rows.filter("blocks is not null").select("node", F.explode("blocks").alias("block"))
    shared = blocks.withColumn("lowest", F.min("node").over(block)).withColumn("highest", F.max("node").over(block)).filter("lowest <> highest")
    shared = cut_lineage(shared.select("block", "node", "lowest"))
    # a node has as many leaders as blocks at most, so its list is bounded by its own size
    led = cut_lineage(shared.groupBy("node").agg(F.collect_set("lowest").alias("leaders")))
    families = components(led.select(F.explode("leaders").alias("a"), F.col("node").alias("b")).filter("a <> b"))
    involved = led.select("node", F.array_min("leaders").alias("grp")).join(families.withColumnRenamed("root", "family"), "node")
    chosen = rows.filter("node is not null").join(broadcast_if_small(cut_lineage(involved)), "node").groupBy("node", "grp", "family", "n_shingles").agg(F.min("key").alias("key"))
    chosen = cut_lineage(chosen)
    texts = one_text_each(docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("key")).join(broadcast_if_small(chosen.select("key", "node")), "key").select("node", "text"))
    places = cut_lineage(placed(chosen, size))
    near = cut_lineage(links_within(places, texts, shingle, percent))
    roots = components(near)
    if has_rows(places.filter("divided")):
        more = cut_lineage(links_across(places, texts, shared.select("block", "node"), cut_lineage(roots), shingle, percent))
        roots = components(near.unionByName(more))

    nodes = rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.min("doc_id").alias("first_id")).join(roots, "node", "left")
    nodes = cut_lineage(nodes.withColumn("root", F.coalesce("root", "node")))
    lowest = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut_lineage(nodes.join(lowest, "root").select("node", "weight", "component_id"))
    found = spread_join(rows.filter("node is not null").select("doc_id", "n_shingles", "node"), named, ["node"], "weight").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(rows.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
