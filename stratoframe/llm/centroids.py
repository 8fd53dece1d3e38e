"""Lloyd's clustering of quantised vectors, exact in integers, over distinct vectors with their multiplicities.

Vectors of the wanted width without null or non-finite components are kept; each component becomes an integer. Equal
quantised vectors are one row from there on, with the number of rows they stand for, so a vector that a third of all rows
share costs one row. Each round assigns the distinct vectors to their nearest centroids in Arrow batches (ties: the smaller
number) and sums components times multiplicities; sums are exact integers, so results don't depend on how rows are dealt.
Only one row for each centroid comes to the driver in a round. At last the assignments of distinct vectors are joined back to
the ids by a 128-bit hash of the vector, those of common vectors by a broadcast, the others by a shuffle.

Defined cases: quantised components are held within +-2**26 (``LARGEST``), so that squared distances fit in a long; a null
vector isn't kept; equal rows count as often as they occur; rows that tie for a first centroid (the same id with different
vectors) go by their components; a null id has no hash and is taken last. Fewer vectors than centroids make fewer centroids,
none an empty result. A sum of distances beyond a long is null. Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratoframe.llm.common import cut_lineage, spread_join

WIDTH = 64
FACTOR = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1
LARGEST = 1 << 26
#: Components up to this size have distances that doubles hold exactly, so the faster product of doubles is used.
EXACT_DOUBLE = 1 << 21


def quantised(vectors: DataFrame, vec_id: str, vector: str, width: int = WIDTH, factor: float = FACTOR) -> DataFrame:
    """vec_id, v (array of int) of the rows that are kept."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("x"))
    finite = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    kept = rows.filter((F.size("x") == width) & finite)
    whole = F.transform("x", lambda x: F.greatest(F.least(F.floor(x.cast("double") * F.lit(float(factor))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return kept.select("vec_id", whole.alias("v"))


def hashes(v: str) -> list[Column]:
    return [F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(7), v).alias("k2")]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_DOUBLE:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def nearest(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """k1, k2, weight, cluster, distance of distinct vectors (k1, k2, weight, v)."""
    width = centroids.shape[1]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = distances(_matrix(batch.column("v"), width), centroids)
            cluster = found.argmin(1)
            columns = [*(batch.column(c) for c in ("k1", "k2", "weight")), pa.array(cluster.astype(np.int32)), pa.array(found[np.arange(len(found)), cluster])]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "weight", "cluster", "distance"])

    return distinct.mapInArrow(assigned, "k1 long, k2 long, weight long, cluster int, distance long")


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of their vectors' weighted means; those without vectors stay."""
    number, width = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((number, width), object), np.zeros(number, object)
        for batch in batches:
            x, weight = _matrix(batch.column("v"), width), batch.column("weight").to_numpy()
            cluster = distances(x, centroids).argmin(1)
            for k in np.unique(cluster):
                mine, times = x[cluster == k], weight[cluster == k]
                rows[k] += int(times.sum())
                # products stay below 2**26 * 2**20 * rows of a batch; heavier vectors are summed as Python integers
                heavy = times > 1 << 20
                sums[k] += (mine[~heavy] * times[~heavy, None]).sum(0).astype(object)
                for v, w in zip(mine[heavy], times[heavy], strict=True):
                    sums[k] += v.astype(object) * int(w)
        used = [k for k in range(number) if rows[k]]
        total = pa.array([[str(s) for s in (rows[k], *sums[k])] for k in used], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), total], names=["cluster", "total"])

    parts = distinct.mapInArrow(summed, "cluster int, total array<string>")
    each = parts.select("cluster", F.posexplode("total").alias("place", "some")).groupBy("cluster", "place").agg(F.sum(F.col("some").cast("decimal(38,0)")).alias("total"))
    after, found = centroids.copy(), {(r["cluster"], r["place"]): int(r["total"]) for r in each.collect()}
    for k in range(number):
        if count := found.get((k, 0)):
            after[k] = [found[k, place + 1] // count for place in range(width)]
    return after


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, factor: float = FACTOR
) -> tuple[DataFrame, np.ndarray]:
    """The kept rows' vec_id, cluster and squared distance, and the final centroids (numbers of clusters are their rows)."""
    rows = quantised(vectors, vec_id, vector, width, factor)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(order.asc_nulls_last(), "v").limit(centroids).collect()
    middles = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
    if not len(first):
        return rows.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).limit(0), middles
    distinct = cut_lineage(rows.groupBy("v").agg(F.count("*").alias("weight")).select(*hashes("v"), "weight", "v"))
    for _ in range(rounds):
        middles = moved(distinct, middles)
    found = cut_lineage(nearest(distinct, middles))
    keyed = rows.select("vec_id", *hashes("v"))
    return spread_join(keyed, found, ["k1", "k2"], "weight").select("vec_id", "cluster", "distance"), middles


def with_inertia(assigned: DataFrame, middles: np.ndarray) -> DataFrame:
    """Assigned rows with cluster_inertia, inertia (distances summed over the cluster and over all rows) and centroid_sha256."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    whole = fits(sum(sums.values()))
    table = [(k, fits(total), whole, hashlib.sha256(",".join(str(int(x)) for x in middles[k]).encode()).hexdigest()) for k, total in sums.items()]
    each = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
