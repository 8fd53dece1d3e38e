"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A text's features are its words (A-Z lower-cased, hashed into ``BUCKETS`` buckets, weighed by the logarithm of their count,
together of length 1) and statistics of its structure and size (see ``STATISTICS``), standardised on the training rows.
score = sigmoid(bias + sum w x + 1/2 sum over factors ((sum v x)^2 - sum v^2 x^2)): all pairs of features interact through
``FACTORS``-dimensional vectors, in time linear in the features.

Training takes labelled rows only, at most ``SAMPLE`` of them, counted after texts and labels have met (ids may repeat): the
lowest by a hash of the id, so the sample is the same in each run. Their features (not their texts) come to the driver, where the machine is fitted by Adam on mini-batches with a
fixed seed. The fitted machine has a fixed size (``BUCKETS`` + statistics rows of 1 + ``FACTORS`` numbers, about 1 MB) and is
broadcast; scoring is one pass over the documents in Arrow batches, without a shuffle.

Null and empty texts have no words and statistics of zero, and get the score that these have. Labels that are null or whose
document is missing are left out; equal rows of id, label and text count once, an id with several texts or labels gives a row for each. With no labels, or labels of one class only,
the score of every text is the share of label 1 (0.5 without labels). Extra columns pass through.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratoframe.llm.common import cut_lineage

BUCKETS = 1 << 15
FACTORS = 6
SAMPLE = 8_000
EPOCHS = 12
#: Texts whose features are held and summed at once.
TEXTS = 500
STATISTICS = (
    "log of characters",
    "log of words",
    "log of lines",
    "mean word length",
    "mean line length, log",
    "capitals among characters",
    "digits among characters",
    "common punctuation among characters",
    "other ASCII signs among characters",
    "characters beyond ASCII",
    "distinct words among words, by the root of their number",
    "commonest word's share",
    "words equal to the one before",
    "words that end in a sign other than a stop, a comma or the like",
    "words that are only signs",
    "repeated lines among lines",
    "words of one or two characters",
)


def _share(raw: bytes, kept: bytes) -> float:
    return (len(raw) - len(raw.translate(None, kept))) / max(1, len(raw))


_CAPITALS, _DIGITS, _COMMON = bytes(range(65, 91)), b"0123456789", b".,;:'\"()-?"
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _COMMON)
_ALL_SIGNS = _SIGNS + _COMMON
_BEYOND = bytes(range(128, 256))


class Features(NamedTuple):
    buckets: np.ndarray  # of distinct words
    weights: np.ndarray
    statistics: np.ndarray


def features_of(text: str | None) -> Features:
    raw = (text or "").encode()
    words = raw.lower().split()
    if not words:
        return Features(np.zeros(0, np.int64), np.zeros(0), np.zeros(len(STATISTICS)))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    letters = sum(map(len, words))
    signs = sum(1 for w in counts if w[-1] in _SIGNS)
    statistics = np.array(
        [
            math.log1p(len(raw)),
            math.log1p(n),
            math.log1p(len(lines)),
            letters / n,
            math.log1p(len(raw) / max(1, len(lines))),
            _share(raw, _CAPITALS),
            _share(raw, _DIGITS),
            _share(raw, _COMMON),
            _share(raw, _SIGNS),
            _share(raw, _BEYOND),
            len(counts) / n * min(1.0, math.sqrt(n / 200)) + (1 - min(1.0, math.sqrt(n / 200))),
            counts.most_common(1)[0][1] / n if n >= 20 else 0.0,
            sum(map(eq, words, words[1:])) / n,
            signs / len(counts),
            sum(c for w, c in counts.items() if not w.translate(None, _ALL_SIGNS)) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            sum(c for w, c in counts.items() if len(w) <= 2) / n,
        ]
    )
    buckets = np.fromiter((zlib.crc32(w) % BUCKETS for w in counts), np.int64, len(counts))
    weights = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    return Features(buckets, weights / np.sqrt((weights**2).sum()), statistics)


class Machine(NamedTuple):
    """Feature k < BUCKETS is a word bucket, BUCKETS + k is statistic k."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def inputs(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        scaled = np.clip((f.statistics - self.mean) / self.spread, -4, 4) / 4
        return np.concatenate([f.buckets, BUCKETS + np.arange(len(scaled))]), np.concatenate([f.weights, scaled])

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """All texts at once: their features lie one after the other and are summed from start to start."""
        if not len(texts):
            return np.zeros(0)
        parts = [self.inputs(features_of(t)) for t in texts]
        lengths = [len(index) for index, _ in parts]
        index, x = (np.concatenate([p[side] for p in parts]) for side in (0, 1))
        starts = np.cumsum([0, *lengths[:-1]])
        vx = self.factors[index] * x[:, None]
        pairs = 0.5 * (np.add.reduceat(vx, starts) ** 2 - np.add.reduceat(vx**2, starts)).sum(1)
        z = self.bias + np.add.reduceat(self.linear[index] * x, starts) + pairs
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


class Sample(NamedTuple):
    """Training rows, flat: row k has the buckets and weights from starts[k] to starts[k + 1]."""

    starts: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray
    statistics: np.ndarray
    labels: np.ndarray


def sample_of(rows: list[tuple[Features, int]]) -> Sample:
    starts = np.cumsum([0] + [len(f.buckets) for f, _ in rows])
    flat = [np.concatenate([f[k] for f, _ in rows]) if rows else np.zeros(0) for k in (0, 1)]
    stats = np.stack([f.statistics for f, _ in rows]) if rows else np.zeros((0, len(STATISTICS)))
    return Sample(starts, flat[0].astype(np.int32), flat[1].astype(np.float32), stats, np.array([y for _, y in rows], float))


def fit(rows: Sample, epochs: int = EPOCHS, factors: int = FACTORS, seed: int = 1, rate: float = 0.02, batch: int = 128, decay: float = 1e-4) -> Machine:
    """Logistic loss, Adam on mini-batches; classes weigh alike up to a factor of four."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + len(STATISTICS)
    labels = rows.labels
    if len(labels) == 0 or labels.min() == labels.max():
        share = labels.mean() if len(labels) else 0.5
        bias = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Machine(bias, np.zeros(size), np.zeros((size, factors)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    machine = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, factors)), rows.statistics.mean(0), rows.statistics.std(0) + 1e-9)

    def inputs(k: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(rows.starts[k], rows.starts[k + 1])
        return machine.inputs(Features(rows.buckets[own], rows.weights[own], rows.statistics[k]))

    bias, linear, vectors = 0.0, machine.linear, machine.factors
    heavy = min(4.0, max(labels.mean(), 1 - labels.mean()) / min(labels.mean(), 1 - labels.mean()))
    weight = np.where(labels == (labels.mean() < 0.5), heavy, 1.0)
    moments = {"w1": np.zeros(size), "w2": np.zeros(size), "v1": np.zeros((size, factors)), "v2": np.zeros((size, factors)), "b1": 0.0, "b2": 0.0}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        pace = rate * 0.5 ** (epoch / 2)
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            step += 1
            parts = [inputs(k) for k in chosen]
            index, x = (np.concatenate([p[side] for p in parts]) for side in (0, 1))
            lengths = [len(p[0]) for p in parts]
            starts = np.cumsum([0, *lengths[:-1]])
            row = np.repeat(np.arange(len(chosen)), lengths)
            vx = vectors[index] * x[:, None]
            total = np.add.reduceat(vx, starts)
            z = bias + np.add.reduceat(linear[index] * x, starts) + 0.5 * (total**2 - np.add.reduceat(vx**2, starts)).sum(1)
            error = weight[chosen] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) / len(chosen)
            unique, inverse = np.unique(index, return_inverse=True)
            g = error[row] * x
            gw = np.bincount(inverse, g, len(unique)) + decay * linear[unique]
            pair = g[:, None] * (total[row] - vx)
            gv = np.stack([np.bincount(inverse, pair[:, f], len(unique)) for f in range(factors)], 1) + decay * vectors[unique]
            for name, values, where, grad in (("w", linear, unique, gw), ("v", vectors, unique, gv)):
                m1, m2 = moments[f"{name}1"], moments[f"{name}2"]
                m1[where] = 0.9 * m1[where] + 0.1 * grad
                m2[where] = 0.999 * m2[where] + 0.001 * grad**2
                values[where] -= pace * (m1[where] / (1 - 0.9**step)) / (np.sqrt(m2[where] / (1 - 0.999**step)) + 1e-8)
            gb = error.sum()
            moments["b1"] = 0.9 * moments["b1"] + 0.1 * gb
            moments["b2"] = 0.999 * moments["b2"] + 0.001 * gb**2
            bias -= pace * (moments["b1"] / (1 - 0.9**step)) / (math.sqrt(moments["b2"] / (1 - 0.999**step)) + 1e-8)
    return machine._replace(bias=float(bias))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 when divided by 3 are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most ``sample`` labelled rows that are not held out.

    A labelled row is an id, a label and a text: ids that several texts or labels share give a row for each, equal rows count once. Of more than
    ``sample`` rows those of the least hashes (of id, label and text) are taken, whatever partitions they lie in. Without rows the
    machine scores all texts alike.
    """
    usable = labels.select(F.col(doc_id).alias("labelled_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and labelled_id is not null").filter(~held_out(F.col("labelled_id")))
    # ids first, so that few texts are looked at; a repeated id can only add rows, which the cap after the join takes away again
    drawn = usable.distinct().orderBy(F.xxhash64("labelled_id", F.lit(11)), "labelled_id", "label").limit(sample)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled_id")).select("labelled_id", "label", F.xxhash64("text").alias("chosen_key")).distinct()
    chosen = cut_lineage(found.orderBy(F.xxhash64("labelled_id", F.lit(11)), "labelled_id", "label", "chosen_key").limit(sample))
    same = (F.col("doc_id") == F.col("labelled_id")) & (F.xxhash64("text") == F.col("chosen_key"))
    rows = texts.join(F.broadcast(chosen), same).groupBy("doc_id", "label", "chosen_key").agg(F.first("text").alias("text"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(t.as_py()) for t in batch.column(1)]
            arrays = [batch.column(0), batch.column(2), batch.column(3), *[pa.array([list(f[k]) for f in found], pa.list_(kind)) for k, kind in ((0, pa.int32()), (1, pa.float32()), (2, pa.float64()))]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "text_key", "buckets", "weights", "statistics"])

    kind = docs.schema[doc_id].dataType.simpleString()
    table = rows.select("doc_id", "text", "label", "chosen_key").mapInArrow(extracted, f"doc_id {kind}, label int, text_key long, buckets array<int>, weights array<float>, statistics array<double>").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text_key", "ascending")]).combine_chunks()
    flat = {c: pa.chunked_array(table[c].chunks, table[c].type).combine_chunks() for c in ("buckets", "weights", "statistics")}
    starts = np.concatenate([[0], np.cumsum([len(b) for b in table["buckets"]])]).astype(np.int64)
    buckets, weights, stats = (np.array(flat[c].flatten()) for c in ("buckets", "weights", "statistics"))
    labels = np.array(table["label"], float)
    del table, flat
    pa.default_memory_pool().release_unused()
    return fit(Sample(starts, buckets, weights, stats.reshape(len(labels), len(STATISTICS)), labels))


def scored(docs: DataFrame, machine: Machine, text: str = "text", score: str = "score") -> DataFrame:
    """The input's rows and columns with the score (0 to 1, higher: label 1 likelier); a column that has its name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        parts = [sent.value.scores(texts.iloc[at : at + TEXTS].tolist()) for at in range(0, len(texts), TEXTS)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0), dtype="float64")

    return docs.withColumn(score, of(F.col(text)))
