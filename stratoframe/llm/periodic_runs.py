"""Maximal periodic stretches (runs) of words: menus, chants and generated loops that repeat themselves back to back.

A run has a smallest period q (words q apart are the same), is at least ``least`` words and ``times`` periods long, and no
neighbouring word extends it. Every run is found from a Lyndon root: in one of the two orders of words (any total order and
its reverse) the longest Lyndon word at some place of the run is one period of it. So a stack of next smaller suffixes is
built from right to left under both orders; the distance to the next smaller suffix is the length of that Lyndon word, the
one candidate period of a place. A run of three periods holds a place whose candidate recurs right behind itself, so other
places are dropped by a comparison of four words each. The rest are extended to both sides. Suffixes are compared and
candidates extended by longest common extensions: binary search on rolling hashes (modulo a prime, with a fixed random base),
then a check of the words themselves; extensions at a distance that was met before only check the words that are new, so a
long periodic text costs no quadratic time. There is no suffix array.

Words are runs of other characters than ASCII white space. Whole texts are read, one at a time, in Arrow batches; nothing is
shuffled. A null or empty text has no words and no runs, and its collapsed text is empty. Rows are handled one by one, so
repeated rows, ties of ids and null ids need no rule; columns of the input other than the id and the text are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 24
TIMES = 3
#: Words that are compared directly before hashes are made.
DIRECT = 8
PRIME = (1 << 61) - 1
_BASE = random.Random(42).randrange(1 << 32, PRIME)
_POWERS = [1]

Run = tuple[int, int, int]
Edit = Callable[[int | None, list[bytes]], list[bytes]]


class Extensions:
    """Longest common extensions of a list of word numbers that ends in a sentinel no word equals."""

    def __init__(self, w: list[int]) -> None:
        self.w, self.n = w, len(w) - 1
        self.array = np.array(w, np.int32)
        self.sums: list[int] | None = None
        self.met: dict[int, tuple[int, int]] = {}  # distance: a stretch known to be equal at it, and maximal to the right

    def _equal_hash(self, i: int, j: int, size: int) -> bool:
        s = self.sums
        return ((s[i + size] - s[i]) * _POWERS[j - i] - (s[j + size] - s[j])) % PRIME == 0

    def _prepare(self) -> None:
        while len(_POWERS) <= self.n:
            _POWERS.append(_POWERS[-1] * _BASE % PRIME)
        self.sums = [0, *accumulate((v + 1) * p % PRIME for v, p in zip(self.w[:-1], _POWERS, strict=False))]

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on (i < j)."""
        w, n, apart = self.w, self.n, j - i
        low, high = self.met.get(apart, (n, n))
        if low <= i <= high:
            return high - i
        k = i
        stop = min(i + DIRECT, n - apart)
        while k < stop and w[k] == w[k + apart]:
            k += 1
            if k == low:
                self.met[apart] = (i, high)
                return high - i
        if k < stop or k == n - apart:
            return k - i
        if self.sums is None:
            self._prepare()
        good, bad = k - i, n - j + 1
        step = DIRECT
        while good + step < bad and self._equal_hash(i, j, good + step):
            good += step
            step *= 2
        bad = min(bad, good + step)
        while bad - good > 1:
            half = (good + bad) // 2
            good, bad = (half, bad) if self._equal_hash(i, j, half) else (good, half)
        end = i + good
        check = min(end, low) if low > i and end >= low else end
        if not np.array_equal(self.array[k:check], self.array[k + apart : check + apart]) or (end < n - apart and w[end] == w[end + apart]):
            good = self._plain(i, apart)
        self.met[apart] = (i, i + good)
        return good

    def _plain(self, i: int, apart: int) -> int:
        """The same without hashes, where they were wrong."""
        differ = np.flatnonzero(self.array[i : self.n - apart] != self.array[i + apart : self.n])
        return int(differ[0]) if len(differ) else self.n - apart - i

    def left(self, i: int, apart: int) -> int:
        """How many words before i equal those the distance further on."""
        w, size, step = self.w, 0, DIRECT
        while size < min(DIRECT, i) and w[i - size - 1] == w[i + apart - size - 1]:
            size += 1
        if size < min(DIRECT, i) or size == i:
            return size
        while size < i:
            some = min(step, i - size)
            at = i - size
            differ = np.flatnonzero(self.array[at - some : at] != self.array[at - some + apart : at + apart])
            if len(differ):
                return size + some - 1 - int(differ[-1])
            size += some
            step *= 2
        return size


def next_smaller(w: list[int], extensions: Extensions) -> list[int]:
    """For each place the next place whose suffix is smaller, from right to left; the sentinel at the end is smaller than all."""
    n, right = len(w) - 1, extensions.right
    found = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        v, j = w[i], i + 1
        while (u := w[j]) >= v:
            if u == v:
                a, b = w[i + 1], w[j + 1]
                if a == b:
                    same = right(i, j)
                    a, b = w[i + same], w[j + same]
                if b < a:
                    break
            j = found[j]
        found[i] = j
    return found


def runs_of(numbers: list[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """Runs (start, length, period), sorted by start and period, of a list of word numbers."""
    if times < 3:
        raise ValueError("runs are sought from three periods on")
    n = len(numbers)
    if n < least:
        return []
    top = max(numbers)
    forward = [*numbers, -1]
    extensions = Extensions(forward)
    array, found, last = extensions.array, set(), {}
    for w in (forward, [*(top - v for v in numbers), -1]):
        last.clear()
        after = np.array(next_smaller(w, extensions)[:n])
        place = np.arange(n)
        place = place[2 * after - place <= n]
        period = after[place] - place
        twice = place + period
        kept = (array[place] == array[twice]) & (array[twice - 1] == array[twice + period - 1])
        for i, q in zip(place[kept].tolist(), period[kept].tolist(), strict=True):
            start, end = last.get(q, (0, 0))
            if start <= i and i + 2 * q <= end:
                continue
            same = extensions.right(i, i + q)
            if same < q:
                continue
            start, end = i - extensions.left(i, q), i + q + same
            last[q] = (start, end)
            if end - start >= max(least, times * q):
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> list[int]:
    """Words as numbers in the order of their first places."""
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return [words[k] for k in np.flatnonzero(keep)]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, edit: Edit | None = None) -> DataFrame:
    """For each row doc_id, runs (start, length, period in words, by start and period) and collapsed: the words without those that a run holds after its first period, joined by one space.

    ``edit`` may change the words of a document before.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for key, body in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                words = (body.as_py() or b"").split()
                words = edit(key.as_py(), words) if edit else words
                own = runs_of(numbered(words), least, times)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                texts.append(b" ".join(kept_words(words, own)))
            made = [batch.column(0), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "runs", "collapsed"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    key = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scanned, f"doc_id {key}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def strongest(runs: str) -> Column:
    """The run of most periods (exact fractions; ties: smallest start, then period), null without runs."""

    def better(a: Column, b: Column) -> Column:
        more, same = a["length"] * b["period"] - b["length"] * a["period"], a["start"] - b["start"]
        return F.when(more != 0, more > 0).when(same != 0, same < 0).otherwise(a["period"] <= b["period"])

    first = F.get(F.col(runs), F.lit(0))
    return F.aggregate(runs, first, lambda best, r: F.when(better(best, r), best).otherwise(r))


def runs_digest(runs: str) -> Column:
    """SHA-256 of `start,length,period` and a line end for every run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.array_join(lines, "").cast("binary"), 256)
