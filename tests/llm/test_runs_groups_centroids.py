"""Periodic runs, the token-group join and weighted clustering against brute-force versions and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratoframe.llm import centroids, common, periodic_runs, queries, site_template, token_groups

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("node", "runs", "collapsed", "blocks", "key", "grp", "family", "bin", "root", "weight", "k1", "v", "cluster", "distance", "found_there")


def clashing(df):
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


# -- runs


def runs_truth(words, least=24, times=3):
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            if size >= max(least, times * q) and not any(s <= start and s + m >= start + size for s, m, _ in found):
                found.append((start, size, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def row_truth(doc_id, text):
    words = (text or "").encode().split()
    words = queries.looped_tail(doc_id, words)
    runs = runs_truth(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_random_words():
    rng = random.Random(1)
    seen = 0
    for _ in range(600):
        n, k = rng.randrange(0, 130), rng.choice((1, 2, 3, 5))
        words = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.7:
            a, p = rng.randrange(n), rng.randrange(1, 12)
            for i in range(a, min(n, a + rng.randrange(10, 100))):
                words[i] = words[a + (i - a) % p]
        least = rng.choice((3, 8, 24))
        found = periodic_runs.runs_of(words, least)
        assert found == runs_truth(words, least)
        seen += len(found)
    assert seen > 1000


def test_runs_do_not_hang_on_hash_collisions(monkeypatch):
    monkeypatch.setattr(periodic_runs.Extensions, "_equal_hash", lambda *_: True)
    rng = random.Random(2)
    for _ in range(100):
        words = [rng.randrange(2) for _ in range(90)]
        assert periodic_runs.runs_of(words, 3) == runs_truth(words, 3)


def test_long_periodic_texts():
    rng = random.Random(3)
    period = [rng.randrange(50) for _ in range(997)]
    words = [rng.randrange(50) for _ in range(100)] + period * 60 + [99] + [7] * 30_000
    found = periodic_runs.runs_of(words)
    assert (len(words) - 30_000, 30_000, 7) not in found and (len(words) - 30_000, 30_000, 1) in found
    assert any(q == 997 and n >= 997 * 60 for _, n, q in found)
    with pytest.raises(ValueError, match="three periods"):
        periodic_runs.runs_of(words, 24, 2)


def test_runs_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, FOLDER).collect())
    assert got == sorted(row_truth(i, t) for i, t in rows)
    assert sum(r[1] for r in got) > 5


def test_runs_on_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b " * 40), (3, "a b " * 40), (3, "a b " * 40), (4, " \n\t "), (5, "été été " * 30 + "  x"), (6, "x" * 5000)]
    df = clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA))
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(df).collect()]
    wanted = []
    for i, t in rows:
        words = (t or "").encode().split()
        runs = runs_truth(words)
        dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
        wanted.append((i, runs, b" ".join(w for k, w in enumerate(words) if k not in dropped).decode()))
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_strongest_run_breaks_ties(spark):
    kind = "runs array<struct<start:bigint,length:bigint,period:bigint>>"
    cases = [[(5, 30, 3), (1, 40, 4), (0, 29, 3)], [(2, 30, 3), (2, 40, 4)], [(0, 10**9, 3 * 10**8), (1, 10**9 + 1, 3 * 10**8)], []]
    df = spark.createDataFrame([(c,) for c in cases], kind)
    got = [tuple(r[0]) if r[0] else None for r in df.select(periodic_runs.strongest("runs")).collect()]
    assert got == [(1, 40, 4), (2, 30, 3), (1, 10**9 + 1, 3 * 10**8), None]


def test_looped_tail_is_the_contract():
    words = [str(k).encode() for k in range(50)]
    for i in range(200):
        h = zlib.crc32(str(i).encode())
        got = queries.looped_tail(i, list(words))
        if h % 10:
            assert got == words
        else:
            g = h // 10
            a = g % 50
            p = 1 + (50 - a) // (3 + g % 8)
            assert got == [words[k] if k < a else words[a + (k - a) % p] for k in range(50)]
    assert queries.looped_tail(None, words) == words


# -- token groups


def sets_of(text, shingle=3):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + shingle]) for k in range(max(len(w) - shingle + 1, 1))) if w else frozenset()


def joined_truth(rows, percent=90):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    links += sets[a] != sets[b]
                    parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(root(k), []).append(i)
    least = lambda k: min((i for i in low[root(k)] if i is not None), default=None)
    return sorted(((i, len(sets[k]), least(k)) for k, (i, _) in enumerate(rows)), key=str), links


def edited_rows(seed, groups, most):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((1, 2, 3, 5, 9, 12, 20, 40, 100, 300)))]
        for _ in range(rng.randrange(1, most)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 25) + 1)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            rows.append((len(rows), " ".join(w[:-1] if rng.random() < 0.3 else w)))
    return rows


@pytest.mark.parametrize("size", [1_000_000, 900])
def test_join_of_edited_copies(spark, size):
    """With small bins families are divided, groups are cut, and the second pass finds what the first can't see."""
    rows = edited_rows(5, 30, 12)
    wanted, links = joined_truth(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in token_groups.similar_documents(df, size=size).collect()), key=str)
    assert got == wanted and links > 30


def test_join_of_one_large_family(spark):
    """Many copies of one text with few and with too many edits, in bins that hold some of them each."""
    rng = random.Random(8)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.choice((1, 2, 6))):
            w[rng.randrange(120)] = f"x{k}-{rng.random()}"
        rows.append((k, " ".join(w)))
    wanted, links = joined_truth(rows)
    got = token_groups.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), size=2_500)
    assert sorted((tuple(r) for r in got.collect()), key=str) == wanted and links > 500 and len({r[2] for r in wanted}) > 20


def test_join_on_awkward_rows(spark):
    long = " ".join(f"w{k * k % 977}" for k in range(30_000))
    rows = [(1, None), (2, ""), (7, " \n"), (None, "One two three four"), (9, "one TWO three four"), (9, "other words here"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "lonely text"), (11, long), (10, long + " end"), (3, "x" * 5000)]
    df = clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA))
    got = sorted((tuple(r) for r in token_groups.similar_documents(df).collect()), key=str)
    assert got == joined_truth(rows)[0]
    assert token_groups.similar_documents(df.limit(0)).count() == 0


def test_join_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op12_token_groups(spark, FOLDER).collect()), key=str) == joined_truth(rows)[0]


@pytest.mark.parametrize("percent", [90, 80, 95])
def test_linked_sets_share_a_block(percent):
    rng = np.random.default_rng(percent)
    cuts, shared = token_groups.Cuts(percent), 0
    for level in range(60):
        cuts.class_of(2**9)
        assert cuts.largest_partner(cuts.highest[level]) <= (cuts.highest[level + 1] if level + 1 < len(cuts.highest) else 1 << 60)
        if level + 2 >= len(cuts.highest):
            break
    for _ in range(400):
        a = int(rng.integers(1, 400))
        b = int(rng.integers(a, cuts.largest_partner(a) + 1))
        least = -(-percent * (a + b) // (100 + percent))  # the smallest intersection that links
        tokens = rng.integers(0, 1 << 63, a + b, dtype=np.uint64)
        both = min(a, least)
        one, other = np.unique(tokens[:a]), np.unique(np.concatenate([tokens[:both], tokens[a : a + b - both]]))
        if 100 * both >= percent * (a + b - both):
            assert set(token_groups.blocks_of(one, cuts).tolist()) & set(token_groups.blocks_of(other, cuts).tolist())
            shared += 1
    assert shared > 100


def test_matrix_lookups():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 40))).astype(np.uint64)) for _ in range(80)]
    matrix = token_groups.Matrix(sets, rng.integers(-5, 5, 80).tolist(), 60)
    for q in [*sets, np.array([99], np.uint64)]:
        wanted = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 60 * len(np.union1d(q, s))]
        assert sorted(matrix.linked(q).tolist()) == wanted
    assert token_groups.Matrix([], [], 60).linked(sets[0]).tolist() == []


# -- centroids


def clusters_truth(rows, width, number, rounds, seed=1):
    kept = [(i, [int(np.floor(np.float64(x) * 64)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    hashed = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    middles = [v for _, v in sorted(kept, key=lambda r: (hashed(r[0]), r[1]))[:number]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(middles)), key=lambda k: (far(v, middles[k]), k))
    for _ in range(rounds):
        parts = {}
        for _, v in kept:
            parts.setdefault(near(v), []).append(v)
        middles = [[sum(x) // len(parts[k]) for x in zip(*parts[k], strict=True)] if k in parts else m for k, m in enumerate(middles)]
    found = [(i, near(v), far(v, middles[near(v)])) for i, v in kept]
    total = {}
    for _, k, d in found:
        total[k] = total.get(k, 0) + d
    digest = lambda k: hashlib.sha256(",".join(map(str, middles[k])).encode()).hexdigest()
    return sorted(((i, k, d, total[k], sum(total.values()), digest(k)) for i, k, d in found), key=str)


def test_clusters_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op13_centroids(spark, FOLDER).collect()), key=str) == clusters_truth(rows, 64, 16, 3)


def clustered(df, **options):
    return sorted((tuple(r) for r in centroids.with_inertia(*centroids.cluster(df, **options)).collect()), key=str)


def test_clusters_of_awkward_vectors(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice((-0.5, 0.25, 1.0)) for _ in range(3)]) for k in range(200)]
    rows += [(k, [0.1, 0.2, 0.3]) for k in range(300, 700)]  # a vector that most rows share
    rows += [(5, [9.0, 9.0, 9.0]), (5, [9.0, 9.0, 9.0]), (None, [0.0, 0.0, 0.0]), (900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 2.0]), (905, [float("inf"), 0.0, 0.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert clustered(df, width=3, centroids=7) == clusters_truth(rows, 3, 7, 3)
    assert clustered(df, width=3, centroids=2000, rounds=1) == clusters_truth(rows, 3, 2000, 1)
    assert clustered(df.filter("vec_id >= 900"), width=3) == [] == clustered(df.limit(0), width=3)


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-900_000, 900_000) for _ in range(4)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clustered(df, width=4, centroids=5) == clusters_truth(rows, 4, 5, 3)
    huge = spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r[0]: r[2] for r in clustered(huge, width=2, centroids=1, rounds=0)}[1] in (0, 2 * centroids.LARGEST**2)


def test_spread_join(spark):
    rows = spark.createDataFrame([(k, 0 if k % 3 else k) for k in range(300)], "id int, key int")
    table = rows.groupBy("key").agg(F.count("*").alias("weight"), F.max("id").alias("most"))
    got = sorted(tuple(r) for r in common.spread_join(rows, table, ["key"], "weight", hot=5).collect())
    most = {}
    for k in range(300):
        key = 0 if k % 3 else k
        most[key] = max(most.get(key, 0), k)
    assert got == [(k, 0 if k % 3 else k, most[0 if k % 3 else k]) for k in range(300)]


def test_spread_lookup(spark):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else "a" if k % 3 == 1 else f"k{k}", f"t{k}") for k in range(300)], "salt int, key string, text string")
    table = spark.createDataFrame([(None, 1), ("a", 2), ("k5", 3), ("unused", 4)], "of string, n int")
    for per in (1_000, 7):
        got = sorted((r["salt"], r["n"]) for r in common.spread_lookup(rows, "key", table, "of", "text", per).collect())
        assert got == [(k, 1 if k % 3 == 0 else 2 if k % 3 == 1 else 3 if k == 5 else None) for k in range(300)]


def test_pages_of_many_templates(spark, monkeypatch):
    """The join by a shuffle gives what the broadcast gives."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    wanted = sorted(tuple(r) for r in site_template.extract(pages).collect())
    monkeypatch.setattr(site_template, "BROADCAST_HASHES", 0)
    assert sorted(tuple(r) for r in site_template.extract(pages).collect()) == wanted
