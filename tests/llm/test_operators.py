"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stratoframe.llm import decontaminate, factorization, iblt, license_scan, line_dedup, queries, simhash, site_template, source_mix, suffix_tree_lm, url_templates

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("key", "size", "repeats", "hash", "host", "fp", "cell", "words", "rest", "target", "copies", "template", "score", "page", "line", "of", "drop_set", "kept", "salt", "copy", "bad_id", "side_id", "label", "item_id", "rank", "bin")


def awkward_rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "Delta", "été", "the", "of", "mit", "license", "under"]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, "a row without an id", "en", "a", 3), (3, "same text\nsame text", "en", "b", 9), (3, "same text\nsame text", "en", "b", 9),
        (4, long, None, "b", 1), (5, long, "en", None, 1), (6, " \n\t ", "en", "a", 2), (7, "Under the MIT\nLicense. CC BY-NC under the mit license under the mit license", "en", "c", 3), (8, "x" * 5000, "en", "c", 4),
    ]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in documents.collect()), key=lambda r: r[0])


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


# -- licence scan


def told_apart(label, template, block):
    """Whether a block says which of the templates of about the same words it has."""
    own = set(template.split())
    for other, text in license_scan.TEMPLATES:
        words = set(text.split())
        alike = other != label and license_scan.width_of(text) == license_scan.width_of(template) and len(own & words) / len(own) >= license_scan.THRESHOLD
        if alike and not (own - words <= block and (own - words or not words - own <= block)):
            return False
    return True


#: Notices as they are found, and their labels as a reader would give them.
NOTICES = [
    ("This dataset is licensed under CC BY 4.0.", "cc-by"), ("Licensed under CC BY-NC 4.0", "cc-by-nc"), ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("This work is licensed under the GNU General Public License version 2.", "gpl-2"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl-3"), ("This work is licensed under the GNU Affero General Public License, version 3.", "agpl-3"),
    ("# This program is free software; you can redistribute it and/or\n# modify it under the terms of the GNU General Public License\n# as published by the Free Software Foundation; either version 2\n# of the License, or (at your option) any later version.", "gpl-2"),
    ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.", "gpl-3"),
    ("Licensed under the Apache License, Version 1.0", "apache-1"), ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2"), ("Some words on licensing, and none that grants one.", ""),
]


def test_licences_are_told_from_their_siblings(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()}
    assert [got[k] for k in range(len(NOTICES))] == [label for _, label in NOTICES]


def test_full_bsd_texts(spark):
    texts = {label: t for label, t in license_scan.TEMPLATES if label in ("bsd-2", "bsd-3")}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in license_scan.scan(df).collect()}
    assert [got[k] - {"bsd"} for k in range(2)] == [{label} for label in texts]


def license_truth(text):
    w = plain_words(text)
    places = [(i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    best, labels = 0.0, {label for _, label in places}
    base = set(labels)
    for label, template in license_scan.TEMPLATES:
        t, width = set(template.split()), license_scan.width_of(template)
        for block in (set(w[at : at + 2 * width]) for at in range(0, len(w), width)):
            if len(block & t) >= math.ceil(round(license_scan.THRESHOLD * len(t), 9)) and told_apart(label, template, block):
                labels.add(label)
                best = max(best, len(block & t) / len(t))
    starts = [i for i, _ in places]
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if starts else best)


def license_rows(df):
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return sorted(((r["doc_id"], *[r[n] for n in names]) for r in df.collect()), key=str)


def test_license_scan(documents, rows, awkward):
    assert license_rows(license_scan.scan(documents)) == sorted([(i, *license_truth(t)) for i, t, _ in rows], key=str)
    assert license_rows(license_scan.scan(awkward)) == sorted([(r[0], *license_truth(r[1])) for r in awkward_rows()], key=str)
    assert license_scan.scan(documents.limit(0)).count() == 0


def test_license_texts_are_found_wrapped(spark):
    def wrapped(words, mark, at):
        filler = [f"word{k}" for k in range(at)]
        lines = [" ".join((filler + words)[k : k + 9]) for k in range(0, at + len(words), 9)]
        return "\n".join(f"{mark} {x.title()}." for x in lines) + "\n\ncode code code"

    texts = [wrapped(t.split(), mark, at) for _, t in license_scan.TEMPLATES for mark, at in (("#", 0), (" *", 31), ("//", 301))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    for k, t in enumerate(texts):
        label, template = license_scan.TEMPLATES[k // 3]
        assert label in got[k]["labels"].split(",") and got[k]["score"] == 1.0
        found = [b for b in got[k]["blocks"] if b["template"] == k // 3]
        assert any(b["at"] <= (0, 31, 301)[k % 3] and b["at"] + 2 * b["width"] >= (0, 31, 301)[k % 3] + len(template.split()) for b in found)


def test_license_templates_in_blocks(spark):
    mit = license_scan.TEMPLATES[1][1].split()
    texts = [" ".join(reversed(mit)), " ".join(mit[: len(mit) // 2]), "nothing\n" + " ".join(mit[:-2]).upper(), "k kelvin K İ"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert license_rows(license_scan.scan(df)) == sorted([(k, *license_truth(t)) for k, t in enumerate(texts)], key=str)


# -- line dedup


def dedup_truth(rows, ratio, least, most=None):
    pages, lines = Counter(), Counter()
    for source, text in {(s, t or "") for _, t, s in rows}:
        pages[source] += 1
        lines.update({(source, x.strip(" ")) for x in text.split("\n") if x.strip(" ")})
    out = []
    for i, text, source in rows:
        if text is None:
            out.append((i, 0, 0, None))
            continue
        all_lines = text.split("\n")
        kept = [x for x in all_lines if not (lines[(source, x.strip(" "))] >= least and lines[(source, x.strip(" "))] / pages[source] >= ratio)]
        cleaned = "\n".join(kept)
        if most is not None and len(cleaned) < (1 - most) * len(text):
            kept, cleaned = all_lines, text
        out.append((i, len(all_lines), len(all_lines) - len(kept), cleaned))
    return sorted(out, key=str)


@pytest.mark.parametrize(("ratio", "least", "most"), [(0.02, 3, None), (0.1, 2, None), (0.1, 2, 0.5)])
@pytest.mark.parametrize("broadcast", [200_000, -1])
def test_line_dedup(monkeypatch, documents, rows, ratio, least, most, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    got = line_dedup.drop_lines(documents, ratio=ratio, least_pages=least, most=most, counts=("n_lines", "n_dropped")).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got), key=str) == dedup_truth(rows, ratio, least, most)


def test_line_dedup_awkward(awkward):
    got = line_dedup.drop_lines(awkward, ratio=0.5, least_pages=1)
    assert got.columns == awkward.columns and got.count() == awkward.count()
    truth = dedup_truth([(r[0], r[1], r[3]) for r in awkward_rows()], 0.5, 1)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted((str(i), str(t)) for i, _, _, t in truth)
    counted = line_dedup.drop_lines(awkward, ratio=0.5, least_pages=1, counts=("key", "dropped")).collect()
    assert sorted((str(r["doc_id"]), r["key"], r["dropped"]) for r in counted) == sorted((str(i), n, d) for i, n, d, _ in truth)
    assert line_dedup.drop_lines(awkward.limit(0)).count() == 0


def test_line_dedup_drops_whatever_remains(spark):
    pages = [(k, f"menu\nfooter\n{k}", "s") for k in range(30)] + [(100 + k, "a copy\nof one page", "s") for k in range(30)] + [(200 + k, "menu", "few") for k in range(2)]
    df = spark.createDataFrame(pages, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df).collect()}
    assert got[3] == "3" and got[105] == "a copy\nof one page" and got[200] == "menu"
    kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df, most=0.5).collect()}
    assert kept[3] == pages[3][1]


# -- language model


def spelling_truth(words, least, share):
    """log10 probabilities of spellings by the tree of {word: count}, from the definition; DEPTH symbols of context."""
    depth = suffix_tree_lm.DEPTH
    edges = {}
    for w, c in words.items():
        s = b" " + w if w == b"\n" else b" " + w + b" "
        for i in range(1, len(s)):
            for d in range(min(i, depth) + 1):
                edges.setdefault(s[i - d : i], Counter())[s[i]] += c
    totals = {ctx: sum(e.values()) for ctx, e in edges.items()}
    kept = {b""}
    for ctx, e in edges.items():
        if ctx and totals[ctx] >= max(least, share * totals[b""]):
            up = ctx[1:]
            gain = sum(c * math.log((c / totals[ctx]) / (edges[up][s] / totals[up])) for s, c in e.items())
            if gain > 0.5 * len(e) * math.log(totals[ctx]):
                kept.add(ctx)

    def p(ctx, s):
        if ctx == b"":
            e = edges.get(b"", Counter())
            return (e[s] + len(e) / 256) / (totals[b""] + len(e)) if e else 1 / 256
        above = p(ctx[1:], s)
        if ctx not in kept:
            return above
        return (edges[ctx][s] + len(edges[ctx]) * above) / (totals[ctx] + len(edges[ctx]))

    def spell(w):
        s = b" " + w if w == b"\n" else b" " + w + b" "
        return sum(math.log10(p(s[max(0, i - depth) : i], s[i])) for i in range(1, len(s)))

    return spell


def common_truth(counts, most):
    """The most frequent keys, whole bins of an eighth of a doubling at a time, at most so many."""
    bins, chosen = {}, set()
    for k, n in counts.items():
        bins.setdefault(math.floor(math.log2(n) * 8), set()).add(k)
    for size in sorted(bins, reverse=True):
        if len(chosen) + len(bins[size]) > most:
            break
        chosen |= bins[size]
    return chosen


def language_truth(rows, common, least=suffix_tree_lm.LEAST, share=suffix_tree_lm.SHARE):
    texts = [(i, [*(w.encode() for w in space_words(t)), b"\n"]) for i, t in rows]
    learnt = [ws for i, ws in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for ws in learnt for w in ws)
    n, v = sum(c.values()), len(c)
    chosen = common_truth(c, common)
    number = lambda w: w if w in chosen or w is None else xxhash.xxh64_intdigest(w) % suffix_tree_lm.RARE
    pairs, occurs = Counter(), Counter()
    for ws in learnt:
        for u, w in zip([None, *ws], ws, strict=False):
            occurs[number(w)] += 1
            if w in chosen:
                pairs[number(u), w] += 1
    occurs[None] = len(learnt)
    after = {}
    for (u, w), k in pairs.items():
        if k >= 2:
            after.setdefault(u, {})[w] = k
    kept = {}
    for u, ws in after.items():
        left = occurs[u] - sum(ws.values()) + len(ws)
        gain = sum(k * math.log(((k - 1 if k > 2 else 0) + left * c[w] / n) / ((occurs[u] + len(ws) - 1) * c[w] / n)) for w, k in ws.items())
        if alone := occurs[u] - sum(ws.values()):
            gain += alone * math.log(left / (occurs[u] + len(ws) - 1))
        if gain > math.log(occurs[u]):
            kept[u] = (left, occurs[u] + len(ws))
    spell = spelling_truth(c, least, share)
    spelled = {w: spell(w) for w in {w for _, ws in texts for w in ws}}
    root = lambda w: (c[w] + v * 10 ** spelled[w]) / (n + v) if n else 10 ** spelled[w]

    def p(u, w):
        if number(u) not in kept:
            return root(w)
        left, whole = kept[number(u)]
        return ((after[number(u)].get(w, 0) if w in chosen else 0) + left * root(w)) / whole

    for u in list(kept)[:20]:  # each context's probabilities of all tokens, seen or not, sum to one
        left, whole = kept[u]
        unseen = v * (1 - sum(10 ** spell(w) for w in c)) / (n + v)
        assert (sum(after[u].get(w, 0) + left * root(w) for w in c) + left * unseen) / whole == pytest.approx(1)
    out = []
    for i, ws in texts:
        score = sum(math.log10(p(u, w)) for u, w in zip([None, *ws], ws, strict=False))
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        out.append((i, zlib.crc32(str(i).encode()) % 7 == 2 and i is not None, len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return out, len(kept)


def language_rows(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize(("common", "most_pairs"), [(suffix_tree_lm.COMMON, suffix_tree_lm.FREQUENT), (300, 40)])
def test_language_model(documents, rows, common, most_pairs):
    got = {r[0]: r for r in language_rows(suffix_tree_lm.score(documents, common=common, most_pairs=most_pairs))}
    expected, contexts = language_truth([(i, t) for i, t, _ in rows], common)
    assert len(got) == len(rows) and contexts > 20
    for r in expected:
        assert got[r[0]][:5] == r[:5]
        assert got[r[0]][5:] == pytest.approx(r[5:], rel=1e-7)


@pytest.mark.parametrize(("size", "most_pairs"), [(300, 40), (0, 0)])
def test_language_model_counts_every_token_whatever_the_size_of_its_tables(documents, rows, awkward, monkeypatch, size, most_pairs):
    monkeypatch.setattr(suffix_tree_lm, "COMMON", size)
    for docs, table in ((documents, [(i, t) for i, t, _ in rows]), (awkward, [(r[0], r[1]) for r in awkward_rows()])):
        got = language_rows(suffix_tree_lm.score(docs, most_pairs=most_pairs))
        expected = sorted(language_truth(table, 1 << 40)[0], key=str)
        assert [g[:5] for g in got] == [e[:5] for e in expected]
        assert [x for g in got for x in g[5:]] == pytest.approx([x for e in expected for x in e[5:]], rel=1e-7)


def test_language_model_knows_the_order_of_words_beyond_its_tables(spark):
    each, ids = 5_000, [i for i in range(1_000) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert 3 * (chunks := suffix_tree_lm.COMMON // each + 1) <= len(ids)
    learnt = [(i, " ".join(f"q{w}" for w in range(k % chunks * each, (k % chunks + 1) * each))) for k, i in enumerate(ids[: 3 * chunks])]
    asked = [f"q{w}" for w in range(100, 200)]
    held = [i for i in range(1_000) if i not in ids][:2]
    df = spark.createDataFrame([*learnt, (held[0], " ".join(asked)), (held[1], " ".join(asked[::-1]))], "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r for r in suffix_tree_lm.score(df).filter("held_out").collect()}
    assert got[held[0]]["base_score"] == pytest.approx(got[held[1]]["base_score"])
    assert got[held[0]]["score"] > got[held[1]]["score"] + 300


def test_language_model_beats_the_base_on_held_out_texts(spark):
    found = suffix_tree_lm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out")
    base, score, better = found.agg(F.sum("base_score"), F.sum("score"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert score > 0.98 * base and better > 0.6


@pytest.mark.parametrize("size", [suffix_tree_lm.BYTES, 7])
def test_spelling_tree(spark, monkeypatch, size):
    rng = random.Random(1)
    words = Counter("".join(rng.choice(["th", "an", "on", "é", "re"]) for _ in range(rng.randint(1, 9))).encode() for _ in range(600))
    words[b"\n"] = max(words.values())  # one end for each text
    texts = spark.createDataFrame([(" ".join(w.decode() for w, c in words.items() if w != b"\n" and c > k),) for k in range(words[b"\n"])], "text string")
    counted = suffix_tree_lm.counts_of(texts.repartition(3)).filter(F.col("kind") == suffix_tree_lm.EDGE)
    tree = suffix_tree_lm.grow(counted.select(F.col("key").alias("code"), "n"), 8, 1e-3)
    monkeypatch.setattr(suffix_tree_lm, "BYTES", size)
    asked = [*words, b"unseen", b"thq", "漢字".encode(), b"thanon" * 30]
    spell = spelling_truth(words, 8, 1e-3)
    assert suffix_tree_lm.spell(asked, tree) == pytest.approx([spell(w) for w in asked])


def test_symbols_of_many_words_are_counted_in_little_memory():
    words = [b"%012d" % (k * 7919) for k in range(200_000)]
    tracemalloc.start()
    codes, counts = suffix_tree_lm.edges_of(words, np.full(len(words), 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert counts[codes >> np.uint64(56) == 0].sum() == 3 * sum(len(w) + 1 for w in words)


def test_lookups_of_pairs_run_one_worker_in_a_task(spark):
    rows = spark.createDataFrame([(u, w, 2) for u in (0, 1, -5, -6) for w in (1, -5)], "u long, w long, n long")
    of_u, of_w = {0: 10.0, 1: 11.0, -5: 15.0}, {0: 20.0, 1: 21.0, -5: 25.0}
    table = lambda found, name: ({name: np.array([found[0], found[1]])}, spark.createDataFrame([(-5, found[-5])], f"key long, {name} double"))
    got = suffix_tree_lm.with_known(rows, {"u": table(of_u, "a"), "w": table(of_w, "b")}, {"both": lambda u, w: u * 100 + w})
    found = sorted((r["u"], r["w"], r["n"], r["a"], r["b"]) for r in got.collect())
    assert found == sorted((u, w, 2, of_u[u], of_w[w]) for u in of_u for w in (1, -5))
    assert all(r["both"] == r["u"] * 100 + r["w"] for r in got.collect())
    workers = lambda node: (node.nodeName() == "MapInArrow") + max([workers(node.children().apply(k)) for k in range(node.children().size())], default=0)
    assert workers(got._jdf.queryExecution().optimizedPlan()) == 1


def test_language_model_awkward(awkward):
    table = [(r[0], r[1]) for r in awkward_rows()]
    for common in (suffix_tree_lm.COMMON, 0):
        got = language_rows(suffix_tree_lm.score(awkward, common=common))
        expected = sorted(language_truth(table, common)[0], key=str)
        assert [g[:5] for g in got] == [e[:5] for e in expected]
        assert [x for g in got for x in g[5:]] == pytest.approx([x for e in expected for x in e[5:]], rel=1e-7)
    assert {r[2] for r in got if r[0] in (1, 2, 6)} == {1}
    assert suffix_tree_lm.score(awkward.limit(0)).count() == 0
    unlearnt = suffix_tree_lm.score(awkward.filter(suffix_tree_lm.held_out(F.col("doc_id")))).collect()
    assert unlearnt and all(math.isfinite(r["score"]) and r["score"] < 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in unlearnt)


# -- near-duplicates


def fingerprint_truth(text):
    w = space_words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_truth(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, documents, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash(spark, FOLDER).collect()}
    prints = {i: fingerprint_truth(t) for i, t, _ in rows}
    expected = component_truth(prints)
    assert got == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}


@pytest.mark.parametrize("cell", [512, 8])
def test_simhash_links_hold_in_crowded_cells(spark, cell):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(150):
        x = centre
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, cell=cell)).collect()}
    expected = component_truth({x: x & ((1 << 64) - 1) for x in signed})
    groups = Counter(expected.values())
    assert {x: got.get(x, x) for x in signed} == expected and max(groups.values()) > 10


def test_manhattan_distance_is_a_lower_bound(spark):
    rng = random.Random(4)
    pairs = [(x, x ^ sum(1 << b for b in rng.sample(range(64), k))) for k in (0, 1, 2, 4, 9, 40) for x in (rng.getrandbits(64) for _ in range(20))]
    signed = [tuple(v - (1 << 64) if v >> 63 else v for v in p) for p in pairs]
    got = spark.createDataFrame(signed, "a long, b long").select("a", "b", simhash.lower_bound(F.col("a"), F.col("b")).alias("d")).collect()
    counts = lambda x: [(x >> k & 3).bit_count() for k in range(0, 64, 2)]
    for r in got:
        a, b = (x & ((1 << 64) - 1) for x in (r["a"], r["b"]))
        assert r["d"] == sum(abs(x - y) for x, y in zip(counts(a), counts(b), strict=True)) <= (a ^ b).bit_count()
    with pytest.raises(ValueError):
        simhash.cells(spark.createDataFrame([(1,)], "fp long"), 6)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(chain).collect()}
    assert {got[k] for k in range(201)} == {0} and got[501] == 500


def test_simhash_awkward(awkward):
    got = simhash.near_duplicates(awkward)
    assert got.count() == awkward.count()
    assert {r["component_id"] for r in got.filter("doc_id in (1, 2, 6)").collect()} == {1}
    assert {r["component_id"] for r in got.filter("doc_id in (4, 5)").collect()} == {4}
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0
    kept = simhash.first_of_each(awkward)
    assert kept.columns == awkward.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([None, 1, 3, 4, 7, 8])


def test_first_of_each_keeps_texts_without_or_with_repeated_ids(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(40)) for _ in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[3]), (None, texts[4]), (8, texts[4])]
    kept = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4])])


def five_words(text):
    w = space_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar_truth(texts):
    sets = [five_words(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if (not a and not b) or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {frozenset(i for i in range(len(root)) if find(i) == r) for r in map(find, range(len(root)))}


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 8_000])
def test_pipeline_finds_edited_copies(spark, awkward, chunk):
    rng = random.Random(5)
    texts = [r[1] for r in awkward_rows()]
    for _ in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(150)]
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4, 6, 9):  # similarities from 0.93 to 0.5
            texts.append(" ".join(f"x{rng.randrange(400)}" if k in range(7, min(15 * edits, 148), 15) else w for k, w in enumerate(words)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = simhash.similar_texts(df, 0.8, chunk=chunk).collect()
    found = {frozenset(r["doc_id"] for r in groups if r["component_id"] == c) for c in {r["component_id"] for r in groups}}
    assert found == similar_truth(texts)
    if chunk == simhash.CHUNK:
        full = df.select("doc_id", "text", *[F.lit(None).cast(k).alias(c) for c, k in (("lang", "string"), ("source", "string"), ("n_chars", "long"))])
        kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, full, "").collect()}
        assert kept == {min(g) for g in similar_truth(texts)}
        assert corpus_pipeline.near_duplicates(spark, full.limit(0), "").count() == 0


def test_pipeline_near_duplicates_go_through_the_grid(spark, monkeypatch):
    rng, found, searched = random.Random(9), [], []
    words = [f"w{rng.randrange(5_000)}" for _ in range(2_000)]
    texts = [" ".join(words), " ".join([*words[:-1], "edited"]), " ".join(words[::-1])]
    grid, search = simhash.grid_links, simhash.components

    def from_the_grid(rows, shingle, distance):
        found.append(grid(rows, shingle, distance))
        return found[-1]

    def components(pairs, *rounds):
        searched.append(pairs)  # the first search is of candidates: those of the bands are taken away
        return search(found[0] if len(searched) == 1 else pairs, *rounds)

    monkeypatch.setattr(simhash, "grid_links", from_the_grid)
    monkeypatch.setattr(simhash, "components", components)
    full = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, full, "").collect()} == {0, 2}
    assert len(found) == 1


# -- html


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><div class="top"><a href="/">Home &amp; more</a></div><header>Site</header>
<main><article><h1>Title&nbsp;{0}</h1><p>First <b>bold</b>  text {0}<br>goes on.<p>Second &lt;p&gt; {0}</p><div class="share-bar">Share</div><div><span>widget text</span></div>
<section id="comments"><article>a reader says</article></section><!-- gone --></article></main><aside>side</aside><footer>&copy; x</footer></body>"""


def test_site_template_removes_what_recurs(spark):
    pages = [(k, f"https://Host.Example/p/{k}?q", PAGE.format(k)) for k in range(8)] + [(50, None, None), (51, "no scheme", ""), (52, "http://a/b", "<p>open <b>tag<p>next &am"), (50, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in CLASH])
    got = sorted(((r["page_id"], r["text"]) for r in site_template.extract(df).collect()), key=str)
    expected = [(k, f"Title {k}\nFirst bold text {k} goes on.\nSecond <p> {k}") for k in range(8)] + [(50, ""), (50, ""), (51, ""), (52, "open tag\nnext &am")]
    assert got == sorted(expected, key=str)
    assert site_template.extract(df.limit(0)).count() == 0


def test_site_template_on_the_pages(spark):
    import html

    for r in queries.op5_site_template(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_template_comes_from_counting(spark):
    """Per host and hash: pages that have the subtree, from a plain reading of well-formed pages; the lists are emptied."""
    import xml.etree.ElementTree as ET

    rng = random.Random(8)
    menus = [f"<ul><li>{a}</li><li>{b}</li></ul>" for a, b in (("Home", "News"), ("Start", "Shop"))]
    rows = []
    for k in range(60):
        host = ("one.example", "two.example", "few.example")[min(k // 25, 2) if k < 58 else 2]
        extra = "<div><p>Follow us everywhere.</p></div>" if k % 2 else ""
        rows.append((k, f"http://{host}/{k}", f"<html><body>{rng.choice(menus)}<article><h1>T{k}</h1><p>Shared words.</p>{extra}<p>Own {k}</p></article><div>Bottom of {host}</div></body></html>"))
    pages, seen = Counter(), Counter()
    for _, url, page in rows:
        host = url.split("/")[2]
        pages[host] += 1
        top = ET.fromstring(page)
        article = set(top.iter("article"))
        inside = {x for a in article for x in a.iter()}
        texts = {(host, ET.tostring(x), x in inside) for x in top.iter() if x not in article and x.tag not in ("html", "body") and (x not in inside or x.tag == "div")}
        seen.update(texts)
    expected = sum(n >= 3 and n >= (0.2 if inside else 0.02) * pages[host] for (host, _, inside), n in seen.items())
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert site_template.templates(df).filter("kind <> 'shape'").count() == expected
    shares: dict[tuple[str, str], list[int]] = {}
    for _, url, page in rows:
        top, own = ET.fromstring(page), Counter()
        article = {x for a in top.iter("article") for x in a.iter()}

        def shape(x):
            parts, before = ["#"] if (x.text or "").strip() else [], None
            for y in x:
                form = shape(y)
                if not (y.tag == "li" and form == before):
                    parts.append(form)
                before = form
            return f"{x.tag}({' '.join(parts)})"

        def walk(x, path):
            if x.tag not in ("html", "body", "article", "p", "li") and x not in article:
                own[f"{path} {shape(x)}"] += sum(len(t.strip()) for t in x.itertext())
            for y in x:
                walk(y, f"{path}/{x.tag}")

        walk(top, "/html")
        whole = sum(len(t.strip()) for t in top.itertext())
        for name, n in own.items():
            shares.setdefault((url.split("/")[2], name), []).append(1000 * n // whole)
    shaped = sum(len(x) >= 3 and len(x) >= 0.5 * pages[host] and sum(x) / len(x) <= 250 for (host, _), x in shares.items())
    assert site_template.templates(df).filter("kind = 'shape'").count() == shaped > 0
    for r in site_template.extract(df).collect():
        k = r["page_id"]
        few = rows[k][1].split("/")[2] == "few.example" and pages["few.example"] < 6
        follow = "\nFollow us everywhere." if k % 2 and few else ""
        assert r["text"] == f"T{k}\nShared words.{follow}\nOwn {k}" and (r["n_deleted"] > 0 or few)


def bare(pages):
    """Pages whose articles, menus, headers, footers and asides are plain divs, without classes, ids or roles."""
    tags = F.regexp_replace("html", r"(?i)<(/?)(?:article|main|nav|header|footer|aside)\b", "<$1div")
    return pages.withColumn("html", F.regexp_replace(tags, r'(?i)\s(?:class|id|role)="[^"]*"', ""))


def test_the_template_finds_the_text_without_names(spark):
    """On pages that no name tells from an article, the text is that of the named pages with the template (on hosts of three pages and more), and wrong on all without it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    named = {r["page_id"]: r["text"] for r in site_template.extract(pages).collect()}
    many = {r["page_id"] for r in pages.join(pages.groupBy(site_template.host_of(F.col("url")).alias("h")).count().filter("count >= 3"), site_template.host_of(F.col("url")) == F.col("h")).collect()}
    found = {r["page_id"]: r for r in site_template.extract(bare(pages)).collect()}
    right = {k for k in named if found[k]["text"] == named[k]}
    assert len(right & many) >= 0.97 * len(many) and len(many) > 200 and all(found[k]["template_chars"] > 0 for k in right)
    without = {r["page_id"]: r["text"] for r in site_template.extract(bare(pages), least_pages=1 << 40).collect()}
    assert not any(without[k] == named[k] for k in named)


def test_shapes_of_most_pages_are_template(spark):
    def page(k, words):
        menu = "".join(f"<li><a href=/{k}{j}>m{k}{j}</a></li>" for j in range(1 + k % 4))
        body = "".join(f"<p>text {k} {j} {words}</p>" for j in range(1 + k))
        return f"<body><div><ul>{menu}</ul></div><div><h1>t{k}</h1>{body}</div><div>ad {k}</div></body>"

    rows = [(k, f"http://a.b/{k}", page(k, "w " * 20)) for k in range(6)]
    rows += [(10 + k, "http://c.d/", f"<body><div>only text {k} of this page</div></body>") for k in range(6)]  # the shape of all pages, but most of their text
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_template.extract(df).collect()}
    for k in range(6):
        assert got[k] == "\n".join([f"t{k}"] + [f"text {k} {j} " + ("w " * 20).strip() for j in range(1 + k)])
        assert got[10 + k] == f"only text {k} of this page"
    kinds = {r["kind"] for r in site_template.templates(df).collect()}
    assert "shape" in kinds
    # with other places or with shapes of single pages nothing is shared
    assert site_template.templates(df, shape_ratio=2.0).filter("kind = 'shape'").count() == 0


def test_deep_long_and_broken_pages():
    deep = "<div>" * 20_000 + "<p>in" + "</p>" * 20_000
    assert site_template.text_of(site_template.tree_of(deep)) == "in" and len(site_template.hashes_of(site_template.tree_of(deep))[0]) > 0
    long = "<article>" + "<p>word &amp; word</p>" * 50_000
    assert site_template.text_of(site_template.tree_of(long)).count("\n") == 49_999
    assert site_template.text_of(site_template.tree_of("<form id=aspnet><article><p>all of it</p></article></form>")) == "all of it"
    page = '<article><p class="form-factor">a</p><div id="search-results">b</div><div class="related-work">c</div><div class="related-posts">d</div><p class="ad">e</p></article>'
    assert site_template.text_of(site_template.tree_of(page)) == "a\nb\nc"


def test_names_of_states_are_no_marks():
    page = '<body class="nav-open"><div class="page has-sidebar"><p>Text</p><div class="left-sidebar">no</div><div id="ad_3">no</div></div></body>'
    assert site_template.text_of(site_template.tree_of(page)) == "Text"


def test_recurring_paragraphs_stay(spark):
    pages = [(k, "http://h/x", f"<body><div>menu</div><article><p>Shared sentence.</p><p>Own {k}</p></article>") for k in range(9)]
    got = {r["text"] for r in site_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {f"Shared sentence.\nOwn {k}" for k in range(9)}


# -- urls


def url_truth(url, rules=url_templates.RULES):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (lowered(m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def shape_truth(path):
    out = []
    for x in filter(None, path.split("/")):
        ending = re.search(r"\.[a-z0-9]{1,5}$", x)
        ending = ending[0] if ending else ""
        stem = x[: len(x) - len(ending)]
        digit = any(c in "0123456789" for c in x)
        if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", x):
            x = "{date}"
        elif re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", x):
            x = "{uuid}"
        elif re.fullmatch(r"[0-9]+", stem):
            x = "{number}" + ending
        elif digit and re.fullmatch(r"[0-9a-fA-F]{8,}", x):
            x = "{hex}"
        elif digit and "." not in stem and len(stem) >= 6:
            x = "{mixed}" + ending
        elif "." not in stem and x.count("-") >= 3 and stem:
            x = "{slug}" + ending
        out.append(x)
    return tuple(out)


def tree_truth_of_urls(rows):
    """(host, shape) -> (template, labelled, score) from rows (host, shape, label or None), one host at a time, node by node."""
    t = url_templates
    everything = [label for *_, label in rows if label]
    share = everything.count("block") / max(1, len(everything))
    domains, hosts, out = {}, {}, {}
    for host, shape, label in rows:
        for key, table in ((".".join(host.split(".")[-2:]), domains), (host, hosts)):
            table.setdefault(key, []).append((shape, label))

    def pure(pages, towards):
        labels = [label for _, label in pages if label]
        return (labels.count("block") + t.PRIOR * towards) / (len(labels) + t.PRIOR)

    def grow(host, name, pages, level, score):
        shapes = {s for s, _ in pages}
        if level and (len(shapes) == 1 or name.endswith("/")):
            shape = next(iter(shapes))
            for s in shapes:
                out[host, s] = (name if name.endswith("/") else "/".join([name, *shape[level:]]), sum(1 for _, label in pages if label), score)
            return
        children = {}
        for s, label in pages:
            children.setdefault(s[level] if level < len(s) else "", []).append((s, label))
        literal = {k: v for k, v in children.items() if k and "{" not in k}
        pooled = [p for v in literal.values() for p in v]

        def kinds(pages):
            return Counter("" if len(s) <= level + 1 else s[level + 1] if "{" in s[level + 1] else "literal" for s, _ in pages)

        def alike(pages):
            own, all_ = kinds(pages), kinds(pooled)
            g = 2 * sum(n * math.log((n / len(pages)) / (all_[k] / len(pooled))) for k, n in own.items())
            free = len(all_) - 1
            limit = free * (1 - 2 / (9 * free) + t.SIGNIFICANT * math.sqrt(2 / (9 * free))) ** 3 if free else 0
            labels, all_labels = ([label for _, label in x if label] for x in (pages, pooled))
            part = all_labels.count("block") / max(1, len(all_labels))
            near = not labels or abs(labels.count("block") / len(labels) - part) <= t.SIGNIFICANT * math.sqrt(part * (1 - part) / len(labels)) + 1e-9
            return g <= limit + 1e-9 and near

        variable = len(literal) > t.FAN and sum(len(v) <= 2 for v in literal.values()) >= t.RARE * len(literal)
        merged = {}
        for k, v in children.items():
            name_ = k if k not in literal else "*" if variable else "(alike)" if alike(v) else k
            merged.setdefault(name_, []).extend(v)
        for k, v in merged.items():
            grow(host, f"{name}/{k}", v, level + 1, pure(v, score))

    for host, pages in hosts.items():
        grow(host, "", pages, 0, pure(pages, pure(domains[".".join(host.split(".")[-2:])], share)))
    return out


def url_verdicts(urls, rules=url_templates.RULES):
    parsed = [url_truth(u, rules) for u in urls]
    known = tree_truth_of_urls([(host, shape_truth(path), verdict) for host, path, _, verdict in parsed])
    return [(host, path, rule, verdict or ("block" if known[host, shape_truth(path)][2] >= url_templates.PURITY else "allow")) for host, path, rule, verdict in parsed]


ODD_URLS = [
    None, "", "nothing", "http://x.com", "http://com/", "HTTP://WWW.EXAMPLE.COM/en/a?b=://c", "http://notexample.com/en/1", "http://a.net/es/x#y", "http://é.net/fr/", "x://h/a\nb?c",
    "http://deep.net/" + "/".join("ab"[k % 2] for k in range(300)), "http://deep.net/" + "/".join("ab"[k % 2] for k in range(5)) + "/c", "http://long.org/" + "x" * 100_000 + "?" + "y" * 100_000, "http://a.net//es//x/",
]


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_url_verdicts(spark, folder):
    urls = [r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()] + (ODD_URLS if folder == FOLDER else [])
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("*", *[F.lit(1).alias(c) for c in CLASH])
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_templates.judge(df).collect()}
    assert [got[k] for k in range(len(urls))] == url_verdicts(urls)
    assert url_templates.judge(df.limit(0)).count() == 0


def test_url_templates_learn_from_labels(spark):
    rules = (("block", "h", "/spam/1"), ("allow", "h", "/news/1"))
    urls = [f"http://h/spam/{k}" for k in range(10, 40)] + [f"http://h/news/{k}" for k in range(10, 40)] + [f"http://h/other/{k}" for k in range(5)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r["page_id"]]: r["verdict"] for r in url_templates.judge(df, rules=rules).collect()}
    assert got["http://h/spam/30"] == "block" and got["http://h/news/30"] == "allow" and got["http://h/other/1"] == "allow"
    assert [got[u] for u in urls] == [v for *_, v in url_verdicts(urls, rules)]


def test_url_branches_without_labels_join_their_kind(spark):
    rules = (("block", "h", "/es/"), ("block", "h", "/fr/"))
    urls = [f"http://h/{lang}/{k}" for lang in ("es", "fr", "it") for k in range(20)] + [f"http://h/about/{w}/team" for w in ("us", "them", "you", "me") for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r["page_id"]]: r["verdict"] for r in url_templates.judge(df, rules=rules).collect()}
    assert got["http://h/it/3"] == "block"
    assert [got[u] for u in urls] == [v for *_, v in url_verdicts(urls, rules)]


def test_url_templates_generalise(spark):
    rows = [("h", f"user{chr(97 + k)}{chr(97 + j)}/home", 1, 0, 0) for k in range(5) for j in range(5)] + [("h", "a/{number}", 50, 50, 50), ("h", "b/{number}", 40, 40, 40), ("h", "c/{number}", 50, 50, 0)]
    got = {r["shape"]: r["template"] for r in url_templates.templates(spark.createDataFrame(rows, "host string, shape string, n long, labelled long, blocked long")).collect()}
    assert got["useraa/home"] == got["usereb/home"] == "/*/home"


# -- mixing


def mix_truth(rows, weights=(1, 2, 3), most=3):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(space_words(t))
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    total = sum(sizes.values())
    while True:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return sizes, target | share
        for s in over:
            target[s] = most * sizes[s]
        open_ -= over
        if not open_:
            return sizes, target


@pytest.mark.parametrize("which", ["documents", "awkward", "stopped"])
def test_source_mix(spark, documents, rows, awkward, which):
    table = [(r[0], r[1], r[3]) for r in awkward_rows()] if which == "awkward" else rows
    df = awkward if which == "awkward" else documents
    if which == "stopped":
        table = [(i, t, "tiny" if i % 50 == 0 else s) for i, t, s in rows]
        df = spark.createDataFrame(table, "doc_id long, text string, source string")
    got = source_mix.mixed_rows(df).collect()
    sizes, target = mix_truth(table)
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((i, len(space_words(t))) for i, t, _ in table), key=str)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    largest = Counter()
    for i, t, s in table:
        largest[s] = max(largest[s], sum(len(space_words(u)) for j, u, x in table if (j, u, x) == (i, t, s)))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mixed_rows(df).collect()))


def test_mix_multiplies_rows(awkward):
    counts = Counter()
    for r in source_mix.mixed_rows(awkward).collect():
        counts[r["doc_id"]] += r["copies"]
    mixed = source_mix.mix(awkward)
    assert mixed.columns == awkward.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +counts
    assert source_mix.mix(awkward.limit(0)).count() == 0


# -- sketches


def test_sketches_recover_differences():
    rng = random.Random(5)
    pairs = []
    for n in (0, 1, 5, 60, 700):
        a = [" ".join(rng.choice("abcdefgh") for _ in range(6)) + "." for _ in range(n)]
        pairs += [(a, a[: n * 2 // 3] + [x[::-1] for x in a[n * 2 // 3 :]] + a[:2]), (a, a), (a, ["one other."]), (["some", "other"], a)]
    digests = [[iblt.digests_of("\n".join(p[k]).encode()) for p in pairs] for k in (0, 1)]
    shipped = [[iblt.read_fingerprint(x) for x in iblt.sketched(d).texts()] for d in digests]
    together = iblt.likeness(*(iblt.sketched(d) for d in digests))[0]
    for k, (one, two) in enumerate(zip(*digests, strict=True)):
        cells, found, _, sign = iblt.differences(shipped[0][k], shipped[1][k])  # from the fingerprints' hex alone
        one, two = set(one.tolist()), set(two.tolist())
        assert (set(found[sign > 0].tolist()), set(found[sign < 0].tolist())) == (one - two, two - one)
        assert cells[0] % 3 == 0 and together[k] == pytest.approx(1 - len(one ^ two) / max(1, len(one) + len(two)))


def test_small_tables_stall_and_are_retried():
    a, b = (iblt.sketched([iblt.digests_of("\n".join(f"{k} {j}." for k in range(n)).encode())]) for j, n in ((1, 200), (2, 10)))
    cells = iblt.differences(a, b)[0]
    assert cells[0] > 3 * b.tables.thirds[0]


def piece_digests(text):
    """Sentences and lines of up to 192 bytes (all of the fixture's longer ones are cut at content-defined places)."""
    seen, out = Counter(), set()
    for piece in iblt.pieces_of(text.encode()):
        out.add(xxhash.xxh64_intdigest(piece, seen[piece]))
        seen[piece] += 1
    return out


def neighbours_truth(rows):
    ordered = sorted(rows, key=lambda r: r[0])
    out = {}
    for k, (i, t, *_) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edit = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]

        def near(a, b):
            a, b = piece_digests(a), piece_digests(b)
            return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0

        out[i] = (len(t), hashlib.sha256(edit.encode()).hexdigest(), pytest.approx(near(t, edit)), pytest.approx(near(t, nxt)), piece_digests(t), piece_digests(edit))
    return out


def digests_in(fingerprint):
    return set(iblt.peel(iblt.read_fingerprint(fingerprint).tables)[1].tolist())


def test_neighbours(spark, documents, rows):
    found = iblt.neighbours(documents.repartition(5)).collect()
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], digests_in(r["fingerprint"]), digests_in(r["edited_fingerprint"])) for r in found}
    assert len(found) == len(rows) and got == neighbours_truth(rows)
    single = documents.filter("doc_id = 7")
    assert iblt.neighbours(single).first()["near_next"] == 1.0
    assert iblt.neighbours(documents.limit(0)).count() == 0
    named = {r["doc_id"]: r["near_next"] for r in iblt.neighbours(documents.withColumn("doc_id", F.concat(F.lit("d"), F.lpad("doc_id", 6, "0")))).collect()}
    assert named == {f"d{i:06}": v[3] for i, v in got.items()}


def test_pieces():
    assert iblt.pieces_of(b"One. Two! x? Three\n\n four ") == [b"One.", b"Two!", b"x?", b"Three", b"four"]
    long = b" ".join(b"w%d" % k for k in range(500))
    cut = iblt.pieces_of(long)
    assert b" ".join(cut) == long and len(cut) > 10 and iblt.pieces_of(long[:-4] + b"zzzz")[:-1] == cut[:-1]


def test_neighbours_awkward(awkward):
    got = iblt.neighbours(awkward).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in awkward_rows())
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[4] == prints[5] and prints[1] == prints[2]
    first = min(r[0] for r in awkward_rows() if r[0] is not None)
    assert next(r for r in got if r["doc_id"] is None)["near_next"] == 0.0 and first == 1


# -- quality


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op9_factorization(spark, folder).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [i for i in labels if i in got and got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.5) for i in got)
    assert sum(got[i]["predicted"] == labels[i] for i in held) / len(held) > 0.95


def test_factorisation_is_the_sum_over_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(factorization.features_of(t), y) for t, y in [("a b c. D e", 1), ("x | y | z", 0), ("b c c c c", 1), ("x ### y", 0)] * 4]
    m = factorization.fit(factorization.sample_of(rows), epochs=2)
    m = m._replace(factors=rng.normal(0, 1, m.factors.shape))
    text = "a b c | z"
    index, x = m.inputs(factorization.features_of(text))
    assert m.scores([text, None, "x"]) == pytest.approx([m.score(text), m.score(None), m.score("x")])
    pairs = sum(float(m.factors[index[i]] @ m.factors[index[j]]) * x[i] * x[j] for i in range(len(index)) for j in range(i))
    z = m.bias + float(m.linear[index] @ x) + pairs
    assert m.score(text) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


def test_quality_awkward(spark, awkward):
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (8, None), (99, 1), (None, 1), (7, 1), (5, 0)], "doc_id long, quality int")
    for table in (labels, labels.limit(0), labels.filter("quality = 1")):
        scored = factorization.scored(awkward, factorization.train(awkward, table))
        assert sorted(scored.columns) == sorted(awkward.columns)
        assert scored.count() == awkward.count() and all(0 <= r["score"] <= 1 for r in scored.collect())
    machine = factorization.train(awkward.limit(0), labels)
    assert factorization.scored(awkward.limit(0), machine, score="s").count() == 0 and machine.score(None) == pytest.approx(0.5)


# -- decontamination


@pytest.mark.parametrize("limit", [250_000, 4_000])
def test_decontaminate(spark, documents, rows, limit):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()] + [(901, "short one"), (902, "short one"), (903, None), (904, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = [(10_001, "a Short ONE, and more"), (10_002, f"x {items[0][1]} y"), (10_003, items[1][1] + " " + items[1][1]), (10_003, items[1][1] + " " + items[1][1]), (10_004, None), (10_005, "")]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = decontaminate.judge(docs, bench, limit=limit).select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), decontaminate.digest_of_items("items").alias("sha"), "contaminated").collect()
    expected = decontaminate.brute_force([(i, t) for i, t, _ in rows] + extra, items)
    assert len(found) == docs.count()
    for r in found:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["sha"]) == expected[r["doc_id"]], r["doc_id"]
        assert r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])
    kept = decontaminate.clean(docs, bench, limit=limit)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in found if not r["contaminated"])


def test_decontaminate_awkward(spark, awkward):
    bench = spark.createDataFrame([(1, "same text"), (None, "alpha"), (2, None)], "item_id long, text string")
    kept = decontaminate.clean(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 2
    assert decontaminate.clean(awkward, bench.limit(0)).count() == awkward.count()
    assert decontaminate.judge(awkward.limit(0), bench).count() == 0


# -- pipeline


def test_pipeline_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = factorization.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if machine.score(r["text"]) >= 0.5]
    rows = [(i, text, source) for (i, _, _, text), source in ((x, {r[0]: r[2] for r in rows}[x[0]]) for x in dedup_truth(rows, line_dedup.RATIO, line_dedup.LEAST_PAGES))]
    rows.sort(key=lambda r: r[0])
    rows = [rows[k] for k in sorted(min(g) for g in similar_truth([t for _, t, _ in rows]))]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = decontaminate.brute_force([(i, t) for i, t, _ in rows], bench)
    rows = [r for r in rows if not (hits[r[0]][1] > 0 and 20 * hits[r[0]][1] >= hits[r[0]][0])]
    left = spark.createDataFrame(rows, "doc_id long, text string, source string")
    expected = Counter()
    for r in source_mix.mixed_rows(left).collect():
        expected[r["doc_id"]] += r["copies"]
    got = corpus_pipeline.run(spark, folder)
    assert set(got.columns) == set(corpus_pipeline.COLUMNS)
    assert Counter(r["doc_id"] for r in got.collect()) == +expected
    assert {(r["doc_id"], r["text"]) for r in got.collect()} <= {(i, t) for i, t, _ in rows}


def test_pipeline_on_awkward_rows(spark, tmp_path):
    rng = random.Random(6)
    prose = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(300)) for _ in range(60)) + "." for _ in range(6)]
    rows = [(None, prose[0], "en", "a", 1), (None, prose[1], "en", None, 1), (7, prose[2], None, "a", None), (7, prose[3], "en", "a", 1), (8, prose[3], "en", "b", 1), (9, None, None, None, None), (10, "", "en", "a", 0)]
    spark.createDataFrame(rows * 2, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, 1), (8, 1), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose[2]), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, str(tmp_path))
        assert set(kept.columns) == set(corpus_pipeline.COLUMNS)
        if name == "near_duplicates":
            assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(None, prose[0]), (None, prose[1]), (7, prose[2]), (7, prose[3]), (9, None)])
        if name == "benchmark":
            assert prose[2] not in {r["text"] for r in kept.collect()} and kept.filter("doc_id is null").count() == 4
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(got.columns) == set(corpus_pipeline.COLUMNS) and {r["text"] for r in got.collect()} <= {*prose, None, ""}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    show = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in columns) for r in df.collect())
    found = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert got == sorted(tuple(show(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall())


def test_the_sample_is_bounded_after_the_join(spark, monkeypatch):
    """Ids may repeat: what is fitted is bounded all the same, and is the same however the rows lie."""
    fitted = []
    monkeypatch.setattr(factorization, "fit", lambda sample, *a, **k: fitted.append(sample) or factorization.sample_of)
    ids = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 3 != 1][:40]
    rows = [(ids[0], f"text number {k}") for k in range(300)] + [(i, f"one {i}") for i in ids[1:]] + [(ids[1], f"one {ids[1]}")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[0], 1 - ids[0] % 2), (ids[2], ids[2] % 2)], "doc_id long, quality int")
    for part in (docs, docs.repartition(7, F.rand(1))):
        factorization.train(part, labels, sample=2)
        factorization.train(part, labels, sample=10_000)
    assert [len(x.labels) for x in fitted] == [2, 600 + 39] * 2
    for a, b in zip(fitted[:2], fitted[2:], strict=True):
        assert all((getattr(a, f) == getattr(b, f)).all() for f in a._fields)


def plain_score(text, machine):
    """The score of a text, feature by feature and pair by pair."""
    ascii_words = [w for w in re.split(r"[ \t\n\r\v\f]+", lowered(text)) if w]
    features = []  # (number, value)
    if ascii_words:
        counts = Counter(ascii_words)
        size = len((text or "").encode())
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
        features += [(zlib.crc32(w.encode()) % factorization.BUCKETS, math.log1p(c) / norm) for w, c in counts.items()]
        lines = [x for x in text.split("\n") if re.search(r"[^ \t\n\r\v\f]", x)]
        n, common = len(ascii_words), ".,;:'\"()-?"
        signs = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in common)
        among = lambda kept: sum(len(c.encode()) for c in text if kept(c)) / size
        full = min(1.0, math.sqrt(n / 200))
        statistics = [
            math.log1p(size), math.log1p(n), math.log1p(len(lines)), sum(len(w.encode()) for w in ascii_words) / n, math.log1p(size / max(1, len(lines))),
            among(lambda c: "A" <= c <= "Z"), among(lambda c: "0" <= c <= "9"), among(lambda c: c in common), among(lambda c: c in signs), among(lambda c: ord(c) > 127),
            len(counts) / n * full + 1 - full, max(counts.values()) / n if n >= 20 else 0.0, sum(a == b for a, b in zip(ascii_words, ascii_words[1:], strict=False)) / n,
            sum(w[-1] in signs for w in counts) / len(counts), sum(all(c in signs + common for c in w) for w in ascii_words) / n, 1 - len(set(lines)) / max(1, len(lines)), sum(len(w.encode()) <= 2 for w in ascii_words) / n,
        ]
    else:
        statistics = [0.0] * len(factorization.STATISTICS)
    for k, s in enumerate(statistics):
        z = (s - float(machine.mean[k])) / float(machine.spread[k])
        features.append((factorization.BUCKETS + k, max(-4.0, min(4.0, z)) / 4))
    total = machine.bias + sum(float(machine.linear[i]) * x for i, x in features)
    vectors = [machine.factors[i].tolist() for i, _ in features]
    for a in range(len(features)):
        for b in range(a):
            total += sum(p * q for p, q in zip(vectors[a], vectors[b], strict=True)) * features[a][1] * features[b][1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_scores_by_a_plain_reading(spark, documents, rows):
    """The query's scores of documents of all kinds, from features and pairs computed anew."""
    machine = factorization.train(documents, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries.op9_factorization(spark, FOLDER).collect()}
    short = [(i, t) for i, t, _ in rows if len(t or "") < 1500][:60]
    assert len(short) > 30
    for i, text in short:
        assert got[i] == pytest.approx(plain_score(text, machine), abs=1e-9), i
    for text in (None, "", " \n", "É été | x 12\n\nÉ été | x 12\nA.", "a"):
        assert machine.score(text) == pytest.approx(plain_score(text, machine), abs=1e-9)
