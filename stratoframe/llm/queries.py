"""The queries of this subpackage, with production parameters over whole tables, and the SQL they are checked against."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratoframe.llm import centroids, decontaminate, factorization, iblt, license_scan, line_dedup, periodic_runs, simhash, site_template, source_mix, suffix_tree_lm, token_groups, url_templates
from stratoframe.llm.common import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).drop("blocks")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=("n_lines", "n_dropped")).select("doc_id", "n_lines", "n_dropped", "text")


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op5_site_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_template.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source_mix.mixed_rows(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op8_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.neighbours(read(spark, sf_dir, "documents"))


def op9_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = factorization.train(docs, read(spark, sf_dir, "labels"))
    found = factorization.scored(docs.select("doc_id", factorization.held_out(F.col("doc_id")).alias("held_out"), "text"), machine)
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.digest_of_items("items").alias("items_sha256"), "contaminated")


def looped_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's edit: in one of ten documents (by the id's CRC-32) the words from some place on repeat the first of them; a null id changes nothing."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(read(spark, sf_dir, "documents"), edit=looped_tail).withColumn("best", periodic_runs.strongest("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        periodic_runs.runs_digest("runs").alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_groups.similar_documents(read(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(read(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_line_dedup, op3_suffix_tree_lm, op4_simhash, op5_site_template, op6_url_templates, op7_source_mix, op8_iblt, op9_factorization, op10_decontaminate, op11_periodic_runs, op12_token_groups, op13_centroids)
    return {f.__name__: f for f in found}


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def _license_sql() -> str:
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM words, range(1, len(w) + 1) t(i) WHERE w[i:i + {len(phrase.split()) - 1}] = {phrase.split()}" for phrase, label in license_scan.PHRASES
    )
    siblings = license_scan.siblings_of(license_scan.TEMPLATES, license_scan.THRESHOLD)
    templates = " UNION ALL ".join(
        f"SELECT {sorted(set(t.split()))} AS t, '{label}' AS label, {license_scan.width_of(t)} AS width, {must}::VARCHAR[] AS must, {never}::VARCHAR[][] AS never"
        for (label, t), (must, never) in zip(license_scan.TEMPLATES, siblings, strict=True)
    )
    return f"""
    WITH words AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
    places AS ({places}),
    base AS (SELECT doc_id, count(*) AS n, min(place) AS f, max(place) AS l, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
    templates AS ({templates}),
    blocks AS (SELECT doc_id, width, list_distinct(w[p + 1:p + 2 * width]) AS b FROM words, (SELECT DISTINCT width FROM templates), range(0, greatest(len(w) - width, 1), width) t(p)),
    found AS (SELECT doc_id, label, len(list_intersect(b, t)) / len(t) AS share FROM blocks JOIN templates USING (width) WHERE len(list_intersect(b, t)) >= ceil(round({license_scan.THRESHOLD} * len(t), 9))
      AND list_has_all(b, must) AND len(list_filter(never, lambda words: list_has_all(b, words))) = 0),
    method AS (SELECT doc_id, max(share) AS best, list(DISTINCT label) AS labels FROM found GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, f AS first_word, l AS last_word,
      coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ','), '') AS labels,
      CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
    FROM words LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)"""


_LINES_SQL = f"""
WITH lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(DISTINCT coalesce(text, '')) AS pages FROM documents GROUP BY source),
bad AS (SELECT l.source, trim(line) AS line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE trim(line) <> '' GROUP BY l.source, trim(line), pages
  HAVING count(DISTINCT text) >= {line_dedup.LEAST_PAGES} AND count(DISTINCT text) / pages >= {line_dedup.RATIO}),
marked AS (SELECT l.*, b.line IS NOT NULL AS drop_it FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line) = b.line),
cleaned AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop_it) AS n, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT drop_it), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n, 0) AS n_dropped, kept AS text
FROM documents d LEFT JOIN cleaned USING (doc_id)"""


def _mix_sql() -> str:
    weight = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(source_mix.WEIGHTS))
    return rf"""
    WITH sized AS (SELECT doc_id, source, md5(coalesce(text, '')) AS body, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
    sources AS (SELECT source, sum(size) AS s, sum(size * sqrt(size)) AS roots FROM sized GROUP BY source),
    weighed AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(source_mix.WEIGHTS)} {weight} END AS DOUBLE) AS w FROM sources),
    summed AS (SELECT *, (sum(s) OVER () - coalesce(sum({source_mix.MOST} * s) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fair FROM weighed),
    goal AS (SELECT source, s, roots, CASE WHEN {source_mix.MOST} * s < fair * w THEN CAST({source_mix.MOST} * s AS DOUBLE) ELSE w * (SELECT fair FROM summed WHERE {source_mix.MOST} * s >= fair * w ORDER BY s / w, source LIMIT 1) END AS target FROM summed),
    parts AS (SELECT *, floor(CASE WHEN s > 0 THEN target / s ELSE 0 END + 1e-9) AS whole FROM goal),
    rests AS (SELECT *, greatest(target - whole * s, 0) AS rest FROM parts),
    ranked AS (SELECT d.*, r.s, r.target, r.whole, r.rest, least(CASE WHEN roots > 0 THEN rest / roots ELSE 0 END * sqrt(size), {source_mix.CERTAIN}) AS p,
      (CAST('0x' || substr(md5('{source_mix.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / {1 << 48} AS u FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source),
    ordered AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM ranked),
    running AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM ordered)
    SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target, CAST(size * (whole + CASE WHEN rank IS NOT NULL AND so_far + size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM running"""


_CLEAN_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {decontaminate.WINDOW - 1}], ' ') AS win, least(len(w), {decontaminate.WINDOW}) AS size FROM items, range(1, greatest(len(w) - {decontaminate.WINDOW - 1}, 1) + 1) t(i) WHERE len(w) > 0 AND i <= greatest(len(w) - {decontaminate.WINDOW - 1}, 1)),
words AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
grams AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM words, (SELECT DISTINCT size FROM windows), range(1, len(w) + 1) t(i) WHERE i + size - 1 <= len(w)),
hits AS (SELECT doc_id, i, g.size, item_id FROM grams g JOIN windows USING (size, win)),
places AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hits, range(hits.size) t(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AND {decontaminate.SHARE} * coalesce(p.n, 0) >= len(w) AS contaminated
FROM words LEFT JOIN places p USING (doc_id) LEFT JOIN named i USING (doc_id)"""


def _centroids_sql() -> str:
    distance = "(SELECT CAST(sum((a - b) * (a - b)) AS BIGINT) FROM (SELECT unnest({0}) AS a, unnest({1}) AS b))"
    nearest = "SELECT v, c.k, c.c, row_number() OVER (PARTITION BY v ORDER BY " + distance.format("v", "c.c") + ", c.k) AS place, " + distance.format("v", "c.c") + " AS d FROM dist, {0} c"
    rounds = ""
    for r in range(centroids.ROUNDS):
        rounds += f"""
    near{r} AS (SELECT v, k FROM ({nearest.format(f"cent{r}")}) WHERE place = 1),
    parts{r} AS (SELECT k, generate_subscripts(v, 1) AS p, unnest(v) AS x, weight FROM near{r} JOIN dist USING (v)),
    sums{r} AS (SELECT k, p, sum(CAST(x AS HUGEINT) * weight) AS s, sum(weight) AS n FROM parts{r} GROUP BY k, p),
    means{r} AS (SELECT k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY p) AS c FROM sums{r} GROUP BY k),
    cent{r + 1} AS (SELECT o.k, coalesce(m.c, o.c) AS c FROM cent{r} o LEFT JOIN means{r} m USING (k)),"""
    last = f"cent{centroids.ROUNDS}"
    return f"""
    WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {centroids.FACTOR}) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = {centroids.WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    dist AS MATERIALIZED (SELECT v, count(*) AS weight FROM kept GROUP BY v),
    cent0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('{centroids.SEED}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h, v LIMIT {centroids.CENTROIDS})),{rounds}
    final AS (SELECT v, k, c, d FROM ({nearest.format(last)}) WHERE place = 1),
    rows AS (SELECT vec_id, k, c, d FROM kept JOIN final USING (v))
    SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM rows"""


def _runs_sql() -> str:
    # CRC-32 by its table, since DuckDB has no function for it; runs are islands of words that equal the word q places on
    return rf"""
    WITH RECURSIVE shifts(byte, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM shifts WHERE k < 8),
    crc AS (SELECT list(c ORDER BY byte) AS t FROM shifts WHERE k = 8),
    plain AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS w,
      xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, crc),
    places AS (SELECT *, len(w) AS n, (h // 10) % len(w) AS a, (h // 10) % 8 AS e FROM plain),
    edited AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + e)) + 1])) ELSE w END AS w FROM places),
    words AS MATERIALIZED (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word, len(w) AS n FROM edited),
    equal AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND {periodic_runs.TIMES} * (b.i - a.i) <= a.n),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
    found AS MATERIALIZED (SELECT doc_id, q AS period, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({periodic_runs.LEAST}, {periodic_runs.TIMES} * q)),
    runs AS MATERIALIZED (SELECT * FROM found r WHERE NOT EXISTS (SELECT 1 FROM found s WHERE s.doc_id = r.doc_id AND s.period < r.period AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS place FROM runs) WHERE place = 1),
    listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM words w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND i >= start + period AND i < start + length) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
    FROM plain LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The others have none: fitted models (3, 9), XXH64 (4), a parser of HTML (5), a tree grown level by level (6), bit-level sketches (8). Tests hold them against brute force."""
    return {"op1_license_scan": _license_sql(), "op2_line_dedup": _LINES_SQL, "op7_source_mix": _mix_sql(), "op10_decontaminate": _CLEAN_SQL, "op11_periodic_runs": _runs_sql(), "op13_centroids": _centroids_sql()}
