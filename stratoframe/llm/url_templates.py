"""URL filters by path-template trees.

Each host has a tree whose levels are the segments of its urls' paths. Segments of a variable shape (numbers, dates, hex and
UUIDs, mixtures of letters and digits) become wildcards at once, so the many pages of a site fall into few shapes, and all
that follows works on counts of shapes. Level by level, from the root: a node with over ``FAN`` literal children of which
most are rare is variable too, and its children become one wildcard. Other literal children are merged with each other if they
are statistically alike: what follows them (wildcards by name, literals, ends) is distributed as after all their siblings
together (a G-test), and their labelled pages, where they have any, are blocked as often as their siblings' (a test of shares).
So a branch without labels joins labelled ones of its kind. A node that one shape alone has left is done; so the tree is as deep
as its branches, however long paths are.

A template's purity is the share of blocked ones among its labelled pages, smoothed towards its parent's purity, this towards
its own parent's, and so on to the host, its registered domain (the last two names) and all labelled pages. Templates of at
least ``PURITY`` are rejected. Labels come from the rules (host and path prefix; the longest that fits wins): pages that a rule
judges teach the tree, and the tree judges the others. A page without a rule is blocked if its template is rejected and
allowed otherwise.

Everything is DataFrame operations. Pages are shuffled as counts, pre-aggregated for each host and shape; a host with a
third of all pages is spread by its shapes and the joins of counts are splittable. Only rejected shapes are joined to pages.

Null urls and those without :// have empty host and path, no rule, and are judged as the (empty) host's root. Repeated rows
each give a row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratoframe.llm.common import broadcast_if_small, cut_lineage, has_rows

#: Verdict, host (with its subdomains), start of the path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
FAN = 12
RARE = 0.3
SIGNIFICANT = 2.58
PURITY = 0.8
PRIOR = 5.0

#: Shapes of variable segments, tried in this order.
SHAPES = (
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "{date}"),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "{uuid}"),
    (r"^[0-9]+$", "{number}"),
    (r"^[0-9]+(\.[a-z0-9]{1,5})$", "{number}$1"),
    (r"^(?=.*[0-9])[0-9a-fA-F]{8,}$", "{hex}"),
    (r"^(?=.*[0-9])[^.]{6,}(\.[a-z0-9]{1,5})?$", "{mixed}$1"),
    (r"^(?=.*-.*-.*-)[^.]+(\.[a-z0-9]{1,5})?$", "{slug}$1"),
)


def parts_of(pages: DataFrame, url: str) -> DataFrame:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": host, "path": F.regexp_extract(text, pattern, 2)})


def ruled(rows: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """With rule (the longest that fits) and ruling (its verdict), null where none fits."""
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, ruling = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return rows.withColumns({"rule": rule, "ruling": ruling})


def shape_of(path: Column) -> Column:
    """The path's segments, joined by /, variable ones by the name of their shape."""

    def one(segment: Column) -> Column:
        out = segment
        for pattern, name in reversed(SHAPES):
            out = F.when(segment.rlike(pattern), F.regexp_replace(segment, pattern, name.replace("{", r"\{").replace("}", r"\}"))).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), one), "/")


def smoothed(blocked: str, labelled: str, towards: str) -> Column:
    return (F.col(blocked) + PRIOR * F.col(towards)) / (F.col(labelled) + PRIOR)


def roots(counts: DataFrame) -> DataFrame:
    """Each host with the purity of its root."""
    totals = counts.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    share = float(totals["blocked"] or 0) / max(1, totals["labelled"] or 0)
    sums = [F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    hosts = counts.groupBy("host").agg(*sums).withColumn("domain", F.substring_index("host", ".", -2))
    domains = hosts.groupBy("domain").agg(*sums).withColumn("all", F.lit(share)).select("domain", smoothed("blocked", "labelled", "all").alias("above"))
    return hosts.join(domains, "domain").select("host", smoothed("blocked", "labelled", "above").alias("score"))


def names_of(active: DataFrame, level: int) -> DataFrame:
    """host, template, segment, name of the children that get another name than their own: '*' or '(alike)'."""
    following = F.get("segments", F.lit(level + 1))
    kind = F.when(following.isNull(), F.lit("")).when(following.contains("{"), following).otherwise(F.lit("literal"))
    by_kind = cut_lineage(active.withColumn("kind", kind).groupBy("host", "template", "segment", "kind").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")))
    literal = ~F.col("segment").contains("{") & (F.col("segment") != "")
    own = by_kind.filter(literal)
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    children = own.groupBy("host", "template", "segment").agg(*sums)
    nodes = children.groupBy("host", "template").agg(
        F.count("*").alias("fan"), F.count(F.when(F.col("n") <= 2, 1)).alias("rare"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")]
    )
    pooled = own.groupBy("host", "template", "kind").agg(F.sum("n").alias("of_kind"))
    kinds = pooled.groupBy("host", "template").agg(F.count("*").alias("kinds"))
    compared = own.select("host", "template", "segment", "kind", F.col("n").alias("here")).join(pooled, ["host", "template", "kind"]).join(children, ["host", "template", "segment"]).join(nodes, ["host", "template"])
    unlike = F.col("here") * F.log(F.col("here") * F.col("all_n") / (F.col("n") * F.col("of_kind")))
    judged = compared.groupBy("host", "template", "segment").agg((2 * F.sum(unlike)).alias("g"), *[F.first(c).alias(c) for c in ("labelled", "blocked", "fan", "rare", "all_labelled", "all_blocked")])
    judged = judged.join(kinds, ["host", "template"])
    free = F.col("kinds") - 1
    # the quantile of chi square by the cube root of a normal one
    most = F.when(free > 0, free * F.pow(1 - 2 / (9 * free) + SIGNIFICANT * F.sqrt(2 / (9 * free)), F.lit(3.0))).otherwise(0.0) + 1e-9
    share = F.col("all_blocked") / F.greatest("all_labelled", F.lit(1))
    error = F.sqrt(share * (1 - share) / F.greatest("labelled", F.lit(1)))
    labels_alike = (F.col("labelled") == 0) | (F.abs(F.col("blocked") / F.greatest("labelled", F.lit(1)) - share) <= SIGNIFICANT * error + 1e-9)
    variable = (F.col("fan") > FAN) & (F.col("rare") >= RARE * F.col("fan"))
    name = F.when(variable, F.lit("*")).when((F.col("fan") > 1) & (F.col("g") <= most) & labels_alike, F.lit("(alike)"))
    return judged.select("host", "template", "segment", name.alias("name")).filter("name is not null")


def templates(counts: DataFrame) -> DataFrame:
    """host, shape, template, template_labelled, score (smoothed purity of the template) from counts (host, shape, n, labelled, blocked)."""
    segments = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))
    rows = counts.join(roots(counts), "host").withColumn("segments", segments).withColumn("template", F.lit(""))
    active, level, done = cut_lineage(rows), 0, []
    out = ["host", "shape", "template", "template_labelled", "score"]
    while has_rows(active):
        active = cut_lineage(active.withColumn("segment", F.coalesce(F.get("segments", F.lit(level)), F.lit(""))))
        named = active.join(names_of(active, level), ["host", "template", "segment"], "left")
        stepped = named.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("name", "segment"))).drop("name")
        nodes = stepped.groupBy("host", "template").agg(F.count("*").alias("shapes"), F.sum("labelled").alias("template_labelled"), F.sum("blocked").alias("template_blocked"))
        stepped = cut_lineage(stepped.join(nodes, ["host", "template"]).withColumn("score", smoothed("template_blocked", "template_labelled", "score")))
        level += 1
        open_ = (F.col("segment") != "") & (F.col("shapes") > 1)
        rest = F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0)))
        whole = F.when(F.col("segment") == "", F.rtrim("template", F.lit("/"))).otherwise(F.array_join(F.concat(F.array("template"), rest), "/"))
        done.append(stepped.filter(~open_).withColumn("template", whole).select(*out))
        active = stepped.filter(open_).drop("shapes", "template_labelled", "template_blocked", "segment")
    return reduce(DataFrame.unionByName, done) if done else rows.withColumn("template_labelled", F.lit(0).cast("long")).select(*out)


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, purity: float = PURITY) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, template (where the tree rejects it), score."""
    # the tree's joins and counts are on shapes, of which there are few for each host
    rows = ruled(parts_of(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), "url"), rules).withColumn("shape", shape_of(F.col("path")))
    counts = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("ruling").alias("labelled"), F.count(F.when(F.col("ruling") == "block", 1)).alias("blocked"))
    known = templates(cut_lineage(counts)).filter(F.col("score") >= purity)
    bad = cut_lineage(known.select(F.col("host").alias("bad_host"), F.col("shape").alias("bad_shape"), "template", "score"))
    joined = rows.join(broadcast_if_small(bad), (F.col("host") == F.col("bad_host")) & (F.col("shape") == F.col("bad_shape")), "left")
    verdict = F.coalesce("ruling", F.when(F.col("bad_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "score")
