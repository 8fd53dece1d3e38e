"""Main text of web pages by site template removal.

Each page is read into a tree of elements. All subtrees outside the article, and inside it containers and whatever the fixed
lists name (not paragraphs, headings, lists' items and the like), are hashed whole: tag and text with the subtrees within.
Spark counts for each host on how many pages (pages with the same html count once) each hash occurs; subtrees on at least
``least_pages`` pages and at least ``ratio`` of the host's are that site's template and are deleted on each of its pages, on the
tree as it was read. Subtrees inside an article need ``inside_ratio``, since they may be text that articles share.

Menus and adverts often differ in their words from page to page, but stand at the same place in the same shape. So outside
the article subtrees are hashed by shape as well: the tags above and within, runs of equal list items, rows or links as one,
without any words. Shapes on at least ``shape_ratio`` of the host's pages that hold no more than ``shape_share`` of their pages' text on average
are template too. On a page without article or main element nothing is inside an article: what the template leaves of the
body is its main text, so there the template alone tells the text from what surrounds it.

What recurs too seldom to be counted (hosts of few pages, parts that differ on each page) is left to the fixed lists, after
the template: elements that are never main text (navigation, page header and footer, asides, forms, scripts, styles), and
those whose role, id or class names say so in all their words. Where an article or main element is left, its text is taken and
not what else is left of the body: one block per block element, character references decoded, white space turned into one space.
``template_chars`` and ``listed_chars`` tell how much text each of the two parts removed.

Paragraphs of the article are never deleted as template: a sentence that many articles share is still their text.

Hosts are spread: only (host, hash) counts are shuffled, pre-aggregated, and the templates found are few (at most mean
subtrees per page / ratio for each host). They are broadcast if their hashes are few in all, else joined on the host, a host of many pages by copies of its list.

Null or empty html gives an empty text; a null url is the empty host. Broken markup is read as far as it goes: open elements
end with the page. Repeated rows each give a row. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratoframe.llm.common import cut_lineage, spread_lookup

RATIO = 0.02
INSIDE_RATIO = 0.2
LEAST_PAGES = 3
#: Shares of a host's pages that must have a shape, and of a page's text that a shape may hold.
SHAPE_RATIO, SHAPE_SHARE = 0.5, 0.25
#: Elements of which a run counts as one in a shape.
REPEATED = frozenset("li tr option a dt dd".split())
#: Templates of more hashes than this (8 bytes each) are joined by a shuffle.
BROADCAST_HASHES = 500_000

#: Names of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
NEVER = frozenset("nav aside form footer button select dialog menu head object video audio canvas map fieldset datalist".split()) | RAW
BLOCK = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr tbody pre blockquote br b i em strong a span code".split())
#: An open element on the left ends when one on the right begins.
ENDED_BY = {
    "p": BLOCK - {"body", "html"} | {"form", "nav", "aside", "footer", "fieldset", "menu"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody"}), "th": frozenset({"td", "th", "tr", "tbody"}),
}
#: Parts of class names and ids, and roles, of what isn't main text.
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments respond reply disqus footer masthead pagination pager widget toolbar skip search form".split()
)
#: Words that such names have besides; a name with any other word (form-factor, related-work) says something else.
NEUTRAL = frozenset(
    "box bar block wrapper wrap container section list area button buttons link links item items inner outer top bottom left right center main site page global header post posts article articles user "
    "users reader readers entry content text body title story stories news more also primary secondary sticky fixed inline small large mini slot unit message icon icons row col column columns panel group "
    "desktop mobile count thread author field fields input submit email policy strip holder frame zone region area widgets wp js id by to us up on".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[!?/][^>]*(?:>|\Z))""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_NAME = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _marked(name: str) -> bool:
    """A class name or id that says so in all its words; names such as has-sidebar or search-results speak of something else."""
    words = [w for w in _NAME.findall(name) if not w.isdigit()]
    return not MARKS.isdisjoint(words) and all(w in MARKS or w in NEUTRAL for w in words)


class Element:
    __slots__ = ("tag", "parts", "parent", "drop", "root", "template")

    def __init__(self, tag: str, parent: Element | None, attributes: str = "") -> None:
        self.tag, self.parent, self.parts = tag, parent, []
        self.root = tag in ("article", "main")
        self.drop = tag in NEVER
        self.template = False
        if "=" in attributes and not self.drop:
            for name, *values in _ATTRIBUTE.findall(attributes):
                words = _NAME.findall("".join(values).lower())
                self.drop |= not ROLES.isdisjoint(words) if name.lower() == "role" else any(map(_marked, "".join(values).lower().split()))
                self.root |= name.lower() == "role" and "main" in words
        if tag in ("body", "html"):
            self.drop = False


def tree_of(page: str) -> Element:
    top = here = Element("html", None)
    opened: Counter[str] = Counter()
    end = 0

    def left(element: Element, to: Element) -> Element:
        while element is not to:
            opened[element.tag] -= 1
            element = element.parent
        return to

    at = _TAG.search(page)
    while at:
        if at.start() > end:
            here.parts.append(page[end : at.start()])
        end = at.end()
        closing, tag, attributes = at[1], (at[2] or "").lower(), at[3] or ""
        if tag and closing:
            if opened[tag] > 0:
                up = here
                while up.tag != tag:
                    up = up.parent
                here = left(here, up.parent)
        elif tag in VOID:
            if tag in ("br", "hr"):
                here.parts.append(" " if tag == "br" else Element("hr", here))
        elif tag in ("html", "body") and here.tag in ("html", "body"):
            if tag == "body":
                element = Element(tag, here, attributes)
                here.parts.append(element)
                opened[tag] += 1
                here = element
        elif tag:
            while here.parent is not None and tag in ENDED_BY.get(here.tag, ()):
                here = left(here, here.parent)
            if tag in BLOCK and here.tag in PLAIN - BLOCK:  # an inline element left open ends with its paragraph
                up = here
                while up.parent is not None and up.tag in PLAIN - BLOCK:
                    up = up.parent
                if tag in ENDED_BY.get(up.tag, ()) and up.parent is not None:
                    here = left(here, up.parent)
            element = Element(tag, here, attributes)
            here.parts.append(element)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, end)
                end = close.end() if close else len(page)
            elif not attributes.rstrip().endswith("/") or tag in BLOCK:
                opened[tag] += 1
                here = element
        at = _TAG.search(page, end)
    if end < len(page):
        here.parts.append(page[end:])
    return top


def roots_of(top: Element) -> list[Element]:
    """The outermost articles (or main elements) that aren't dropped; else the whole page."""
    found, open_ = [], [top]
    while open_:
        element = open_.pop()
        if element.template or (element.drop and element.tag != "form"):  # a form may hold the whole page
            continue
        if element.root:
            found.append(element)
            continue
        open_ += [x for x in reversed(element.parts) if isinstance(x, Element)]
    inner = [x for x in found if x.tag == "main" and _articles(x)]
    for x in inner:
        k = found.index(x)
        found[k : k + 1] = _articles(x)
    return found or [top]


def _articles(element: Element) -> list[Element]:
    out, open_ = [], [x for x in reversed(element.parts) if isinstance(x, Element)]
    while open_:
        x = open_.pop()
        if x.drop or x.template:
            continue
        if x.tag == "article":
            out.append(x)
        else:
            open_ += [y for y in reversed(x.parts) if isinstance(y, Element)]
    return out


def _is_part(element: Element, inside: bool, roots: set[int]) -> bool:
    """Whether an element may be template: no root or page, and in an article no plain block."""
    return id(element) not in roots and element.tag not in ("html", "body", "article", "main") and (element.drop or not inside or element.tag not in PLAIN)


def hashes_of(top: Element) -> tuple[dict[tuple[int, bool], list[Element]], dict[int, list[Element]], dict[int, int]]:
    """Subtrees that may be template, by hash and whether they are inside the article (its plain blocks are no subtrees of their own), those outside articles by shape, and the characters of each element's text."""
    roots = set(map(id, roots_of(top)))
    marked = top not in roots_of(top)  # an article or main element is there
    out: dict[tuple[int, bool], list[Element]] = {}
    shapes: dict[int, list[Element]] = {}
    digest: dict[int, int] = {}
    form: dict[int, int] = {}
    chars: dict[int, int] = {}
    stack = [(top, False, False, "")]
    while stack:
        element, inside, done, path = stack.pop()
        if not done:
            inside = inside or id(element) in roots
            stack.append((element, inside, True, path))
            below = f"{path}/{element.tag}"
            stack += [(x, inside, False, below) for x in element.parts if isinstance(x, Element)]
            continue
        h = xxhash.xxh64(element.tag.encode())
        shape, before, size = [element.tag], None, 0
        for x in element.parts:
            if isinstance(x, str):
                h.update(x.encode("utf-8", "surrogatepass"))
                size += len(x.strip())
                if x.strip() and shape[-1] != "#":
                    shape.append("#")
                    before = None
                continue
            h.update(digest[id(x)].to_bytes(8, "little"))
            size += chars[id(x)]
            if x.tag not in REPEATED or form[id(x)] != before:
                shape.append(str(form[id(x)]))
            before = form[id(x)]
        digest[id(element)] = h.intdigest()
        form[id(element)] = xxhash.xxh64_intdigest(" ".join(shape).encode())
        chars[id(element)] = 0 if element.tag in RAW else size
        if _is_part(element, inside, roots):
            out.setdefault((h.intdigest() - (1 << 63), inside), []).append(element)
        if not (inside and marked) and element.tag not in PLAIN and _is_part(element, False, roots):
            shapes.setdefault(xxhash.xxh64_intdigest(f"{path} {form[id(element)]}".encode()) - (1 << 63), []).append(element)
    return out, shapes, chars


def removed_chars(top: Element) -> tuple[int, int]:
    """Characters of text (scripts and styles aside) in subtrees deleted as template, and in those that the lists alone drop."""
    counts = [0, 0]
    stack: list[tuple[Element, int | None]] = [(top, None)]
    while stack:
        element, by = stack.pop()
        by = 0 if element.template else 1 if by is None and element.drop else by
        if element.tag in RAW:
            continue
        for x in element.parts:
            if isinstance(x, Element):
                stack.append((x, by))
            elif by is not None:
                counts[by] += len(x.strip())
    return counts[0], counts[1]


def text_of(top: Element) -> str:
    """The blocks of the article, in page order, joined by line ends."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := _SPACE.sub(" ", html.unescape("".join(run))).strip():
            blocks.append(text)
        run.clear()

    for root in roots_of(top):
        in_article = root.root
        stack: list[Element | str | None] = [root]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                run.append(x)
            elif not (x.drop or x.template) and not (x.tag == "header" and not in_article):
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(x.parts)
        flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _shares(shapes: dict[int, list[Element]], chars: dict[int, int], top: Element) -> list[dict[str, int]]:
    """Of each shape the thousandths of the page's text that its elements hold."""
    whole = max(chars[id(top)], 1)
    return [{"hash": h, "share": 1000 * sum(chars[id(e)] for e in elements) // whole} for h, elements in shapes.items()]


def templates(
    pages: DataFrame, url: str = "url", page: str = "html", ratio: float = RATIO, inside_ratio: float = INSIDE_RATIO, least_pages: int = LEAST_PAGES, shape_ratio: float = SHAPE_RATIO, shape_share: float = SHAPE_SHARE
) -> DataFrame:
    """host, hash, kind (outside, inside or shape) of the subtrees to delete."""
    shape_type = pa.list_(pa.struct([("hash", pa.int64()), ("share", pa.int32())]))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, shares = [], []
            for p in batch.column(2):
                top = tree_of(p.as_py() or "")
                subtrees, shapes, chars = hashes_of(top)
                found.append(list(subtrees))
                shares.append(_shares(shapes, chars, top))
            sides = [pa.array([[h for h, i in f if i == inside] for f in found], pa.list_(pa.int64())) for inside in (False, True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sides, pa.array(shares, shape_type)], names=["host", "key", "outside", "inside", "shapes"])

    rows = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(page).alias("key"), F.col(page).alias("page"))
    each = cut_lineage(rows.mapInArrow(hashed, "host string, key long, outside array<long>, inside array<long>, shapes array<struct<hash:bigint,share:int>>").dropDuplicates(["host", "key"]))
    totals = each.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "of")
    sides = [each.select("host", F.explode(side).alias("hash"), F.lit(side).alias("kind"), F.lit(0).alias("share")) for side in ("outside", "inside")]
    shaped = each.select("host", F.inline("shapes"), F.lit("shape").alias("kind")).select("host", "hash", "kind", "share")
    counted = sides[0].unionByName(sides[1]).unionByName(shaped).groupBy("host", "hash", "kind").agg(F.count("*").alias("n"), F.avg("share").alias("share")).filter(F.col("n") >= least_pages)
    needed = F.when(F.col("kind") == "inside", F.lit(inside_ratio)).when(F.col("kind") == "shape", F.lit(shape_ratio)).otherwise(F.lit(ratio)) * F.col("pages")
    found = counted.join(totals, F.col("host") == F.col("of")).filter((F.col("n") >= needed) & (F.col("share") <= 1000 * shape_share))
    return found.select("host", "hash", "kind")


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", ratio: float = RATIO, inside_ratio: float = INSIDE_RATIO, least_pages: int = LEAST_PAGES, shape_ratio: float = SHAPE_RATIO
) -> DataFrame:
    """One row for each page: page_id, url, text, n_deleted (subtrees deleted as template), template_chars, listed_chars."""
    found = cut_lineage(templates(pages, url, page, ratio, inside_ratio, least_pages, shape_ratio))
    kinds = ("outside", "inside", "shape")
    by_host = found.groupBy(F.col("host").alias("of")).agg(*[F.collect_list(F.when(F.col("kind") == kind, F.col("hash"))).alias(kind) for kind in kinds])
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("page"), host_of(F.col(url)).alias("host"))
    if found.count() <= BROADCAST_HASHES:
        joined = rows.join(F.broadcast(by_host), F.col("host") == F.col("of"), "left")
    else:
        joined = spread_lookup(rows, "host", by_host, "of", "page")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], frozenset[int]] = {}
        for batch in batches:
            texts, counts = [], []
            for p, host, *lists in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), batch.column(5), batch.column(6), strict=True):
                top, n = tree_of(p.as_py() or ""), 0
                for side, kind in zip(lists, kinds, strict=True):
                    if (host, kind) not in known:
                        known[host, kind] = frozenset(side.as_py() or ())
                outside, inside, shape = (known[host, kind] for kind in kinds)
                if outside or inside or shape:
                    subtrees, shapes, _ = hashes_of(top)
                    gone = [e for (h, within), elements in subtrees.items() if h in (inside if within else outside) for e in elements]
                    gone += [e for h, elements in shapes.items() if h in shape for e in elements]
                    n = len(set(map(id, gone)))
                    for element in gone:
                        element.template = True
                texts.append(text_of(top))
                counts.append((n, *removed_chars(top)))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *columns], names=["page_id", "url", "text", "n_deleted", "template_chars", "listed_chars"])

    kind = pages.schema[page_id].dataType.simpleString()
    chosen = joined.select("page_id", "url", "page", "host", *kinds)
    return chosen.mapInArrow(extracted, f"page_id {kind}, url string, text string, n_deleted long, template_chars long, listed_chars long")
