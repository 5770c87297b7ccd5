"""Extraction from HTML: native regular expressions where they suffice, the standard parser on Arrow batches where a tree is needed."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewell.functions.dates import SCAN_CRAWL, iso, scan_date, url_date
from brinewell.functions.urls import ATTACHMENT_EXTENSIONS, content_hash, normalize_url, snapshot_path
from brinewell.operators.crawl import site_of_url

#: Containers tried for the main text, in order (fixed values).
CONTENT_SELECTORS = (
    "article", ".article-content", ".news-content", ".content", ".main", ".main-content", ".post-content",
    ".entry-content", "#content", "#article", ".TRS_Editor", ".TRS_PreAppend", ".Custom_UnionStyle",
)
#: Where a title is looked for, in order (fixed values).
TITLE_SELECTORS = ("title", "h1", ".title", ".article-title", ".news-title", "h2")
#: Where a time is looked for, in order (fixed values).
TIME_SELECTORS = (".time", ".date", ".publish-time", ".pub-time", ".news-time", ".article-time", ".info-time", ".pubdate", "#pubtime")
#: Tags without article text (fixed values).
REMOVED_TAGS = frozenset(("script", "style", "noscript", "nav", "footer", "header", "aside", "iframe"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


#: Attributes of <meta> that name a time, and what they contain then (fixed values).
META_TIMES = (("property", "date"), ("name", "publish"), ("name", "pubdate"))
#: Characters that a chosen container, and one chosen by its paragraphs, must have more of (fixed values).
LEAST_SELECTED, LEAST_SCORED = 120, 80
#: Characters of a page's text that are searched for a time (fixed value).
TIME_TEXT = 8192
#: Where a crawler looks for a title, in order (fixed values).
CRAWL_TITLE_SELECTORS = ("h1", ".title", "title")
_WANTED = frozenset((*CONTENT_SELECTORS, *TITLE_SELECTORS, *TIME_SELECTORS, "body"))
_UNREAD = frozenset(("script", "style"))


class Node:
    """An element: tag, attributes, children (elements and texts); ``gone`` once it is removed."""

    __slots__ = ("tag", "attrs", "children", "parent", "gone")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.gone = tag, attrs, parent, [], False

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self, skip: frozenset[str] = frozenset()) -> Iterator[str]:
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif not x.gone and (x is self or x.tag not in skip):
                stack += reversed(x.children)

    def text(self) -> str:
        return " ".join("".join(self.texts()).split())

    def there(self) -> bool:
        """Neither it nor what it is in is removed."""
        node = self
        while node is not None and not node.gone:
            node = node.parent
        return node is None


class _Tree(HTMLParser):
    """Builds the tree and notes, in the same pass, the elements that anything is asked of."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.hits: dict[str, list[Node]] = defaultdict(list)
        self.metas: list[dict[str, str]] = []
        self.anchors: list[Node] = []

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P and self.at.tag == "p":
            self.at = self.at.parent
        if tag == "li" and self.at.tag == "li":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node
        if tag == "meta":
            self.metas.append(node.attrs)
        elif tag == "a":
            self.anchors.append(node)
        names = {tag, "#" + node.attrs.get("id", ""), *("." + c for c in node.attrs.get("class", "").split())}
        for name in names & _WANTED:
            self.hits[name].append(node)

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_tree(page: str) -> _Tree:
    """A tolerant tree of a page; broken markup never raises."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return tree


def clean_lines(text: str) -> str:
    """Lines with single spaces, without empty ones."""
    return "\n".join(x for x in (" ".join(line.split()) for line in text.splitlines()) if x)


def _first_text(tree: _Tree, selectors: tuple[str, ...]) -> str:
    """The text of the first selector's first element, if it has any, else that of the next selector's."""
    return next((t for t in (tree.hits[s][0].text() for s in selectors if tree.hits[s]) if t), "")


def _letters(node: Node) -> int:
    return sum(len(t.strip()) for t in node.texts(_UNREAD))


def scored_container(root: Node) -> Node | None:
    """The element whose paragraphs have the most text that isn't links: a paragraph counts fully for its parent, by half for the parent's."""
    score: dict[int, float] = defaultdict(float)
    nodes: dict[int, Node] = {}
    for p in root.walk():
        if p.tag not in ("p", "pre", "td", "blockquote") or p.parent is None:
            continue
        n = _letters(p) - sum(_letters(a) for a in p.walk() if a.tag == "a")
        for node, part in ((p.parent, 1.0), (p.parent.parent, 0.5)):
            if node is not None and n > 0:
                score[id(node)] += part * n
                nodes[id(node)] = node
    return nodes[max(score, key=score.get)] if score else None


def _container(tree: _Tree) -> Node:
    """The main text's element: by selector, else by its paragraphs, else the body, else the whole page."""
    for s in CONTENT_SELECTORS:
        if tree.hits[s] and sum(len(t.strip()) for t in tree.hits[s][0].texts()) > LEAST_SELECTED:
            return tree.hits[s][0]
    scored = scored_container(tree.root)
    if scored is not None and _letters(scored) > LEAST_SCORED:
        return scored
    return tree.hits["body"][0] if tree.hits["body"] else tree.root


def _resolved(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def extract(page: str | None, url: str | None) -> dict:
    """What a page says: title, heading (a crawler's title), content, places of its time in order, links.

    ``meta_times`` and ``time_texts`` are candidates, the first that is a date counts. ``out_links``,
    ``anchor_texts`` and ``attachment_links`` leave out empty, script, mail and fragment targets and
    repetitions of an absolute address; ``links`` has all anchors with an href, their first text alone.
    Null and empty pages give empty values. The removed tags of the chosen container are gone before
    times and links are read, as the content is taken first.
    """
    out = dict.fromkeys(EXTRACTED.names, "") | {c: [] for c in _LISTS} | {"links": []}
    if not page:
        return out
    tree = parse_tree(page)
    out["title"], out["heading"] = _first_text(tree, TITLE_SELECTORS), _first_text(tree, CRAWL_TITLE_SELECTORS)
    out["links"] = [(_resolved(url or "", a.attrs["href"]), next((t.strip() for t in a.texts()), "")) for a in tree.anchors if "href" in a.attrs]
    out["meta_times"] = [m["content"].strip() for m in tree.metas if m.get("content", "").strip() and any(part in m.get(at, "").lower() for at, part in META_TIMES)]
    chosen = _container(tree)
    for node in chosen.walk():
        node.gone = node.gone or (node is not chosen and node.tag in REMOVED_TAGS)
    out["content"] = clean_lines("\n".join(chosen.texts()))
    places = [next((n for n in tree.hits[s] if n.there()), None) for s in TIME_SELECTORS]
    out["time_texts"] = ["".join(n.texts()) for n in places if n is not None] + ["".join(tree.root.texts(_UNREAD))[:TIME_TEXT]]
    hrefs = [(a.attrs.get("href", "").strip(), a) for a in tree.anchors if a.there()]
    kept: dict[str | None, Node] = {}
    for href, a in hrefs:
        if href and not href.startswith(("javascript:", "#", "mailto:")):
            kept.setdefault(_resolved(url or "", href), a)
    kept.pop(None, None)
    files = tuple("." + e for e in ATTACHMENT_EXTENSIONS)
    out["anchor_texts"] = [a.text() for a in kept.values()]
    out["attachment_links"] = [u for u in kept if u.lower().endswith(files)]
    out["out_links"] = [u for u in kept if not u.lower().endswith(files)]
    return out


_LISTS = ("meta_times", "time_texts", "out_links", "anchor_texts", "attachment_links")
EXTRACTED = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("title", "heading", "content")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS]
    + [T.StructField("links", T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])))]
)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch's columns, the last two of them page and address, with ``parsed``."""
    kind = pa.struct(
        [(c, pa.string()) for c in ("title", "heading", "content")] + [(c, pa.list_(pa.string())) for c in _LISTS] + [("links", pa.list_(pa.struct([("url", pa.string()), ("text", pa.string())])))]
    )
    for batch in batches:
        rows = [extract(p, u) for p, u in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
        for r in rows:
            r["links"] = [{"url": u, "text": t} for u, t in r["links"]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rows, kind)], names=[*batch.schema.names[:-2], "parsed"])


def first_date(texts: Column, read: Callable[[Column], Column]) -> Column:
    """The first text's date that can be read."""
    return F.get(F.filter(F.transform(texts, read), lambda d: d.isNotNull()), 0)


def parse_pages(pages: DataFrame, html_col: str = "raw_html", url_col: str = "url") -> DataFrame:
    """pages with ``parsed`` (title, content, links, ...) and ``publish_time``: the first date that metadata, the time's places or the text have."""
    schema = T.StructType([*pages.schema.fields, T.StructField("parsed", EXTRACTED)])
    parsed = pages.select("*", F.col(html_col).alias("__page"), F.col(url_col).alias("__url")).mapInArrow(_extract_batches, schema)
    iso = lambda t: F.coalesce(F.try_to_timestamp(F.replace(t, F.lit("T"), F.lit(" "))).cast("timestamp_ntz"), scan_date(t))
    return parsed.withColumn("publish_time", F.coalesce(first_date(F.col("parsed.meta_times"), iso), first_date(F.col("parsed.time_texts"), lambda t: scan_date(t))))


def is_html(content_type: Column) -> Column:
    """A content type of HTML, or none."""
    return F.coalesce(F.trim(content_type), F.lit("")).eqNullSafe("") | F.contains(F.lower(content_type), F.lit("text/html"))


def crawl_items(pages: DataFrame, sites: DataFrame, as_of: Column, min_chars: int = 50) -> DataFrame:
    """The items that a crawl of pages (url, raw_html, status_code, content_type) gives, with all fields of ITEM_TYPE.

    Other content types than HTML, and contents under ``min_chars``, give no item. The time is the address's
    date, else the first in the content; site and category are those of ``sites`` (site, domains, category),
    a crawl's configuration; links are all anchors', split by their ending.
    """
    rows = parse_pages(pages.where(is_html(F.col("content_type"))).select("url", "raw_html", "status_code"))
    rows = site_of_url(rows.where(F.length("parsed.content") >= min_chars), sites)
    rows = rows.join(F.broadcast(sites.select("site", "category")), "site", "left")
    absolute = F.filter("parsed.links", lambda x: x["url"].isNotNull())
    day = F.coalesce(url_date(F.col("url")).cast("timestamp_ntz"), scan_date(F.col("parsed.content"), SCAN_CRAWL))
    of = lambda kind: F.transform(F.filter(absolute, lambda x: classify_link(x["url"]) == kind), lambda x: x["url"])
    return rows.select(
        "url", normalize_url(F.col("url")).alias("normalized_url"), F.col("parsed.heading").alias("title"), "parsed.content", "raw_html",
        F.coalesce("site", F.lit("")).alias("source_site"), F.coalesce("category", F.lit("")).alias("category"), iso(day).alias("publish_time"),
        F.transform(absolute, lambda x: x["text"]).alias("anchor_texts"), of("page").alias("out_links"), of("attachment").alias("attachment_links"),
        iso(as_of).alias("crawl_time"), content_hash(F.col("parsed.content")).alias("content_hash"), snapshot_path(F.col("url")).alias("snapshot_path"), F.col("status_code").cast("int").alias("status_code"),
    )


def html_title(page: Column) -> Column:
    """The <title> text, else the first <h1>, white space collapsed; '' without either. Native."""

    def inner(tag: str) -> Column:
        text = F.regexp_extract(page, f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>", 1)
        return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), "\\s+", " "))

    return F.coalesce(F.nullif(inner("title"), F.lit("")), F.nullif(inner("h1"), F.lit("")), F.lit(""))


def html_links(page: Column) -> Column:
    """Array of (href, text) of the anchors, in order, repeated ones too. Native."""
    anchors = F.regexp_extract_all(page, F.lit('(?is)(<a\\s[^>]*?href="[^"]*"[^>]*>.*?</a>)'), 1)
    return F.transform(
        anchors,
        lambda a: F.struct(
            F.regexp_extract(a, '(?i)href="([^"]*)"', 1).alias("href"),
            F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(a, "(?is)>(.*)</a>$", 1), "<[^>]*>", ""), "\\s+", " ")).alias("text"),
        ),
    )


def classify_link(url: Column) -> Column:
    """'attachment' for the attachment endings, in any case, else 'page'."""
    return F.when(url.rlike("(?i)\\.(" + "|".join(ATTACHMENT_EXTENSIONS) + ")$"), "attachment").otherwise("page")


def with_banner(page: Column, banner: str) -> Column:
    """The banner after the first <body> tag, else before the page."""
    put = banner.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(page.rlike("(?i)<body[^>]*>"), F.regexp_replace(page, "(?is)^(.*?<body[^>]*>)", "$1" + put)).otherwise(F.concat(F.lit(banner), page))


ITEM_TYPE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("url", "normalized_url", "title", "content", "raw_html", "source_site", "category", "publish_time")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("anchor_texts", "out_links", "attachment_links")]
    + [T.StructField("crawl_time", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("snapshot_path", T.StringType()), T.StructField("status_code", T.IntegerType())]
)
