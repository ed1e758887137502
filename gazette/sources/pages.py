"""Crawled pages and feeds as sources: metadata, links and feed items out of stored markup."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms, text, urls
from .dom import Node, parse

#: Hints of article links and of links that are none; words of their anchors.
ARTICLE_HINTS = ["/news", "/article", "/articles", "/press", "/business", "/story", "/stories", "/entry/", "/archives/", "/2026/", "/2025/"]
EXCLUDED_HINTS = ["login", "signin", "signup", "account", "privacy", "terms", "contact", "help", "support", "faq", "cart", "wishlist", "javascript:", "#"]
ANCHOR_WORDS = ["news", "article", "press", "release", "announcement", "business"]
#: Paths at which feeds are usual, types of linked feeds, parts of their URLs.
FEED_PATHS = ["/feed", "/rss", "/feed.xml", "/rss.xml", "/atom.xml"]
FEED_TYPES = {"application/rss+xml", "application/atom+xml", "application/xml", "text/xml"}
FEED_PARTS = ["/feed", "/rss", "atom"]
#: Where a page says when it was published, its title, its category, its tags; keys of linked data.
DATES = [('meta[property="article:published_time"]', "content"), ('meta[name="article:published_time"]', "content"), ('meta[name="publish-date"]', "content"), ('meta[name="pubdate"]', "content"), ('meta[property="og:updated_time"]', "content"), ("time[datetime]", "datetime")]
TITLES = ['meta[property="og:title"]', 'meta[name="twitter:title"]']
SECTIONS = ['meta[property="article:section"]', 'meta[name="article:section"]', 'meta[property="og:section"]']
BREADCRUMB = 'nav[aria-label*="breadcrumb"] li:last-child, .breadcrumb li:last-child, .breadcrumbs li:last-child'
TAGS = ['meta[name="keywords"]', 'meta[property="article:tag"]']
TAG_LINKS = 'a[rel="tag"], .tag a, .tags a, [class*="tag"] a'
DATE_KEYS = {"datePublished", "dateCreated", "uploadDate", "pubDate"}
DESCRIPTIONS = ['meta[property="og:description"]', 'meta[name="description"]', 'meta[name="twitter:description"]']
BODIES = ["article", "main", '[class*="article"]', '[class*="content"]']
#: Characters from which a paragraph counts as one of the body, and the most tags of a page.
PARAGRAPH, MOST_TAGS = 30, 12
#: Pages whose markup and rows a task holds as Python objects at once.
FEW = 16
_TEXTS = pa.list_(pa.string())
_ARTICLE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("published_at", pa.string()), ("summary", pa.string()), ("category", pa.string()), ("tags", _TEXTS), ("body_excerpt", pa.string())])
_LINK = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("pos", pa.int64()), ("href", pa.string()), ("anchor", pa.string()), ("feed", pa.bool_())])


def _few(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rows: Callable[[int, str | None, str | None], list[tuple]]) -> Iterator[pa.RecordBatch]:
    """The rows made of (page_id, url, html), a few pages at a time: a batch stays as it came, its strings and results do not pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, FEW):
            part = batch.slice(at, FEW)
            out = [r for page in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True) for r in rows(*page)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


def _linked_dates(root: Node) -> list[str]:
    found: list[str] = []
    for script in root.select('script[type="application/ld+json"]'):
        try:
            todo = [json.loads(" ".join(script.strings()))]
        except ValueError:
            continue
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                found += [v for k, v in x.items() if k in DATE_KEYS and isinstance(v, str)]
                todo += [v for k, v in x.items() if isinstance(v, dict | list)]
            elif isinstance(x, list):
                todo += x
    return found


def _content(root: Node, selectors: list[str]) -> str:
    for selector in selectors:
        node = root.first(selector)
        if node and (value := " ".join(node.attrs.get("content", "").split())):
            return value
    return ""


def _tags(root: Node) -> list[str]:
    raw = [part for selector in TAGS for node in root.select(selector) for part in re.split(r"[,/|、，]\s*", node.attrs.get("content", ""))]
    raw += [node.text() for node in root.select(TAG_LINKS)]
    return list(dict.fromkeys(t for x in raw if (t := " ".join(x.split()))))[:MOST_TAGS]


def _body(root: Node) -> list[str]:
    """The paragraphs of the first container that has any."""
    for selector in BODIES:
        box = root.first(selector)
        if box is not None:
            found = [t for node in box.select("p, li") if len(t := node.text()) >= PARAGRAPH]
            if found:
                return list(dict.fromkeys(found))
    return []


def _heading(root: Node) -> str:
    node = root.first("h1") or root.first("title")
    return node.text() if node else ""


def page_articles(pages: DataFrame, excerpt: int | None = None) -> DataFrame:
    """page_id, url, title, published_at, summary, category, tags, body_excerpt of stored pages; each by a chain of fallbacks.

    The summary is the page's description and its body where the former does not hold it. ``excerpt`` cuts both to so many
    characters (the body of a report, say); by default nothing is cut.
    """

    def rows(page_id: int, url: str | None, html: str | None) -> list[tuple]:
        root = parse(html)
        dates = [v for selector, attr in DATES if (n := root.first(selector)) and (v := n.attrs.get(attr, "").strip())] + _linked_dates(root)
        crumb = root.first(BREADCRUMB)
        body = " ".join(_body(root))[:excerpt].strip()
        said = _content(root, DESCRIPTIONS)[:excerpt].strip()
        whole = said if body in said else body if said in body else f"{said} {body}"
        return [(page_id, url, _content(root, TITLES) or _heading(root), dates[0] if dates else "", whole[:excerpt].strip(), _content(root, SECTIONS) or (crumb.text() if crumb else ""), _tags(root), body)]

    return pages.select("page_id", "url", "html").mapInArrow(lambda batches: _few(batches, _ARTICLE, rows), "page_id long, url string, title string, published_at string, summary string, category string, tags array<string>, body_excerpt string")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href, anchor of all links, and feed (linked as one), made absolute."""

    def rows(page_id: int, url: str | None, html: str | None) -> list[tuple]:
        root, out = parse(html), []
        feeds = [n for n in root.select("link[href]") if "alternate" in n.attrs.get("rel", "").lower().split() and n.attrs.get("type", "").strip().lower() in FEED_TYPES]
        for pos, (node, feed) in enumerate([*((n, True) for n in feeds), *((n, False) for n in root.select("a[href]"))]):
            try:
                href = urljoin(url or "", node.attrs["href"].strip())
            except ValueError:
                continue
            out.append((page_id, url, pos, href, "" if feed else node.text(), feed))
        return out

    return pages.select("page_id", "url", "html").mapInArrow(lambda batches: _few(batches, _LINK, rows), "page_id long, url string, pos long, href string, anchor string, feed boolean")


def link_score(url: Column, href: Column, anchor: Column) -> Column:
    """How likely a link leads to an article."""
    low = F.lower(href)
    parts = [
        (F.regexp_extract(href, urls.PARTS, 2) == F.regexp_extract(url, urls.PARTS, 2), 3), (terms.contains_any(low, ARTICLE_HINTS), 3), (low.rlike(r"\d{4}/\d{2}/\d{2}"), 3),
        (terms.contains_any(F.lower(anchor), ANCHOR_WORDS), 2), (F.char_length(anchor).between(16, 140), 1), (terms.contains_any(low, EXCLUDED_HINTS), -10),
    ]
    return sum((F.when(c, n).otherwise(0) for c, n in parts), F.lit(0))


def candidate_links(pages: DataFrame, limit: int = 8) -> DataFrame:
    """The best links of each page, each once: score over 0, ties in page order. ``limit`` links a page are crawled."""
    links = page_links(pages).where("not feed and href like 'http%'")
    once = links.groupBy("page_id", "href").agg(F.min_by(F.struct("pos", "url", "anchor"), "pos").alias("x")).select("page_id", "href", "x.*")
    scored = once.withColumn("score", link_score(F.col("url"), F.col("href"), F.col("anchor"))).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= limit).drop("url")


def feed_urls(pages: DataFrame, limit: int = 6) -> DataFrame:
    """Feeds of each page: the linked ones, links that look like feeds, then the usual paths; the first ``limit`` are asked."""
    links = page_links(pages).where(F.col("feed") | terms.contains_any(F.lower("href"), FEED_PARTS)).select("page_id", "href", "pos")
    usual = pages.select("page_id", F.posexplode(F.transform(F.array(*map(F.lit, FEED_PATHS)), lambda p: F.concat(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1), p))).alias("i", "href")).select("page_id", "href", (F.col("i") + 1_000_000).cast("long").alias("pos"))
    once = links.unionByName(usual).groupBy("page_id", "href").agg(F.min("pos").alias("pos"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("rank") <= limit)


def hydrate(hits: DataFrame, pages: DataFrame, start: str, end: str) -> DataFrame:
    """Search hits (article_url, title, published_at, summary, category, tags, source_discovery, allow_search_only) with what their
    page says (page_articles). A hit without a page stays where ``allow_search_only`` and its own date allow it.
    """
    from ..functions import dates

    none = F.array().cast("array<string>")
    p = pages.select(F.col("url").alias("article_url"), *(F.col(c).alias(f"_{c}") for c in ("title", "published_at", "summary", "category", "tags", "body_excerpt")), F.lit(True).alias("_met"))
    p = p.groupBy("article_url").agg(*(F.first(c).alias(c) for c in p.columns if c != "article_url"))
    rows = hits.join(p, "article_url", "left")
    own, theirs = dates.parse(F.col("published_at")), dates.parse(F.col("_published_at"))
    inside = lambda t: dates.in_range(t, F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp") + F.expr("interval 1 day") - F.expr("interval 1 second"))
    title = text.first_present(F.col("_title"), F.col("title"))
    met = F.coalesce(F.col("_met"), F.lit(False)) & inside(F.coalesce(theirs, own)) & (title != "")
    alone = ~met & F.col("allow_search_only") & inside(own)
    tidy = lambda c: F.filter(F.transform(F.coalesce(c, none), text.clean), lambda x: x != "")
    merged = {
        "title": F.when(met, title).otherwise(text.clean(F.col("title"))),
        "published_at": F.when(met & theirs.isNotNull(), F.col("_published_at")).otherwise(F.col("published_at")),
        "summary": F.when(met, text.merged(F.col("_summary"), F.col("summary"), F.col("_body_excerpt"))).otherwise(text.clean(F.col("summary"))),
        "category": F.when(met, F.array_join(F.array_distinct(F.filter(F.array(text.clean(F.col("_category")), text.clean(F.col("category"))), lambda x: x != "")), " / ")).otherwise(text.clean(F.col("category"))),
        "tags": F.when(met, F.array_distinct(F.concat(tidy(F.col("_tags")), tidy(F.col("tags"))))).otherwise(tidy(F.col("tags"))),
        "source_discovery": F.when(met, F.col("source_discovery")).otherwise(F.concat("source_discovery", F.lit("_search_only"))),
    }
    keep = rows.where(met | alone)
    return keep.select(*(merged.get(c, F.col(c)).alias(c) for c in hits.columns if c != "allow_search_only"), F.when(met, F.col("_body_excerpt")).otherwise("").alias("body_excerpt"))


def html_text(c: Column) -> Column:
    """Text without markup unless the value is a bare URL; the usual character references are decoded."""
    bare = text.clean(c).rlike(r"^https?://\S+$")
    plain = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")
    for reference, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(reference), F.lit(sign))
    return F.when(bare, text.clean(c)).otherwise(text.clean(plain))
