"""Connectors by configuration, over stored pages: what to fetch, what the fetched pages list, and which articles that gives.

Fetching itself is a table: (url, status_code, html) of every page that a crawler stored. A connector states the URLs it wants
(``search_requests``, ``site_searches``), reads the stored answers, and joins the articles' own pages.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, context, dates, terms, text, urls
from . import feeds as feeds_of
from . import pages as P
from .dom import parse

#: URLs of the news searches, as feeds and as pages; engines' own hosts.
FEEDS = {"google": "https://news.google.com/rss/search?q={query}&hl={hl}&gl={gl}&ceid={ceid}", "bing": "https://www.bing.com/news/search?q={query}&format=rss&mkt={market}"}
PAGES = {"google": "https://news.google.com/search?q={query}&hl={hl}&gl={gl}&ceid={ceid}", "bing": "https://www.bing.com/news/search?q={query}&mkt={market}"}
ENGINE_HOSTS = ("news.google.com", "bing.com", "www.bing.com")
CONFIG = "struct<search_url_template:string,page_mode:string,offset_step:int,max_pages:int,max_terms:int,max_items_per_term:int,search_terms:array<string>,source_discovery:string,allow_search_only:boolean,require_search_result_date:boolean>"
_ITEMS = "domain string, term string, page int, item int, matched int, href string, title string, date_text string, summary string"


def quoted(c: Column) -> Column:
    """Text as a URL's parameter: everything but letters, digits and ``_.-~`` by its bytes."""
    out = F.url_encode(c)
    for sign, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def _filled(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), value.cast("string"))
    return template


def valid_config(configs: DataFrame) -> DataFrame:
    """domain, config (JSON) with ``valid``: a search template with a place for the query, selectors of items and links."""
    c = F.from_json("config", "struct<search_url_template:string,item_selector:string,link_selector:string>")
    filled = lambda f: text.clean(c[f]) != ""
    return configs.withColumn("valid", F.coalesce(F.contains(c["search_url_template"], F.lit("{query}")) & filled("item_selector") & filled("link_selector"), F.lit(False)))


def search_requests(configs: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """domain, term, place, page, url: the pages that each configured site is searched by. asked: the terms of this run; without
    them the configuration's own. A site's ``max_terms`` and ``max_pages`` bound what it is asked for."""
    c = F.from_json("config", CONFIG)
    rows = configs.select("domain", c.alias("c")).where("c.search_url_template is not null")
    terms_of = F.array(*map(F.lit, asked)) if asked else F.coalesce("c.search_terms", F.array().cast("array<string>"))
    tidy = F.filter(F.transform(terms_of, text.clean), lambda t: t != "")
    some = F.when(F.coalesce("c.max_terms", F.lit(0)) > 0, F.slice(tidy, 1, F.greatest(F.col("c.max_terms"), F.lit(1)))).otherwise(tidy)
    each = rows.select("domain", "c", F.posexplode(some).alias("place", "term")).withColumn("page", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(F.nullif("c.max_pages", F.lit(0)), F.lit(1)), F.lit(1)) - 1)))
    step = F.coalesce(F.nullif("c.offset_step", F.lit(0)), F.lit(10))
    url = _filled(text.clean(F.col("c.search_url_template")), {"query": quoted(F.col("term")), "raw_query": F.col("term"), "page": F.col("page") + 1, "offset": F.col("page") * step})
    return each.select("domain", "term", "place", "page", url.alias("url"))


def listed_items(requests: DataFrame, fetched: DataFrame, configs: DataFrame) -> DataFrame:
    """domain, term, page, item, matched, href, title, date_text, summary of the items on the stored search pages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                config = json.loads(r.config)
                get = lambda k, d="": (config.get(k) or d).strip()  # noqa: B023, E731
                found = parse(r.html).select(get("item_selector")) if get("item_selector") else []
                most = int(config.get("max_items_per_term") or 0)

                def value(node, kind):
                    target = node.first(get(f"{kind}_selector")) if get(f"{kind}_selector") else None  # noqa: B023
                    return "" if target is None else " ".join(target.attrs.get(get(f"{kind}_attr"), "").split()) if get(f"{kind}_attr") else target.text()  # noqa: B023

                for i, node in enumerate(found[: most or None]):
                    link = node.first(get("link_selector")) if get("link_selector") else None
                    href = (link.attrs.get(get("link_attr", "href")) or "").strip() if link is not None else ""
                    if not href:
                        continue
                    try:
                        href = urljoin(r.url, href)
                    except ValueError:
                        continue
                    if get("link_pattern") not in href:
                        continue
                    rows.append((r.domain, r.term, r.page, i, len(found), href, value(node, "title") if get("title_selector") else link.text(), value(node, "date"), value(node, "summary")))
                if not found:
                    rows.append((r.domain, r.term, r.page, -1, 0, None, None, None, None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _ITEMS.split(", ")])

    rows = requests.join(fetched.select("url", "html"), "url").join(configs.select("domain", "config"), "domain")
    return rows.select("domain", "term", "page", "url", "html", "config").mapInPandas(run, _ITEMS)


def date_of(c: Column) -> Column:
    """A date as the sites write it: ISO, a feed's, or with a month's name."""
    t = text.clean(c)
    return F.coalesce(dates.parse(t), *(F.try_to_timestamp(t, F.lit(f)) for f in ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")))


def configured_articles(requests: DataFrame, fetched: DataFrame, configs: DataFrame, start: str, end: str) -> DataFrame:
    """Articles of configured sites: listed items up to a term's first empty page, each URL once, with what their page says."""
    items = listed_items(requests, fetched, configs)
    empty = items.where("matched = 0").groupBy("domain", "term").agg(F.min("page").alias("stop"))
    live = items.where("href is not null").join(empty, ["domain", "term"], "left").where("stop is null or page < stop")
    place = requests.groupBy("domain", "term").agg(F.min("place").alias("place"))
    c = F.from_json("config", CONFIG)
    settings = configs.select("domain", F.coalesce(F.nullif(text.clean(c["source_discovery"]), F.lit("")), F.lit("configured_search")).alias("source_discovery"), F.coalesce(c["allow_search_only"], F.lit(False)).alias("allow_search_only"), F.coalesce(c["require_search_result_date"], F.lit(False)).alias("dated"))
    rows = live.join(place, ["domain", "term"]).join(settings, "domain").withColumn("published_at", F.date_format(date_of(F.col("date_text")), "yyyy-MM-dd'T'HH:mm:ss")).where("not dated or published_at is not null")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("domain", "href").orderBy("place", "page", "item"))).where("_n = 1")
    none = F.array().cast("array<string>")
    hits = first.select(F.col("href").alias("article_url"), "title", "published_at", "summary", F.lit("").alias("category"), none.alias("tags"), "source_discovery", "allow_search_only")
    known = P.page_articles(fetched.join(hits.select(F.col("article_url").alias("url")).distinct(), "url", "left_semi").select(F.xxhash64("url").alias("page_id"), "url", "html"))
    return P.hydrate(hits, known, start, end)


def configured_diagnostics(requests: DataFrame, fetched: DataFrame, configs: DataFrame) -> DataFrame:
    """domain, search_endpoint_status, selector_match_count, parsed_date_count of each configured site."""
    asked = requests.join(fetched.select("url", "status_code"), "url").groupBy("domain").agg(F.min_by("status_code", F.struct("place", "page")).alias("code"))
    items = listed_items(requests, fetched, configs)
    counts = items.groupBy("domain").agg(F.count_if(F.col("matched") > 0).alias("selector_match_count"), F.count(date_of(F.col("date_text"))).alias("parsed_date_count"))
    return asked.join(counts, "domain", "left").select("domain", F.concat(F.lit("http_"), F.col("code").cast("string")).alias("search_endpoint_status"), F.coalesce("selector_match_count", F.lit(0)).alias("selector_match_count"), F.coalesce("parsed_date_count", F.lit(0)).alias("parsed_date_count"))


def listing_articles(listings: DataFrame, fetched: DataFrame, start: str, end: str, asked: list[str] | None = None, source_discovery: str = "listing", limit: int = 18) -> DataFrame:
    """Articles that listing pages (page_id, url, html) link to on their own host: score over 0, a term in anchor or URL, the best
    ``limit`` links of a page (what a crawl follows), each article once."""
    links = P.page_links(listings).where("not feed and href like 'http%'").where(urls.host(F.col("href")) == urls.host(F.col("url")))
    links = links.where(terms.matches_search_terms(F.concat_ws(" ", "anchor", "href"), asked or []))
    once = links.groupBy("page_id", "href").agg(F.min_by(F.struct("pos", "url", "anchor"), "pos").alias("x")).select("page_id", "href", "x.*")
    scored = once.withColumn("score", P.link_score(F.col("url"), F.col("href"), F.col("anchor"))).where("score > 0")
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "pos"))).where(F.col("_n") <= limit)
    hints = best.groupBy("href").agg(F.min_by("anchor", F.struct("page_id", "pos")).alias("title"))
    none = F.array().cast("array<string>")
    blank = F.lit("")
    hits = hints.select(F.col("href").alias("article_url"), "title", F.lit(None).cast("string").alias("published_at"), blank.alias("summary"), blank.alias("category"), none.alias("tags"), F.lit(source_discovery).alias("source_discovery"), F.lit(False).alias("allow_search_only"))
    known = P.page_articles(fetched.join(hits.select(F.col("article_url").alias("url")), "url", "left_semi").select(F.xxhash64("url").alias("page_id"), "url", "html"))
    return P.hydrate(hits, known, start, end)


def engine_url(engine: Column, query: Column, country: dict[str, str], page: bool = False) -> Column:
    """The URL of a news search. country: hl, gl, ceid, market."""
    values = {"query": quoted(query)} | {k: F.lit(v) for k, v in country.items()}
    table = PAGES if page else FEEDS
    return F.when(engine == "google", _filled(F.lit(table["google"]), values)).otherwise(_filled(F.lit(table["bing"]), values))


def site_searches(asked: list[str], domains: list[str], country: dict[str, str], spark, engines: tuple[str, ...] = ("google", "bing"), most: int = 4) -> DataFrame:
    """term, domain, engine, url: the news searches of a few sites by the first ``most`` terms."""
    some = list(dict.fromkeys(" ".join(t.split()) for t in asked if t.strip()))[:most]
    rows = [(i, t, d, e) for i, t in enumerate(some) for d in dict.fromkeys(x.strip() for x in domains if x.strip()) for e in engines]
    df = spark.createDataFrame(rows, "place int, term string, domain string, engine string")
    return df.withColumn("url", engine_url(F.col("engine"), F.concat("term", F.lit(" site:"), "domain"), country))


def site_search_articles(searches: DataFrame, feeds: DataFrame, fetched: DataFrame, start: str, end: str, source_discovery: str = "site_search") -> DataFrame:
    """Articles that the stored feeds (feed_url, xml) of site searches name, on the wanted hosts or behind an engine's link."""
    items = feeds_of.feed_items(feeds, start, end).join(searches.select(F.col("url").alias("feed_url"), "term", "domain", "place").distinct(), "feed_url")
    behind = urls.in_domain(F.col("article_url"), *ENGINE_HOSTS)
    wanted = items.where(behind | (urls.host(F.col("article_url")) == F.lower("domain")))
    said = F.lower(F.concat_ws(" ", "title", "summary"))
    wanted = wanted.where(said.contains(F.lower("term")))
    first = wanted.withColumn("_n", F.row_number().over(Window.partitionBy("article_url").orderBy("place", "domain", "pos"))).where("_n = 1")
    none = F.array().cast("array<string>")
    hits = first.select("article_url", "title", F.date_format("published_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"), "summary", F.lit("").alias("category"), none.alias("tags"), F.lit(source_discovery).alias("source_discovery"), F.lit(True).alias("allow_search_only"))
    known = P.page_articles(fetched.join(hits.select(F.col("article_url").alias("url")), "url", "left_semi").select(F.xxhash64("url").alias("page_id"), "url", "html"))
    return P.hydrate(hits, known, start, end)


def dispatch(sources: DataFrame, configs: DataFrame, official: DataFrame) -> DataFrame:
    """Sources (source_url, side) with ``adapter``: official (a buyer's or seller's own host), configured (its domain, or one above
    it, has a configuration), else generic."""
    from .files import config_for

    own = official.select(urls.host(F.col("target_url")).alias("_host")).distinct().withColumn("_own", F.lit(True))
    found = config_for(sources.select(F.col("source_url").alias("url")).distinct(), configs.select("domain", "config")).select(F.col("url").alias("_url"), F.lit(True).alias("_set"))
    rows = sources.join(own, urls.host(F.col("source_url")) == F.col("_host"), "left").join(found, F.col("source_url") == F.col("_url"), "left")
    kind = F.when((F.col("side") != "media") & F.col("_own"), "official").when(F.col("_set"), "configured").otherwise("generic")
    return rows.select(*sources.columns, kind.alias("adapter"))


def with_source(articles: DataFrame, side: str, platform: str, source_url: str, matched: Column, country: str) -> DataFrame:
    """Articles of one source that it keeps, with its context: platform, side, source, site and the brands matched."""
    kept, brands = context.keeps_article(F.lit(side), matched, context.matched_text(articles), F.lit(platform))
    rows = text.let(articles.where(kept), "matched_brands", brands)
    label = F.when(F.lit(side != "media"), F.lit(platform)).when(F.size("matched_brands") == 0, "Unassigned Media Match").otherwise(F.array_join(F.array_distinct("matched_brands"), ", "))
    return rows.withColumns({"platform": label, "platform_label": label, "source_platform": F.lit(platform), "side": F.lit(side), "source_url": F.lit(source_url), "source_site": urls.host(F.lit(source_url)), "country_code": F.lit(country)})


def with_search(articles: DataFrame, task: dict[str, str], country: str) -> DataFrame:
    """Articles of a search task with its context. task: type, dimension, label, query, platform, source_platform, engine, feed_url,
    page_url, strategy. Reports without a brand are of all brands."""
    from ..functions.classify import guess_country

    own = F.filter(F.transform(F.coalesce(F.col("matched_brands"), F.array().cast("array<string>")), text.clean), lambda x: x != "") if "matched_brands" in articles.columns else F.array().cast("array<string>")
    rows = text.let(articles.drop("matched_brands"), "_own", own) if "matched_brands" not in articles.columns else text.let(articles, "_own", own).drop("matched_brands")
    some = F.size("_own") > 0
    label = F.when(some, text.brand_list(F.col("_own"))).otherwise(F.lit(task["platform"]))
    platform = F.when(F.lit(task["type"] == "report_ranking") & ~some, "Cross-brand report").otherwise(label)
    return rows.select(
        *(c for c in rows.columns if c != "_own" and c not in ("platform", "platform_label", "side", "source_url", "source_site")), platform.alias("platform"), label.alias("platform_label"), F.lit(task.get("source_platform") or task["platform"]).alias("source_platform"), F.lit("search_engine").alias("side"),
        F.lit(task["page_url"]).alias("source_url"), F.lit(task["page_url"]).alias("source_final_url"), F.lit(task["feed_url"]).alias("source_feed_url"), F.regexp_extract(F.lit(task["page_url"]), urls.PARTS, 2).alias("source_site"), guess_country(F.col("article_url")).alias("source_country_guess"),
        F.when(some, F.col("_own")).otherwise(F.array(F.lit(task["platform"]))).alias("matched_brands"), F.lit(task["type"]).alias("search_task_type"), F.lit(task.get("dimension", "")).alias("search_focus_dimension"), F.lit(task["label"]).alias("search_query_label"),
        F.lit(task.get("strategy", "")).alias("search_query_strategy"), F.lit(task["query"]).alias("search_query"), F.lit(country).alias("country_code"),
    )


#: Strategies of searches whose hits need a context of their market.
BROAD = ("platform_broad_eu_global", "platform_broad_short")


def judged_hits(hits: DataFrame, tasks: DataFrame) -> DataFrame:
    """Hits of search tasks with kept, skipped (the reason; empty where kept), allowed (reasons to keep what a rule alone would
    not), matched_brands and broad_entry_reason as they are admitted.

    hits: task_id, pos, article_url, met (its page or its own date is in range), matched_brands, broad_reason (what its text says of a
    broad market), report_like, commerce (strong, weak or empty) and no_commerce_reason, of its own text each. tasks: task_id,
    task_type, platform_label, query_strategy, broad_allowed, needs_commerce, a row each. A task's first hit of a URL is judged, and
    is known from then on, admitted or not; the order of tasks plays no part. A task without hits has none here.
    """
    said = lambda c: text.clean(F.col(c))
    none = F.array().cast("array<string>")
    t = tasks.select("task_id", *(F.col(c).alias(f"_{c}") for c in ("task_type", "platform_label", "query_strategy", "broad_allowed", "needs_commerce")))
    rows = hits.join(t, "task_id")
    url = said("article_url")
    # One pass: a row number over the task's URL stands for the set of URLs seen.
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("task_id", url).orderBy("pos")))
    broad = said("_query_strategy").isin(*BROAD)
    needs, report = F.coalesce("_needs_commerce", F.lit(False)), F.coalesce("_task_type", F.lit("")) == "report_ranking"
    reason = F.when(broad | (F.coalesce("_broad_allowed", F.lit(False)) & needs), said("broad_reason")).otherwise("")
    rows = text.let(rows, "_broad", F.struct(reason.alias("reason"), broad.alias("asked")))
    own = F.coalesce("matched_brands", none)
    named = F.array_contains(own, F.col("_platform_label"))
    has = F.col("_broad.reason") != ""
    strength = F.when(said("commerce") != "", said("commerce")).when(has, "weak").otherwise("")
    skipped = classify.first_match(
        [
            ((url == "") | (F.col("_n") > 1), "duplicate_or_empty_url"), (~F.coalesce("met", F.lit(False)), "no_metadata_or_out_of_range"),
            (report & ((F.size(own) == 0) | ~F.coalesce("report_like", F.lit(False))), "report_not_matched"), (~report & ~F.coalesce(named, F.lit(False)) & ~has, "platform_not_matched"),
        ],
        "",
    )
    skipped = F.when(skipped != "", skipped).when(~report & needs & (strength == ""), said("no_commerce_reason")).when(~report & F.col("_broad.asked") & ~has, "broad_entry_context_not_matched").otherwise("")
    rows = text.let(rows, "_skipped", skipped)
    past = ~report & ~F.col("_skipped").isin("duplicate_or_empty_url", "no_metadata_or_out_of_range", "platform_not_matched")
    forced = past & ~F.coalesce(named, F.lit(False)) & has
    # What a rule allowed is told even where a later one turned the hit down.
    allowed = F.array_compact(F.array(F.when(forced, "broad_entry_platform_context_allowed"), F.when(past & needs & (strength == "weak"), "instagram_weak_commerce_allowed")))
    kept = F.col("_skipped") == ""
    out = {"kept": kept, "skipped": F.col("_skipped"), "allowed": allowed, "matched_brands": F.when(forced, F.array("_platform_label")).otherwise(own), "broad_entry_reason": F.when(kept, F.col("_broad.reason")).otherwise("")}
    return rows.select(*(c for c in hits.columns if c not in out), *(v.alias(k) for k, v in out.items()))


def search_diagnostics(judged: DataFrame, tasks: DataFrame) -> DataFrame:
    """The tasks with feed_count, kept_count, broad_entry_count and the counts of each reason, of ``judged_hits``; zeros and empty
    maps for a task without hits."""
    each = judged.groupBy("task_id").agg(F.count("*").alias("feed_count"), F.count_if("kept").alias("kept_count"), F.count_if((F.col("broad_entry_reason") != "") & F.col("kept")).alias("broad_entry_count"))
    told = judged.select("task_id", F.explode(F.concat(F.when(F.col("skipped") != "", F.array(F.struct(F.lit("s").alias("kind"), F.col("skipped").alias("reason")))).otherwise(F.array().cast("array<struct<kind:string,reason:string>>")), F.transform("allowed", lambda r: F.struct(F.lit("a").alias("kind"), r.alias("reason"))))).alias("r"))
    counted = told.groupBy("task_id", "r.kind", "r.reason").agg(F.count("*").alias("n"))
    # A few reasons a task.
    maps = counted.groupBy("task_id").agg(*(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("reason", "n"))))).alias(name) for k, name in (("s", "skipped_reason_count"), ("a", "allowed_reason_count"))))
    empty = F.create_map().cast("map<string,bigint>")
    out = tasks.join(each, "task_id", "left").join(maps, "task_id", "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("feed_count", "kept_count", "broad_entry_count")} | {c: F.coalesce(c, empty) for c in ("skipped_reason_count", "allowed_reason_count")}
    return out.select(*tasks.columns, *(v.alias(k) for k, v in zeros.items()))
