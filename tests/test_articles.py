"""Events, fills, briefings, summaries, connectors, spreadsheets and requests on rows of our own."""

import difflib
import itertools
import json
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazette.functions import classify, context, lexicon, text
from gazette.operators import briefing, browse, dedup, enrich, export, funnel, labels, messages, similar, store, summary, survey
from gazette.plans import run as run_plan
from gazette.sources import adapters, dom, feeds, pages, sheets, tables


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


# --- events ---


def key(t):
    t = re.sub(r"\s*[|〜~\-–—:：]\s*", " ", " ".join((t or "").split()).lower())
    return " ".join(re.sub(r"[^0-9a-z一-鿿぀-ヿ]+", " ", t).split())


def same_title(a, b):
    """The rule for titles without a source's name, by loops."""
    x, y = key(a), key(b)
    if not x or not y:
        return False
    if x == y or (min(len(x), len(y)) >= 16 and (x in y or y in x)):
        return True
    s, t = ({w for w in v.split() if len(w) >= 2} for v in (x, y))
    ratio = difflib.SequenceMatcher(None, x, y).ratio()
    if not s or not t:
        return ratio >= 0.82
    share = len(s & t) / len(s | t)
    return ratio >= 0.76 or (ratio >= 0.74 and share >= 0.55) or share >= 0.82


def same_event(a, b):
    if same_title(a[0], b[0]):
        return True
    x, y = (" ".join(p for p in (r[0], r[0], r[1], r[1]) if p) for r in (a, b))
    tokens = [{w for w in key(v).split() if len(w) >= 3 and w not in {"news", "report", "update", "media"}} for v in (x, y)]
    numbers = [{n for m in re.findall(r"\d[\d., ]*\d|\d", v) if len(n := re.sub(r"\D", "", m)) >= 3 and not re.fullmatch(r"(19|20)\d\d", n)} for v in (x, y)]
    kinds = [{k for k, words in text.EVENT_PHRASES.items() if any(w in key(v) for w in words)} for v in (x, y)]
    common, titles = tokens[0] & tokens[1], {w for w in key(a[0]).split() if len(w) >= 2} & {w for w in key(b[0]).split() if len(w) >= 2}
    if numbers[0] & numbers[1] and (kinds[0] & kinds[1] or len(common) >= 4):
        return True
    if not key(x) or not key(y):
        return False
    ratio = difflib.SequenceMatcher(None, key(x), key(y)).ratio()
    if not tokens[0] or not tokens[1]:
        return ratio >= 0.84
    share = len(common) / len(tokens[0] | tokens[1])
    return ratio >= 0.88 or (len(titles) >= 3 and len(common) >= 4) or (len(titles) >= 2 and len(common) >= 5) or (ratio >= 0.8 and share >= 0.48) or (share >= 0.68 and len(common) >= 6)


def event_rows():
    rng = np.random.default_rng(4)
    words = ["market", "seller", "fees", "payment", "cash", "points", "delivery", "refund", "fine", "investigation", "growth", "shop", "prime", "day", "sales", "policy", "privacy", "store", "launch", "trend"]
    rows = []
    for i in range(45):
        title = " ".join(rng.choice(words, rng.integers(2, 7)))
        body = " ".join(rng.choice(words + ["1,200 stores", "45000 users", "in 2024", "cash payment"], rng.integers(0, 14)))
        rows.append((i, title, body))
    for k in range(15):
        i, t, b = rows[3 * k]
        rows.append((45 + k, t + rng.choice(["", " now", "s", " again today"]), rng.choice([b, b + " more", "other words only"])))
    return rows


def test_event_rules_against_loops(spark):
    rows = event_rows()
    df = spark.createDataFrame([(i, "Shop", t, b, "2024-01-%02d" % (1 + i % 10)) for i, t, b in rows], "pos long, platform string, title string, summary string, published_at string")
    events = dedup.event_rows(df)
    every = events.select(F.col("pos").alias("a")).join(events.select(F.col("pos").alias("b")), F.col("a") < F.col("b"))
    got = {(r["a"], r["b"]) for r in dedup.similar_events(every, events).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if same_event(a[1:], b[1:])}
    assert got == want and 20 < len(want) < len(rows) * (len(rows) - 1) / 2
    blocked = {(r["a"], r["b"]) for r in dedup.event_candidates(events).collect()}
    # What the blocks leave out resembles letter by letter only.
    assert all(not ({w for w in key(rows[a][1]).split()} & {w for w in key(rows[b][1]).split()}) for a, b in want - blocked)
    clusters = {r["node"]: r["cluster"] for r in dedup.event_clusters(df).collect()}
    assert all(clusters[a] == clusters[b] for a, b in want & blocked)


def test_events_keep_brands_and_days_apart(spark):
    rows = [(0, "Shop", "Fees rise for all sellers", "2024-01-01"), (1, "Shop", "Fees rise for all sellers now", "2024-01-05"), (2, "Shop", "Fees rise for all sellers", "2024-02-01"), (3, "Other", "Fees rise for all sellers", "2024-01-01"), (4, "Shop", "", "2024-01-01")]
    df = spark.createDataFrame([(*r[:3], "", r[3]) for r in rows], "pos long, platform string, title string, summary string, published_at string")
    assert {r["node"]: r["cluster"] for r in dedup.event_clusters(df).collect()} == {0: 0, 1: 0}
    scorer = lambda members: {members[0]["pos"]}
    assert sorted(r["pos"] for r in dedup.scored_dedupe(df, dedup.event_clusters(df), scorer).collect()) == [0, 2, 3, 4]

    def broken(members):
        raise RuntimeError

    assert dedup.scored_dedupe(df, dedup.event_clusters(df), broken).count() == 5


def test_statistics_and_samples(spark):
    rows = [(0, "Shop", "Fees go up in spring", "2024-01-02", "a", "", "x"), (1, "Shop", "Fees go up in spring", "2024-01-02", "a", "", "yy"), (2, "", "", "", "", "", "same words"), (3, "", "", "", "", "", "same words"), (4, "Shop", "t", "2024-01-02", "a", "https://a.example/1", ""), (5, "Shop", "u", "2024-01-02", "b", "https://A.example/1?utm_source=1", "")]
    df = spark.createDataFrame(rows, "pos long, platform string, title string, published_at string, source_site string, article_url string, summary string")
    assert {r["reason"]: r["removed"] for r in dedup.dedupe_stats(df).collect()} == {"same_source_title_duplicate": 1, "weak_key_duplicate": 1, "url_duplicate": 1}
    assert dedup.dedupe_summary(df).first().asDict() == {"input_count": 6, "missing_url_count": 4, "group_count": 3, "output_count": 3, "removed_count": 3}
    samples = dedup.removed_samples(df).collect()
    assert [r["reason"] for r in samples] == ["same_source_title_duplicate", "weak_key_duplicate", "url_duplicate"] and samples[2]["source_sites"] == ["a", "b"] and dedup.removed_samples(df, 2, 1).collect()[0]["titles"] == ["Fees go up in spring"]
    out = {r["pos"]: r for r in dedup.initial_dedupe(df).collect()}
    assert out[0]["summary"] == "yy" and out[4]["source_site"] == "a | b"


def test_weak_key_takes_the_original_summary(spark):
    rows = [(0, "same", "one"), (1, "same", "two"), (2, "other", "one")]
    df = spark.createDataFrame(rows, "pos long, summary string, summary_translated string")
    assert dedup.initial_dedupe(df).count() == 2


# --- fill, context ---


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_fill_against_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    brands = ["a", "b", "c", "d"]
    rows = [(i, "2024-01-%02d" % rng.integers(1, 22), sorted(set(rng.choice(brands, rng.integers(1, 4)).tolist())), "2024-01-01T%02d" % rng.integers(0, 24)) for i in range(150)]
    kept = [("2024-01-%02d" % rng.integers(1, 22), [str(rng.choice(brands))]) for _ in range(20)]
    week = lambda d: (int(d[-2:]) - 1) // 7  # noqa: E731  2024-01-01 is a Monday
    count = Counter((b, week(d)) for d, bs in kept for b in bs)
    want = []
    for i, d, bs, _ in sorted(rows, key=lambda r: ([-ord(c) for c in r[3]], r[0])):
        thin = [b for b in bs if count[b, week(d)] < 7]
        if thin:
            want.append(i)
            for b in thin:
                count[b, week(d)] += 1
    c = spark.createDataFrame(rows, "pos long, day string, brands array<string>, stamp string").withColumn("day", F.col("day").cast("date"))
    k = spark.createDataFrame(kept, "day string, brands array<string>").withColumn("day", F.col("day").cast("date"))
    assert sorted(r["pos"] for r in funnel.greedy_fill(c, k).collect()) == sorted(want)
    assert funnel.greedy_fill(c.limit(0), k).count() == 0


def test_context_rules(spark):
    f = lambda column, t: one(spark, column(F.col("x")), x=t)
    assert f(context.only_noise, "a baseball match") and not f(context.only_noise, "a baseball match and a coupon") and not f(context.in_trade_context, "")
    assert [f(context.shop_strength, t) for t in ("Instagram Shopping for all", "creator economy news", "holiday photos")] == ["strong", "weak", ""]
    assert f(context.shop_skip_reason, "a concert") == "instagram_entertainment_noise" and f(context.shop_skip_reason, "new followers") == "instagram_account_or_influencer_noise"
    assert f(lambda c: context.shop_strength(c, True), "il negozio Instagram") == "strong"
    assert f(lambda c: context.foreign_only(c, ["italy"]), "news from Greece") and not f(lambda c: context.foreign_only(c, ["italy"]), "news from Greece and Italy")
    assert f(context.single_coverage, "Sony WH-1000XM5 review") and not f(context.single_coverage, "fees rise for all")
    assert [f(text.mostly_chinese, t) for t in ("平台政策", "平台 policy of all shops", "プラットフォーム政策", "")] == [True, False, False, False]
    assert one(spark, context.hard_filter_wording(F.col("x"), "意大利市场", "意大利消费者"), x="foreign_market").startswith("新闻主要针对非意大利市场") and f(lambda c: context.hard_filter_wording(c, "a", "b"), "") == ""
    assert one(spark, context.exclusion_category(F.col("a"), F.col("b"), F.col("c")), a="a note", b="", c="low") == "low_confidence_or_weak_link"
    df = spark.createDataFrame([(1, "media", ["A"], "a coupon"), (2, "media", [], "a coupon"), (3, "media", ["A"], "baseball"), (4, "buyer", [], "x"), (5, "buyer", ["B"], "x")], "pos int, side string, m array<string>, t string")
    kept, brands = context.keeps_article(F.col("side"), F.col("m"), F.col("t"), F.lit("Own"))
    assert {r[0]: (r[1], r[2]) for r in df.select("pos", kept, brands).collect()} == {1: (True, ["A"]), 2: (False, []), 3: (False, []), 4: (True, ["Own"]), 5: (True, ["B"])}
    assert "data" in lexicon.TREND_MARKET and lexicon.TREND_MARKET[0] == "market share" and "report" in lexicon.REPORT_SIGNALS


# --- reports ---


def test_briefing_answers(spark, tmp_path):
    rows = [("1", "Prime deals", "words", "Price", "AMZ", "2024-01-03T08:00:00"), ("2", "x", "", "", "AMZ", "soon")]
    df = spark.createDataFrame(rows, "article_id string, title string, summary string, survey_dimensions string, platform_label string, published_at string")
    answers = spark.createDataFrame([("1", "意大利 Prime 会员", "up", "maybe", "N"), ("2", "users", "sideways", "Content", "")], ["article_id", "Key User Segment Affected", "Impact Direction on NPS (Up / Down / Neutral)", "Impacted NPS Metric (Price / Trust / Fulfillment / Content / Assortment)", "Include in Client Readout (Y/N)"])
    out = {r["article_id"]: r for r in briefing.briefing_table(df, "意大利", "it", "2024-02-01", answers).collect()}
    assert out["1"].__fields__[1:] == briefing.HEADERS
    assert [out["1"][h] for h in ("Key User Segment Affected", "NPS Overall Change", "Impacted NPS Metric (Price / Trust / Fulfillment / Content / Assortment)", "Include in Client Readout (Y/N)", "Tracking Week", "Publish Date")] == ["意大利 Prime 会员", "↑", "Price", "N", "2024 W01", "1/3/2024"]
    assert [out["2"][h] for h in ("Key User Segment Affected", "NPS Overall Change", "Impacted NPS Metric (Price / Trust / Fulfillment / Content / Assortment)", "Core Summary", "Publish Date", "Tracking Week")] == ["意大利平台买家", "→", "Content", "x", "soon", "2024 W05"]
    briefing.write_briefing(briefing.briefing_table(df, "意大利", "it", "2024-02-01"), str(tmp_path / "table"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "table")).columns == briefing.HEADERS
    for value, wanted in (("", True), ("用户", True), ("意大利用户", True), ("buyers", True), ("意大利平台卖家", False)):
        assert one(spark, briefing.empty_segment(F.col("x"), "意大利"), x=value) is wanted


def test_summaries(spark):
    rows = [("1", "Fees rise", "Sellers pay more from May on. https://a.example", "amazon", "", "2024-01-03", "Daily", "https://a.example/1", "ok"), ("2", "Law of the European Commission", "", "Temu", "true", "", "", "", "")]
    df = spark.createDataFrame(rows, "article_id string, title string, summary string, platform_label string, industry_trend_flag string, published_at string, source_name string, article_url string, article_body_fetch_status string")
    answers = spark.createDataFrame([("1", "【amazon】", "Fees rise for sellers。", "A long detail " * 10 + "B5_18: 题项。", "利好", ["coupon", "Price", "Own 标签", "more"], ["a", "b", "a"])], "article_id string, platform_label string, core_claim string, detail string, sentiment string, tags array<string>, evidence_points array<string>")
    items = summary.summary_items(df, "意大利", answers)
    got = {r["article_id"]: r for r in items.collect()}
    assert (got["1"]["platform"], got["1"]["core_claim"], got["1"]["sentiment"], got["1"]["evidence_points"]) == ("AMZ", "Fees rise for sellers", "正向", ["a", "b"])
    assert got["1"]["tags"] == ["品牌形象", "促销活动", "商品价格"] and "B5_18" not in got["1"]["detail"] and got["1"]["needs_review"] is False
    assert got["2"]["platform"] == "EU行业" and got["2"]["needs_review"] is True and got["2"]["detail"].startswith("近期媒体消息，")
    sheet = {r["article_id"]: r for r in summary.summary_rows(df, items).collect()}
    assert sheet["1"]["发布时间"] == "2024年1月3日" and sheet["1"]["完整汇报文案"].endswith("媒体【正向】【品牌形象】【促销活动】【商品价格】") and sheet["2"]["媒体"] == ""
    lines = {r["article_id"]: r["html"] for r in summary.html_lines(summary.summary_rows(df, items)).collect()}
    assert '<a href="https://a.example/1">媒体</a>' in lines["1"] and "<a" not in lines["2"]


def test_labels(spark):
    f = lambda column, t: one(spark, column(F.col("x")), x=t)
    normal = lambda c: labels.normal_keywords(c, "(a)\n(b)\n(c)", ["(x)"])
    assert [f(normal, t) for t in ("", "(a)\n(b)\n(c)", "(a)\n(b)", "(x)", "(own)")] == ["(a)\n(b)\n(c)"] * 4 + ["(own)"]
    assert f(labels.alias_map, "Shop: a, b\nbad\nX=c\nShop: d") == {"Shop": ["d"], "X": ["c"]}
    assert one(spark, labels.alias_text(F.create_map(F.lit("b"), F.array(F.lit("1")), F.lit("a"), F.array(F.lit("2"), F.lit("3"))), ["b"]), x=1) == "b: 1\na: 2, 3"
    made = labels.generated_aliases(spark.createDataFrame([("Temu",), ("TTS",)], "platform string"), ["Italy", "Italian"], "it").collect()
    assert made[0]["aliases"] == ["Temu", "Temu Italy", "Temu IT", "TEMU", "TEMU Italy", "TEMU IT", "temu.it"] and "TikTok Italian" in made[1]["aliases"]
    assert [f(enrich.platform_concept, t) for t in ("INS-DTC", "tt shop", "Amazon.it", "x")] == ["instagram_shopping", "tiktok_shop", "amazon", ""]


# --- pages and connectors ---


def test_tree():
    root = dom.parse('<div id=a class="x y"><ul><li>1<li><b>2</b> &amp; 3</ul><p>t<p>u<br>v</div><a href="/n" rel=tag>n</a>')
    assert [n.text() for n in root.select("ul li")] == ["1", "2 & 3"] and [n.text() for n in root.select("div.x > p, #a b")] == ["2", "t", "u v"]
    assert root.first("li:last-child").text() == "2 & 3" and root.first('a[rel="tag"]').attrs["href"] == "/n" and root.select("[class*=y]") and not root.select("p:nth(2)")
    assert dom.parse(None).text() == "" and dom.parse("<" * 50).text()


PAGE = """<html><head><meta property="og:title" content="T"><meta name="keywords" content="a, b|c"><meta property="article:tag" content="d"><meta property="article:section" content="Shops">
<meta name="description" content="Said of it."><meta name="pubdate" content="2024-01-03"></head><body><nav aria-label="breadcrumb"><ul><li>Home</li><li>News</li></ul></nav><article><p>%s</p><p>short</p></article><div class="tags"><a>e</a></div>
<a href="/business/2024/01/02/x">A business story with a long text</a><a href="/login">login for news</a><a href="https://b.example/feed">f</a><link rel="alternate" type="application/rss+xml" href="/r.xml"></body></html>""" % (
    "A paragraph of the body, long enough to count. " * 30
)


def test_page_metadata(spark):
    df = spark.createDataFrame([(1, "https://a.example/p", PAGE), (2, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pages.page_articles(df).collect()}[1]
    assert (got["title"], got["published_at"], got["category"], got["tags"]) == ("T", "2024-01-03", "Shops", ["a", "b", "c", "d", "e"])
    assert len(got["body_excerpt"]) > 1200 and got["summary"].startswith("Said of it. A paragraph") and pages.page_articles(df, 100).first()["body_excerpt"] == got["body_excerpt"][:100].strip()
    assert [(r["href"], r["score"]) for r in pages.candidate_links(df.where("page_id = 1")).collect()] == [("https://a.example/business/2024/01/02/x", 12)]
    assert [r["href"] for r in pages.feed_urls(df.where("page_id = 1")).orderBy("rank").collect()] == ["https://a.example/r.xml", "https://b.example/feed", *(f"https://a.example{p}" for p in ("/feed", "/rss", "/feed.xml", "/rss.xml"))]


def test_feed_categories(spark):
    xml = "<rss><channel><item><title>A</title><link>u</link><pubDate>Tue, 02 Jan 2024 08:00:00 +0000</pubDate><category>x &amp; y</category><category><![CDATA[z]]></category></item></channel></rss>"
    out = feeds.feed_items(spark.createDataFrame([("f", xml)], "feed_url string, xml string"), "2024-01-01", "2024-01-03").collect()
    assert out[0]["categories"] == ["x & y", "z"]


CONFIG = {"search_url_template": "https://s.example/q?k={query}&p={page}&o={offset}", "max_pages": 3, "max_terms": 1, "item_selector": "li.hit", "link_selector": "a", "title_selector": "h2", "date_selector": "time", "date_attr": "datetime", "summary_selector": ".sum", "allow_search_only": True, "search_terms": ["a b", "c"]}
LIST = '<ul><li class="hit"><a href="/1">x</a><h2>First</h2><time datetime="2024-01-03">3</time><p class="sum">s1</p></li><li class="hit"><a href="/2"></a><h2>Second</h2><time datetime="Jan 4, 2024"></time></li><li class="hit"><h2>no link</h2></li></ul>'


def test_configured_adapter(spark):
    configs = spark.createDataFrame([("s.example", json.dumps(CONFIG)), ("bad.example", json.dumps({"search_url_template": "https://x"}))], "domain string, config string")
    assert {r["domain"]: r["valid"] for r in adapters.valid_config(configs).collect()} == {"s.example": True, "bad.example": False}
    requests = adapters.search_requests(configs.where("domain = 's.example'"))
    assert [r["url"] for r in requests.orderBy("page").collect()] == [f"https://s.example/q?k=a%20b&p={p + 1}&o={10 * p}" for p in range(3)]
    urls = [r["url"] for r in requests.orderBy("page").collect()]
    page = '<meta property="og:title" content="Whole"><article><p>' + "Body of the first story, long enough. " * 3 + "</p></article>"
    fetched = spark.createDataFrame([(urls[0], 200, LIST), (urls[1], 200, "<p>none</p>"), (urls[2], 200, LIST.replace("/1", "/9")), ("https://s.example/1", 200, page)], "url string, status_code int, html string")
    got = {r["article_url"]: r for r in adapters.configured_articles(requests, fetched, configs, "2024-01-01", "2024-01-10").collect()}
    assert set(got) == {"https://s.example/1", "https://s.example/2"}
    assert (got["https://s.example/1"]["title"], got["https://s.example/1"]["source_discovery"]) == ("Whole", "configured_search") and "s1" in got["https://s.example/1"]["summary"]
    assert (got["https://s.example/2"]["title"], got["https://s.example/2"]["source_discovery"]) == ("Second", "configured_search_search_only")
    assert adapters.configured_articles(requests, fetched, configs, "2024-01-04", "2024-01-10").count() == 1
    seen = adapters.configured_diagnostics(requests, fetched, configs).first()
    assert (seen["search_endpoint_status"], seen["parsed_date_count"]) == ("http_200", 4)


def test_listing_search_and_dispatch(spark):
    listing = spark.createDataFrame([(1, "https://a.example/", '<a href="/news/1">A story about the market</a><a href="https://b.example/news/2">Another story far away</a><a href="/news/3">A tale of nothing at all</a>')], "page_id long, url string, html string")
    fetched = spark.createDataFrame([("https://a.example/news/1", 200, "<title>Market</title><time datetime=2024-01-02></time>")], "url string, status_code int, html string")
    assert [(r["article_url"], r["title"]) for r in adapters.listing_articles(listing, fetched, "2024-01-01", "2024-01-05", ["market"]).collect()] == [("https://a.example/news/1", "Market")]
    country = {"hl": "it", "gl": "IT", "ceid": "IT:it", "market": "it-IT"}
    searches = adapters.site_searches(["Fees up", "x"], ["a.example"], country, spark, most=1)
    assert sorted(r["url"] for r in searches.collect()) == ["https://news.google.com/rss/search?q=Fees%20up%20site%3Aa.example&hl=it&gl=IT&ceid=IT:it", "https://www.bing.com/news/search?q=Fees%20up%20site%3Aa.example&format=rss&mkt=it-IT"]
    item = "<item><title>{}</title><link>{}</link><pubDate>Tue, 02 Jan 2024 08:00:00 +0000</pubDate></item>"
    xml = "<rss><channel>" + item.format("Fees up now", "https://a.example/7") + item.format("Fees up", "https://c.example/8") + item.format("Fees up", "https://news.google.com/z") + item.format("Other", "https://a.example/9") + "</channel></rss>"
    feeds = searches.select(F.col("url").alias("feed_url"), F.lit(xml).alias("xml"))
    assert sorted(r["article_url"] for r in adapters.site_search_articles(searches, feeds, fetched, "2024-01-01", "2024-01-05").collect()) == ["https://a.example/7", "https://news.google.com/z"]
    sources = spark.createDataFrame([("https://www.shop.example/x", "buyer"), ("https://news.s.example/", "media"), ("https://q.example/", "media")], "source_url string, side string")
    got = adapters.dispatch(sources, spark.createDataFrame([("s.example", "{}")], "domain string, config string"), spark.createDataFrame([("https://shop.example/",)], "target_url string"))
    assert [r["adapter"] for r in got.orderBy("adapter").collect()] == ["configured", "generic", "official"]
    rows = spark.createDataFrame([(1, "Shop coupon", "https://x.jp/1")], "pos long, title string, article_url string")
    named = adapters.with_source(rows, "media", "General Media", "https://www.m.example/", F.array(F.lit("A"), F.lit("B")), "it").first()
    assert (named["platform_label"], named["source_site"]) == ("A, B", "m.example")
    task = {"type": "report_ranking", "label": "l", "query": "q", "platform": "Temu", "engine": "google", "feed_url": "f", "page_url": "https://news.google.com/search?q=q"}
    said = adapters.with_search(rows, task, "it").first()
    assert (said["platform"], said["source_site"], said["matched_brands"], said["source_country_guess"]) == ("Cross-brand report", "news.google.com", ["Temu"], "JP")


def test_body_and_audit(spark):
    long = "<article>" + "<p>Story of many words here. </p>" * 20 + "<script>x</script></article>"
    stored = spark.createDataFrame([("https://a.example/1", 200, "", long), ("https://a.example/2", 500, "", ""), ("https://a.example/3", 200, "", "<p>login</p><input type=\"password\">")], "url string, status_code int, final_url string, html string")
    rows = spark.createDataFrame([(1, "https://a.example/1"), (2, "https://a.example/2"), (3, "https://a.example/4"), (4, ""), (5, "https://r.example/?url=https%3A%2F%2Fa.example%2F1")], "pos long, article_url string")
    got = {r["pos"]: (r["article_body_fetch_status"], r["article_body_excerpt"][:8]) for r in enrich.body_context(rows, stored).collect()}
    assert got == {1: ("ok", "Story of"), 2: ("failed", ""), 3: ("not_stored", ""), 4: ("missing_url", ""), 5: ("ok", "Story of")}
    audit = {r["source_url"]: r["status"] for r in enrich.audit_sources(spark.createDataFrame([(f"https://a.example/{k}",) for k in (1, 2, 3, 9)], "source_url string"), stored, "now").collect()}
    assert audit == {"https://a.example/1": "public", "https://a.example/2": "http_error", "https://a.example/3": "login_required", "https://a.example/9": "error"}
    assert [r["verification_final_url"] for r in enrich.verified(rows, stored).collect()] == ["https://a.example/1"]


# --- sheets, sinks, requests ---


def test_sheets(spark, tmp_path):
    raw = sheets.workbook(["id", "platform", "seller", "buyer", "media"], iter([("", "", "", "", ""), ("", "", "", "", ""), ("1", "Shop", "https://s.example/a?utm_source=1 and https://s.example/b", "", "https://m.example/")]))
    (tmp_path / "a.xlsx").write_bytes(raw)
    rows = sheets.sources(sheets.read_cells(spark, str(tmp_path / "a.xlsx"))).orderBy("pos").collect()
    assert [(r["platform"], r["side"], r["source_url"]) for r in rows] == [("Shop", "seller", "https://s.example/a"), ("Shop", "seller", "https://s.example/b"), ("Shop", "media", "https://m.example/")]
    lines = [(sheets.SECTION, "", "", "", ""), ("head", "", "", "", ""), ("Price", "B3_1", "price?", "价格?", ""), ("", "x", "B3_2", "cheap?", "便宜?"), ("Logistics", "B6", "", "", ""), ("", "B6_1", "fast?", "", ""), ("", "", "", "", ""), ("", "", "", "", ""), ("Late", "B9_1", "never", "", "")]
    (tmp_path / "b.xlsx").write_bytes(sheets.workbook(["x"] * 5, iter(lines)))
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    got = sheets.indicators(sheets.read_cells(spark, str(tmp_path / "b.xlsx"))).orderBy("pos").collect()
    assert [(r["dimension"], r["question_id"], r["prompt_en"], r["prompt_zh"]) for r in got] == [("Price", "B3_1", "price?", "价格?"), ("Price", "B3_2", "cheap?", "便宜?"), ("Logistics", "B6_1", "fast?", "")]
    assert sheets.read_cells(spark, str(tmp_path / "c.xlsx")).count() == 0
    table = spark.createDataFrame([(1, "https://a.example/?a=1&b=2", "<T>"), (2, "", "U")], "pos long, url string, title string")
    sheets.write_workbook(table, str(tmp_path / "out" / "d.xlsx"), links={"title": "url"}, order="pos")
    cells = {(r["row"], r["col"]): r["value"] for r in sheets.read_cells(spark, str(tmp_path / "out" / "d.xlsx")).collect()}
    assert cells[1, 2] == "url" and cells[2, 3] == "<T>" and (3, 2) not in cells


def test_report_sinks(spark, tmp_path):
    df = export.header_union(spark.createDataFrame([(1, 'a "b"')], "pos long, title string"), spark.createDataFrame([(2, ["x", "y"])], "pos long, tags array<string>"))
    assert df.columns == ["pos", "title", "tags"]
    export.write_bom_csv(df.orderBy("pos"), str(tmp_path / "a.csv"))
    assert (tmp_path / "a.csv").read_bytes() == b'\xef\xbb\xbf"pos","title","tags"\r\n"1","a ""b""",""\r\n"2","","x | y"\r\n'
    export.write_bom_csv(df.limit(0), str(tmp_path / "b.csv"))
    assert (tmp_path / "b.csv").read_bytes() == b""
    export.write_json_array(df.orderBy("pos"), str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text()) == [{"pos": 1, "title": 'a "b"', "tags": None}, {"pos": 2, "title": None, "tags": ["x", "y"]}]
    export.write_json(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    export.write_json_array(df.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []
    many = spark.range(0, 5000, 1, 7).selectExpr("id", "array(id, id + 1) as l", "concat('é', id) as t")
    export.write_json_array(many, str(tmp_path / "many.json"))
    assert json.loads((tmp_path / "many.json").read_text()) == [{"id": i, "l": [i, i + 1], "t": f"é{i}"} for i in range(5000)]
    export.write_bom_csv(many, str(tmp_path / "many.csv"))
    assert (tmp_path / "many.csv").read_text(encoding="utf-8-sig").splitlines()[1::1000] == [f'"{i}","{i} | {i + 1}","é{i}"' for i in range(0, 5000, 1000)]
    assert not [x for x in tmp_path.iterdir() if x.name.count(".") > 1 and not x.name.endswith(".crc")]


def test_manual_rows(spark):
    forms = spark.createDataFrame([("db:r1:after", "t", "", "P", "2024"), ("x.csv", "t", "", "P", "2024"), ("db:r1:before", "t", "", "P", "2024"), ("db:r1:after", " ", None, "P", "2024"), ("db:r1:after", "t", "", "", "2024"), ("db:r1:after", "t", "", "P", "")], "article_source string, title string, article_url string, platform_label string, published_at string")
    assert [r["error"] for r in store.checked_manual(forms).collect()] == ["", "source", "stage", "title_or_url", "platform", "date"]
    manual = spark.createDataFrame([("m1", "r1", "after", True, "2", '{"title": "a"}'), ("m2", "r1", "after", False, "1", '{"title": "b"}'), ("m3", "r1", "after", True, "1", "bad")], "manual_article_id string, run_id string, stage string, enabled boolean, updated_at string, raw_json string")
    assert [r["manual_article_id"] for r in store.load_manual(manual, " r1 ", "after", "title string").collect()] == ["m3", "m1"]
    assert store.load_manual(manual, "r1", "after", "title string", True).count() == 3
    with pytest.raises(ValueError):
        browse.selected(manual, manual.select("manual_article_id").limit(0), "manual_article_id")
    with pytest.raises(ValueError):
        browse.selected(manual, spark.createDataFrame([("zz",)], "manual_article_id string"), "manual_article_id")


def test_run_with_a_scorer(spark):
    rows = [(0, "Temu checkout with cash payment", "Pay in cash at physical points", "Temu", "2024-01-02"), (1, "Concert tonight", "music", "Temu", "2024-01-02"), (2, "Temu checkout news", "payment in the app", "Temu", "2024-01-03"), (3, "News from Greece", "greek market only", "Temu", "2024-01-03"), (4, "Temu cash payment at checkout", "Pay in cash at points", "Temu", "2024-01-03")]
    df = spark.createDataFrame([(*r[:4], r[3], r[4], "") for r in rows], "pos long, title string, summary string, platform string, platform_label string, published_at string, article_url string")
    book = spark.createDataFrame([(0, "Product feature", "B5_18", "payment?", "支付?")], "pos long, dimension string, question_id string, prompt_en string, prompt_zh string")
    answers = spark.createDataFrame([(0, json.dumps({"decisions": [{"article_id": "0", "relevant": True, "matched_dimensions": ["product feature"], "matched_question_ids": ["b5_18"], "reason": "r", "confidence": "possible"}, {"article_id": "1", "relevant": False, "reason": "", "confidence": "high"}]}))], "batch long, payload string")
    args = (book, {"Product feature": ["payment", "checkout"]}, {"Product feature": ["B5_18"]}, ["italy"], "意大利", "it", "2024-02-01")
    out = run_plan.run(df, *args, answers=answers, cluster_scorer=lambda m: {m[0]["pos"]})
    kept = {r["pos"]: r for r in out["survey"].collect()}
    assert {k: r["survey_filter_method"] for k, r in kept.items()} == {0: "ai", 2: "keyword_fallback", 4: "keyword_fallback"}
    assert kept[0]["survey_filter_confidence"] == "medium" and kept[0]["survey_question_ids"] == "B5_18" and kept[0]["survey_ai_reason"] == "r"
    assert {r["pos"]: r["category"] for r in out["excluded"].collect()} == {1: "entertainment_or_content_noise", 3: "foreign_market"}
    assert sorted(r["pos"] for r in out["final"].collect()) == [0, 2] or sorted(r["pos"] for r in out["final"].collect()) == [0]
    assert out["briefing"].count() == out["final"].count() and {r["stage"] for r in out["stages"].collect()} == {"raw", "initial", "survey", "final"}


def test_messages(spark):
    rows = spark.createDataFrame([(i, f"t{i}", ["a", " "]) for i in range(10)], "pos long, title string, tags array<string>")
    out = messages.batch_messages(rows, "survey", " You  judge. ", "judge", ["r"], {"d": 1}, [{"q": "B"}], size=4, parts=2).orderBy("batch").collect()
    assert [r["n"] for r in out] == [4, 4, 2]
    system, user = json.loads(out[1]["messages"])
    body = json.loads(user["content"])
    assert system == {"role": "system", "content": "You judge."} and [a["article_id"] for a in body["articles"]] == ["4", "5", "6", "7"] and body["articles"][0]["tags"] == ["a"] and body["survey_indicators"] == [{"q": "B"}] and body["output_schema"] == {"d": 1}
    bad = messages.decisions(spark.createDataFrame([(0, "no json"), (1, '[{"article_id": "3", "relevant": true}, {"article_id": "x"}]')], "batch long, payload string")).collect()
    assert [(r["pos"], r["relevant"], r["dimensions"]) for r in bad] == [(3, True, [])]


def test_question_reasons(spark):
    df = spark.createDataFrame([(1, "t", ["Price"], []), (2, "t", [], ["B2_1"]), (3, "", [], []), (4, "t", [], [])], "pos long, title string, d array<string>, q array<string>")
    got = [r[0] for r in df.orderBy("pos").select(survey.fallback_reason(F.col("d"), F.col("q"), F.col("title"))).collect()]
    assert got == [survey.REASONS[1][3], survey.REASONS[3][3], "", survey.PLAIN_REASON]
    assert one(spark, classify.capability_risk(F.lit("public"), F.lit(""), F.lit("read timeout"), F.lit(False), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(200)), x=1) == "medium"


def test_event_clusters_against_all_pairs(spark):
    """Wordings without a word in common, contained titles, Han titles, blank texts, many copies: as by all pairs."""
    rng = np.random.default_rng(8)
    han = "平台商家费用上涨投诉调查罚款促销配送退款隐私政策门店市场"
    rows = [(t, b) for _, t, b in event_rows()]
    rows += [("platformraisescommissionforsellers", ""), ("platformraisedcommissionsforseller", "x"), ("the platformraisescommissionforsellers today", "y"), ("a b c d e", ""), ("a b c d f", ""), ("...", "")]
    for _ in range(40):
        base = list(rng.choice(list(han), rng.integers(8, 24)))
        rows.append(("".join(base), ""))
        base[rng.integers(len(base))] = "新"
        rows.append(("".join(base), rng.choice(["", "正文"])))
    for _ in range(10):
        word = "".join(rng.choice(list("abcdefghij"), 30))
        rows += [(word, "one"), (word[2:], "two"), (word[:24] + "zz", "three")]
    rows += [("Same headline in all papers", "")] * 12 + [("Same headlines in all papers", "")] * 9
    rows += [(f"Report {k}", "fine of 120,000 euro") for k in range(6)]
    rows = [(i, t, b) for i, (t, b) in enumerate(rows)]
    days = ["2024-%02d-%02d" % (1 + i % 2, 1 + (i * 11) % 28) for i in range(len(rows))]
    df = spark.createDataFrame([(i, "Shop", t, b, d) for (i, t, b), d in zip(rows, days, strict=True)], "pos long, platform string, title string, summary string, published_at string")
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    day = [np.datetime64(d) for d in days]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if abs((day[a] - day[b]).astype(int)) <= 14 and same_event(rows[a][1:], rows[b][1:]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    groups = [find(i) for i in range(len(rows))]
    want = {i: g for i, g in enumerate(groups) if groups.count(g) > 1}
    got = {r["node"]: r["cluster"] for r in dedup.event_clusters(df).collect()}
    assert got == want and len(set(want.values())) > 20


def test_close_pairs_lose_none():
    """The bounds of the similarity join against all ratios, for strings of a few letters and of sentences."""
    rng = np.random.default_rng(1)
    words = ["seller", "fees", "rise", "market", "in", "of", "delivery", "late"]
    strings = ["".join(rng.choice(list("abc"), rng.integers(1, 20))) for _ in range(70)] + [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(70)] + ["市" * k for k in (1, 3, 300)]
    for least in (0.5, 0.76, 0.88):
        got = {(i, j) for i, j, _, _ in similar.close_pairs(strings, strings, least)}
        want = {(i, j) for i, a in enumerate(strings) for j, b in enumerate(strings) if max(difflib.SequenceMatcher(None, a, b).ratio(), difflib.SequenceMatcher(None, b, a).ratio()) >= least}
        assert got == want


def test_event_clusters_of_the_smallest_table(spark):
    """The registered query against all pairs of its articles: keys and tokens as the engine has them, rules by loops."""
    articles = tables.articles(spark, "/root/testdata/sf0.001")
    title = F.col("title")
    keyed = dedup.event_rows(articles).join(articles.select("pos", text.title_key(title).alias("whole"), text.title_key(text.without_source(title)).alias("primary"), text.title_tokens(title).alias("tokens")), "pos")
    rows = sorted(keyed.collect(), key=lambda r: r["pos"])

    def ratio(a, b):
        return difflib.SequenceMatcher(None, a, b).ratio()

    def alike(a, b):
        if not set(a["brands"]) & set(b["brands"]) or abs((a["day"] - b["day"]).days) > 14:
            return False
        common, titles = set(a["event_tokens"]) & set(b["event_tokens"]), set(a["title_tokens"]) & set(b["title_tokens"])
        if set(a["numbers"]) & set(b["numbers"]) and (set(a["phrases"]) & set(b["phrases"]) or len(common) >= 4):
            return True
        union = set(a["event_tokens"]) | set(b["event_tokens"])
        share = len(common) / max(1, len(union))
        if (len(titles) >= 3 and len(common) >= 4) or (len(titles) >= 2 and len(common) >= 5) or (share >= 0.68 and len(common) >= 6):
            return True
        x, y, p, q = a["whole"], b["whole"], a["primary"], b["primary"]
        if x and y:
            s, t = set(a["tokens"]), set(b["tokens"])
            if x == y or (p and p == q) or (min(len(x), len(y)) >= 18 and (x in y or y in x)) or (p and q and min(len(p), len(q)) >= 16 and (p in q or q in p)):
                return True
            main = ratio(p or x, q or y)
            best, jaccard = max(main, ratio(x, y)), len(s & t) / max(1, len(s | t))
            if best >= 0.82 if not s or not t else best >= 0.86 or main >= 0.76 or (best >= 0.74 and jaccard >= 0.55) or jaccard >= 0.82:
                return True
        x, y = a["event_key"], b["event_key"]
        if not x or not y:
            return False
        close = ratio(x, y)
        return close >= 0.84 if not a["event_tokens"] or not b["event_tokens"] else close >= 0.88 or (close >= 0.8 and share >= 0.48)

    low = {r["pos"]: r["pos"] for r in rows}
    for a, b in itertools.combinations(rows, 2):
        if alike(a, b) and low[a["pos"]] != low[b["pos"]]:
            x, y = sorted((low[a["pos"]], low[b["pos"]]))
            low = {k: x if v == y else v for k, v in low.items()}
    sizes = Counter(low.values())
    assert {r["node"]: r["cluster"] for r in dedup.event_clusters(articles).collect()} == {k: v for k, v in low.items() if sizes[v] > 1}
