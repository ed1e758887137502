"""Operator semantics on rows of our own."""

import numpy as np
from pyspark.sql import functions as F

from gazette.functions import classify, context, dates, terms, text, urls
from gazette.operators import dedup, export, funnel, progress, store, survey, tasks
from gazette.sources import feeds, pages


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def articles(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, platform string, title string, published_at string, source_site string, article_url string, summary string")


def test_no_url_and_other_title_stay(spark):
    a = articles(spark, ("Shop", "Fees go up in spring", "2024-01-02", "a.example", "", ""), ("Shop", "New delivery hub opens", "2024-01-02", "a.example", "", ""))
    assert dedup.initial_dedupe(a).count() == 2


def test_tracking_parameters_do_not_matter(spark):
    a = articles(spark, ("Shop", "x", "2024-01-02", "a", "https://a.example/n?utm_source=q", "s"), ("Shop", "y", "2024-01-03", "a", "https://A.example/n", "longer"))
    out = dedup.initial_dedupe(a).collect()
    assert len(out) == 1 and out[0]["summary"] == "longer" and out[0]["group_size"] == 2
    assert {r["reason"]: r["removed"] for r in dedup.dedupe_stats(a).collect()} == {"url_duplicate": 1}


def test_source_suffix_merges_the_same_day_only(spark):
    title = "Platform raises commission for sellers"
    a = articles(spark, ("Shop", title + " - Daily News", "2024-01-02", "a", "", "s"), ("Shop", title + " | Evening Post", "2024-01-02", "b", "", "s"), ("Shop", title, "2024-01-06", "c", "", "s"))
    assert dedup.initial_dedupe(a).count() == 2
    assert {r["reason"] for r in dedup.dedupe_stats(a).collect()} == {"same_day_exact_title_duplicate"}


def test_ties_keep_the_first_row_and_unions_follow_input_order(spark):
    a = articles(spark, ("Shop", "t", "2024-01-02", "z", "https://u.example/1", "s"), ("Shop", "t", "2024-01-02", "a", "https://u.example/1", "s"))
    row = dedup.initial_dedupe(a).first()
    assert row["pos"] == 0 and row["source_site"] == "z | a"


def test_fuzzy_titles(spark):
    pairs = spark.createDataFrame([("Platform raises commission for all sellers", "Platform raises commission for sellers"), ("Refund rules change", "Warehouse opens in Milan")], "a string, b string")
    assert [r[0] for r in dedup.similar_titles(pairs, "a", "b").collect()] == ["Platform raises commission for all sellers"]


def test_components(spark, monkeypatch):
    """By one task and by rounds alike: chains, stars, repeated links and loops."""
    rng = np.random.default_rng(2)
    rows = [(1, 2), (2, 3), (3, 4), (10, 11), (5, 4), (5, 4), (7, 7), *((100 + i, 101 + i) for i in range(30)), *((500, 500 + i) for i in range(1, 20)), *((int(a), int(b)) for a, b in rng.integers(1000, 1060, (40, 2)))]
    low = {x: x for r in rows for x in r}
    for a, b in rows * 60:
        low[a] = low[b] = min(low[a], low[b])
    links = spark.createDataFrame(rows, "a long, b long")
    for few in (dedup.FEW_LINKS, 0):
        monkeypatch.setattr(dedup, "FEW_LINKS", few)
        assert {r["node"]: r["cluster"] for r in dedup.components(links).collect()} == low
        assert dedup.components(links.limit(0)).count() == 0


def test_text(spark):
    assert one(spark, text.clean(F.col("x")), x=" a　b  c\n") == "a b c"
    assert one(spark, text.title_key(F.col("x")), x="Süd – News: A|B") == "s d news a b"
    assert one(spark, text.without_source(F.col("x")), x="Fees rise (Update) - Daily") == "Fees rise"
    assert one(spark, text.number_tokens(F.col("x")), x="1,200 in 2024 and 35") == ["1200"]
    assert one(spark, text.keyword_blocks(F.col("x")), x="(a) (b)\nc (d)") == ["(a)", "(b)", "c (d)"]
    assert one(spark, text.or_block(F.array(F.lit("a b"), F.lit("c"), F.lit("c"))), x=1) == '("a b" OR c)'


def test_urls(spark):
    assert one(spark, urls.canonical(F.col("x")), x="HTTPS://A.Example/p/?b=2&a=1&gclid=3#f") == "https://a.example/p?a=1&b=2"
    assert one(spark, urls.canonical(F.col("x")), x="no url/") == "no url"
    assert one(spark, urls.in_domain(F.col("x"), "example.com"), x="http://www.news.example.com/") is True
    assert one(spark, urls.redirect_target(F.col("x")), x="https://s.example/r?url=https%3A%2F%2Fa.example%2Fx&z=1") == "https://a.example/x"


def test_dates(spark):
    assert str(one(spark, dates.parse(F.col("x")), x="Tue, 02 Jan 2024 08:00:00 +0100")) == "2024-01-02 07:00:00"
    assert one(spark, dates.parse(F.col("x")), x="soon") is None
    assert one(spark, dates.week_label(F.lit("2027-01-01").cast("date"), F.lit(None).cast("date")), x=1) == "2026 W53"
    assert one(spark, dates.close_days(F.col("a"), F.col("b")), a="2024-01-01", b="2024-01-15") is True
    assert one(spark, dates.close_days(F.col("a"), F.col("b")), a="2024-01-01", b="2024-01-16") is False


def test_terms(spark):
    assert one(spark, terms.matches_any(F.col("x"), ["app"]), x="The APP, again") is True
    assert one(spark, terms.matches_any(F.col("x"), ["app"]), x="happy") is False
    assert one(spark, terms.contains_any(F.col("x"), ["cash"]), x="cashback") is True
    assert one(spark, classify.question_ids(F.col("x"), F.array(F.lit("B5_18"), F.lit("B5_16"))), x="cash payment at physical points") == ["B5_18"]


def test_diagnosis(spark):
    f = lambda *v: one(spark, classify.diagnosis(*(F.lit(x) for x in v)), x=1)
    assert [f(2, 2, 2, 2), f(16, 14, 2, 1), f(16, 14, 8, 3), f(9, 6, 4, 4)] == [classify.FEW_CANDIDATES, classify.LOST_IN_FILTER, classify.LOST_IN_DEDUPE, classify.HEALTHY]


def test_store(spark):
    runs = spark.createDataFrame([("r1", "it", "2024-01-01"), ("r2", "jp", "2024-01-02")], "run_id string, country_code string, updated_at string")
    rows = spark.createDataFrame([("r1", "before"), ("r1", "before"), ("r1", "after")], "run_id string, stage string")
    manual = spark.createDataFrame([("r1", "after", True), ("r1", "after", False)], "run_id string, stage string, enabled boolean")
    assert [(r["run_id"], r["before_count"], r["after_count"]) for r in store.list_runs(runs, rows, manual).collect()] == [("r2", 0, 0), ("r1", 2, 2)]
    assert store.replace_runs(rows, rows.where("run_id = 'r1'")).count() == 3


def test_funnel_and_progress(spark):
    rows = spark.createDataFrame([("A", "2024-01-03", "raw"), ("A", "2024-01-08", "final")], "brand string, day string, stage string").withColumn("day", F.col("day").cast("date"))
    grid = funnel.stage_funnel(rows, spark.createDataFrame([("A",), ("B",)], "brand string"), "2024-01-01", "2024-01-14").orderBy("brand", "week_start").collect()
    assert [(r["brand"], r["raw_count"], r["final_count"]) for r in grid] == [("A", 1, 0), ("A", 0, 1), ("B", 0, 0), ("B", 0, 0)]
    assert tuple(one(spark, progress.counts_in(F.col("x")), x="site 3/12 done")) == (3, 12)
    assert one(spark, progress.steady_remaining(F.lit(10), F.lit(30), F.lit(2)), x=1) == 11


def test_scorer_batches_fall_back(spark):
    rows = spark.createDataFrame([(i, "t") for i in range(20)], "pos long, text string").coalesce(1)

    def scorer(batch):
        if any(r["pos"] == 9 for r in batch):
            raise RuntimeError
        return {r["pos"]: {"relevant": True} for r in batch}

    found = survey.score_in_batches(rows, scorer, "pos long, relevant boolean")
    assert sorted(r["pos"] for r in found.collect()) == [*range(8), 16, 17, 18, 19]


def test_tasks_and_reports(spark):
    p = spark.createDataFrame([("A", ["a", "a b"], 0), ("B", ["a", "a b"], 1)], "platform string, terms array<string>, pos int")
    b = spark.createDataFrame([("x", "(k)", 0)], "label string, block string, pos int")
    assert [(r["platform"], r["query"]) for r in tasks.search_tasks(p, b, ["google"]).collect()] == [("A", '(a OR "a b") (k)')]
    assert one(spark, context.sentiment_name(F.col("x")), x="Unfavorable ") == "Negative"


def test_pages(spark):
    html = '<html><head><meta property="og:title" content="T"><script type="application/ld+json">{"datePublished": "2024-01-02"}</script></head><body><a href="/news/2024/01/a-long-story-title">A story with a long anchor</a><article><p>Body &amp; soul of a story long enough</p></article></body></html>'
    df = spark.createDataFrame([(1, "https://a.example/", html), (2, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pages.page_articles(df).collect()}
    assert got[1]["title"] == "T" and got[1]["published_at"] == "2024-01-02" and got[1]["body_excerpt"] == "Body & soul of a story long enough" and got[2]["title"] == ""
    assert [r["href"] for r in pages.candidate_links(df).collect()] == ["https://a.example/news/2024/01/a-long-story-title"]
    feed = spark.createDataFrame([("f", "<rss><channel><item><title><![CDATA[A & B]]></title><link>https://a.example/1</link><pubDate>Tue, 02 Jan 2024 08:00:00 +0000</pubDate></item><item><title>old</title><link>x</link><pubDate>Mon, 02 Jan 2023 08:00:00 +0000</pubDate></item></channel></rss>"), ("g", "<rss")], "feed_url string, xml string")
    assert [(r["title"], r["article_url"]) for r in feeds.feed_items(feed, "2024-01-01", "2024-01-05").collect()] == [("A & B", "https://a.example/1")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "A B", ["x", "y"])], "pos long, platform string, tags array<string>")
    export.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["tags"] == "x | y"
    export.write_grouped(df, str(tmp_path / "parts"), "platform")
    assert spark.read.parquet(str(tmp_path / "parts")).first()["platform_slug"] == "a-b"
