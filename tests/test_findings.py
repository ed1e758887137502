"""What reviews found: numbering over many rows, words beside other letters, what a text's length costs."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gazette.functions import context, lexicon, terms, text
from gazette.llm import kernels, line_dedup, ngram_join, toxicity
from gazette.operators import briefing, browse, dedup, messages
from gazette.sources import feeds, tables


def test_batches_number_more_rows_than_a_sample_holds(spark):
    """More rows than a range's sample has: the numbers are still 0 to n - 1, in order, whatever the sample is."""
    rows = spark.range(60_000).select(F.pmod(F.col("id") * 7919, F.lit(60_000)).alias("pos"))
    out = browse.batches(rows, 8, "pos", 8)
    assert out.count() == 60_000 and out.where("batch * 8 + slot <> pos").count() == 0
    twice = browse.batches(rows.select((F.col("pos") % 20_000).alias("k"), F.struct(F.col("pos") % 20_000, F.lit(1)).alias("at")), 8, "at", 8)
    assert twice.where("k <> (batch * 8 + slot) div 3").count() == 0


def test_request_batches_are_full(spark):
    rows = spark.range(60_000).select(F.col("id").alias("pos"), F.lit("t").alias("title"))
    found = messages.batch_messages(rows, "translation", "s", "t", parts=8).groupBy("n").count().collect()
    assert [tuple(r) for r in found] == [(8, 7_500)]


def test_batches_without_rows(spark):
    assert browse.batches(spark.range(0).select(F.col("id").alias("pos")), 8).count() == 0


def test_words_end_beside_letters_beyond_ascii(spark):
    """As the SQL's engine has it: only ASCII letters, digits and the underscore are part of a word."""
    rows = spark.createDataFrame([("été éXBOX fini",), ("le modèleAB12é",), ("le_XBOX",), ("rien du tout",)], "t string")
    assert [r[0] for r in rows.select(context.single_coverage(F.col("t"))).collect()] == [True, True, False, False]


def test_long_lists_are_asked_once_a_text(spark):
    """Terms of a list are met in one pass over a text; equal conditions are one."""
    rows = spark.createDataFrame([(1, "A  sale\tof phones")], "pos long, title string")
    c = context.relevance_text(rows)
    plan = rows.select(context.hard_filter(c, F.col("title"), ["der"]).alias("r"), context.exclusion_category(c, F.lit(""), F.lit("high")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan and plan.count("collapsed(") >= 1
    again = rows.select((terms.matches_any(c, lexicon.PRODUCTS) & terms.matches_any(c, lexicon.LAUNCHES)).alias("a"), terms.matches_any(c, lexicon.PRODUCTS).alias("b"))
    assert sum(line.count("found(") for line in again._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ArrowEvalPython" in line) == 2


def test_clean_long_is_clean(spark):
    signs = [chr(c) for c in (9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    said = [None, "", " ", "a b", "a  b ", " a", "\x1b"] + [f"{x}a{x}b {x}c{x}{y}d{y}" for x in signs for y in signs]
    rows = spark.createDataFrame([(s,) for s in said], "t string")
    assert rows.where(~text.clean_long(F.col("t")).eqNullSafe(text.clean(F.col("t")))).count() == 0
    parts = spark.createDataFrame([("a ", None), ("", " b"), (None, None), ("a\n", "\tb  c")], "title string, summary string")
    assert [r[0] for r in parts.select(context.relevance_text(parts)).collect()] == ["a", "b", "", "a b c"]


def test_links_of_equal_titles_grow_with_the_rows(spark):
    """The clusters are those of all pairs; a title that many articles share makes as many links as there are articles."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(12)}x" for _ in range(rng.randrange(1, 9))]
        rows.append((i, rng.choice(["A", "a ", "b", ""]), f"2024-0{rng.randrange(1, 5)}-{rng.randrange(1, 29):02}", rng.choice([" ".join(words), "fees go up in spring", "fees go up in spring again now so soon"])))
    a = spark.createDataFrame(rows, "pos long, platform string, day string, title string").withColumn("published_date", F.to_date("day"))
    want = sorted(map(tuple, dedup.components(dedup.token_candidates(a)).collect()))
    assert sorted(map(tuple, dedup.components(dedup.token_links(a)).collect())) == want
    copies = spark.range(3_000).select(F.col("id").alias("pos"), F.lit("A").alias("platform"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 28).cast("int")).alias("published_date"), F.lit("fees go up in spring").alias("title"))
    assert dedup.token_links(copies).count() == 2_999


def test_toxicity_fit_takes_little_memory(spark, monkeypatch):
    """What the driver holds at once stays a few times the tokens of the sample."""
    rng = np.random.default_rng(3)
    tokens = [np.unique(rng.integers(0, 50_000, 800).astype(np.uint32)) for _ in range(2_000)]
    sample = pa.table({"toxic": pa.array([i % 9 == 0 for i in range(2_000)], pa.bool_()).cast(pa.int32()), "tokens": pa.array([t.tobytes() for t in tokens], pa.binary()), "marks": pa.array([0] * 2_000, pa.int32())})
    monkeypatch.setattr(toxicity, "_sample", lambda *_: sample)
    tracemalloc.start()
    toxicity.fit(None, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * sum(map(len, tokens)), peak / sum(map(len, tokens))


def test_summary_reads_the_long_text_once(spark):
    """White space of the long text is cleaned in one place, and what is made of it does not clean it again."""
    from gazette.operators import summary

    rows = spark.createDataFrame([(1, "Fees go up", "Long \t text  about fees.")], "pos long, title string, summary string")
    items = summary.summary_items(rows, "意大利")
    assert items._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [collapsed(") == 1
    assert "Long text about fees" in items.first()["detail"]


def test_links_of_events_grow_with_the_rows(spark, monkeypatch):
    """Many articles of a brand that share title words and event words are joined by about as many links as there are articles."""
    rng = random.Random(2)
    rows = [(i, "Shop", f"2024-01-{1 + i % 28:02}", "fees rise " + rng.choice("abcdefgh") * 3 + str(i), "sellers told parcels arrive late everywhere " + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(30))) for i in range(700)]
    counts, joined = [], dedup.components

    def counted(links, *more):
        counts.append(links.count())
        return joined(links, *more)

    monkeypatch.setattr(dedup, "components", counted)
    found = dedup.event_clusters(spark.createDataFrame(rows, "pos long, platform string, published_at string, title string, summary string"))
    assert found.count() == 700 and found.where("cluster <> 0").count() == 0
    assert max(counts) < 10 * 700, counts



def test_tags_of_an_article_without_a_text(spark, tmp_path):
    """As the SQL has it: without a text there is no word in which a tag could be found."""
    import duckdb

    from gazette.plans import registry

    texts = [None, None, "", "Sale of the day.", "no word"]
    spark.createDataFrame([(i, t, "en", "src", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(base.sql(registry.oracle_sql()["summary_tags"]).fetchall())
    assert sorted(map(tuple, registry.queries()["summary_tags"](spark, str(tmp_path)).collect())) == want



def test_long_texts_are_compared_as_short_ones_are(spark):
    said = [None, "", " ", "A b", "É—ñ 12,5", "a b", "平台 X", "İstanbul ΑΣ", "x" * 300 + " - y"]
    rows = spark.createDataFrame([(s,) for s in said], "t string")
    assert rows.where(~text.title_key_long(F.col("t")).eqNullSafe(text.title_key(F.col("t")))).count() == 0
    assert rows.where(~text.first_present_long(F.col("t")).eqNullSafe(text.first_present(F.col("t")))).count() == 0



def test_marker_tokens_only_of_rows_with_common_numbers(spark):
    """Rows without a number have no part in it: their tokens are not dealt out, and the long texts are read once, by Arrow."""
    rows = [(i, "Shop", "2024-01-02", f"t{i}", f"order {1000 + i % 3 if i < 200 else ''} alpha beta gamma delta w{i % 7}") for i in range(260)]
    events = dedup.event_rows(spark.createDataFrame(rows, "pos long, platform string, published_at string, title string, summary string"))
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert "collapsed(" in plan and "keyed(" in plan
    found = {(r["a"], r["b"]) for r in dedup.marker_pairs(events.persist()).collect()}
    assert found == {(a, b) for a in range(200) for b in range(a + 1, 200) if a % 3 == b % 3}



def test_pages_are_handled_a_few_at_a_time(spark):
    """A batch's results leave in parts, so a task never holds those of all its pages."""
    from gazette.sources import pages

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(50)), "url": ["u"] * 50, "html": ["<p>x</p>"] * 50})
    parts = list(pages._few(iter([batch]), pages._LINK, lambda page_id, url, html: [(page_id, url, 0, "h", "", False)]))
    assert len(parts) == 4 and sum(p.num_rows for p in parts) == 50



def test_requests_are_moved_where_they_are_asked(spark, tmp_path):
    """Answers are joined by digest: no join or exchange after the calls holds the requests' text."""
    from gazette.operators import scorer

    batches = spark.createDataFrame([(i, 1, f"request {i % 5}") for i in range(10)], "batch long, n long, messages string")
    found = scorer.decisions(batches, lambda r: '{"decisions": [{"article_id": "%s", "relevant": true}]}' % r.split()[1], store=str(tmp_path / "answers"))
    assert sorted(r["pos"] for r in found.collect()) == list(range(5))
    exchanges = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line or "Exchange" in line]
    assert exchanges and not any("request" in line or "messages" in line for line in exchanges)


def test_feeds_of_one_item_share_batches():
    """a batch of items holds those of many feeds; each feed's own place stays with it."""
    xml = "<rss><channel><item><title>t{0}</title><link>http://x/{0}</link><category>a</category></item></channel></rss>"
    given = pa.RecordBatch.from_pydict({"feed_url": [f"f{i}" for i in range(500)], "xml": [xml.format(i) if i % 5 else None for i in range(500)]})
    out = list(feeds._parsed(iter([given, given])))
    assert len(out) == 1 and out[0].num_rows == 800
    assert out[0].slice(1, 1).to_pylist() == [{"feed_url": "f2", "pos": 0, "title": "t2", "article_url": "http://x/2", "published_at": "", "summary": "", "categories": ["a"]}]


def test_segment_of_a_row(spark):
    """F8: the segment's terms are asked outside of lambdas, in which Spark allows no Python function."""
    df = spark.createDataFrame([("a prime offer",), ("nothing",), (None,)], "title string")
    assert [r[0] for r in df.select(briefing.segment(df, "X")).collect()] == ["X Prime 会员", "X平台买家", "X平台买家"]


def test_classes_of_the_jvm(spark):
    """F8, F11: the quick classes are the ones that the SQL states, for every sign."""
    df = spark.range(1, 0x10FFFF).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    for wide, quick in ((text.SPACE, text._JVM_SPACE), (text.NOT_TITLE, text._JVM_NOT_TITLE)):
        assert df.where(F.col("c").rlike(wide) != F.col("c").rlike(quick)).count() == 0 and df.where(F.col("c").rlike(quick)).count() > 20


def test_articles_without_a_page_are_spread(spark, tmp_path):
    """articles without a link are dealt out over the tasks of the join, and keep their empty URL."""
    spark.range(3000).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "'A title. Text' as text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(2000).selectExpr("id as page_id", "concat('http://x.example/', id) as url").write.parquet(f"{tmp_path}/pages.parquet")
    held = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for c, value in zip(held, ("-1", "false"), strict=True):
        spark.conf.set(c, value)
    try:
        own = tables.linked_articles(spark, str(tmp_path)).where("pos % 3 = 0")
        assert own.where("article_url <> ''").count() == 0
        assert sorted(r["count"] > 100 for r in own.groupBy(F.spark_partition_id()).count().collect()) == [True] * 4
    finally:
        for c, value in held.items():
            spark.conf.set(c, value)


def test_rows_are_handled_in_small_chunks():
    """pipeline: 6 MB of texts make a worker's arrays grow by less than 40 MB, and rows come out as from a chunk each."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(4000)]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts), ids], ["doc_id", "text", "h"])
    kernels._powers(kernels._SEGMENT)
    tracemalloc.start()
    try:
        for run in (ngram_join._members(5), lambda x: (line_dedup.Parsed(p).units(p.column("doc_id")) for b in x for p in kernels.chunks(b, limit=line_dedup.CHUNK))):
            tracemalloc.reset_peak()
            before, rows = tracemalloc.get_traced_memory()[0], 0
            for part in run(iter([batch])):
                rows += part.num_rows
            assert rows >= len(texts) and tracemalloc.get_traced_memory()[1] - before < 40 << 20
    finally:
        tracemalloc.stop()
    alone = [x for i in range(3) for part in ngram_join._members(5)(iter([batch.slice(i, 1)])) for x in part.to_pylist()]
    assert next(ngram_join._members(5)(iter([batch]))).slice(0, 3).to_pylist() == alone


def test_tags_of_odd_texts(spark, tmp_path):
    """words over the end of a title, and a capital I with a dot, are met as in the SQL, by other queries of the step too."""
    import duckdb

    from gazette.plans import registry

    said = ["Z came after gen. More text", "share of the market. No more", "products are illegal\nso they say", "A POLİCY. DİSCOUNT", "İLLEGAL PRODUCTS", "PLATFORM STRATEGY, BİTCOİN EXPOSURE, ACQUİSİTİON", "no word"]
    spark.createDataFrame([(i, t, "en", "src", 0) for i, t in enumerate(said * 12)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("summary_tags", "exclusion_category"):
        want = sorted(base.sql(registry.oracle_sql()[name]).fetchall())
        assert sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect())) == want, name


def test_long_strings_that_resemble_each_other():
    """in long strings difflib's stretches begin at rare letters, which bounds what must be in common; no pair is lost to it, and of
    unlike texts of one language none is compared letter by letter."""
    import difflib

    from gazette.operators import similar

    rng = random.Random(4)
    words = ["".join(rng.choice("aaeeiioonnrrssttlldd") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    alone = [" ".join(rng.choice([*words, "quiz", "jab", "x9"]) for _ in range(rng.randint(35, 60))) for _ in range(40)]
    said = list(alone)
    for s in alone[:25]:
        t = list(s)
        for _ in range(rng.choice([1, 5, 15, 25, 40])):
            t[rng.randrange(len(t))] = rng.choice("etaqz ")
        said += ["".join(t), s[: len(s) // 2] + " " + rng.choice(alone)[-len(s) // 8 :] + s[len(s) // 2 :]]
    said += ["ab" * 150, "ab" * 150 + "ba", "abc" * 80, "z" + "ab" * 120, "q" * 210, "e" * 190, "e" * 230]
    for least in (0.76, 0.84):
        ratios = {(i, j): difflib.SequenceMatcher(None, a, b).ratio() for i, a in enumerate(said) for j, b in enumerate(said)}
        want = {(i, j) for (i, j), x in ratios.items() if max(x, ratios[j, i]) >= least}
        assert {(i, j) for i, j, _, _ in similar.close_pairs(said, said, least)} == want and len(want) > len(said) + 20
    asked = []

    class Counted(similar._Subsequence):
        def reaches(self, other, least):
            asked.append(other)
            return super().reaches(other, least)

    unlike = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(30)]
    held, similar._Subsequence = similar._Subsequence, Counted
    try:
        assert not list(similar.close_pairs(unlike[:15], unlike[15:], 0.84)) and not asked
    finally:
        similar._Subsequence = held
