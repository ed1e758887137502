"""Feeds: the parser, stored documents, and the data source in batches, with pushed bounds, and as a stream."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from gazette.functions import dates
from gazette.sources import feeds

RSS = '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>c</title>{}</channel></rss>'
ITEM = "<item><title>{}</title><link> https://a.example/{} </link><pubDate>{}</pubDate><description>{}</description><category>x &amp; y</category><category/></item>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">It&#8217;s &lt;b&gt;on&lt;/b&gt;</title><link href="https://b.example/1"/><updated>2024-01-03T10:00:00Z</updated><category term="t"/><summary>s</summary></entry><entry><title>no link</title><updated>2024-01-03T10:00:00Z</updated></entry></feed>'


def test_items():
    rss = RSS.format(ITEM.format("It&#8217;s &#x41; <![CDATA[<test>]]>", 1, "Tue, 02 Jan 2024 08:00:00 +0000", "&lt;p&gt;d&lt;/p&gt;"))
    assert list(feeds.items(rss)) == [(0, "It’s A <test>", "https://a.example/1", "Tue, 02 Jan 2024 08:00:00 +0000", "<p>d</p>", ["x & y", ""])]
    assert list(feeds.items(ATOM)) == [(0, "It’s <b>on</b>", "https://b.example/1", "2024-01-03T10:00:00Z", "s", ["t"]), (1, "no link", "", "2024-01-03T10:00:00Z", "", [])]
    # A feed that breaks off has no item, whatever came before; nor has one without a channel, or what is no feed.
    for bad in (None, "", "<rss", rss.replace("</channel>", ""), rss.replace("channel>", "chan>"), "<html><item/></html>", rss.replace("&lt;p", "&nosuch;"), ATOM.replace("http://www.w3.org/2005/Atom", "x")):
        assert list(feeds.items(bad)) == []


def test_feed_items(spark):
    rows = [("a", RSS.format("".join(ITEM.format(f"t{i}", i, f"0{i} Jan 2024 08:00:00 +0000", "") for i in range(1, 8)))), ("b", RSS.format(ITEM.format("again", 3, "2024-01-03", ""))), ("c", ATOM), ("d", None), ("e", RSS.format(ITEM.format("broken", 99, "2024-01-03", ""))[:-4]), ("f", RSS.format(ITEM.format("undated", 98, "soon", "")))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "feed_url string, xml string, title int")
    got = feeds.feed_items(df, "2024-01-02", "2024-01-04").orderBy("article_url").collect()
    assert [(r["feed_url"], r["title"], r["categories"]) for r in got] == [("a", "t2", ["x & y"]), ("a", "t3", ["x & y"]), ("a", "t4", ["x & y"]), ("c", "It’s <b>on</b>", ["t"])]


def test_days_agree_with_the_engine(spark):
    texts = ["2024-01-03", "2024/1/3", "2024.01.03", "2024-01-03T10:00:00Z", "2024-01-03T23:30:00-05:00", "Wed, 03 Jan 2024 08:00:00 +0000", "3 Jan 2024 23:00:00 -0500", "soon", "", "2024-13-40"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dates.parse(F.col("t")).cast("date").alias("d")).collect()
    assert [feeds.day_of(t) for t in texts] == [r["d"] for r in got]


@pytest.fixture
def folder(tmp_path):
    for k in range(6):
        (tmp_path / f"f{k}.xml").write_text(RSS.format("".join(ITEM.format(f"t{k}", f"{k}/{i}", f"2024-01-{10 * k % 28 + i:02d}", "d") for i in range(1, 4))))
        os.utime(tmp_path / f"f{k}.xml", ns=(k, 10**18 + k))
    (tmp_path / "bad.xml").write_text(RSS.format("x")[:-3])
    os.utime(tmp_path / "bad.xml", ns=(0, 10**18))
    (tmp_path / "other.txt").write_text("no feed")
    return tmp_path


def test_data_source(spark, folder):
    feeds.register(spark)
    read = lambda **o: spark.read.format(feeds.FORMAT).options(**o).load(f"file://{folder}")
    assert read().count() == 18 and read(partitionBytes="1").rdd.getNumPartitions() == 7
    row = read().where("article_url = 'https://a.example/1/2'").first()
    assert (row["feed_url"], row["title"], row["published_day"], row["categories"]) == ("f1.xml", "t1", datetime.date(2024, 1, 12), ["x & y"])
    some = read().where("published_day between date'2024-01-02' and date'2024-01-12' and title <> 't5'")
    assert sorted(r["article_url"][-3:] for r in some.collect()) == ["0/2", "0/3", "1/1", "1/2", "3/1", "3/2", "3/3"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert ">=" not in plan and "<=" not in plan
    assert read().where("published_day > date'2024-01-12' and published_day < date'2024-01-14'").count() == 2
    with pytest.raises(Exception, match="path"):
        spark.read.format(feeds.FORMAT).load().count()


def test_pushed_bounds():
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual, StringContains

    reader = feeds.FeedReader({"path": "/nowhere"})
    day = datetime.date(2024, 1, 2)
    left = list(reader.pushFilters([GreaterThan(("published_day",), day), LessThanOrEqual(("published_day",), day + datetime.timedelta(5)), StringContains(("title",), "a"), EqualTo(("pos",), 3)]))
    assert [type(f) for f in left] == [StringContains, EqualTo] and (reader.low, reader.high) == (datetime.date(2024, 1, 3), datetime.date(2024, 1, 7))


def test_stream_goes_on_where_it_stopped(spark, folder, tmp_path_factory):
    """Each file is read once: by a stream, by the one that restarts from its offsets, with files that came in between."""
    feeds.register(spark)
    out = tmp_path_factory.mktemp("out")

    def run():
        stream = spark.readStream.format(feeds.FORMAT).load(str(folder))
        stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(once=True).start().awaitTermination()
        return sorted(r["article_url"] for r in spark.read.schema(stream.schema).parquet(f"{out}/data").collect())

    first = run()
    assert len(first) == len(set(first)) == 18
    assert run() == first
    (folder / "new.xml").write_text(RSS.format(ITEM.format("new", "new", "2024-02-01", "")))
    assert run() == sorted([*first, "https://a.example/new"])
