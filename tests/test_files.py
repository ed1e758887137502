import json

from gazette.sources import files


def test_registry_and_configs(spark, tmp_path):
    rows = [{"platform": "", "side": "Media", "source_url": "https://m.example/"}, {"platform": "P", "side": "buyer", "source_url": "https://p.example/"}, {"platform": "P", "side": "buyer", "source_url": "https://p.example/"}, {"platform": "P", "side": "other", "source_url": "x"}, {"platform": "P", "side": "seller", "source_url": "y", "active": False}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps({"sources": rows}))
    for name in ("a.json", "b.json"):
        assert [(r["platform"], r["side"]) for r in files.read_sources(spark, str(tmp_path / name)).orderBy("pos").collect()] == [("General Media", "media"), ("P", "buyer")]
    (tmp_path / "c.json").write_text(json.dumps({"Example.com": {"a": 1}, "x": 3, "news.example.com": {"a": 2}}))
    urls = spark.createDataFrame([("https://www.news.example.com/1",), ("https://shop.example.com/",), ("https://other.example/",)], "url string")
    assert {r["url"]: json.loads(r["config"])["a"] for r in files.config_for(urls, files.read_map(spark, str(tmp_path / "c.json"))).collect()} == {"https://www.news.example.com/1": 2, "https://shop.example.com/": 1}


def test_csv(spark, tmp_path):
    folder = tmp_path / "runs" / "run1"
    folder.mkdir(parents=True)
    (folder / "after.csv").write_text("﻿title,n\n\"a\nb\",1\n", encoding="utf-8")
    assert files.read_csv(spark, str(folder / "after.csv")).collect()[0]["title"] == "a\nb"
    assert [r["run_id"] for r in files.run_files(spark, str(tmp_path / "runs")).collect()] == ["run1"]
    (folder / "before.csv").write_text("title,n\n", encoding="utf-8")
    (folder / "metadata.json").write_text('{"a": 1}')
    assert {r["path"].rsplit("/", 1)[1]: r["n"] for r in files.csv_row_counts(spark, str(tmp_path / "runs")).collect()} == {"after.csv": 1, "before.csv": 0}
    assert [(r["run_id"], r["metadata"]) for r in files.run_metadata(spark, str(tmp_path / "runs")).collect()] == [("run1", '{"a": 1}')]
    for k in range(60):
        (folder / f"f{k}.csv").write_text("a\n1\n")
    assert files.run_files(spark, str(tmp_path / "runs")).count() == 62 and files.run_files(spark, str(tmp_path / "runs"), 5).count() == 5


def test_configurations_have_no_cap(spark):
    from pyspark.sql import functions as F

    from gazette.operators import store

    base = spark.range(10_050).select(F.lit(0).alias("country"), F.col("id").cast("string").alias("key"), F.lit("d").alias("value"))
    own = spark.range(10_050).select(F.lit(1).alias("country"), F.col("id").cast("string").alias("key"), F.lit("own").alias("value"))
    got = {(r[0], r[1]): r[2] for r in store.overlay(base, own, ["country", "key"], 0).groupBy("country", "value").count().select("country", "value", "count").collect()}
    assert got == {(0, "d"): 10_050, (1, "own"): 10_050}
    configs = spark.range(100_050).select(F.concat(F.lit("h"), F.col("id"), F.lit(".example")).alias("domain"), F.lit("{}").alias("config"))
    urls = configs.select(F.concat(F.lit("https://"), F.col("domain"), F.lit("/a")).alias("url"))
    assert files.config_for(urls, configs).count() == 100_050
