"""Readers: the driver tables, and articles derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the title is the text up to its first full stop or line feed, the source is the platform."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int"))
    return d.select(
        F.col("doc_id").alias("pos"), F.col("source").alias("platform"), day.alias("published_date"), day.cast("string").alias("published_at"),
        F.regexp_extract("text", r"^([^.\n]*)", 1).alias("title"), F.col("text").alias("summary"), F.lit("").alias("article_url"), F.col("lang"), F.col("source").alias("source_site"),
    )


def linked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles with URLs of the stored pages for two in three of them: two neighbours share a page, each as it was shared, with
    trackers and a fragment of its own."""
    pages = table(spark, sf_dir, "pages")
    # Unique ids from 0 on: each article meets one page.
    links = pages.select(F.col("page_id").alias("_page"), F.split_part("url", F.lit("#"), F.lit(1)).alias("_url"))
    # Those without a page ask for one of their own that is not there: nulls would all go to one task of the join.
    rows = articles(spark, sf_dir).withColumn("_page", F.when(F.col("pos") % 3 != 0, F.expr("pos div 2") % pages.count()).otherwise(-1 - F.col("pos")))
    own = F.concat(F.col("_url"), F.when(F.contains("_url", F.lit("?")), "&").otherwise("?"), F.lit("utm_medium=m"), F.col("pos") % 4, F.lit("&fbclid="), F.col("pos"), F.when(F.col("pos") % 4 == 0, "#x").otherwise(""))
    return rows.join(links, "_page", "left").withColumn("article_url", F.coalesce(own, F.lit(""))).drop("_page", "_url")
