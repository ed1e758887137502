"""The interactive article query: filter, group, merge, facet, sort, limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from .dedup import _col
from .stored import stored


def longest(c: str) -> Column:
    """The longest text of a group (ties: the first one)."""
    return F.max_by(F.col(c), F.struct(F.char_length(text.clean(F.col(c))), -F.col("pos")))


def first_filled(c: str) -> Column:
    return F.min_by(F.col(c), F.when(text.clean(F.col(c)) != "", F.col("pos")))


def united(c: str) -> Column:
    return text.union_text(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col(c).alias("v")))), lambda s: s["v"]))


def decided(c: str) -> Column:
    """The first sentiment that is not neutral, else Neutral."""
    return F.coalesce(F.min_by(F.col(c), F.when(~F.coalesce(F.col(c), F.lit("")).isin("", "Neutral"), F.col("pos"))), F.lit("Neutral"))


def browse(articles: DataFrame, keyword: str = "", platform: str = "", star: str = "", limit: int | None = 50) -> DataFrame:
    """Rows with the keyword in title, summary, platform or source, merged by URL (or platform, day and title), then filtered
    by platform and star, newest first. articles: pos, title, summary, platform, source_site, published_at, article_url,
    starred, sentiment, dimensions.
    """
    rows = articles
    if keyword:
        hay = text.lower(F.concat_ws(" ", "title", "summary", "platform", "source_site"))
        rows = rows.where(hay.contains(keyword.lower()))
    url = urls.canonical(F.col("article_url"))
    key = F.when(url != "", F.concat(F.lit("u:"), url)).otherwise(F.concat_ws("\x1f", F.lit("t"), F.col("platform"), F.left("published_at", F.lit(10)), text.title_key(F.col("title"))))
    merged = rows.withColumn("_k", key).groupBy("_k").agg(
        F.min("pos").alias("pos"), longest("title").alias("title"), longest("summary").alias("summary"), first_filled("platform").alias("platform"), first_filled("source_site").alias("source_site"),
        F.max("published_at").alias("published_at"), first_filled("article_url").alias("article_url"), F.bool_or(F.coalesce("starred", F.lit(False))).alias("starred"), decided("sentiment").alias("sentiment"), united("dimensions").alias("dimensions"), F.count("*").alias("merged"),
    ).drop("_k")
    if platform:
        merged = merged.where(F.col("platform") == platform)
    if star:
        merged = merged.where(F.col("starred") == F.lit(star == "starred"))
    merged = merged.orderBy(F.desc("published_at"), "pos")
    return merged if limit is None else merged.limit(max(5, min(200, limit)))


def facets(articles: DataFrame) -> DataFrame:
    """platform, n, starred: the brand facet over all raw rows."""
    return articles.groupBy("platform").agg(F.count("*").alias("n"), F.count_if("starred").alias("starred"))


def selected(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows with a ticked id; an error where none is ticked or none of the ticked ones is there."""
    ticked = ids.select(key).where(F.col(key).isNotNull()).distinct()
    if ticked.isEmpty():
        raise ValueError("no article is ticked")
    out = rows.join(ticked, key, "left_semi")
    if out.isEmpty():
        raise ValueError("none of the ticked articles is in this source")
    return out


def export_score(df: DataFrame) -> Column:
    """How much a row says: has a summary, dimensions, a source; length of summary and title."""

    def filled(c: str) -> Column:
        return (F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int") if c in df.columns else F.lit(0)

    length = lambda c: F.char_length(F.coalesce(F.col(c), F.lit("")))
    return F.struct(filled("summary").alias("a"), filled("survey_dimensions").alias("b"), filled("source_name").alias("c"), length("summary").alias("d"), length("title").alias("e"), (-F.col("pos")).alias("f"))


def star_export(stars: DataFrame, rows: DataFrame) -> DataFrame:
    """Every star with its best row over all runs (by score; ties: the first one), or with none."""
    best = rows.groupBy("article_id").agg(F.max_by(F.struct("pos", "title", "platform"), export_score(rows)).alias("b"))
    return stars.join(best, "article_id", "left").select("article_id", F.col("b.pos").alias("pos"), F.col("b.title").alias("title"), F.col("b.platform").alias("platform"))


def identity(df: DataFrame) -> Column:
    """What an article is known by across stages: its URL in lower case, else platform, day and title as compared."""
    url = F.lower(_col(df, "verification_final_url", "article_url"))
    title = text.title_key(_col(df, "title", "title_translated"))
    rest = F.concat(F.lit("text:"), F.concat_ws("|", F.lower(_col(df, "platform_label", "platform")), F.left(_col(df, "published_at"), F.lit(10)), title))
    return F.when(url != "", F.concat(F.lit("url:"), url)).otherwise(rest)


def survivors(stage: DataFrame, later: DataFrame, key: str) -> DataFrame:
    return stage.join(later.select(key).distinct(), key, "left_semi")


def lost(stage: DataFrame, later: DataFrame, key: str) -> DataFrame:
    return stage.join(later.select(key).distinct(), key, "left_anti")


def batches(rows: DataFrame, size: int, order: str = "pos", parts: int = 64) -> DataFrame:
    """Adds batch and slot: numbers rows in order without one task seeing them all, then cuts every ``size`` rows.

    The ranges are drawn by a sample of the keys, which may fall out differently each time it is drawn: their first keys (``parts`` at
    most) are written down once, and say for every reader which range a row is in. Rows move once.
    """
    drawn = rows.select(F.col(order).alias("_key")).repartitionByRange(parts, "_key").withColumn("_p", F.spark_partition_id())
    first = stored(drawn.groupBy("_p").agg(F.min("_key").alias("_key")).agg(F.sort_array(F.collect_list("_key")).alias("_first")))
    ranged = rows.join(F.broadcast(first)).withColumn("_p", F.size(F.filter("_first", lambda x: x <= F.col(order)))).drop("_first")
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    begin = sizes.withColumn("_b", F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_b", F.lit(0)).alias("_b"))  # ``parts`` rows and one at most
    at = F.col("_b") + F.col("_i")
    return local.join(F.broadcast(begin), "_p").withColumn("batch", F.floor(at / size)).withColumn("slot", F.pmod(at, F.lit(size))).drop("_p", "_i", "_b")
