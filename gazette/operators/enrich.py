"""Enrichment by foreign functions: each distinct input once, failures keep what was there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text, urls

def translate(rows: DataFrame, columns: list[str], translator: Callable[[str], str], suffix: str = "_translated") -> DataFrame:
    """Adds translated columns: every distinct text is translated once, in the executors, and joined back.

    A text that fails stays null, and is told from an empty one that way.
    """

    @F.pandas_udf("string")
    def run(texts):
        def one(t):
            try:
                return translator(t)
            except Exception:  # noqa: BLE001  foreign code; the row keeps its original text
                return None

        return texts.map(one)

    texts = rows.select(F.explode(F.array(*(text.present(F.col(c)) for c in columns))).alias("_t")).where("_t is not null").distinct()
    known = texts.withColumn("_to", run("_t"))
    out = rows
    for c in columns:
        out = out.withColumn("_t", text.present(F.col(c))).join(known, "_t", "left").withColumn(c + suffix, F.col("_to")).drop("_t", "_to")
    return out


def refresh(previous: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh snapshots over previous ones; where the refresh has nothing the previous snapshot stays."""
    rest = [c for c in previous.columns if c != key]
    a, b = previous.select(key, F.struct(*rest).alias("_old")), fresh.select(key, F.struct(*rest).alias("_new"))
    out = a.join(b, key, "full").withColumn("_s", F.coalesce("_new", "_old"))
    return out.select(key, *(F.col(f"_s.{c}").alias(c) for c in rest))


def error_histogram(results: DataFrame) -> DataFrame:
    """category, n over results(status, note) whose status is an error."""
    return results.where("status = 'error'").groupBy(classify.error_category(F.col("note")).alias("category")).agg(F.count("*").alias("n"))


#: Names of two platforms with their full names and abbreviations; any other one is its own full name.
FULL_NAMES = {"TTS": ["tiktok shop", "tiktok"], "IG": ["instagram", "instagram shop", "instagram shopping"]}
ABBREVIATIONS = {"TTS": ["tts", "tt shop"], "IG": ["ig", "ins", "ins-dtc"]}
UNFOLDED, SHORTENED = "品牌别名未展开到全称，可能影响搜索入池。", "品牌别名似乎只包含缩写，建议补充平台全称。"


def platform_concept(c: Column) -> Column:
    """The platform that a label means: letters and digits of the label decide; empty: none that is known."""
    spaced = F.trim(F.regexp_replace(F.lower(text.clean(c)), r"[^a-z0-9]+", " "))
    tight = F.replace(spaced, F.lit(" "), F.lit(""))
    network = spaced.contains("instagram") | tight.isin("ig", "ins", "insdtc", "insshop", "instagramshop", "instagramshopping") | (spaced.contains("ins") & spaced.contains("dtc"))
    video = spaced.contains("tiktok") | tight.isin("tts", "ttsop", "tiktokshop", "ttshop")
    return classify.first_match([(spaced == "", ""), (network, "instagram_shopping"), (video, "tiktok_shop"), *((spaced.contains(n), n) for n in ("amazon", "zalando", "shein", "temu", "rakuten"))], "")


def alias_summary(aliases: DataFrame, terms: int = 12) -> DataFrame:
    """platform, alias_count, has_full_name, abbreviation_only, representative_terms (the first ``terms``), warnings of each
    platform of aliases(platform, alias, pos)."""
    tidy = aliases.withColumn("alias", text.clean(F.col("alias"))).where("alias <> ''")
    once = tidy.groupBy("platform", "alias").agg(F.min("pos").alias("pos"))
    grouped = once.groupBy("platform").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "alias"))), lambda s: s["alias"]).alias("a"))
    concept = platform_concept(F.col("platform"))
    key = F.when(concept == "tiktok_shop", "TTS").when(concept == "instagram_shopping", "IG").otherwise(F.col("platform"))

    def of(table: dict[str, list[str]], default: Column) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), key), default)

    low = F.transform("a", F.lower)
    full = F.exists(low, lambda t: F.exists(of(FULL_NAMES, F.array(F.lower("platform"))), lambda f: t.contains(f)))
    short = ~full & F.forall(low, lambda t: F.array_contains(of(ABBREVIATIONS, F.array().cast("array<string>")), t))
    warnings = F.array_compact(F.array(F.when(key.isin("TTS", "IG") & ~full, UNFOLDED), F.when(short, SHORTENED)))
    return grouped.select("platform", F.size("a").alias("alias_count"), full.alias("has_full_name"), short.alias("abbreviation_only"), F.slice("a", 1, terms).alias("representative_terms"), warnings.alias("warnings"))


def summary_fallback(rows: DataFrame, pages: DataFrame, translated: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (article_url, published_at, title, summary) whose blank summary is their page's, where one is stored.

    pages: url, published_at, title, summary, body_excerpt (``pages.page_articles``), each URL looked up once. A page counts if it is
    dated within a day of its row, where both have a date, and if page or row has a title. ``translated`` adds ``summary_translated``
    to what was found (``scorer.translations``, say); where that is blank the summary stays as it is.
    """
    from ..functions import dates

    known = pages.where(F.trim("url") != "").groupBy(F.trim("url").alias("_url")).agg(F.min(F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in ("published_at", "title", "summary", "body_excerpt")))).alias("_page"))
    blank = text.clean(F.col("summary")) == ""
    out = rows.withColumn("_asked", F.when(blank, F.trim("article_url"))).join(known, F.col("_asked") == F.col("_url"), "left")
    own, theirs = dates.parse(F.col("published_at")), dates.parse(F.col("_page.published_at"))
    near = F.coalesce(F.abs(F.unix_timestamp(theirs) - F.unix_timestamp(own)) <= 86400, F.lit(True))
    titled = text.first_present(F.col("_page.title"), F.col("title")) != ""
    found = F.when(blank & near & titled, text.merged(F.col("_page.summary"), F.lit(""), F.col("_page.body_excerpt")))
    out = text.let(out, "_found", F.coalesce(found, F.lit("")))
    if translated is not None:
        texts = translated(out.where("_found <> ''").select(F.col("_found").alias("summary")).distinct()).select(F.col("summary").alias("_t"), "summary_translated")
        out = out.join(texts.withColumnRenamed("summary_translated", "_to"), F.col("_found") == F.col("_t"), "left").withColumn("_found", F.coalesce(F.nullif(text.clean(F.col("_to")), F.lit("")), "_found"))
    return out.select(*(F.when(blank, F.col("_found")).otherwise(F.col(c)).alias(c) if c == "summary" else F.col(c) for c in rows.columns))


def body_context(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (article_url) with their page's text: article_body_excerpt, article_body_fetch_status and resolved_article_url.

    pages: url, status_code, html of stored pages. Status: ok, empty (no text), failed (an error code), missing_url, not_stored.
    """
    from collections.abc import Iterator

    import pandas as pd

    from ..sources.dom import parse

    skip = frozenset({"script", "style", "noscript", "svg", "form", "nav", "footer", "header"})

    def readable(html: str | None) -> str:
        root = parse(html)
        boxes = [t for s in ("article", "main", '[role="main"]') for n in root.select(s) if len(t := n.text(skip)) >= 200]
        return max(boxes, key=len) if boxes else " ".join(t for n in root.select("p, li") if len(t := n.text(skip)) >= 30)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"_url": frame["url"], "_code": frame["status_code"], "_text": [readable(h) for h in frame["html"]]})

    target = rows.withColumn("resolved_article_url", F.trim(urls.redirect_target(F.col("article_url"))))
    asked = target.select(F.col("resolved_article_url").alias("url")).where("url <> ''").distinct()
    once = pages.join(asked, "url", "left_semi").dropDuplicates(["url"]).select("url", "status_code", "html")
    known = once.mapInPandas(run, "_url string, _code int, _text string")
    out = target.join(known, F.col("resolved_article_url") == F.col("_url"), "left")
    status = classify.first_match([(F.coalesce("resolved_article_url", F.lit("")) == "", "missing_url"), (F.col("_url").isNull(), "not_stored"), (F.col("_code") >= 400, "failed"), (F.col("_text") == "", "empty")], "ok")
    return out.select(*target.columns, F.when(status == "ok", F.col("_text")).otherwise("").alias("article_body_excerpt"), status.alias("article_body_fetch_status"))


def audit_sources(sources: DataFrame, pages: DataFrame, checked_at: str) -> DataFrame:
    """Sources (source_url) with status, note, http_status and country of their stored page (url, status_code, final_url, html)."""
    p = pages.select(F.col("url").alias("_url"), F.struct("status_code", "final_url", "html").alias("_p")).dropDuplicates(["_url"])
    out = sources.join(p, F.col("source_url") == F.col("_url"), "left")
    found = classify.source_status(F.col("source_url"), F.col("_p.status_code"), F.col("_p.final_url"), F.col("_p.html"))
    return out.select(*sources.columns, found["status"].alias("status"), found["note"].alias("note"), F.col("_p.status_code").alias("http_status"), classify.guess_country(F.col("source_url")).alias("country"), F.lit(checked_at).alias("checked_at"))


def verified(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidate articles (article_url, title) whose stored page is public and holds their title."""
    p = pages.select(F.col("url").alias("_url"), F.struct("status_code", "final_url", "html").alias("_p")).dropDuplicates(["_url"])
    rows = candidates.join(p, F.col("article_url") == F.col("_url"))
    found = classify.source_status(F.col("article_url"), F.col("_p.status_code"), F.col("_p.final_url"), F.col("_p.html"))
    return rows.where(found["status"] == "public").select(*candidates.columns, F.coalesce(F.nullif(F.col("_p.final_url"), F.lit("")), F.col("article_url")).alias("verification_final_url"))


def run_folder(country: Column, side: Column, stamp: Column, start: Column, end: Column) -> Column:
    """The name of a run's folder."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    return F.concat_ws("_", text.slug(country), text.slug(side), F.date_format(stamp, "yyyyMMdd_HHmmss"), F.concat_ws("-", day(start), day(end)))
