"""Requests to a scorer: batches of articles as messages, with the task, its rules and the answer's form."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .browse import batches

#: Fields of an article that each kind of request carries; lists are carried as lists.
FIELDS = {
    "survey": ["platform", "source_site", "published_at", "title", "title_translated", "summary", "summary_translated", "category", "body_excerpt", "tags", "article_url", "broad_entry", "broad_entry_reason", "market_scope", "search_query_strategy"],
    "sentiment": ["platform", "published_at", "title", "title_translated", "summary", "summary_translated", "survey_dimensions"],
    "translation": ["title"],
    "dedupe": ["platform", "published_at", "title", "title_translated", "summary", "article_url"],
    "briefing": ["platform_label", "title", "summary", "source_name", "published_at", "survey_dimensions", "survey_question_ids", "survey_indicator_examples"],
    "summary": ["platform_label", "title", "summary", "article_body_excerpt", "source_name", "published_at", "survey_dimensions", "industry_trend_reason"],
}


def _article(df: DataFrame, fields: list[str]) -> Column:
    kinds = dict(df.dtypes)

    def value(name: str) -> Column:
        if name not in kinds:
            return F.lit("").alias(name)
        if kinds[name].startswith("array"):
            return F.filter(F.transform(F.coalesce(name, F.array().cast(kinds[name])), lambda x: text.clean(x.cast("string"))), lambda x: x != "").alias(name)
        return text.clean(F.col(name).cast("string")).alias(name)

    return F.struct(F.col("pos").cast("string").alias("article_id"), *(value(f) for f in fields))


def batch_messages(rows: DataFrame, kind: str, system: str, task: str, rules: list[str] | None = None, answer: dict | None = None, indicators: list[dict] | None = None, size: int = 8, parts: int = 64) -> DataFrame:
    """batch, n, messages: JSON of a system and a user message for every ``size`` articles in the order of ``pos``.

    system, task, rules and answer are the request's wording; indicators, if given, go along with every batch.
    """
    numbered = batches(rows, size, "pos", parts).withColumn("_a", _article(rows, FIELDS[kind]))
    grouped = numbered.groupBy("batch").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("slot", "_a"))), lambda s: s["_a"]).alias("articles"))  # ``size`` rows a batch
    head = json.dumps({"task": task, "strict_rules": rules or []}, ensure_ascii=False)[:-1]
    tail = "".join(f", {json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in (("survey_indicators", indicators), ("output_schema", answer)) if v is not None)
    content = F.concat(F.lit(head + ', "articles": '), F.to_json("articles"), F.lit(tail + "}"))
    messages = F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(" ".join(system.split())).alias("content")), F.struct(F.lit("user").alias("role"), content.alias("content"))))
    return grouped.select("batch", "n", messages.alias("messages"))


def decisions(answers: DataFrame) -> DataFrame:
    """pos, relevant, dimensions, question_ids, reason, confidence out of scorers' answers (batch, payload); bad JSON gives none.

    Of several decisions about an article the last one of its answer counts.
    """
    from ..functions.payload import payload_items

    item = "struct<article_id:string,relevant:boolean,matched_dimensions:array<string>,matched_question_ids:array<string>,reason:string,confidence:string>"
    each = answers.select("batch", F.posexplode(payload_items(F.col("payload"))).alias("_i", "_x")).select("batch", "_i", F.from_json("_x", item).alias("d")).where("d.article_id rlike '^[0-9]+$'")
    none = F.array().cast("array<string>")
    best = each.groupBy(F.col("d.article_id").cast("long").alias("pos")).agg(F.max_by("d", F.struct("batch", "_i")).alias("d"))
    return best.select("pos", F.coalesce("d.relevant", F.lit(False)).alias("relevant"), F.coalesce("d.matched_dimensions", none).alias("dimensions"), F.coalesce("d.matched_question_ids", none).alias("question_ids"), text.clean(F.col("d.reason")).alias("reason"), F.col("d.confidence").alias("confidence"))
