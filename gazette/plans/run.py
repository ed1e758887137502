"""A whole run: collected articles to kept rows, funnel and report, as one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, context, text
from ..operators import briefing, dedup, funnel, messages, survey
from ..operators.browse import identity
from ..operators.stored import stored


def run(
    collected: DataFrame, indicators: DataFrame, lookup: dict[str, list[str]], questions: dict[str, list[str]], home: list[str], country: str, code: str, today: str, mode: str = "balanced",
    answers: DataFrame | None = None, cluster_scorer: Callable[[list[dict]], set[int] | None] | None = None,
) -> dict[str, DataFrame]:
    """raw, initial, survey, final, excluded, stages and briefing of a run.

    collected: articles with pos, title, summary, platform, platform_label, published_at, article_url. lookup, questions: the
    questionnaire's keywords and ids by dimension. answers: a scorer's (batch, payload); without them the keyword rule decides.
    cluster_scorer: drops reports of one event. The four snapshots are written once and read from there.
    """
    raw = stored(collected)
    initial = stored(dedup.initial_dedupe(raw).drop("group_size"))
    hay = text.let(initial, "_said", context.relevance_text(initial))
    reason = context.hard_filter(F.col("_said"), F.col("title"), home)
    gone = classify.applies_hard_filter(F.col("_reason"), F.col("_level"), mode)
    # What is said of a row is stored with it: the fill asks it again.
    judged = stored(text.let(text.let(text.let(hay, "_level", context.platform_level(F.col("_said"))), "_reason", reason), "_hard", gone))
    open_rows = judged.where("not _hard")
    matched = survey.keyword_filter(open_rows, F.col("_said"), lookup, questions)
    method, extra = "keyword", {}
    excluded = judged.where("_hard").select("pos", F.col("_reason").alias("category"))
    if answers is not None:
        told = messages.decisions(answers)
        named = survey.matched_dimensions(survey.normalise_ids(told, "question_ids", indicators), "dimensions", indicators)
        scored = open_rows.join(named, "pos")
        silent = matched.join(named.select("pos"), "pos", "left_anti")
        columns = [*initial.columns, "dimensions", "question_ids"]
        no = scored.where("not relevant")
        excluded = excluded.unionByName(no.select("pos", context.exclusion_category(F.col("_said"), F.col("reason"), context.confidence_name(F.col("confidence"), "low")).alias("category")))
        yes = survey.enrich(scored.where("relevant").select(*columns, "reason", "confidence"), indicators, "ai", F.col("reason"), F.col("confidence")).drop("reason", "confidence")
        kept = yes.unionByName(survey.enrich(silent.select(*columns), indicators, "keyword_fallback"))
    else:
        kept = survey.enrich(matched.select(*initial.columns, "dimensions", "question_ids"), indicators, method, **extra)
    if mode == "balanced":
        kept = _filled(stored(kept), judged, initial.columns, indicators, lookup, questions)
    kept = stored(context.with_trend(kept, context.relevance_text(kept), context.looks_like_report(context.matched_text(kept))))
    final = kept
    if cluster_scorer is not None:
        final = stored(dedup.scored_dedupe(kept, dedup.event_clusters(kept), cluster_scorer))
    stages = None
    for name, rows in (("raw", raw), ("initial", initial), ("survey", kept), ("final", final)):
        one = rows.select(F.explode(F.array_distinct(brands(rows))).alias("brand"), F.to_date("published_at").alias("day"), F.lit(name).alias("stage"))
        stages = one if stages is None else stages.union(one)
    return {"raw": raw, "initial": initial, "survey": kept, "final": final, "excluded": excluded, "stages": stages, "briefing": briefing.briefing_table(final, country, code, today)}


def brands(df: DataFrame) -> Column:
    """Matched brands, then the parts of the platform's label."""
    parts = F.split(text.first_present(*(F.col(c) for c in ("platform_label", "platform") if c in df.columns)), r"[,|/]+")
    own = F.coalesce(F.col("matched_brands"), F.array().cast("array<string>")) if "matched_brands" in df.columns else F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.concat(own, parts), text.clean), lambda x: x != ""))


def _filled(kept: DataFrame, judged: DataFrame, columns: list[str], indicators: DataFrame, lookup: dict[str, list[str]], questions: dict[str, list[str]]) -> DataFrame:
    """The kept rows, and in thin weeks of a brand more of the judged ones that speak of a platform and match the questionnaire."""
    known = kept.select(identity(kept).alias("_id")).distinct()
    rows = judged.where("_level").withColumn("_id", identity(judged)).join(known, "_id", "left_anti")
    fit = survey.keyword_filter(rows, F.col("_said"), lookup, questions)
    fit = stored(fit.select(*columns, "dimensions", "question_ids"))
    candidates = fit.select("pos", F.to_date("published_at").alias("day"), brands(fit).alias("brands"), F.coalesce("published_at", F.lit("")).alias("stamp"))
    chosen = funnel.greedy_fill(candidates, kept.select(F.to_date("published_at").alias("day"), brands(kept).alias("brands")))
    more = survey.enrich(fit.join(chosen, "pos", "left_semi"), indicators, "low_volume_fill", F.lit(survey.FILL_REASON), F.lit("medium"), fill=True)
    return kept.unionByName(more)
