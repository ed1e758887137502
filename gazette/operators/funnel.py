"""Brand by week funnels and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, dates

STAGES = {"raw": "raw_count", "initial": "initial_dedupe_count", "survey": "survey_filter_count", "final": "final_count"}


def brand_week_counts(rows: DataFrame, brands: Column, day: Column) -> DataFrame:
    """brand, week_start, n: a row counts once for each of its brands; rows without a date do not count."""
    exploded = rows.select(F.explode(F.array_distinct(brands)).alias("brand"), dates.week_start(day).alias("week_start"))
    return exploded.where("week_start is not null and brand <> ''").groupBy("brand", "week_start").agg(F.count("*").alias("n"))


def stage_funnel(rows: DataFrame, brands: DataFrame, start: str, end: str) -> DataFrame:
    """A dense grid of the brands and the weeks between two days with the rows of each stage.

    rows: brand, day, stage (raw, initial, survey, final). brands: brand, the selection.
    """
    # With no time of day left, the week is all that remains to group by; stages become columns in the same aggregation.
    counts = rows.groupBy("brand", dates.week_start(F.col("day")).alias("week_start")).agg(*(F.count_if(F.col("stage") == s).alias(c) for s, c in STAGES.items()))
    first, last = dates.week_start(F.lit(start).cast("date")), dates.week_start(F.lit(end).cast("date"))
    grid = brands.select("brand").distinct().withColumn("week_start", F.explode(F.sequence(first, last, F.expr("interval 7 days"))))
    return grid.join(counts, ["brand", "week_start"], "left").select("brand", "week_start", *(F.coalesce(c, F.lit(0)).alias(c) for c in STAGES.values()))


def brand_totals(weekly: DataFrame, brands: DataFrame) -> DataFrame:
    """Weeks rolled up to brands, with a diagnosis; selected brands without rows stay with zeros."""
    sums = weekly.groupBy("brand").agg(*(F.sum(c).alias(c) for c in STAGES.values()))
    out = brands.select("brand").distinct().join(sums, "brand", "full").select("brand", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in STAGES.values()))
    return out.withColumn("diagnosis", classify.diagnosis(*(F.col(c) for c in STAGES.values())))


def reason_counts(rows: DataFrame, key: str, reason: str, top: int | None = None) -> DataFrame:
    """key, reason, n, rank: how often each reason occurs, ranked within its key (ties by name)."""
    counts = rows.where(F.col(reason) != "").groupBy(key, reason).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), reason)))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def low_volume_fill(candidates: DataFrame, kept: DataFrame, target: int = 7) -> DataFrame:
    """Newest candidates by brand and week until ``target`` rows are there. Both: brand, week_start; candidates: ts, pos.

    For rows of one brand each: the first ``target`` of a group are found on the map side, then what is there already is taken off.
    """
    have = kept.groupBy("brand", "week_start").agg(F.count("*").alias("have"))
    order = Window.partitionBy("brand", "week_start").orderBy(F.desc("ts"), "pos")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= target).join(have, ["brand", "week_start"], "left")
    return ranked.where(F.col("rank") <= F.lit(target) - F.coalesce("have", F.lit(0))).drop("rank", "have")


def greedy_fill(candidates: DataFrame, kept: DataFrame, target: int = 7) -> DataFrame:
    """(pos) of the candidates that fill up thin weeks. candidates: pos, day, brands (list), stamp; kept: day, brands.

    From the newest on (ties: the smaller pos) a candidate is added while any of its brands has under ``target`` rows in its week;
    it counts for these brands then. Behind ``target`` newer candidates of a brand that brand is full, so only what is among the
    ``target`` newest of one of its brands can be added, and only that goes to the week's task.
    """
    week = dates.week_start(F.col("day"))
    have = kept.select(F.explode(F.array_distinct("brands")).alias("brand"), week.alias("week_start")).where("week_start is not null").groupBy("brand", "week_start").agg(F.count("*").alias("have"))
    each = candidates.select("pos", "stamp", week.alias("week_start"), F.explode(F.array_distinct("brands")).alias("brand")).where("week_start is not null")
    order = Window.partitionBy("brand", "week_start").orderBy(F.desc("stamp"), "pos")
    near = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= target)
    near = near.join(have, ["brand", "week_start"], "left").select("pos", "stamp", "week_start", "brand", F.coalesce("have", F.lit(0)).alias("have"))
    # A candidate that is among the newest for one brand counts for its other brands as well.
    rest = each.join(near.select("pos").distinct(), "pos", "left_semi").join(have, ["brand", "week_start"], "left").select("pos", "stamp", "week_start", "brand", F.coalesce("have", F.lit(0)).alias("have"))

    def run(frame):
        import pandas as pd

        count = dict(zip(frame["brand"], frame["have"], strict=True))
        added = []
        for (_, pos), part in sorted(((s, p), g) for (s, p), g in frame.assign(neg=frame["stamp"].map(_newest_first)).groupby(["neg", "pos"], sort=False)):
            thin = [b for b in part["brand"] if count[b] < target]
            if thin:
                added.append(pos)
                for b in thin:
                    count[b] += 1
        return pd.DataFrame({"pos": pd.Series(added, dtype="int64")})

    return rest.groupBy("week_start").applyInPandas(run, "pos long")


def _newest_first(stamp: str) -> tuple[int, ...]:
    """A text's place in descending order."""
    return tuple(-ord(c) for c in stamp) + (1,)


#: Platforms that let articles in without the market's name; strategies of queries that look for them.
BROAD_LABELS = ["TEMU", "TTS", "IG"]
BROAD_STRATEGIES = ["platform_broad_eu_global", "platform_broad_short"]
SEVERAL_PLATFORMS = "multi_platform_regulatory_or_market_event"


def broad_entry_summary(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a platform of ``BROAD_LABELS``: sums over queries, and what became of the articles let in.

    queries: platform, strategy, feed_count, kept_count, entry_count. rows: platforms (list), reason, in_survey, in_final of the
    articles let in.
    """
    broad = F.col("strategy").isin(BROAD_STRATEGIES)
    short = F.col("strategy") == BROAD_STRATEGIES[1]

    def total(c: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0)).cast("long")

    sums = queries.where(F.col("platform").isin(BROAD_LABELS)).groupBy("platform").agg(
        total("feed_count", ~broad).alias("target_market_feed_count"), total("kept_count", ~broad).alias("target_market_kept_count"), total("feed_count", broad).alias("broad_feed_count"), total("kept_count", broad).alias("broad_kept_count"),
        total("feed_count", short).alias("broad_short_feed_count"), total("kept_count", short).alias("broad_short_kept_count"), total("entry_count", broad).alias("broad_entry_count"),
    )
    each = rows.select(F.explode(F.array_distinct("platforms")).alias("platform"), "reason", "in_survey", "in_final").where(F.col("platform").isin(BROAD_LABELS))
    fates = each.groupBy("platform").agg(
        F.count("*").alias("broad_entry_before_filter_count"), F.count_if("in_survey").alias("broad_entry_ai_kept_count"), F.count_if("in_final").alias("broad_entry_final_count"), F.count_if(~F.col("in_survey")).alias("broad_entry_ai_excluded_count"),
        F.count_if(F.col("reason") == SEVERAL_PLATFORMS).alias("multi_platform_event_kept_count"),
    )
    out = sums.join(fates, "platform", "full")
    return out.select("platform", *(F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "platform"))


def low_volume_diagnostics(totals: DataFrame, engines: DataFrame, skipped: DataFrame, broad: DataFrame, platforms: list[str] | None = None, engine: str = "google", top: int = 6) -> DataFrame:
    """One row for each asked platform: its tasks, feeds, kept rows, stage counts, top skip reasons (a report's feature) and broad
    entries. totals: brand and the stages' counts; engines: platform, engine, task_count, feed_count, kept_count; skipped:
    platform, reason, n; broad: ``broad_entry_summary``.
    """
    asked = totals.sparkSession.createDataFrame([(p,) for p in platforms or ["TTS", "IG"]], "platform string")
    reasons = skipped.groupBy("platform", "reason").agg(F.sum("n").alias("n"))
    ranked = reasons.withColumn("rank", F.row_number().over(Window.partitionBy("platform").orderBy(F.desc("n"), "reason"))).where(F.col("rank") <= top)
    best = ranked.groupBy("platform").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "reason", "n"))), lambda x: F.struct(x["reason"].alias("reason"), x["n"].alias("n"))).alias("top_skipped"))
    own = engines.where(F.col("engine") == engine).select("platform", "task_count", "feed_count", "kept_count")
    out = asked.join(totals.withColumnRenamed("brand", "platform"), "platform", "left").join(own, "platform", "left").join(best, "platform", "left").join(broad, "platform", "left")
    entered = F.when(F.coalesce("broad_entry_before_filter_count", F.lit(0)) > 0, F.col("broad_entry_before_filter_count")).otherwise(F.coalesce("broad_entry_count", F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "platform", zero("task_count").alias("search_task_count"), zero("feed_count").alias("search_feed_count"), zero("kept_count").alias("entry_kept_count"), *(zero(c).alias(c) for c in STAGES.values()), "top_skipped",
        entered.cast("long").alias("broad_entry_before_filter_count"), zero("broad_entry_ai_kept_count").alias("broad_entry_ai_kept_count"), zero("broad_entry_final_count").alias("broad_entry_final_count"),
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    """The mean of positive values by positive weights; null if there are none."""
    use = (value > 0) & (weight > 0)
    return F.try_divide(F.sum(F.when(use, value * weight)), F.sum(F.when(use, weight)))
