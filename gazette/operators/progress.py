"""Job progress from an event log: stage durations, monotone percentages, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage_durations(events: DataFrame, job: str, stage: str, ts: str, tie: str) -> DataFrame:
    """job, stage, seconds, visits: each event lasts until the job's next one; the last one lasts no time."""
    window = Window.partitionBy(job).orderBy(ts, tie)
    at = F.col(ts).cast("timestamp")
    spans = events.withColumn("_s", F.coalesce(F.unix_micros(F.lead(at).over(window)) - F.unix_micros(at), F.lit(0)))
    return spans.groupBy(job, stage).agg(F.floor(F.sum("_s") / 1_000_000).alias("seconds"), F.count("*").alias("visits"))


def monotone(events: DataFrame, job: str, value: Column, ts: str, tie: str) -> DataFrame:
    """Adds percent: the largest clamped value so far of a job."""
    window = Window.partitionBy(job).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("percent", F.max(F.least(F.lit(99), F.greatest(F.lit(2), F.bround(value).cast("int")))).over(window))


def steady_remaining(previous: Column, fresh: Column, elapsed: Column) -> Column:
    """A countdown that never rises by more than three seconds."""
    return F.least(F.greatest(fresh, F.lit(0)), F.greatest(previous - elapsed, F.lit(0)) + 3)


def blend(history: Column, fallback: Column, weight: float, least: float) -> Column:
    """Expected seconds: history weighted against the formula; the formula where there is no history."""
    return F.greatest(F.lit(least), F.round(F.coalesce(history * weight + fallback * (1 - weight), fallback)))


def history_weight(promo: Column, scored: Column, sites: Column, like: tuple[bool, bool, int]) -> Column:
    """How like a past run is to one with these settings."""
    record = F.greatest(F.lit(1), sites)
    near = F.least(record, F.lit(like[2])) / F.greatest(record, F.lit(like[2])) if like[2] > 0 else F.lit(0.0)
    return 1.0 + F.when(promo == like[0], 1.2).otherwise(0.0) + F.when(scored == like[1], 1.2).otherwise(0.0) + near


def last_of_each(rows: DataFrame, kind: str, ts: str, tie: str, keep: int = 80) -> DataFrame:
    """The newest ``keep`` rows of each kind."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(ts), F.desc(tie)))).where(F.col("_n") <= keep).drop("_n")


def counts_in(c: Column) -> Column:
    """``n/m`` in a message as a struct of longs; zeros where there is none."""
    pattern = r"(\d+)\s*/\s*(\d+)"

    def one(k: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).cast("long"), F.lit(0))

    return F.struct(one(1).alias("done"), one(2).alias("total"))
