"""Streaming twins of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import WINDOW_DAYS, exact_key


def deduplicated(articles: DataFrame) -> DataFrame:
    """Articles of a stream whose exact key did not occur within the date window; published_ts is the event time."""
    keyed = articles.withColumn("_key", exact_key(articles)).withWatermark("published_ts", f"{WINDOW_DAYS} days")
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def weekly_counts(articles: DataFrame, late: str = "14 days") -> DataFrame:
    """brand, week_start, n over weeks that begin on Monday."""
    week = F.window("published_ts", "7 days", "7 days", "4 days")
    return articles.withWatermark("published_ts", late).groupBy("platform", week).agg(F.count("*").alias("n")).select(F.col("platform").alias("brand"), F.col("window.start").cast("date").alias("week_start"), "n")


def stage_totals(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """job, stage, events and last time of a progress stream, updated as events come in."""
    return events.withWatermark("ts", late).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def first_of_key(rows: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """One row of each key within a time of its first one."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def _folder(spark) -> str:
    """A new folder for a stream's output and state, in the shared folder; in one process without one, a temporary folder."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def drained(spark, sf_dir: str, name: str, transform) -> DataFrame:
    """A stream over a stored table, run until everything there is read, then its output as a table in the shared folder."""
    out = _folder(spark)
    done = transform(_stream(spark, sf_dir, name)).writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{out}/data")


def totals_table(spark, sf_dir: str, name: str) -> DataFrame:
    """Stage totals of a stored progress stream: every batch writes its updated totals, and the largest count of a key is its last."""
    out = _folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    rows = _stream(spark, sf_dir, name).withColumn("ts", F.col("ts").cast("timestamp"))
    done = stage_totals(rows).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    last = spark.read.parquet(f"{out}/data").groupBy("user_id", "event_type").agg(F.max(F.struct("n", "last_ts")).alias("l"))
    return last.select("user_id", "event_type", F.col("l.n").alias("n"), F.col("l.last_ts").alias("last_ts"))
