"""Search tasks: platforms by keyword blocks by engines, each query once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Search engines.
ENGINES = ["google", "bing"]


def search_tasks(platforms: DataFrame, blocks: DataFrame, engines: list[str] | None = None) -> DataFrame:
    """task_id, platform, label, engine, query: platforms(platform, terms, pos) by blocks(label, block, pos) by engine.

    Platforms, blocks and engines are dimensions of a configuration, a few rows each.
    """
    own = engines or ENGINES
    names = F.explode(F.array(*(F.struct(F.lit(i).alias("e"), F.lit(n).alias("engine")) for i, n in enumerate(own))))
    query = F.concat_ws(" ", text.or_block(F.col("terms")), F.col("block"))
    all_tasks = platforms.withColumnRenamed("pos", "p").join(F.broadcast(blocks.withColumnRenamed("pos", "b")), F.lit(True)).withColumn("n", names).select("p", "b", "n.*", "platform", "label", query.alias("query"))
    first = Window.partitionBy("engine", "query").orderBy("p", "b")
    return all_tasks.withColumn("k", F.row_number().over(first)).where("k = 1").select(F.sha1(F.concat_ws("|", "engine", "query").cast("binary")).alias("task_id"), "platform", "label", "engine", "query")


def platform_terms(platforms: DataFrame, suffixes: DataFrame, limit: int = 6) -> DataFrame:
    """platform, terms: a platform's own aliases, then its name with each country suffix; distinct, the first ``limit``."""
    own = platforms.select("platform", F.posexplode("aliases").alias("i", "term"))
    made = platforms.join(F.broadcast(suffixes), F.lit(True)).select("platform", (F.lit(1000) + F.col("pos")).alias("i"), F.concat_ws(" ", "platform", "suffix").alias("term"))
    once = own.unionByName(made).withColumn("term", text.clean(F.col("term"))).where("term <> ''").groupBy("platform", "term").agg(F.min("i").alias("i"))
    return once.groupBy("platform").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("i", "term"))), lambda s: s["term"]), 1, limit).alias("terms"))


def resolve_platforms(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked, platform, custom: requested names looked up among aliases in any case; unknown ones are custom."""
    known = aliases.select(F.lower(text.clean(F.col("alias"))).alias("_k"), "platform").dropDuplicates(["_k"])
    out = asked.withColumn("_k", F.lower(text.clean(F.col("asked")))).join(F.broadcast(known), "_k", "left")
    return out.select("asked", F.coalesce("platform", text.clean(F.col("asked"))).alias("platform"), F.col("platform").isNull().alias("custom"))
