"""Configuration and run files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.dedup import keep_first

_SOURCE = "struct<platform:string,side:string,source_url:string,active:boolean>"


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """pos, platform, side, source_url of a JSON registry, a list or ``{"sources": [...]}``: active ones with a known side and a
    URL, each once; media without a platform are general media."""
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.ltrim("value").startswith("{")
    rows = F.when(wrapped, F.from_json("value", f"struct<sources:array<{_SOURCE}>>")["sources"]).otherwise(F.from_json("value", f"array<{_SOURCE}>"))
    out = raw.select(F.posexplode(rows).alias("pos", "s")).select("pos", text.clean(F.col("s.platform")).alias("platform"), F.lower(text.clean(F.col("s.side"))).alias("side"), text.clean(F.col("s.source_url")).alias("source_url"), F.coalesce("s.active", F.lit(True)).alias("active"))
    out = out.where("active and side in ('media', 'buyer', 'seller') and source_url <> ''").drop("active")
    out = out.withColumn("platform", F.when((F.col("platform") == "") & (F.col("side") == "media"), "General Media").otherwise(F.col("platform"))).where("platform <> ''")
    return keep_first(out, "platform", "side", "source_url")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """domain, config of a JSON object keyed by domain; values that are no objects go."""
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("domain", "config"))
    return pairs.select(F.lower(F.trim("domain")).alias("domain"), "config").where("config like '{%'")


def config_for(urls: DataFrame, configs: DataFrame) -> DataFrame:
    """url, config: the configuration of the URL's domain, or of the longest domain that it is below."""
    from ..functions.urls import host

    parts = F.split(host(F.col("url")), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "."))
    tried = urls.select("url", F.posexplode(tails).alias("k", "domain"))
    return tried.join(configs, "domain").groupBy("url").agg(F.min_by("config", "k").alias("config"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text, a byte order mark ignored."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def run_files(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """path, run_id, modified of the CSV files of run folders, newest first; a listing may ask for the first ``limit`` of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select("path", "modificationTime")
    out = files.select("path", F.element_at(F.split("path", "/"), -2).alias("run_id"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")
    return out if limit is None else out.limit(limit)


def csv_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """path, n: the rows of each CSV file of run folders, without its header; quoted line feeds are part of their row."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    counts = reader.schema("first string").option("enforceSchema", True).csv(folder).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("n"))
    every = run_files(spark, folder).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    return every.join(counts.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")), "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


def run_metadata(spark: SparkSession, folder: str, name: str = "metadata.json") -> DataFrame:
    """run_id, metadata (JSON) of run folders that hold such a file beside their rows."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(folder, wholetext=True)
    return raw.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run_id"), F.col("value").alias("metadata")).where(F.ltrim("metadata").startswith("{"))
