"""Deduplication of articles that come in day by day: each increment is merged into stored groups, without reading the rest.

The store is a table of versions with three kinds of parts. ``members`` are articles without their long texts, by a digest of their
exact key: each increment adds folders and changes none. ``groups`` have a row for each exact key, ``final`` one for each title of a
platform and day, both by day and digest: an increment reads and replaces the parts of the days that it changes. All of an
increment becomes one version, so a reader sees it whole, and of two writers at once one is told to start again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from . import versions
from .dedup import LONG, cluster_key, merge, narrow
from .stored import stored

#: Parts of the members' keys, and of one day.
KEY_PARTS, DAY_PARTS = 256, 4
BY = ("_kind", "_place", "_step")


def _place(key: Column, parts: int, day: Column | None = None) -> Column:
    digest = F.pmod(F.xxhash64(key), F.lit(parts)).cast("string")
    return digest if day is None else F.concat_ws("#", day, digest)


def _grouped(members: DataFrame) -> DataFrame:
    """One row for each exact key, with the key of the second phase and its place."""
    first = merge(members.drop("_kind", "_place", "_step", "_second")).drop("_merged")
    second = F.coalesce(cluster_key(first), F.concat(F.lit("row\x1f"), F.col("pos").cast("string")))
    first = first.withColumn("_second", second).withColumn("_key", F.col("_second"))
    return stored(first.withColumn("_place", _place(F.col("_second"), DAY_PARTS, dates.day_key(F.col("published_at") if "published_at" in first.columns else F.lit("")))))


def _read(spark: SparkSession, path: str, version: versions.Version, kind: str, places: set[str], like: DataFrame) -> DataFrame:
    if not version.number:
        return like.limit(0)
    return versions.read(spark, path, version.number, keep=lambda key: key[0] == kind and key[1] in places)


def _places(*frames: DataFrame) -> set[str]:
    """The places of an increment's rows: as many as the store has parts, at most."""
    return {r[0] for f in frames for r in f.select("_place").distinct().collect()}


def add(articles: DataFrame, path: str) -> int:
    """Merges articles (with a ``pos`` that no other has) into the store at ``path``; gives the version's number.

    Of the members only places with a key of this increment are read, of groups and results only the days that these touch. An
    empty increment adds an empty version. ``versions.Conflict`` says that another writer was first: call again.
    """
    spark = articles.sparkSession
    version = versions.version(spark, path)
    new = narrow(articles)
    new = stored(new.withColumn("_first", F.col("_key")).withColumn("_place", _place(F.col("_key"), KEY_PARTS)))
    keys = new.select(F.col("_key").alias("_first")).distinct()
    known = _read(spark, path, version, "members", _places(new), new).join(keys, "_first", "left_semi")
    known = stored(known.select(*new.columns))
    before, now = _grouped(known), _grouped(known.unionByName(new))
    places = _places(before, now)
    seconds = before.select("_second").union(now.select("_second")).distinct()
    groups = _read(spark, path, version, "groups", places, now).select(*now.columns).join(keys, "_first", "left_anti").unionByName(now)
    groups = stored(groups)
    whole = merge(groups.join(seconds, "_second", "left_semi")).drop("_merged").withColumn("_key", F.col("_second"))
    final = _read(spark, path, version, "final", places, now).select(*now.columns).join(seconds, "_second", "left_anti").unionByName(whole.select(*now.columns))
    kinds = [df.withColumn("_kind", F.lit(kind)).withColumn("_step", F.lit(step)) for df, kind, step in ((new, "members", f"{version.number + 1}"), (groups, "groups", ""), (final, "final", ""))]
    rows = kinds[0].unionByName(kinds[1], allowMissingColumns=True).unionByName(kinds[2], allowMissingColumns=True)
    return versions.save(rows, path, BY, [(kind, place, "") for kind in ("groups", "final") for place in places], base=version.number)


def result(spark: SparkSession, path: str, articles: DataFrame | None = None) -> DataFrame:
    """The deduplicated articles as of now; with the ``articles`` themselves (all of them, by pos) also their long texts, by one join."""
    rows = versions.read(spark, path, keep=lambda key: key[0] == "final")
    rows = rows.drop("_key", "_first", "_second", "_place", "_kind", "_step", "_ls")
    if articles is not None:
        rows = rows.join(articles.select(F.col("pos").alias("_rep"), *(c for c in LONG if c in articles.columns)), "_rep")
    return rows.drop("_rep")
