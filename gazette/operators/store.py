"""Run store: runs, stage rows, manual rows, stars and the source registry as tables; writes replace whole keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from . import versions


def list_runs(runs: DataFrame, articles: DataFrame, manual: DataFrame, country: str | None = None, limit: int | None = None) -> DataFrame:
    """Runs, newest update first, with their rows before and after filtering; enabled manual rows count as after."""
    counts = articles.groupBy("run_id").agg(F.count_if(F.col("stage") == "before").alias("before_count"), F.count_if(F.col("stage") == "after").alias("after_rows"))
    added = manual.where((F.col("stage") == "after") & F.col("enabled")).groupBy("run_id").agg(F.count("*").alias("manual_rows"))
    wanted = runs if not country else runs.where(F.col("country_code") == country)
    out = wanted.join(counts, "run_id", "left").join(added, "run_id", "left")
    out = out.select(*wanted.columns, F.coalesce("before_count", F.lit(0)).alias("before_count"), (F.coalesce("after_rows", F.lit(0)) + F.coalesce("manual_rows", F.lit(0))).alias("after_count"))
    out = out.orderBy(F.desc("updated_at"), "run_id")
    return out if limit is None else out.limit(limit)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Target with changed keys replaced and new ones added; of several changes to a key the last one by ``order`` counts."""
    latest = latest_per_key(changes, keys, order)
    return target.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*target.columns))


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; combined on the map side, so a hot key is one row a task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.struct(*rest))).alias("_b"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in rows.columns))


def replace_runs(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Saves runs: all rows of the runs that come in replace those that were there, so saving twice changes nothing."""
    return target.join(rows.select("run_id").distinct(), "run_id", "left_anti").unionByName(rows)


def manual_identity(run: Column, url: Column, platform: Column, day: Column, title: Column, source: Column) -> Column:
    """The id of a manual row: of run and URL, or of run, platform, date, title and source where there is no URL; any case."""
    link = F.lower(text.clean(url))
    by_url = F.concat_ws("|", text.clean(run), F.lit("url"), link)
    by_text = F.lower(F.concat_ws("|", *(text.clean(c) for c in (run, platform, day, title, source))))
    return F.concat(F.lit("manual_"), F.sha1(F.when(link != "", by_url).otherwise(by_text).cast("binary")))


def load_articles(articles: DataFrame, run: str, stage: str, schema: str) -> DataFrame:
    """A run's rows of one stage in their order: articles(run_id, stage, row_index, raw_json); rows that are no object go."""
    wanted = "before" if stage == "before" else "after"
    rows = articles.where((F.col("run_id") == run) & (F.col("stage") == wanted)).where(F.ltrim("raw_json").startswith("{"))
    return rows.select("row_index", F.from_json("raw_json", schema).alias("a")).where("a is not null").orderBy("row_index").select("row_index", "a.*")


def load_manual(manual: DataFrame, run: str, stage: str, schema: str, include_disabled: bool = False) -> DataFrame:
    """A run's manual rows, oldest update first: manual(manual_article_id, run_id, stage, enabled, updated_at, raw_json)."""
    wanted = "before" if stage == "before" else "after"
    rows = manual.where((F.col("run_id") == text.clean(F.lit(run))) & (F.col("stage") == wanted))
    rows = rows if include_disabled else rows.where("enabled")
    out = rows.select("manual_article_id", "enabled", "updated_at", F.from_json("raw_json", schema).alias("a")).orderBy("updated_at", "manual_article_id")
    return out.select("a.*", F.lit(True).alias("manual_added"), "manual_article_id", F.col("enabled").alias("manual_enabled"))


def checked_manual(forms: DataFrame) -> DataFrame:
    """Forms of manual rows with ``error``: empty where all is there, else what is missing first.

    forms: article_source (``db:<run>:after``), title, article_url, platform_label, published_at; run_id is added.
    """
    source = source_reference(F.trim("article_source"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    error = (
        F.when(source.isNull(), "source").when(source["stage"] != "after", "stage").when(blank("title") & blank("article_url"), "title_or_url")
        .when(blank("platform_label"), "platform").when(blank("published_at"), "date").otherwise("")
    )
    return forms.withColumn("run_id", source["run_id"]).withColumn("error", error)


def save_runs(rows: DataFrame, path: str, runs: list[str] | None = None) -> int:
    """Saves runs to a store of versions: each run's stages are replaced by what comes in, so saving twice changes nothing, a reader
    sees all of it or nothing, and of two writers at once neither loses a row. ``runs`` are those whose stages may be empty now."""
    return versions.save(rows, path, ("run_id", "stage"), [(r, s) for r in runs or () for s in ("before", "after")])


def saved_runs(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """The rows of the store as it is now, of some runs or of all; what is saved later does not change them."""
    return versions.read(spark, path, keep=None if runs is None else lambda key: key[0] in set(runs))


def set_enabled(manual: DataFrame, ids: DataFrame, enabled: bool) -> DataFrame:
    """Soft deletion: the flag of the given ids changes, nothing is removed."""
    hit = ids.select("manual_article_id").distinct().withColumn("_hit", F.lit(True))
    out = manual.join(hit, "manual_article_id", "left")
    return out.withColumn("enabled", F.when(F.col("_hit"), F.lit(enabled)).otherwise(F.col("enabled"))).select(*manual.columns)


def set_stars(stars: DataFrame, changes: DataFrame) -> DataFrame:
    """Starred ids after changes (article_id, starred, updated_at): the last change of an id adds or removes it."""
    last = latest_per_key(changes, ["article_id"], "updated_at")
    return stars.join(last, "article_id", "left_anti").unionByName(last.where("starred").select(*stars.columns))


def migrate_once(target: DataFrame, rows: DataFrame, markers: DataFrame, name: str) -> DataFrame:
    """Adds rows only where the marker of this migration is not set."""
    done = markers.where(F.col("name") == name).limit(1).select(F.lit(1).alias("_done"))
    return target.unionByName(rows.join(done, F.lit(True), "left_anti").join(target, "article_id", "left_anti").select(*target.columns))


def source_reference(c: Column) -> Column:
    """``db:<run>:<stage>`` as a struct of run_id and stage; null where it is nothing of the kind."""
    ok = c.rlike(r"^db:[^:]+:(?:before|after)$")
    return F.when(ok, F.struct(F.split_part(c, F.lit(":"), F.lit(2)).alias("run_id"), F.split_part(c, F.lit(":"), F.lit(3)).alias("stage")))


# --- source registry ---


def list_sources(registry: DataFrame, show_inactive: bool = False, **equal: str) -> DataFrame:
    out = registry if show_inactive else registry.where("active")
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    return out.orderBy("platform", "side", "source_url")


def change_sources(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Registry after additions, deactivations and reactivations: changes(platform, side, source_url, active, at).

    A new key is created; a known one gets its flag, and the time at which it last changed it.
    """
    keys = ["platform", "side", "source_url"]
    last = latest_per_key(changes.select(*keys, F.col("active").alias("_to"), F.col("at").alias("_at")), keys, "_at")
    out = registry.join(last, keys, "full")
    new, moved = F.col("created_at").isNull(), F.coalesce(F.col("_to") != F.col("active"), F.lit(False))
    return out.select(
        *keys, F.coalesce("domain", urls.host(F.col("source_url"))).alias("domain"), F.coalesce("_to", "active").alias("active"), F.coalesce("created_at", "_at").alias("created_at"),
        F.when(new | moved, F.col("_at")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when((moved | new) & ~F.col("_to"), F.col("_at")).otherwise(F.col("deactivated_at")).alias("deactivated_at"),
        F.when(moved & F.col("_to") & ~new, F.col("_at")).otherwise(F.col("reactivated_at")).alias("reactivated_at"),
    )


#: Columns of a run's sources that a card shows, by the name they get, and how they are read.
LAST_YIELD = {
    "last_source_status": ("status", "text"), "last_recent_article_count": ("recent_article_count", "count"), "last_candidate_count": ("candidate_count", "count"), "last_matched_brand_count": ("matched_brand_count", "count"),
    "last_elapsed_seconds": ("elapsed_seconds", "number"), "last_recent_yield": ("recent_yield", "text"), "last_zero_yield_reason": ("zero_yield_reason", "text"), "last_source_recommendation": ("source_recommendation", "text"),
    "last_search_endpoint_status": ("search_endpoint_status", "text"), "last_selector_match_count": ("selector_match_count", "count"), "last_parsed_date_count": ("parsed_date_count", "count"),
}


def latest_yield(runs: DataFrame, sources: DataFrame, newest: int = 12) -> DataFrame:
    """url (as compared), last_run_id and what the newest run that has any source says of each: the first of the ``newest`` runs
    (run_id, updated_at) with a row in ``sources`` (run_id, row_index, source_url and its texts). Of a URL's rows the last one counts;
    what is no number is 0; a column that is not there is empty."""
    ranked = runs.select("run_id", F.struct(F.col("updated_at").alias("t"), F.col("run_id").alias("r")).alias("_age")).orderBy(F.desc("_age")).limit(newest)
    # ``newest`` rows are broadcast.
    rows = sources.where(F.trim("source_url") != "").join(F.broadcast(ranked), "run_id")
    first = rows.agg(F.max("_age").alias("_first"))
    own = rows.join(F.broadcast(first), F.col("_age") == F.col("_first"))

    def read(column: str, kind: str) -> Column:
        value = F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) if column in sources.columns else F.lit("")
        number = F.coalesce(value.try_cast("double"), F.lit(0.0))
        return {"text": value, "number": number, "count": F.when(F.isnan(number) | (F.abs(number) > 1e18), 0).otherwise(number.cast("long"))}[kind]

    fields = F.struct("row_index", F.col("run_id").alias("last_run_id"), *(read(c, kind).alias(name) for name, (c, kind) in LAST_YIELD.items()))
    last = own.groupBy(urls.canonical(F.col("source_url")).alias("url")).agg(F.max_by(fields, "row_index").alias("l"))
    return last.select("url", "l.last_run_id", *(F.col(f"l.{name}") for name in LAST_YIELD))


def source_cards(registry: DataFrame, capabilities: DataFrame, yields: DataFrame) -> DataFrame:
    """Registry with each source's capabilities and last yield by canonical URL; what is unknown gets defaults."""
    r = registry.withColumn("_k", urls.canonical(F.col("source_url")))
    c = capabilities.select(urls.canonical(F.col("source_url")).alias("_k"), "feeds", "risk").dropDuplicates(["_k"])
    y = yields.select(urls.canonical(F.col("source_url")).alias("_k"), "recent_articles").dropDuplicates(["_k"])
    out = r.join(c, "_k", "left").join(y, "_k", "left")
    return out.select(*registry.columns, F.coalesce("feeds", F.lit(0)).alias("feeds"), F.coalesce("risk", F.lit("unknown")).alias("risk"), F.coalesce("recent_articles", F.lit(0)).alias("recent_articles"))


def overlay(base: DataFrame, own: DataFrame, keys: list[str], default: str) -> DataFrame:
    """Configuration values: a country's own ones over the built-in ones, missing ones from the default country."""
    merged = base.alias("b").join(own.alias("o"), keys, "full").select(*keys, F.coalesce("o.value", "b.value").alias("value"))
    country, key = keys
    fall = merged.where(F.col(country) == default).select(key, F.col("value").alias("_d"))
    grid = merged.select(country).distinct().crossJoin(fall)
    return grid.join(merged, keys, "left").select(country, key, F.coalesce("value", "_d").alias("value")).unionByName(merged.join(fall.select(key), key, "left_anti").select(country, key, "value"))


def official_match(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Each source's official target: same host, longest path prefix (ties: the first one by ``pos``)."""
    s = sources.select("source_url", urls.host(F.col("source_url")).alias("h"), F.regexp_extract("source_url", urls.PARTS, 3).alias("p"))
    t = targets.select(urls.host(F.col("target_url")).alias("h"), F.regexp_extract("target_url", urls.PARTS, 3).alias("tp"), "target_url", "pos")
    hit = s.join(t, "h").where(F.col("p").startswith(F.col("tp")))
    return hit.groupBy("source_url").agg(F.max_by("target_url", F.struct(F.length("tp"), -F.col("pos"))).alias("target_url"))


def wanted_sources(sources: DataFrame, sides: list[str], platforms: list[str]) -> DataFrame:
    """Media of the allowed sides once for each canonical URL, and the chosen platforms' own sources."""
    allowed = sources.where(F.col("side").isin(sides))
    first = Window.partitionBy(urls.canonical(F.col("source_url"))).orderBy("pos")
    media = allowed.where("side = 'media'").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return media.unionByName(allowed.where("side <> 'media'").where(F.lower("platform").isin([p.lower() for p in platforms])))
