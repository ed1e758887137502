"""Labels of runs and platforms, and search texts, as readers see and write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Names of a run's folder.
RUN_NAME = r"run_(\d{8})_(\d{6})(?:_range_(\d{8})_(\d{8}))?"
#: Wordings of a label.
LATEST, FETCHED, HISTORY, TO, UNKNOWN = "最近一次抓取", " 抓取", "历史结果", " 至 ", "时间范围未知"
#: White space and marks that separate platforms in a label.
SEPARATORS = r"\s*(?:\||,|/|、|，)\s*"


def moment(c: Column) -> Column:
    """A timestamp as a label writes it: ISO text, or digits of a day with or without a time; null otherwise."""
    t = F.trim(c.cast("string"))
    return F.coalesce(F.try_to_timestamp(F.when(t.rlike(r"^\d{14}$"), t), F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(F.when(t.rlike(r"^\d{8}$"), t), F.lit("yyyyMMdd")), F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-"), t)))


def run_parts(c: Column) -> Column:
    """run_time, range_start, range_end that a run's name holds, as digits; empty where they are not there."""
    part = lambda k: F.regexp_extract(c, RUN_NAME, k)
    return F.struct(F.concat(part(1), part(2)).alias("run_time"), part(3).alias("range_start"), part(4).alias("range_end"))


def range_label(start: Column, end: Column) -> Column:
    day = lambda c: F.date_format(moment(c), "yyyy-MM-dd")
    return F.coalesce(F.concat(day(start), F.lit(TO), day(end)), F.lit(UNKNOWN))


def source_label(run: Column, country: Column, generated: Column, start: Column, end: Column, count: Column, latest: Column, history: Column) -> Column:
    """``latest or time | country | range | rows`` of a stored run; of a CSV file of an old one ``history | ... | CSV``."""
    parts = run_parts(run)
    blank = F.lit("")
    first = lambda a, b: F.coalesce(F.nullif(F.trim(a.cast("string")), blank), b)
    when = F.coalesce(F.date_format(moment(parts["run_time"]), "yyyy-MM-dd HH:mm"), F.date_format(moment(generated), "yyyy-MM-dd HH:mm"))
    prefix = F.when(history, HISTORY).when(latest, LATEST).when(when.isNotNull(), F.concat(when, F.lit(FETCHED))).otherwise(HISTORY)
    suffix = F.when(history, "CSV").otherwise(F.concat(F.coalesce(count, F.lit(0)).cast("string"), F.lit("条")))
    named = F.nullif(F.trim(F.coalesce(country, blank)), blank)
    return F.concat_ws("｜", prefix, named, range_label(first(start, parts["range_start"]), first(end, parts["range_end"])), suffix)


def run_sources(runs: DataFrame) -> DataFrame:
    """value (``db:<run>:after``) and label of the runs with rows, newest update first; the first one is the latest.

    runs: run_id, country_label, generated_at, range_start, range_end, after_count, updated_at: one row a run.
    """
    some = runs.where("after_count > 0")
    newest = some.agg(F.max(F.struct("updated_at", "run_id")).alias("n")).select(F.col("n.run_id").alias("_newest"))
    rows = some.join(F.broadcast(newest), F.lit(True))
    label = source_label(F.col("run_id"), F.col("country_label"), F.col("generated_at"), F.col("range_start"), F.col("range_end"), F.col("after_count"), F.col("run_id") == F.col("_newest"), F.lit(False))
    return rows.select(F.concat(F.lit("db:"), "run_id", F.lit(":after")).alias("value"), label.alias("label"), "updated_at").orderBy(F.desc("updated_at"), F.desc("value")).drop("updated_at")


def display_label(c: Column, names: dict[str, str]) -> Column:
    """A platform's label with each token that has a name (by its lower case) replaced; separators stay as they are."""
    t = F.trim(F.coalesce(c, F.lit("")))
    pieces = F.regexp_extract_all(t, F.lit(rf"({SEPARATORS}|(?:(?!{SEPARATORS}).)+)"), F.lit(1))
    known = F.create_map(*(x for k, v in names.items() for x in (F.lit(k.lower()), F.lit(v))))
    return F.trim(F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(rf"^{SEPARATORS}$"), p).otherwise(F.coalesce(F.try_element_at(known, F.lower(F.trim(p))), p))), ""))


def _labelled(x: Column) -> tuple[Column, Column]:
    """(label, block) of a line ``label = block`` or ``label: block``; the block is empty where the line is nothing of the kind."""
    equal = x.contains("=")

    def part(k: int) -> Column:
        return F.trim(F.when(equal, F.regexp_extract(x, r"^([^=]*)=(.*)$", k)).otherwise(F.regexp_extract(x, r"^([^:]*):(.*)$", k)))

    return text.clean(part(1)), part(2)


def block_lines(c: Column) -> Column:
    """Lines of a keyword text as blocks: a line of several parenthesised groups is as many; behind a label they are numbered."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), F.trim), lambda x: x != "")
    group = r"\([^()]+\)"

    def one(x: Column) -> Column:
        label, body = _labelled(x)
        rest = F.when(body != "", body).otherwise(x)
        groups = F.regexp_extract_all(rest, F.lit(f"({group})"), F.lit(1))
        several = (F.size(groups) > 1) & (F.trim(F.regexp_replace(rest, group, "")) == "")
        numbered = F.transform(groups, lambda g, i: F.when((body != "") & (label != ""), F.concat(label, F.lit("_"), (i + 1).cast("string"), F.lit(": "), g)).otherwise(g))
        return F.when(several, numbered).otherwise(F.array(x))

    return F.flatten(F.transform(lines, one))


def search_blocks(texts: DataFrame, prefix: str, split: bool = False) -> DataFrame:
    """(id, pos, label, block) of keyword texts (id, text): a line is ``label = block``, ``label: block`` or a block alone, which is
    labelled by its line. Each block once. split: lines of several parenthesised groups are as many blocks."""
    lines = block_lines(F.col("text")) if split else F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), F.trim)
    rows = texts.select("id", F.posexplode(lines).alias("pos", "line")).where("line <> ''")
    label, body = _labelled(F.col("line"))
    own = F.concat(F.lit(f"{prefix}_"), (F.col("pos") + 1).cast("string"))
    out = rows.select("id", "pos", F.when(body != "", F.coalesce(F.nullif(label, F.lit("")), own)).otherwise(own).alias("label"), F.when(body != "", body).otherwise(F.col("line")).alias("block"))
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("id", "block").orderBy("pos"))).where("_n = 1").drop("_n")


def normal_keywords(c: Column, default: str, defaults: list[str]) -> Column:
    """A keyword text, or the country's default where it is empty, any country's default, or whole lines from its beginning."""
    t = text.clean(c)
    lines = [x.strip() for x in default.splitlines() if x.strip()]
    own = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), F.trim), lambda x: x != "")
    beginning = (F.size(own) < len(lines)) & (F.slice(F.array(*map(F.lit, lines)), F.lit(1), F.size(own)) == own) if lines else F.lit(False)
    known = [" ".join(d.split()) for d in [default, *defaults]]
    return F.when((t == "") | t.isin(*known) | beginning, default).otherwise(c)


def alias_map(c: Column) -> Column:
    """``platform: a, b`` lines as a map of lists; lines without a colon or without an alias go, the last line of a platform counts."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^[^:=]+[:=]"))
    pairs = F.transform(lines, lambda x: F.struct(text.clean(F.regexp_extract(x, r"^([^:=]+)[:=]", 1)).alias("key"), F.array_distinct(F.filter(F.transform(F.split(F.regexp_extract(x, r"^[^:=]+[:=](.*)$", 1), r"[,|;，、]"), text.clean), lambda a: a != "")).alias("value")))
    good = F.filter(pairs, lambda p: (p["key"] != "") & (F.size(p["value"]) > 0))
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def alias_text(c: Column, order: list[str]) -> Column:
    """A map of lists as lines, the given platforms first, the others by name."""
    keys = F.array_sort(F.map_keys(c))
    ordered = F.concat(F.filter(F.array(*map(F.lit, order)), lambda k: F.array_contains(keys, k)), F.array_except(keys, F.array(*map(F.lit, order))))
    return F.array_join(F.transform(ordered, lambda k: F.concat(k, F.lit(": "), F.array_join(F.element_at(c, k), ", "))), "\n")


#: What platforms are called, by concept; endings of their country's pages; words for a name's search.
CONCEPT_NAMES = {
    "instagram_shopping": ["Instagram Shopping", "Instagram Shop", "Instagram", "Instagram DTC", "IG", "INS", "INS-DTC"], "tiktok_shop": ["TikTok Shop", "TikTok", "TTS", "TT Shop"], "amazon": ["Amazon"], "zalando": ["Zalando"],
    "shein": ["SHEIN", "Shein"], "temu": ["Temu", "TEMU"], "rakuten": ["Rakuten", "Rakuten Ichiba"],
}
SITES = {"amazon": "Amazon", "zalando": "Zalando", "shein": "shein", "temu": "temu"}
EXTRAS = {"instagram_shopping": ["Instagram Shopping", "Instagram Shop", "Instagram"], "tiktok_shop": ["TikTok Shop", "TikTok"]}


def generated_aliases(platforms: DataFrame, countries: list[str], code: str) -> DataFrame:
    """platform, aliases: a platform's names, each alone, with the country's name and with its code; its site; more by concept.

    countries: the country's names in Latin letters, the main one first. code: as the news search has it. Names in Han or kana go.
    """
    from .enrich import platform_concept

    concept = platform_concept(F.col("platform"))

    def of(table: dict[str, list[str]]) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), concept), F.array().cast("array<string>"))

    main = countries[0] if countries else ""
    seeds = F.array_distinct(F.concat(F.array(text.clean(F.col("platform"))), of(CONCEPT_NAMES)))
    tails = [t for t in (main, code.upper()) if t]
    made = F.flatten(F.transform(seeds, lambda s: F.array(s, *(F.concat(s, F.lit(f" {t}")) for t in tails))))
    site = F.array_compact(F.array(F.when(F.lit(len(code) == 2), F.concat(F.try_element_at(F.create_map(*(x for k, v in SITES.items() for x in (F.lit(k), F.lit(v)))), concept), F.lit(f".{code.lower()}")))))
    named = F.flatten(F.transform(F.array(*map(F.lit, countries[:3])).cast("array<string>"), lambda t: F.transform(of(EXTRAS), lambda e: F.concat(e, F.lit(" "), t))))
    every = F.array_distinct(F.filter(F.transform(F.concat(made, site, named), text.clean), lambda x: (x != "") & ~text.contains_han(x) & ~text.contains_kana(x)))
    return platforms.select("platform", every.alias("aliases"))
