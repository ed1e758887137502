"""Article deduplication: exact keys, same-day titles, and clusters of reports of one event."""

from __future__ import annotations

import difflib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from . import similar
from .stored import stored

MIN_TITLE = 12
WINDOW_DAYS = 14
#: Long texts: no phase of the deduplication moves them.
LONG = ("summary", "summary_translated", "body_excerpt")
UNIONS = ("side", "source_platform", "source_url", "source_final_url", "source_site", "survey_dimensions", "survey_question_ids", "survey_indicator_examples", "survey_ai_reason_raw", "survey_ai_reason_translated")


def _col(df: DataFrame, *names: str) -> Column:
    """The first of the columns with something in it; columns that are not there count as empty."""
    return text.first_present(*(F.col(n) for n in names if n in df.columns))


def _long_col(df: DataFrame, *names: str) -> Column:
    """The same of long texts; not for use inside functions of array elements."""
    return text.first_present_long(*(F.col(n) for n in names if n in df.columns))


def brands(df: DataFrame) -> Column:
    fallback = F.filter(F.array(*(text.clean(F.col(n)) for n in ("platform_label", "platform", "source_platform") if n in df.columns)), lambda x: x != "")
    if "matched_brands" not in df.columns:
        return fallback
    own = F.filter(F.coalesce(F.col("matched_brands"), F.array().cast("array<string>")), lambda x: text.clean(x) != "")
    return F.when(F.size(own) > 0, own).otherwise(fallback)


def exact_key(df: DataFrame) -> Column:
    """url, or platform, day, title and source, or (if one of these is missing) the same with the summary's beginning."""
    url = urls.canonical(_col(df, "article_url"))
    platform, day = text.brand_list(brands(df)), dates.day_key(_col(df, "published_at"))
    title = text.dedupe_title(_col(df, "title_translated", "title"))
    source = F.coalesce(F.nullif(F.lower(_col(df, "source_site")), F.lit("")), urls.canonical(_col(df, "source_url", "source_final_url")))

    def key(s: Column) -> Column:
        whole = (s["platform"] != "") & (s["day"] != "") & (s["title"] != "")
        rest = F.concat_ws("\x1f", s["platform"], s["day"], s["title"], s["source"], F.when(whole, "").otherwise(F.left(_col(df, "summary", "summary_translated"), F.lit(120))))
        return F.when(s["url"] != "", F.concat(F.lit("url\x1f"), s["url"])).when(whole, F.concat(F.lit("fallback\x1f"), rest)).otherwise(F.concat(F.lit("weak\x1f"), rest))

    return text.once(F.struct(url.alias("url"), platform.alias("platform"), day.alias("day"), title.alias("title"), source.alias("source")), key)


def cluster_key(df: DataFrame) -> Column:
    """platform, day and title; null where a part is missing or the title too short to tell."""
    platform, day = text.brand_list(brands(df)), dates.day_key(_col(df, "published_at"))
    title = text.dedupe_title(_col(df, "title_translated", "title"))
    parts = F.struct(platform.alias("platform"), day.alias("day"), title.alias("title"))
    return text.once(parts, lambda s: F.when((s["platform"] != "") & (s["day"] != "") & (F.char_length(s["title"]) >= MIN_TITLE), F.concat_ws("\x1f", s["platform"], s["day"], s["title"])))


def narrow(articles: DataFrame) -> DataFrame:
    """All but the long texts, with their lengths, the row they are to be fetched from, and the exact key."""
    short = [c for c in articles.columns if c not in LONG and c != "pos"]
    return articles.select("pos", *short, F.col("pos").alias("_rep"), F.char_length(_col(articles, "summary_translated", "summary")).alias("_ls"), F.lit(1).cast("long").alias("group_size"), exact_key(articles).alias("_key"))


def merge(df: DataFrame, key: str = "_key") -> DataFrame:
    """One row for each key: the fullest member (ties: the first one) with texts and brands united in input order.

    ``pos`` becomes the smallest one, ``group_size`` the number of rows merged. Only groups of several rows unite anything, and each
    of their distinct values once: a key that a third of all rows share is combined on the map side.
    """
    rank = F.struct("_ls", F.char_length(_col(df, "title_translated", "title")).alias("b"), _col(df, "published_at").alias("c"), (-F.col("pos")).alias("d"))
    kept = [c for c in df.columns if c not in (key, "pos", "group_size")]
    unions = [c for c in UNIONS if c in kept]
    best = df.groupBy(key).agg(F.max_by(F.struct(*kept), rank).alias("_best"), F.min("pos").alias("pos"), F.sum("group_size").alias("group_size"), F.count("*").alias("_n"))
    out = {c: F.col(f"_best.{c}") for c in kept}
    values = [F.array(F.struct(F.lit(c).alias("name"), text.clean(F.col(c)).alias("value"), F.lit(0).alias("i"))) for c in unions]
    if "matched_brands" in kept:
        own = F.coalesce(F.col("matched_brands"), F.array().cast("array<string>"))
        values.append(F.transform(own, lambda x, i: F.struct(F.lit("matched_brands").alias("name"), text.clean(x).alias("value"), i.alias("i"))))
    grouped = best
    if values:
        several = df.join(best.where("_n > 1").select(key), key).select(key, "pos", F.explode(F.concat(*values)).alias("x")).select(key, "pos", "x.*").where("value <> ''")
        once = several.groupBy(key, "name", "value").agg(F.min(F.struct("pos", "i")).alias("at"))
        united = once.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("name", "at", "value"))).alias("_all"))
        grouped = best.join(united, key, "left")

        def found(c: str) -> Column:
            return F.transform(F.filter(F.coalesce("_all", F.array().cast(united.schema["_all"].dataType)), lambda x: x["name"] == c), lambda x: x["value"])

        for c in unions:
            out[c] = F.when(F.col("_n") > 1, F.array_join(found(c), " | ")).otherwise(text.clean(F.col(f"_best.{c}")))
        if "matched_brands" in kept:
            alone = F.array_distinct(F.filter(F.transform(F.coalesce(F.col("_best.matched_brands"), F.array().cast("array<string>")), text.clean), lambda x: x != ""))
            out["matched_brands"] = F.when(F.col("_n") > 1, found("matched_brands")).otherwise(alone)
            for c in ("platform_label", "platform"):
                if c in kept:
                    out[c] = F.when(F.size(out["matched_brands"]) > 0, text.brand_list(out["matched_brands"])).otherwise(out[c])
    return grouped.select("pos", *(v.alias(c) for c, v in out.items()), "group_size", F.col("_n").alias("_merged"))


def _phases(articles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their exact key, one row a key with its second key, one row a second key; without the long texts."""
    keyed = stored(narrow(articles))
    first = merge(keyed).drop("_merged")
    first = stored(first.withColumn("_key", F.coalesce(cluster_key(first), F.concat(F.lit("row\x1f"), F.col("pos").cast("string")))))
    return keyed, first, merge(first)


def initial_dedupe(articles: DataFrame) -> DataFrame:
    """Two phases: equal keys merge, then equal titles of one platform and day. Rows without a second key pass through.

    The phases see keys, lengths and short fields only; the long texts of the rows that stay are fetched by one join.
    """
    merged = _phases(articles)[2].drop("_ls", "_merged")
    long = [c for c in LONG if c in articles.columns]
    texts = articles.select(F.col("pos").alias("_rep"), *long)
    out = merged.join(texts, "_rep") if long else merged
    return out.select("pos", *(c for c in articles.columns if c != "pos"), "group_size")


def _removed(keyed: DataFrame, first: DataFrame) -> DataFrame:
    """reason and size of every group of several rows."""
    kinds = F.split_part("_key", F.lit("\x1f"), F.lit(1))
    reason = F.when(kinds == "url", "url_duplicate").when(kinds == "fallback", "same_source_title_duplicate").otherwise("weak_key_duplicate")
    one = keyed.groupBy("_key").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).where("n > 1").select(reason.alias("reason"), "n", "pos", F.lit(1).alias("phase"), "_key")
    two = first.where(~F.col("_key").startswith("row\x1f")).groupBy("_key").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).where("n > 1")
    return one.union(two.select(F.lit("same_day_exact_title_duplicate").alias("reason"), "n", "pos", F.lit(2).alias("phase"), "_key"))


def dedupe_stats(articles: DataFrame) -> DataFrame:
    """reason, groups, removed: what each phase and kind of key merges away."""
    keyed, first, _ = _phases(articles)
    return _removed(keyed, first).groupBy("reason").agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("removed"))


def dedupe_summary(articles: DataFrame) -> DataFrame:
    """One row: input_count, missing_url_count, group_count, output_count, removed_count."""
    keyed, first, _ = _phases(articles)
    rows = keyed.agg(F.count("*").alias("input_count"), F.count_if(_col(keyed, "article_url") == "").alias("missing_url_count"))
    groups = keyed.groupBy("_key").count().agg(F.count("*").alias("group_count"))
    left = first.groupBy("_key").count().agg(F.count("*").alias("output_count"))
    out = rows.join(groups, F.lit(True)).join(left, F.lit(True))  # three rows of one number each
    return out.withColumn("removed_count", F.col("input_count") - F.col("output_count"))


def removed_samples(articles: DataFrame, samples: int = 30, members: int = 5) -> DataFrame:
    """reason, group_size and the first members' titles, URLs, sites and dates of the first groups of a report (its feature)."""
    keyed, first, _ = _phases(articles)
    some = _removed(keyed, first).orderBy("phase", "pos").limit(samples)
    fields = {"titles": _col(keyed, "title", "title_translated"), "article_urls": _col(keyed, "article_url"), "source_sites": _col(keyed, "source_site"), "published_at": _col(keyed, "published_at")}

    def rows(df: DataFrame, phase: int) -> DataFrame:
        ranked = df.join(F.broadcast(some.where(F.col("phase") == phase).select("_key")), "_key").withColumn("_i", F.row_number().over(Window.partitionBy("_key").orderBy("pos"))).where(F.col("_i") <= members)
        lists = ranked.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_i", *(v.alias(k) for k, v in fields.items())))).alias("m"))
        return some.where(F.col("phase") == phase).join(lists, "_key").select("phase", "pos", "reason", F.col("n").alias("group_size"), *(F.col(f"m.{k}").alias(k) for k in fields))

    return rows(keyed, 1).union(rows(first, 2)).orderBy("phase", "pos").drop("phase", "pos")


def keep_first(df: DataFrame, *keys: str, blank_passes: bool = False) -> DataFrame:
    """The first row by ``pos`` of each key; with ``blank_passes`` rows whose first key is empty all stay."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    if blank_passes:
        parts.append(F.when(text.clean(F.col(keys[0])) == "", F.col("pos")))
    window = Window.partitionBy(*parts).orderBy("pos")
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def _rarest(rows: DataFrame, tokens: str, keep: Column, unit: str = "pos") -> DataFrame:
    """(pos, brand, day, token): of each unit's tokens the ``keep`` ones that the fewest units of its brand hold."""
    by = list(dict.fromkeys(["pos", "brand", unit]))
    long = rows.select(*by, "day", keep.cast("int").alias("keep"), F.explode(tokens).alias("token"))
    seen = long.groupBy("brand", "token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = long.join(seen, ["brand", "token"]).withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("df", "token")))
    held = long.groupBy(*by).agg(F.count("*").alias("held"))
    # Tokens that no other unit holds come first of all and take part in no pair: they use up places of the prefix.
    left = ranked.groupBy(*by).agg(F.count("*").alias("shared"))
    out = ranked.join(held.join(left, by), by)
    return out.where(F.col("_i") <= F.col("keep") - (F.col("held") - F.col("shared"))).select("pos", "brand", "day", "token")


def _near(keys: DataFrame) -> DataFrame:
    """(a, b): rows that share brand and token within the date window, blocked by spans of that many days."""
    span = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / WINDOW_DAYS)
    a = keys.withColumn("span", span).select(F.col("pos").alias("a"), "brand", F.col("day").alias("day_a"), "token", "span")
    b = keys.withColumn("span", F.explode(F.array(span - 1, span, span + 1))).select(F.col("pos").alias("b"), "brand", F.col("day").alias("day_b"), "token", "span")
    pairs = a.join(b, ["brand", "token", "span"]).where(F.col("a") < F.col("b")).where(F.abs(F.datediff("day_a", "day_b")) <= WINDOW_DAYS)
    return pairs.select("a", "b").distinct()


def token_candidates(articles: DataFrame, jaccard: float = 0.82) -> DataFrame:
    """(a, b, jaccard) of articles of one platform within the date window whose titles share enough of their tokens.

    Of a title's tokens, from the rarest of its platform on, as many are keys as a partner may lack, and one: partners share one.
    """
    rows = articles.select("pos", F.lower(text.clean(F.col("platform"))).alias("brand"), F.col("published_date").alias("day"), text.title_tokens(F.col("title")).alias("tokens")).where("brand <> '' and size(tokens) > 0")
    pairs = _near(_rarest(rows, "tokens", F.size("tokens") - F.ceil(F.size("tokens") * jaccard) + 1))
    a, b = rows.select(F.col("pos").alias("a"), F.col("tokens").alias("x")), rows.select(F.col("pos").alias("b"), F.col("tokens").alias("y"))
    share = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", share.alias("jaccard")).where(F.col("jaccard") >= jaccard)


def token_links(articles: DataFrame, jaccard: float = 0.82) -> DataFrame:
    """(a, b): links that join the same articles as the pairs of ``token_candidates``, by way of each other.

    Articles of one platform and one set of tokens are a class: they are chained by day, and only classes are compared. Two classes that
    share enough are linked by one row of each day: many copies make as many links as there are copies.
    """
    rows = articles.select("pos", F.lower(text.clean(F.col("platform"))).alias("brand"), F.col("published_date").alias("day"), F.array_sort(text.title_tokens(F.col("title"))).alias("tokens")).where("brand <> '' and size(tokens) > 0 and day is not null")
    rows = stored(rows)
    days = stored(rows.groupBy("brand", "tokens", "day").agg(F.min("pos").alias("low")))
    span = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / WINDOW_DAYS)
    classes = stored(days.groupBy("brand", "tokens").agg(F.min("low").alias("pos"), F.collect_set(span).alias("spans")))
    keys = _rarest(classes.withColumn("day", F.lit(None).cast("date")), "tokens", F.size("tokens") - F.ceil(F.size("tokens") * jaccard) + 1).select("pos", "brand", "token")
    spanned = keys.join(classes.select("pos", "spans"), "pos")
    a = spanned.select(F.col("pos").alias("a"), "brand", "token", F.explode("spans").alias("span"))
    b = spanned.select(F.col("pos").alias("b"), "brand", "token", F.explode(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.array(x - 1, x, x + 1))))).alias("span"))
    pairs = a.join(b, ["brand", "token", "span"]).where("a < b").select("a", "b").distinct()
    x, y = (classes.select(F.col("pos").alias(n), F.col("tokens").alias(t)) for n, t in (("a", "x"), ("b", "y")))
    share = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    near = pairs.join(x, "a").join(y, "b").where(share >= jaccard).select("a", "b")
    dated = days.join(classes.select("brand", "tokens", "pos"), ["brand", "tokens"]).select("pos", "day", "low")
    left, right = (dated.select(F.col("pos").alias(n), F.col("day").alias(f"day_{n}"), F.col("low").alias(f"low_{n}")) for n in "ab")
    between = near.join(left, "a").join(right, "b").where(F.abs(F.datediff("day_a", "day_b")) <= WINDOW_DAYS).select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))
    return similar.chained(rows, "brand", "tokens").union(between)


def ratio(left: Column, right: Column, least: float = 0.0) -> Column:
    """Ratcliff-Obershelp similarity, left and right in this order (it is not symmetric); there is no built-in for it.

    Below ``least`` it may be any smaller value: what two bounds rule out is not compared.
    """

    @F.pandas_udf("double")
    def run(a, b):
        def one(x, y):
            m = difflib.SequenceMatcher(None, x or "", y or "")
            return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0

        return a.combine(b, one)

    return run(left, right)


def similar_titles(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs whose two titles report the same thing: equal or contained keys, a close ratio, or mostly the same tokens.

    Only pairs that no cheaper rule decides are compared letter by letter.
    """
    p, q = text.title_key(text.without_source(F.col(left))), text.title_key(text.without_source(F.col(right)))
    rows = pairs
    for name, value in (("_a", text.title_key(F.col(left))), ("_b", text.title_key(F.col(right))), ("_p", p), ("_q", q), ("_s", text.title_tokens(F.col(left))), ("_t", text.title_tokens(F.col(right)))):
        rows = text.let(rows, name, value)
    shorter, shorter_p = F.least(F.char_length("_a"), F.char_length("_b")), F.least(F.char_length("_p"), F.char_length("_q"))
    equal = (F.col("_a") == F.col("_b")) | ((F.col("_p") != "") & (F.col("_p") == F.col("_q")))
    inside = ((shorter >= 18) & (F.contains("_a", "_b") | F.contains("_b", "_a"))) | ((shorter_p >= 16) & (F.contains("_p", "_q") | F.contains("_q", "_p")))
    rows = text.let(rows.where("_a <> '' and _b <> ''"), "_j", F.size(F.array_intersect("_s", "_t")) / F.greatest(F.size(F.array_union("_s", "_t")), F.lit(1)))
    rows = text.let(rows, "_easy", equal | inside | (F.col("_j") >= 0.82))
    rest = rows.where("not _easy").withColumn("_p", F.coalesce(F.nullif("_p", F.lit("")), "_a")).withColumn("_q", F.coalesce(F.nullif("_q", F.lit("")), "_b"))
    main = rest.withColumn("_main", ratio(F.col("_p"), F.col("_q"), 0.74))
    sure = main.where("_main >= 0.76 and size(_s) > 0 and size(_t) > 0 or _main >= 0.82")
    open_pairs = main.where("not (_main >= 0.76 and size(_s) > 0 and size(_t) > 0 or _main >= 0.82)").where("_a <> _p or _b <> _q or (_main >= 0.74 and _j >= 0.55)")
    best = F.greatest(F.when((F.col("_a") == F.col("_p")) & (F.col("_b") == F.col("_q")), F.col("_main")).otherwise(F.col("_whole")), F.col("_main"))
    fuzzy = open_pairs.withColumn("_whole", ratio(F.col("_a"), F.col("_b"), 0.74)).withColumn("_best", best).where("case when size(_s) = 0 or size(_t) = 0 then _best >= 0.82 else _best >= 0.86 or (_best >= 0.74 and _j >= 0.55) end")
    names = pairs.columns
    return rows.where("_easy").select(*names).union(sure.select(*names)).union(fuzzy.select(*names))


def event_rows(df: DataFrame) -> DataFrame:
    """pos, brands, day, titles and the text of the event that each article reports; rows without a brand or a day go."""
    keys = [F.lower(text.clean(F.col(c))) for c in ("platform", "platform_label", "source_platform") if c in df.columns]
    every = F.array(*keys)
    if "matched_brands" in df.columns:
        every = F.concat(every, F.transform(F.coalesce(F.col("matched_brands"), F.array().cast("array<string>")), lambda x: F.lower(text.clean(x))))
    translated, own = _col(df, "title_translated"), _col(df, "title")
    long = _long_col(df, "summary_translated", "summary")
    parts = F.array(_col(df, "title_translated", "title"), own, long, _long_col(df, "summary"))
    rows = df.select("pos", F.array_distinct(F.filter(every, lambda x: x != "")).alias("brands"), F.try_to_date(dates.day_key(_col(df, "published_at"))).alias("day"), translated.alias("translated"), own.alias("title"), parts.alias("_parts"))
    rows = text.let(rows.where("size(brands) > 0 and day is not null"), "event", F.array_join(F.filter("_parts", lambda x: x != ""), " ")).drop("_parts")
    rows = text.let(rows, "main", F.coalesce(F.nullif(F.col("translated"), F.lit("")), F.col("title")))
    rows = text.let(rows, "event_key", text.title_key_long(F.col("event")))
    return rows.select("*", F.char_length("event_key").alias("event_size"), text.title_tokens(F.col("main")).alias("title_tokens"), text.key_event_tokens(F.col("event_key")).alias("event_tokens"), text.clean_number_tokens(F.col("event")).alias("numbers"), text.key_event_phrases(F.col("event_key")).alias("phrases"))


#: Rows of a brand that share a number; beyond it the number alone is no key any more.
COMMON_NUMBER = 50


def _marker_keys(each: DataFrame, phrases: bool = True) -> DataFrame:
    """(pos, brand, day, token): rows that share a number, and a kind of event or four tokens, share a key.

    A number that many rows of a brand share is a key together with each kind of event (with ``phrases``) and with each token but the
    row's three commonest ones: of four tokens that two rows share one is among these.
    """
    numbers = each.select("pos", "brand", "day", "phrases", F.explode("numbers").alias("number"))
    # Only rows with a common number need their tokens counted.
    seen = numbers.groupBy("brand", "number").agg(F.count("*").alias("n")).where("n > 1")
    found = numbers.join(seen, ["brand", "number"])
    few, many = found.where(F.col("n") <= COMMON_NUMBER), found.where(F.col("n") > COMMON_NUMBER)
    counted = each.where("size(event_tokens) > 3").join(many.select("pos", "brand").distinct(), ["pos", "brand"], "left_semi")
    tokens = _rarest(counted, "event_tokens", F.size("event_tokens") - 3)
    both = many.join(tokens.select("pos", "brand", F.col("token").alias("other")), ["pos", "brand"])
    out = few.select("pos", "brand", "day", F.concat(F.lit("#"), "number").alias("token")).union(both.select("pos", "brand", "day", F.concat_ws("#", F.lit(""), "number", "other")))
    return out.union(many.select("pos", "brand", "day", F.explode(F.transform("phrases", lambda p: F.concat_ws("#", F.lit("!"), "number", p))))) if phrases else out


def event_candidates(rows: DataFrame, phrases: bool = True) -> DataFrame:
    """(a, b) of rows of one brand within the date window that share numbers or tokens as a rule on these asks for.

    Keys are numbers, all title tokens but the commonest (of either wording), and the rarest event tokens. Rows whose texts
    resemble each other letter by letter only are found by ``letter_links``. Without ``phrases`` a common number and a kind of
    event are no key: ``event_clusters`` chains these.
    """
    each = rows.select("pos", "day", "main", "title", "title_tokens", "event_tokens", "numbers", "phrases", F.explode("brands").alias("brand"))
    wordings = F.when((F.col("title") != "") & (F.col("title") != F.col("main")), F.array("title_tokens", text.title_tokens(F.col("title")))).otherwise(F.array("title_tokens"))
    sets = each.select("pos", "brand", "day", F.posexplode(wordings).alias("i", "tokens")).withColumn("unit", F.col("pos") * 2 + F.col("i"))
    titles = _rarest(sets.where("size(tokens) > 0"), "tokens", F.greatest(F.lit(1), F.size("tokens") - 1), "unit")
    events = _rarest(each.where("size(event_tokens) > 0"), "event_tokens", F.size("event_tokens") - F.ceil(F.size("event_tokens") * 0.48) + 1)
    marked = _marker_keys(each, phrases).union(titles.withColumn("token", F.concat(F.lit("t"), "token"))).union(events.withColumn("token", F.concat(F.lit("e"), "token")))
    return _near(marked)


def _sides(pairs: DataFrame, rows: DataFrame, *fields: str) -> DataFrame:
    """The pairs with those fields of both rows as structs l and r: what a rule compares, and no more."""
    left = rows.select(F.col("pos").alias("a"), F.struct(*fields).alias("l"))
    right = rows.select(F.col("pos").alias("b"), F.struct(*fields).alias("r"))
    return pairs.join(left, "a").join(right, "b")


def _shared(c: str) -> Column:
    return F.size(F.array_intersect(f"l.{c}", f"r.{c}"))


def same_markers() -> Column:
    """Of a pair l, r: a number in common, and a kind of event or four tokens."""
    return (_shared("numbers") > 0) & ((_shared("phrases") > 0) | (_shared("event_tokens") >= 4))


def marker_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of rows that share a brand within the date window, a number, and a kind of event or four tokens."""
    each = rows.select("pos", "day", "event_tokens", "numbers", "phrases", F.explode("brands").alias("brand"))
    return _sides(_near(_marker_keys(each)), rows, "numbers", "phrases", "event_tokens").where(same_markers()).select("a", "b")


def similar_events(pairs: DataFrame, rows: DataFrame, letters: bool = True) -> DataFrame:
    """(a, b) of the pairs that report one event: similar titles in any wording, the same markers, or similar texts.

    From the cheapest rule on, each sees only the pairs that none before it has decided, and fetches the texts it compares then.
    Without ``letters`` pairs that resemble each other by their letters alone may be missing: ``letter_links`` finds these.
    """
    sides = _sides(pairs, rows, "numbers", "phrases", "event_tokens", "title_tokens", "event_size")
    common, title_common = _shared("event_tokens"), _shared("title_tokens")
    share = common / F.greatest(F.size(F.array_union("l.event_tokens", "r.event_tokens")), F.lit(1))
    cheap = same_markers() | ((title_common >= 3) & (common >= 4)) | ((title_common >= 2) & (common >= 5)) | ((share >= 0.68) & (common >= 6))
    blank = (F.size("l.event_tokens") == 0) | (F.size("r.event_tokens") == 0)
    # A ratio is at most twice the shorter length over both: most pairs end here. Similar texts ask for .84, .88, or .8 and a share.
    small, both = F.least("l.event_size", "r.event_size"), F.col("l.event_size") + F.col("r.event_size")
    judged = text.let(text.let(sides, "_share", share), "_cheap", cheap).select("a", "b", "_share", "_cheap", blank.alias("_blank"), (2.0 * small / F.greatest(both, F.lit(1))).alias("_bound"), small.alias("_small"))
    judged = stored(judged)
    found = judged.where("_cheap").select("a", "b")
    rest = judged.where("not _cheap")
    titled = _sides(rest.select("a", "b"), rows, "main", "translated", "title")
    wordings = F.filter(F.array_distinct(F.flatten(F.transform(F.array("l.main", "l.translated", "l.title"), lambda x: F.transform(F.array("r.main", "r.translated", "r.title"), lambda y: F.struct(x.alias("x"), y.alias("y")))))), lambda w: (w["x"] != "") & (w["y"] != ""))
    titles = titled.select("a", "b", F.explode(wordings).alias("w")).select("a", "b", "w.x", "w.y")
    if not letters:
        titles = text.let(text.let(titles, "_s", text.title_tokens(F.col("x"))), "_t", text.title_tokens(F.col("y")))
        titles = titles.where(F.size(F.array_intersect("_s", "_t")) >= 0.55 * F.size(F.array_union("_s", "_t"))).select("a", "b", "x", "y")
    alike = stored(similar_titles(titles, "x", "y").select("a", "b").distinct())
    rest = rest.join(alike, ["a", "b"], "left_anti").where("_small > 0").where(F.col("_bound") >= F.when(F.col("_blank"), 0.84).when(F.col("_share") >= 0.48, 0.8).otherwise(0.88))
    if not letters:
        rest = rest.where("not _blank and _share >= 0.48")
    close = _sides(rest, rows, "event_key").withColumn("_close", ratio(F.col("l.event_key"), F.col("r.event_key"), 0.8)).where("(_blank and _close >= 0.84) or (not _blank and (_close >= 0.88 or (_close >= 0.8 and _share >= 0.48)))")
    return found.union(alike).union(close.select("a", "b"))


def _strings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event, group, s, first, last, id): the distinct titles and texts of each brand; and (id, role, bare, own, day, pos): who has them."""
    each = rows.select("pos", "day", "translated", "title", "event_key", (F.size("event_tokens") == 0).alias("blank"), F.explode("brands").alias("group"))
    worded = each.select("pos", "day", "group", F.explode(F.array_distinct(F.filter(F.array("translated", "title"), lambda x: x != ""))).alias("w"))
    worded = text.let(text.let(worded, "whole", text.title_key(F.col("w"))), "primary", text.title_key(text.without_source(F.col("w"))))
    worded = text.let(worded.where("whole <> ''"), "bare", F.size(text.title_tokens(F.col("w"))) == 0)
    roles = F.array(
        F.struct(F.lit("whole").alias("role"), F.col("whole").alias("s"), F.lit(True).alias("own")),
        F.struct(F.lit("primary").alias("role"), F.coalesce(F.nullif("primary", F.lit("")), "whole").alias("s"), (F.col("primary") != "").alias("own")),
    )
    entries = worded.select("pos", "day", "group", "bare", F.explode(roles).alias("e")).select("pos", "day", "group", "bare", "e.*")
    entries = entries.union(each.where("event_key <> ''").select("pos", "day", "group", F.col("blank").alias("bare"), F.lit("event").alias("role"), F.col("event_key").alias("s"), F.lit(True).alias("own")))
    entries = stored(entries.withColumn("event", F.col("role") == "event"))
    strings = entries.groupBy("event", "group", "s").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    strings = stored(strings.withColumn("id", F.monotonically_increasing_id()))
    keys = stored(entries.join(strings.select("event", "group", "s", "id"), ["event", "group", "s"]).select("id", "role", "bare", "own", "day", "pos"))
    return strings, keys


def letter_links(strings: DataFrame, keys: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    """(a, b): links that join, by way of each other and of ``_same_strings``, all rows of one brand within the date window whose titles
    or texts contain each other or resemble each other letter by letter, whatever tokens they share.

    Each distinct string of a brand is compared once. Two strings that are alike are linked by one row of each day. With ``joined``
    (node, cluster), strings all of whose rows are in one cluster are not compared with each other.
    """
    if joined is not None:
        # A string has a label where all its rows are joined already, to each other too.
        held = keys.select("id", "pos").distinct().join(joined, F.col("pos") == F.col("node"), "left").groupBy("id")
        one = held.agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count_if(F.col("cluster").isNull()).alias("alone"))
        strings = stored(strings.join(one.where("alone = 0 and low = high").select("id", F.col("low").alias("label")), "id", "left"))
    more = ["label"] if joined is not None else []
    titles, events = (strings.where(F.col("event") == which).select("id", "group", "first", "last", "s", *more) for which in (False, True))
    days = keys.groupBy("id", "role", "bare", "own", "day").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    found = similar.alike(titles, 0.76).union(similar.alike(events, 0.84)).withColumn("inside", F.lit(False))
    held = similar.inside(titles).join(titles.select(F.col("id").alias("x"), F.char_length("s").alias("n")), "x").select("x", "y", F.when(F.col("n") >= 18, 1.0).otherwise(0.0).alias("xy"), F.lit(1.0).alias("yx"), F.lit(True).alias("inside"))
    pairs = stored(found.union(held))

    def end(side: str, *names: str) -> DataFrame:
        return days.select(F.col("id").alias(side), "role", *(F.col(c).alias(f"{side}_{c}") for c in ("bare", "own", "day", "low", "high")))

    met = pairs.join(end("x"), "x").join(end("y"), ["y", "role"]).where(F.abs(F.datediff("x_day", "y_day")) <= WINDOW_DAYS)
    bare = F.col("x_bare") | F.col("y_bare")
    least = F.when(F.col("role") == "event", F.when(bare, 0.84).otherwise(0.88)).when(bare, 0.82).when(F.col("role") == "primary", 0.76).otherwise(0.86)
    # A string in another counts for whole titles of 18 letters on, and for titles without their source of 16 on.
    within = F.when(F.col("role") == "primary", F.col("x_own") & F.col("y_own")).otherwise((F.col("role") == "whole") & (F.col("xy") == 1.0))

    def linked(a: str, b: str, value: str) -> DataFrame:
        fits = F.when(F.col("inside"), within).otherwise(F.col(value) >= least)
        return met.where(fits & (F.col(f"{a}_low") < F.col(f"{b}_high"))).select(F.col(f"{a}_low").alias("a"), F.col(f"{b}_high").alias("b"))

    return linked("x", "y", "xy").union(linked("y", "x", "yx")).distinct()


def _same_strings(keys: DataFrame) -> DataFrame:
    """(a, b): rows of one string, chained by their days: many copies make as many links as there are copies."""
    return similar.chained(keys.select("id", "role", "day", "pos").distinct(), "id", "role")


def _tokens(c: str | Column) -> Column:
    """Tokens as fingerprints."""
    return F.transform(c, lambda t: F.xxhash64(t))


def event_clusters(articles: DataFrame) -> DataFrame:
    """(node, cluster): articles of one brand within the date window that report one event, joined into clusters.

    First what tokens, numbers, kinds of events and equal strings join; then letters are compared where this leaves rows apart. No step
    makes more links than a few for each row and block that it meets, so many articles of one event make no pairs of all with all.
    """
    rows = stored(event_rows(articles))
    strings, keys = _strings(rows)
    each = rows.select("pos", "day", F.explode("brands").alias("brand"), "numbers", "phrases").select("pos", "day", "brand", F.explode("numbers").alias("number"), "phrases")
    marked = similar.chained(each.select("pos", "day", "brand", "number", F.explode("phrases").alias("phrase")), "brand", "number", "phrase")
    other = F.when((F.col("title") != "") & (F.col("title") != F.col("main")), text.title_tokens(F.col("title"))).otherwise(F.array().cast("array<string>"))
    tokens = rows.select(F.col("pos").alias("id"), F.explode("brands").alias("group"), "day", _tokens("title_tokens").alias("titles"), _tokens(other).alias("wordings"), _tokens("event_tokens").alias("events"), _tokens("numbers").alias("numbers"), F.col("event_size").alias("length"))
    # Rows without any token share none.
    tokens = stored(tokens.where("size(titles) > 0 or size(wordings) > 0 or size(events) > 0"))
    hubs = similar.hub_links(tokens)
    first = stored(components(hubs.union(marked).union(_same_strings(keys))))
    found = stored(similar.token_pairs(tokens.join(first.toDF("id", "label"), "id", "left")))
    known = first.where("node <> cluster").select(F.col("node").alias("a"), F.col("cluster").alias("b"))
    joined = stored(components(found.where("kind = 0").select("a", "b").union(known)))
    left, right = joined.toDF("a", "cluster_a"), joined.toDF("b", "cluster_b")
    rest = found.where("kind > 0").distinct().join(left, "a", "left").join(right, "b", "left").where("coalesce(cluster_a, a) <> coalesce(cluster_b, b)").select("a", "b", "kind")
    rest = stored(rest)
    titled = _sides(rest.where("kind % 2 = 1").select("a", "b"), rows, "main", "title")
    wordings = F.filter(F.array_distinct(F.flatten(F.transform(F.array("l.main", "l.title"), lambda x: F.transform(F.array("r.main", "r.title"), lambda y: F.struct(x.alias("x"), y.alias("y")))))), lambda w: (w["x"] != "") & (w["y"] != ""))
    alike = similar_titles(titled.select("a", "b", F.explode(wordings).alias("w")).select("a", "b", "w.x", "w.y"), "x", "y").select("a", "b")
    close = _sides(rest.where("kind >= 2").select("a", "b"), rows, "event_key").where(ratio(F.col("l.event_key"), F.col("r.event_key"), 0.8) >= 0.8).select("a", "b")
    known = joined.where("node <> cluster").select(F.col("node").alias("a"), F.col("cluster").alias("b"))
    return components(known.union(alike).union(close).union(letter_links(strings, keys, joined)))


def scored_dedupe(articles: DataFrame, clusters: DataFrame, scorer: Callable[[list[dict]], set[int] | None]) -> DataFrame:
    """Articles without those that a scorer drops from their cluster; a failing or silent scorer drops none.

    scorer: the members of one cluster ({"pos", "title", "published_at", "summary"}) -> the pos to keep. Clusters span a brand's
    two weeks, a few rows each; they are scored in the executors.
    """
    texts = articles.select("pos", "title", "published_at", "summary")
    members = texts.join(clusters, F.col("pos") == F.col("node")).select("cluster", *texts.columns)

    def run(frame):
        rows = frame.sort_values("pos").drop(columns="cluster").to_dict("records")
        known = {r["pos"] for r in rows}
        try:
            keep = {int(k) for k in scorer(rows) or ()} & known
        except Exception:  # noqa: BLE001  a scorer is foreign code; its cluster stays whole
            keep = set()
        return frame[["pos"]][~frame["pos"].isin(keep or known)]

    gone = members.groupBy("cluster").applyInPandas(run, "pos long")
    return articles.join(gone, "pos", "left_anti")


#: Links (16 bytes each, counted before) that one task may join; beyond it labels spread by rounds of joins, with the same result.
FEW_LINKS = 500_000


def _joined(frames):
    """(node, cluster) of all links of one task."""
    import pandas as pd

    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            low, high = sorted((top(a), top(b)))
            above.setdefault(low, low)
            above[high] = low
            above.setdefault(a, low)
            above.setdefault(b, low)
    nodes = list(above)
    yield pd.DataFrame({"node": nodes, "cluster": [top(x) for x in nodes]}, dtype="int64")


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, cluster): the smallest node that each one reaches over links (a, b) of longs. A few links are joined by one task;
    with many, labels spread until none changes."""
    once = stored(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct())
    if once.count() <= FEW_LINKS:
        return once.coalesce(1).mapInPandas(_joined, "node long, cluster long")
    return _spread(once, rounds)


def _spread(links: DataFrame, rounds: int) -> DataFrame:
    both = stored(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("cluster")))
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("cluster").alias("low"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("cluster", "low").alias("cluster"))
        # Jump to the label of the label: path lengths halve.
        hop = new.select(F.col("node").alias("cluster"), F.col("cluster").alias("root"))
        new = new.join(hop, "cluster", "left").select("node", F.coalesce("root", "cluster").alias("cluster"))
        new = stored(new)
        changed = new.join(labels.withColumnRenamed("cluster", "old"), "node").where("cluster <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("the clusters did not settle")
