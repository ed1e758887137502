"""Ordered decisions over article texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms, text

#: What a brand's funnel is diagnosed as.
FEW_CANDIDATES = "候选较少，问题主要发生在搜索入池阶段"
LOST_IN_FILTER = "入池候选有量，但多数在 AI 指标筛选阶段被排除"
LOST_IN_DEDUPE = "筛选后仍有候选，但最终去重/合并移除较多"
NOTHING_KEPT = "有少量候选，但最终未保留可汇报新闻"
HEALTHY = "各阶段有保留，可继续关注最终新闻质量"


def first_match(cases: list[tuple[Column, object]], default: object) -> Column:
    out = F.lit(default)
    for condition, value in reversed(cases):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def nps_dimension(c: Column, low: Column | None = None) -> Column:
    """The first dimension one of whose keywords is a substring. low: the text in lower case, if it is there already."""
    low = text.lower(F.coalesce(c, F.lit(""))) if low is None else low
    return first_match([(terms.contains_any(low, words), name) for name, words in terms.NPS_DIMENSION_RULES], None)


def trend_category(c: Column, is_report: Column | None = None) -> Column:
    """The category of the first group of trend terms that matches; reports without one are ``other``; else empty."""
    found = first_match([(terms.matches_any(c, words), name) for name, _, words in terms.TREND_GROUPS], "")
    return found if is_report is None else F.when((found == "") & is_report, "other").otherwise(found)


def trend_impact(category: Column, c: Column) -> Column:
    down = terms.matches_any(c, terms.DOWNTURN_TERMS)
    rising = category.isin("market_adoption", "brand_performance", "platform_ecosystem")
    return first_match([(category == "regulatory_risk", "Negative"), (category == "competitive_landscape", "Mixed"), (rising & ~down, "Positive")], "Neutral")


def applies_hard_filter(reason: Column, platform_signal: Column, mode: str) -> Column:
    """Strict: any reason counts; balanced: the foreign market always, the others without a platform-level signal."""
    if mode != "balanced":
        return reason != ""
    return (reason == "foreign_market") | ((reason != "") & ~platform_signal)


def question_ids(c: Column, allowed: Column, low: Column | None = None) -> Column:
    """Question ids hinted at by substrings, restricted to the allowed ones, in the order of the hints."""
    low = text.lower(F.coalesce(c, F.lit(""))) if low is None else low
    hits = [F.when(terms.contains_any(low, words), F.array(*map(F.lit, ids))).otherwise(F.array().cast("array<string>")) for ids, words in terms.QUESTION_HINTS]
    found = F.array_distinct(F.concat(*hits))
    loyal = next(words for ids, words in terms.QUESTION_HINTS if ids == ["B5_16"])
    cash_only = terms.contains_any(low, terms.CASH_PLACE_TERMS) & ~terms.contains_any(low, loyal)
    return F.array_intersect(F.when(cash_only, F.array_remove(found, "B5_16")).otherwise(found), allowed)


def diagnosis(raw: Column, initial: Column, survey: Column, final: Column) -> Column:
    """Where a brand loses its candidates."""
    return first_match(
        [
            (raw <= 2, FEW_CANDIDATES),
            ((initial > 0) & (survey <= F.greatest(F.lit(1), F.floor(initial * 0.2))), LOST_IN_FILTER),
            ((survey > 0) & (final <= F.greatest(F.lit(1), F.floor(survey * 0.5))), LOST_IN_DEDUPE),
            (final == 0, NOTHING_KEPT),
        ],
        HEALTHY,
    )


#: Pages of sellers that need a login.
SELLER_SITES = ["seller.tiktokglobalshop.com", "sellercentral.amazon.co.jp", "qsm.qoo10.jp", "seller.shein.com"]


def source_status(url: Column, code: Column, final_url: Column, body: Column) -> Column:
    """status and note of a fetched page: error, http_error, blocked, login_required or public; the first that holds."""
    address, page = F.lower(F.coalesce(F.nullif(final_url, F.lit("")), url)), F.lower(F.coalesce(body, F.lit("")))
    broken = page.contains("523 error") | (page.contains("error occurred") & address.contains("qoo10"))
    seller = terms.contains_any(address, SELLER_SITES) & terms.contains_any(page, ["login", "signin", "ログイン"])

    def said(status: str, note) -> Column:
        return F.struct(F.lit(status).alias("status"), (note if isinstance(note, Column) else F.lit(note)).alias("note"))

    return (
        F.when(code.isNull(), said("error", "request failed"))
        .when(code >= 400, said("http_error", F.concat(F.lit("http "), code.cast("string"))))
        .when(broken, said("blocked", "page returns an error body despite HTTP 200"))
        .when(terms.contains_any(address, ["login", "signin", "sign-in", "auth"]), said("login_required", "final url indicates login flow"))
        .when(seller, said("login_required", "seller-side page content indicates authentication"))
        .when(terms.contains_any(page, ['type="password"', "seller central", "seller center", "returnurl="]), said("login_required", "page content indicates authentication"))
        .otherwise(said("public", "page is publicly reachable"))
    )


def error_category(note: Column) -> Column:
    """The kind of an error by the words of its note; the first that holds."""
    low = F.lower(text.clean(note))

    def has(*words: str) -> Column:
        return text.any_of([low.contains(w) for w in words])

    return first_match(
        [
            (low == "", "unknown"),
            (has("sslerror", "certificate verify failed", "self-signed certificate"), "ssl_cert_verification"),
            (has("connecttimeout") | (has("connection to ") & has("timed out")), "connect_timeout"),
            (has("readtimeout", "read timed out"), "read_timeout"),
            (has("proxyerror", "proxy"), "proxy_error"),
            (has("toomanyredirects", "too many redirects"), "too_many_redirects"),
            (has("login", "signin", "登录"), "login_required"),
            (has("403", "forbidden", "blocked"), "blocked"),
            (has("adapter failed"), "adapter_failed"),
            (has("parse", "selector"), "parse_failure"),
        ],
        "other_network_or_parser_error",
    )


def zero_yield_reason(status: Column, note: Column, endpoint: Column, recent: Column, selectors: Column, dated: Column, candidates: Column, matched: Column) -> Column:
    """Why a source gave no recent article; empty where it gave some."""
    said = F.lower(F.concat_ws(" ", status, note))
    code = F.lower(text.clean(endpoint))

    def has(*words: str) -> Column:
        return text.any_of([said.contains(w) for w in words])

    return first_match(
        [
            (recent > 0, ""),
            (has("login"), "access_limited"),
            (has("cloudflare", "403", "forbidden", "blocked", "anti bot", "anti-bot"), "blocked_or_anti_bot"),
            (has("javascript", "client-side", "next.js", "hydration"), "client_side_rendering"),
            (status == "error", error_category(note)),
            (code.startswith("http_4") | code.startswith("http_5"), "search_endpoint_invalid"),
            ((selectors <= 0) & code.startswith("http_2"), "selector_no_match"),
            ((selectors > 0) & (dated <= 0), "date_not_parsed"),
            (candidates <= 0, "no_recent_candidates"),
            (matched <= 0, "no_brand_match"),
        ],
        "no_recent_brand_articles",
    )


def source_recommendation(reason: Column) -> Column:
    """What to do about a source with this reason."""
    return first_match(
        [
            (reason == "", "keep"),
            (reason.isin("access_limited", "blocked_or_anti_bot", "client_side_rendering"), "skip_deep_crawl_or_disable"),
            (reason.isin("no_recent_candidates", "no_recent_brand_articles", "no_brand_match", "selector_no_match", "date_not_parsed"), "use_shallow_crawl_for_short_window"),
            (reason == "search_endpoint_invalid", "fix_or_replace_source_adapter"),
            (reason.isin("connect_timeout", "read_timeout", "proxy_error"), "retry_later_or_check_network"),
        ],
        "review_source_adapter",
    )


def guess_country(url: Column) -> Column:
    return F.when(terms.contains_any(F.lower(F.coalesce(url, F.lit(""))), [".jp", "ja-jp", "aboutamazon.jp"]), "JP").otherwise("Global")


def dataset_label(name: Column, translation: Column) -> Column:
    """What a run's file is called. translation: its translation status, may be empty."""

    def stage(label: str) -> Column:
        return F.when(text.clean(translation) != "", F.concat(F.lit(label + "/"), text.clean(translation))).otherwise(label)

    return (
        F.when(name.isin("before.csv", "before.json") | name.startswith("articles_before_filter_"), stage("筛选前"))
        .when(name.isin("after.csv", "after.json") | name.startswith("articles_after_filter_"), stage("筛选后"))
        .when(name.isin("sources.csv", "sources.json") | name.startswith("source_results_"), "来源结果")
        .when(name.startswith("articles_"), "兼容结果")
        .otherwise("新闻数据")
    )


def translation_label(name: Column, before: Column, after: Column, timing: Column) -> Column:
    """Whether a run's file is translated, by its status or by when translation took place; empty: unknown."""
    raw, done = F.lit("原文未翻译"), F.lit("已翻译")
    early = F.when(before == "raw_untranslated", raw).when(before == "translated", done).when(timing == "after_ai_filter", raw).when(timing == "before_filter", done).otherwise("")
    late = F.when((after == "translated") | timing.isin("after_ai_filter", "before_filter"), done).otherwise("")
    return F.when(name.isin("before.csv", "before.json"), early).when(name.isin("after.csv", "after.json"), late).otherwise("")


def translation_failed(title: Column, translated: Column, target: str = "zh-CN") -> Column:
    """Whether a title that needed a translation has none, or its own wording, or none in the wanted script."""
    a, b = text.clean(title), text.clean(translated)
    same = (b == "") | (a == b)
    if target == "zh-CN":
        return (a != "") & ~text.contains_han(a) & (same | ~text.contains_han(b))
    return (a != "") & same


def capability_risk(status: Column, note: Column, error: Column, adapter: Column, feeds: Column, searches: Column, interfaces: Column, hints: Column, code: Column) -> Column:
    """low, medium or high: how likely it is that a source's crawl is incomplete."""
    n, e = F.lower(text.clean(note)), F.lower(text.clean(error))
    return first_match(
        [
            (F.lower(text.clean(status)).isin("blocked", "login_required"), "high"),
            (adapter | (feeds > 0) | (searches > 0), "low"),
            (interfaces > 0, "medium"),
            (hints > 0, "high"),
            ((code >= 400) | text.any_of([e.contains(w) for w in ("ssl", "timeout", "connection")]), "medium"),
            (text.any_of([n.contains(w) for w in ("error", "forbidden", "blocked")]), "high"),
        ],
        "medium",
    )
