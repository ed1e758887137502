"""Rules about what an article is about: filters, signals and contexts, as Columns over its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as L
from . import terms, text
from .classify import first_match, trend_category, trend_impact

#: Fields of the text that platforms are matched in, and of the one that relevance is judged by.
MATCHED_FIELDS = ("title", "summary", "category", "tags", "body_excerpt", "article_url")
RELEVANCE_FIELDS = ("title", "summary", "title_translated", "summary_translated", "category", "body_excerpt")
CONTEXT_TERMS = L.MATERIAL_IMPACT + L.TRADE_CONTEXT
#: Name of the place of a search, its aliases.
NETWORKS = ["Instagram", "Meta"]


def _fields(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    kinds = dict(df.dtypes)
    return [text.clean_long(F.array_join(n, " ") if kinds[n].startswith("array") else F.col(n).cast("string")) for n in names if n in kinds]


def _joined(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The fields, each clean, as one text; empty ones leave no space."""
    return F.array_join(F.filter(F.array(*_fields(df, names), F.lit("")), lambda x: x != ""), " ")


def matched_text(df: DataFrame) -> Column:
    """Title, summary, category, tags, excerpt and URL as one text; columns that are not there count as empty."""
    return _joined(df, MATCHED_FIELDS)


def relevance_text(df: DataFrame) -> Column:
    """Title and summary as they are and translated, category and excerpt as one text."""
    return _joined(df, RELEVANCE_FIELDS)


def in_trade_context(c: Column) -> Column:
    """A word of trade, whatever noise stands beside it; an empty text has none."""
    return terms.matches_any(c, CONTEXT_TERMS)


def only_noise(c: Column) -> Column:
    return terms.matches_any(c, L.NOISY_TOPICS) & ~in_trade_context(c)


def keeps_article(side: Column, matched: Column, c: Column, official: Column) -> tuple[Column, Column]:
    """(kept, brands): media need a brand and a context, other sides are kept and fall back to their own brand."""
    media = side == "media"
    some = F.size(matched) > 0
    kept = ~media | (some & in_trade_context(c))
    none = F.array().cast("array<string>")
    return kept, F.when(~kept, none).when(some, matched).otherwise(F.array(official))


# --- hard filters ---


def foreign_only(c: Column, home: list[str]) -> Column:
    return terms.matches_any(c, L.FOREIGN_MARKETS) & ~terms.matches_any(c, home)


def minor_launch(c: Column) -> Column:
    return terms.matches_any(c, L.LAUNCHES) & terms.matches_any(c, L.PRODUCTS) & ~terms.matches_any(c, L.MATERIAL_IMPACT) & ~terms.matches_any(c, L.PROMO_SIGNALS)


def single_coverage(title: Column) -> Column:
    """A title that quotes a name, or holds a model number or a word in capitals."""
    t = text.clean(title)
    quoted = t.rlike(r"[“\"「『][^”\"」』]{2,80}[”\"」』]")
    return quoted | t.rlike(rf"{text.EDGE}[A-Za-z]{{1,8}}[- ]?[A-Za-z0-9]{{1,16}}[0-9][A-Za-z0-9\-]*{text.EDGE}") | t.rlike(rf"{text.EDGE}[A-Z]{{2,}}[A-Za-z0-9\-]{{1,}}{text.EDGE}")


def single_promo(c: Column, title: Column) -> Column:
    """An offer of a single good: two of a word for goods, a kind of goods and a title about one good."""
    goods, kinds = terms.matches_any(c, L.PRODUCTS), terms.matches_any(c, L.SINGLE_CATEGORIES)
    signs = goods.cast("int") + kinds.cast("int") + single_coverage(title).cast("int")
    material = terms.matches_any(c, L.MATERIAL_IMPACT) & ~(goods | kinds)
    return terms.matches_any(c, L.SINGLE_PROMOS) & ~terms.matches_any(c, L.BROAD_PROMOS) & ~material & (signs >= 2)


def hard_filter(c: Column, title: Column, home: list[str]) -> Column:
    """foreign_market, minor_launch, single_product or empty; the first that holds."""
    return first_match([(foreign_only(c, home), "foreign_market"), (minor_launch(c), "minor_launch"), (single_promo(c, title), "single_product")], "")


def hard_filter_wording(reason: Column, market: str, consumers: str) -> Column:
    """What a reader is told about each reason."""
    return first_match(
        [
            (reason == "foreign_market", f"新闻主要针对非{market}，难以直接影响{consumers}对平台的总体感受"),
            (reason == "minor_launch", f"新闻主要是单个商品或小范围发布，影响面较小，难以改变{consumers}对平台的总体感受"),
            (reason == "single_product", f"新闻主要是单个商品的特价、优惠或好价信息，影响面较小，难以改变{consumers}对平台的总体感受"),
        ],
        "",
    )


def platform_level(c: Column) -> Column:
    """Plain substrings of news about a whole platform."""
    return terms.contains_any(text.lower(c), L.PLATFORM_LEVEL)


def direct_impact(c: Column) -> Column:
    return terms.matches_any(c, L.MATERIAL_IMPACT + L.PROMO_SIGNALS)


#: Categories of exclusion with the substrings that decide, in order; those after the low confidence come last.
EXCLUSIONS = [
    ("foreign_market_or_non_target_market", ["foreign market", "other country", "fuori mercato", "non target", "stati uniti", "usa", "uk", "china", "france", "germany", "spain"]),
    ("entertainment_or_content_noise", ["entertainment", "music", "movie", "video", "concert", "celebrity", "reality", "serie tv", "film", "musica", "concerto"]),
    ("single_product_or_coupon", ["single product", "sku", "shopping guide", "buyers guide", "best deals", "gift ideas", "classifica", "migliori", "guida all'acquisto", "codice sconto", "coupon", "one-sku", "one sku", "single-product", "product listicle", "listicle", "offerta", "sconto"]),
    ("target_platform_not_material", ["no platform", "target platform", "not about", "brand not", "platform not", "non riguarda"]),
    ("creator_commerce_weak_link", ["creator economy", "creator marketplace", "creator commerce", "brand partnership", "shoppable posts", "reels shopping", "instagram business", "meta commerce", "ai shopping", "shopping agent", "brand discovery", "collaborazioni", "creator"]),
    ("capital_market_event_weak_link", ["acquisition", "takeover", "capital market", "investor", "shareholder", "board", "gamestop", "offerta", "acquisizione", "cda", "wall street", "bitcoin exposure"]),
    ("platform_ecosystem_weak_link", ["platform ecosystem", "marketplace strategy", "seller ecosystem", "merchant ecosystem", "ebay live", "live shopping", "live commerce", "marketplace performance", "platform-level", "shopping festival", "major promotion", "platform strategy"]),
]
EXCLUSIONS_LAST = [("b2b_or_corporate_only", ["b2b", "corporate", "partnership", "investor", "organization", "financing"])]


def exclusion_category(c: Column, reason: Column, confidence: Column) -> Column:
    """Why a decision let an article go. confidence: high, medium or low."""
    low = text.lower(F.concat(c, F.lit(" "), text.clean(reason)))
    cases = [(terms.contains_any(low, words), name) for name, words in EXCLUSIONS]
    cases.append((confidence == "low", "low_confidence_or_weak_link"))
    return first_match(cases + [(terms.contains_any(low, words), name) for name, words in EXCLUSIONS_LAST], "weak_nps_link")


# --- contexts of single platforms ---


def shop_strength(c: Column, italian: bool = False) -> Column:
    """strong, weak or empty: how much a text about a photo network is about trade."""
    strong = L.SHOP_STRONG + (L.SHOP_STRONG_IT if italian else [])
    weak = L.SHOP_WEAK + (L.SHOP_WEAK_IT if italian else [])
    return first_match([(terms.matches_any(c, strong), "strong"), (terms.matches_any(c, weak), "weak")], "")


def shop_skip_reason(c: Column, italian: bool = False) -> Column:
    low = text.lower(c)
    return first_match(
        [
            (c == "", "instagram_commerce_context_missing"),
            (terms.contains_any(low, L.SHOP_ENTERTAINMENT), "instagram_entertainment_noise"),
            (terms.contains_any(low, L.SHOP_ACCOUNTS) & (shop_strength(c, italian) == ""), "instagram_account_or_influencer_noise"),
        ],
        "instagram_commerce_context_missing",
    )


def union_context(c: Column, aliases: list[str], italian: bool = False) -> Column:
    """A name of the platform, and a sign of an impact on all of Europe or the world."""
    return terms.matches_any(c, aliases) & terms.matches_any(c, L.UNION_IMPACT + (L.UNION_IMPACT_IT if italian else []))


def network_context(c: Column, italian: bool = False) -> Column:
    return terms.matches_any(c, NETWORKS) & (shop_strength(c, italian) != "")


def video_shop_context(c: Column, aliases: list[str], italian: bool = False) -> Column:
    return terms.matches_any(c, aliases) & terms.matches_any(c, L.VIDEO_SHOP + (L.VIDEO_SHOP_IT if italian else []))


def several_platforms(c: Column, aliases: list[str], italian: bool = False) -> Column:
    return union_context(c, aliases, italian) & terms.matches_any(c, L.MULTI_PLATFORM)


def broad_entry_reason(c: Column, label: Column, temu: list[str], video: list[str], italian: bool = False) -> Column:
    """Why an article that names the market nowhere is let in for a platform; empty: it is not."""
    return first_match(
        [
            ((label == "TEMU") & several_platforms(c, temu, italian), "multi_platform_regulatory_or_market_event"),
            ((label == "TEMU") & union_context(c, temu, italian), "TEMU EU/Europe/global platform impact signal"),
            (F.lower(label).isin("tts", "tiktok shop") & video_shop_context(c, video, italian), "TTS/TikTok Shop platform ecosystem or social commerce signal"),
            (F.lower(label).isin("ig", "instagram", "instagram shopping") & network_context(c, italian), "IG/Meta indirect commerce or creator economy signal"),
        ],
        "",
    )


def looks_like_promo(c: Column) -> Column:
    return terms.matches_any(text.lower(c), [t.lower() for t in L.PROMO_SIGNALS])


def looks_like_report(c: Column) -> Column:
    return terms.matches_any(text.lower(c), [t.lower() for t in L.REPORT_SIGNALS])


# --- trends ---

#: What a trend's category is called in its reason.
TREND_LABELS = {
    "market_adoption": "市场渗透率、消费者采用或市场增长",
    "brand_performance": "品牌整体增长、业绩或市场表现",
    "regulatory_risk": "监管、合规、隐私或商品安全风险",
    "platform_ecosystem": "平台生态、卖家、物流、支付或工具能力变化",
    "consumer_behavior": "消费者行为、使用习惯或购物偏好变化",
    "competitive_landscape": "竞争格局、排名或品牌对比变化",
    "other": "行业报告或整体趋势",
}
#: Other names of a category; the reason where nothing better is known.
TREND_ALIASES = {
    "adoption": "market_adoption", "market": "market_adoption", "penetration": "market_adoption", "performance": "brand_performance", "growth": "brand_performance",
    "regulation": "regulatory_risk", "regulatory": "regulatory_risk", "compliance": "regulatory_risk", "ecosystem": "platform_ecosystem", "seller_ecosystem": "platform_ecosystem",
    "consumer": "consumer_behavior", "behavior": "consumer_behavior", "competition": "competitive_landscape", "competitive": "competitive_landscape",
}
TREND_REASON = "新闻涉及品牌或平台整体层面的行业趋势，可能影响消费者对平台的长期认知。"
_GOOD, _BAD = ["positive", "pos", "up", "good", "favorable"], ["negative", "neg", "down", "bad", "unfavorable"]


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v)))), key)


def trend_flag(c: Column) -> Column:
    """Whether a flag, as text, says yes."""
    return F.lower(text.clean(c)).isin("1", "true", "yes", "y", "是", "行业趋势", "trend", "industry_trend")


def trend_category_name(c: Column) -> Column:
    tidy = F.translate(F.lower(text.clean(c)), "- ", "__")
    named = F.coalesce(_lookup(TREND_ALIASES, tidy), tidy)
    return F.when(named.isin(*TREND_LABELS), named).otherwise("other")


def trend_impact_name(c: Column) -> Column:
    low = F.lower(text.clean(c))
    return first_match([(low.isin(*_GOOD), "Positive"), (low.isin(*_BAD, "risk"), "Negative"), (low.isin("mixed", "both", "双向", "mixed/neutral"), "Mixed")], "Neutral")


def sentiment_name(c: Column) -> Column:
    low = F.lower(text.clean(c))
    return first_match([(low.isin(*_GOOD), "Positive"), (low.isin(*_BAD), "Negative")], "Neutral")


def confidence_name(c: Column, default: str = "high") -> Column:
    low = F.lower(text.clean(c))
    return first_match([(low.isin("high", "strong", "certain", "confident"), "high"), (low.isin("medium", "mid", "moderate", "possible"), "medium"), (low.isin("low", "weak", "uncertain"), "low")], default)


def trend_reason(category: Column) -> Column:
    return F.concat(F.lit("新闻涉及"), _lookup(TREND_LABELS, category), F.lit("，可能影响消费者对该平台或品牌的整体认知。"))


def with_trend(df: DataFrame, c: Column, is_report: Column, given: dict[str, Column] | None = None) -> DataFrame:
    """Sets industry_trend_flag ('true' or ''), _category, _impact, _reason: given ones before the row's own before inferred ones.

    A row that nothing flags keeps its own values, tidied.
    """
    names = ("flag", "category", "impact", "reason")
    blank = F.lit("")
    own = {n: F.col(f"industry_trend_{n}").cast("string") if f"industry_trend_{n}" in df.columns else blank for n in names}
    given = {n: (given or {}).get(n, blank) for n in names}
    # Inferred: the first group of terms in the text; reports without one are ``other``. Each is computed once a row.
    rows = text.let(text.let(df, "_low", text.lower(c)), "_report", is_report)
    rows = text.let(rows, "_found", F.when(F.col("_low") == "", "").otherwise(trend_category(F.col("_low"))))
    rows = text.let(rows, "_category", F.when((F.col("_found") == "") & (F.col("_low") != "") & F.col("_report"), "other").otherwise(F.col("_found")))
    found = F.col("_category") != ""
    rows = text.let(rows, "_impact", F.when(found, trend_impact(F.col("_category"), F.col("_low"))).otherwise("Neutral"))
    flagged = trend_flag(given["flag"]) | trend_flag(own["flag"]) | found
    inferred = {"category": F.col("_category"), "impact": F.col("_impact"), "reason": F.when(found, trend_reason(F.col("_category"))).otherwise("")}
    best = {n: text.first_present(given[n], own[n], inferred[n]) for n in names[1:]}
    out = {
        "industry_trend_flag": F.when(flagged, "true").otherwise(""),
        "industry_trend_category": F.when(flagged, trend_category_name(best["category"])).otherwise(text.clean(own["category"])),
        "industry_trend_impact": F.when(flagged, trend_impact_name(best["impact"])).otherwise(trend_impact_name(own["impact"])),
        "industry_trend_reason": F.when(flagged, F.coalesce(F.nullif(best["reason"], blank), F.lit(TREND_REASON))).otherwise(text.clean(own["reason"])),
    }
    return rows.select(*(F.col(x) for x in df.columns if x not in out), *(v.alias(k) for k, v in out.items()))
