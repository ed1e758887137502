"""Word lists and term matching. The lists are fixed values; lists too long to state come in as parameters."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

#: Dimension and keywords, the first dimension with a keyword in the text wins.
NPS_DIMENSION_RULES = [
    ("Post-purchase service", ["refund", "return", "返品", "返金", "cancel", "cancellation", "解約", "aftersales", "アフター", "customer service", "サポート"]),
    ("Logistics", ["shipping", "delivery", "配送", "発送", "物流", "warehouse", "fulfillment", "courier", "parcel", "same-day", "翌日"]),
    ("Price", ["price", "pricing", "discount", "coupon", "voucher", "sale", "promotion", "promo", "point", "ポイント", "価格", "値下げ", "割引"]),
    ("Content", ["video", "live", "livestream", "short video", "creator", "content", "recommendation", "discovery", "動画", "ライブ", "配信", "コンテンツ"]),
    ("Seller quality", ["seller", "merchant", "shop", "partner", "marketplace seller", "shop owner", "出店", "店舗", "加盟店"]),
    ("Product quality", ["quality", "counterfeit", "authentic", "safety", "安全", "品質", "正規品", "偽物"]),
    ("Product variety", ["brand", "assortment", "catalog", "selection", "variety", "category expansion", "品揃え", "ブランド", "カテゴリ"]),
    ("Product feature", ["feature", "function", "app", "search", "payment", "checkout", "membership", "review", "rating", "ui", "ux", "security", "機能", "アプリ", "検索", "決済", "レビュー"]),
]

#: Groups of trend terms in the order in which they decide, with category and impact.
TREND_GROUPS = [
    ("regulatory_risk", "Negative", L.TREND_REGULATORY),
    ("competitive_landscape", "Mixed", L.TREND_COMPETITIVE),
    ("market_adoption", "Positive", L.TREND_MARKET_FIRST),
    ("platform_ecosystem", "Positive", L.TREND_ECOSYSTEM),
    ("market_adoption", "Positive", L.TREND_MARKET),
    ("brand_performance", "Positive", L.TREND_PERFORMANCE),
    ("consumer_behavior", "Neutral", L.TREND_CONSUMER),
]
#: Terms that keep a trend's impact neutral.
DOWNTURN_TERMS = ["decline", "loss", "calo", "rischio", "risk"]

#: Names of hints, their terms (met as plain substrings) and the question ids they stand for.
QUESTION_HINTS = [
    (["B5_18"], ["payment method", "payment methods", "pay in cash", "cash payment", "cash payments", "cash", "contanti", "pagamento", "pagamenti", "pagare", "metodo di pagamento", "metodi di pagamento", "contrassegno", "checkout", "支付", "付款"]),
    (["B5_7", "B5_17"], ["secure payment", "payment security", "secure checkout", "safe payment", "sicuro", "sicura", "sicurezza", "安全", "安心"]),
    (["B5_16"], ["loyalty", "reward", "rewards", "cashback", "membership", "fedelt", "punti fedelt", "programma fedelt", "premio", "premi", "ricompensa", "会员", "积分"]),
    (["B5_1", "B5_9", "B5_10"], ["recommendation", "recommendations", "recommended", "personalized", "preferences", "interests", "raccomand", "consigli", "推荐", "偏好"]),
    (["B5_3"], ["search", "seller search", "product search", "ricerca", "cerca", "检索", "搜索"]),
    (["B5_4"], ["order", "orders", "check my order", "ordine", "ordini", "订单"]),
    (["B5_15"], ["review", "reviews", "rating", "ratings", "recensioni", "valutazioni", "评价"]),
    (["B1_2"], ["copyright", "copyrights", "intellectual property", "ip infringement", "infringement", "counterfeit", "fake", "authentic", "original", "trademark", "piracy", "contraffazione", "contraffatti", "autentico", "autentici", "violazione", "proprietà intellettuale", "版权", "侵权", "正品", "假货"]),
    (["B1_3", "B1_4"], ["reliable", "trustworthy", "legitimate", "legit", "scam", "fraud", "safe", "affidabile", "sicuro", "sicura", "truffa", "frodi", "legittimo", "可靠", "安全可靠吗", "信任", "合法"]),
    (["B1_7"], ["matches the description", "as described", "product description", "not as described", "descrizione", "come descritto", "corrisponde", "描述一致", "实物与描述"]),
]
#: Places to pay in cash; with one of these and no loyalty term, the loyalty question is off.
CASH_PLACE_TERMS = ["cash payment", "cash payments", "pay in cash", "physical points", "payment points", "pickup points", "collection points", "punti in tutta italia", "punti vendita", "punti fisici", "pagamenti in contanti", "pagare in contanti"]

#: The order in which platforms are reported.
PLATFORM_ORDER = ["EU行业", "行业", "AMZ", "Shein", "Temu", "TTS", "eBay", "IG"]


def boundary_pattern(terms: list[str]) -> str | None:
    """One pattern for all ASCII terms: any case, no letter or digit beside them."""
    ascii_terms = sorted((t for t in terms if t.isascii()), key=len, reverse=True)
    return rf"(?i:(?:^|[^A-Za-z0-9])(?:{'|'.join(map(re.escape, ascii_terms))})(?:[^A-Za-z0-9]|$))" if ascii_terms else None


@lru_cache(maxsize=None)
def _finder(pattern: str, application: str | None):
    """Whether a text holds the pattern, by an engine (Arrow's) that reads a text once however many alternatives there are; the JVM's
    tries each of them at each place. One function for each pattern, so that equal conditions are asked once."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    return found


def _holds(c: Column, pattern: str) -> Column:
    context = SparkContext._active_spark_context
    return _finder(pattern, context.applicationId if context else None)(F.coalesce(c, F.lit("")))


def matches_any(c: Column, terms: list[str]) -> Column:
    """ASCII terms stand between boundaries in any case; all others are substrings as they are written."""
    bounded = boundary_pattern(terms)
    parts = ([bounded] if bounded else []) + [re.escape(t) for t in terms if not t.isascii()]
    return _holds(c, "|".join(parts)) if parts else F.lit(False)


def contains_any(c: Column, terms: list[str]) -> Column:
    """Plain substrings of a text that is in lower case already; terms that contain another one add nothing."""
    found = sorted({t.lower() for t in terms}, key=len)
    own = [t for i, t in enumerate(found) if not any(s in t for s in found[:i])]
    return _holds(c, "|".join(map(re.escape, own))) if own else F.lit(False)


def matches_search_terms(c: Column, terms: list[str]) -> Column:
    """No terms, or no text, match anything."""
    return F.lit(True) if not terms else (F.coalesce(c, F.lit("")) == "") | matches_any(c, terms)


def labels(c: Column, groups: dict[str, list[str]]) -> Column:
    """The labels with a matching term, in the order given."""
    return F.array_compact(F.array(*(F.when(matches_any(c, terms), F.lit(label)) for label, terms in groups.items())))
