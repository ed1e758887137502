"""The briefing table: 22 columns of an article, the scorer's answers brought to allowed values, and its sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import context, dates, terms, text, urls
from ..functions.classify import first_match

#: The headers of the table, in order.
HEADERS = [
    "Tracking Week", "Source Country", "Platform", "NPS Overall Change", "Key User Segment Affected", "NPS Dimension", "News Title / Event", "News Type (Media / Official / Community)", "Source Name", "Publish Date", "News URL",
    "Core Summary", "Sentiment (Positive / Neutral / Negative)", "Affected Side (Buyer / Seller / Both)", "Impact Direction on NPS (Up / Down / Neutral)",
    "Impacted NPS Metric (Price / Trust / Fulfillment / Content / Assortment)", "Impact Level (High / Medium / Low)", "Short-term or Lagged Effect", "Quant Linkage Hypothesis", "Analyst Note", "Include in Client Readout (Y/N)", "Follow-up Needed (Y/N)",
]
#: Headers a scorer may answer, the allowed answers of those that are no free text, and the default.
ANSWERS = {
    "Key User Segment Affected": None, "Core Summary": None, "Sentiment (Positive / Neutral / Negative)": (["Positive", "Neutral", "Negative"], "Neutral"), "Affected Side (Buyer / Seller / Both)": (["Buyer", "Seller", "Both"], "Both"),
    "Impact Direction on NPS (Up / Down / Neutral)": (["Up", "Down", "Neutral"], "Neutral"), "Impacted NPS Metric (Price / Trust / Fulfillment / Content / Assortment)": (["Price", "Trust", "Fulfillment", "Content", "Assortment"], None),
    "Impact Level (High / Medium / Low)": (["High", "Medium", "Low"], "Medium"), "Short-term or Lagged Effect": None, "Quant Linkage Hypothesis": None, "Analyst Note": None, "Include in Client Readout (Y/N)": (["Y", "N"], "Y"), "Follow-up Needed (Y/N)": (["Y", "N"], "Y"),
}
#: Tokens that tell an official source and a community; all else is media.
OFFICIAL = ["official", "press", "newsroom", "aboutamazon", "business.", "company"]
COMMUNITY = ["reddit", "forum", "community", "facebook", "instagram", "tiktok", "x.com", "twitter"]
#: Metrics by substrings of the dimensions, in order; else trust.
METRICS = [("Price", ["price"]), ("Fulfillment", ["logistics", "fulfillment", "delivery"]), ("Content", ["content"]), ("Assortment", ["variety", "assortment"])]
#: Segments (``{}``: the country) by tokens of the text, in order; the last one has none.
SEGMENTS = [
    ("偏好现金支付的{}买家", ["cash", "contanti", "现金", "payment", "pagamenti", "支付"]),
    ("{}品质与合规敏感买家", ["pfas", "illegal", "counterfeit", "fake", "authentic", "compliance", "regulator", "investigation", "非法", "假货", "正品", "合规", "调查", "监管", "欧盟"]),
    ("{} Prime 会员", ["prime"]),
    ("{}会员/忠诚度用户", ["会员", "忠诚", "loyalty", "points", "积分", "reward", "奖励"]),
    ("{}促销/优惠关注买家", ["coupon", "优惠码", "折扣码", "promo code", "sconto", "codice"]),
    ("{}价格敏感型买家", ["discount", "deal", "deals", "promo", "promotion", "sale", "折扣", "优惠", "促销", "大促", "特惠", "价格"]),
    ("{}品牌商家", ["brand merchant", "品牌商家", "品牌卖家"]),
    ("{}平台卖家", ["seller", "merchant", "commission", "卖家", "商家", "佣金", "店铺政策", "seller center"]),
    ("{}隐私与数据安全敏感买家", ["privacy", "data", "security", "personal information", "隐私", "数据", "安全", "个人信息"]),
    ("{}售后与权益保障敏感买家", ["refund", "return", "after-sales", "post-purchase", "service", "rights", "退款", "退货", "售后", "权益", "客服"]),
    ("{}内容/直播购物用户", ["live", "livestream", "creator", "content", "recommendation", "tiktok shop", "直播", "内容", "创作者", "推荐算法"]),
    ("{}跨境购物用户", ["cross-border", "global", "import", "export", "跨境", "海外"]),
    ("{}新用户", ["new user", "new customer", "新用户", "新客"]),
    ("{}年轻购物用户", ["young", "gen z", "youth", "年轻", "z世代"]),
    ("{}高频购物用户", ["heavy shopper", "high-frequency", "高频", "重度购物"]),
]
PLAIN_SEGMENT = "{}平台买家"
SEGMENT_FIELDS = ("platform_label", "title", "title_original", "title_display_zh", "summary", "survey_dimensions", "survey_question_ids", "survey_indicator_examples", "survey_ai_reason_raw", "survey_ai_reason_translated")
#: Segments that say nothing, in lower case; the same with the country in front.
EMPTY_SEGMENTS = ["", "chinese user segment", "test segment", "user segment", "segment", "用户群体", "消费者", "用户", "平台用户", "普通消费者", "普通用户", "中国用户", "中文用户", "中国消费者", "中文消费者"]
EMPTY_OF_COUNTRY = ["{}用户", "{}消费者", "{}普通用户", "{}普通消费者", "{}用户群体"]


def column(df: DataFrame, name: str) -> Column:
    """A column as text; one that is not there is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def joined(df: DataFrame, names: tuple[str, ...] | list[str]) -> Column:
    return text.lower(F.concat_ws(" ", *(column(df, n) for n in names)))


def cell(c: Column, limit: int) -> Column:
    """A cell's text, cut to ``limit`` characters with an ellipsis as its last one."""
    return text.once(text.clean(c), lambda t: F.when(F.char_length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit - 1))), F.lit("…"))).otherwise(t))


def news_type(df: DataFrame) -> Column:
    low = joined(df, ("source_name", "source_url", "article_url", "category"))
    return first_match([(terms.contains_any(low, OFFICIAL), "Official"), (terms.contains_any(low, COMMUNITY), "Community")], "Media")


def metric(dimensions: Column) -> Column:
    low = text.lower(F.coalesce(dimensions, F.lit("")))
    return first_match([(terms.contains_any(low, words), name) for name, words in METRICS], "Trust")


def direction_sign(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return first_match([(low == "up", "↑"), (low == "down", "↓")], "→")


def segment(df: DataFrame, country: str) -> Column:
    """The group of users that an article concerns: the first one with a token in its text."""

    low = joined(df, SEGMENT_FIELDS)
    return first_match([(terms.contains_any(low, words), name.format(country)) for name, words in SEGMENTS], PLAIN_SEGMENT.format(country))


def empty_segment(c: Column, country: str) -> Column:
    """Whether a segment says nothing, or is not worded in Chinese."""
    t = text.clean(c)
    low = F.lower(t)
    named = [n.format(country) for n in EMPTY_OF_COUNTRY]
    return low.isin(*EMPTY_SEGMENTS) | t.isin(*named) | low.contains("chinese user segment") | t.contains("中国用户") | t.contains("中文用户") | ~text.contains_han(t)


def checked_segment(df: DataFrame, c: Column, country: str) -> Column:
    """A given segment if it says something about the country's users, else the one inferred."""
    t = text.clean(c)
    return F.when(~empty_segment(c, country) & t.contains(country), t).otherwise(segment(df, country))


def source_name(df: DataFrame) -> Column:
    name = cell(column(df, "source_name"), 180)
    url = F.coalesce(F.nullif(F.trim(column(df, "article_url")), F.lit("")), F.trim(column(df, "source_url")))
    return F.when(name != "", name).otherwise(F.replace(F.regexp_extract(url, urls.PARTS, 2), F.lit("www."), F.lit("")))


def briefing_table(df: DataFrame, country: str, code: str, today: str, answers: DataFrame | None = None) -> DataFrame:
    """article_id and the 22 columns of each article.

    country: its name as the segments have it. code: as the table has it. today: the date of articles without one. answers:
    article_id and columns named like the headers, from a scorer; what is missing or not allowed gets the default.
    """
    df = df if "article_id" in df.columns else df.withColumn("article_id", F.col("pos").cast("string"))
    day = F.to_date(dates.parse(column(df, "published_at")))
    title = F.coalesce(F.nullif(cell(F.coalesce(F.nullif(column(df, "title_display_zh"), F.lit("")), column(df, "title")), 500), F.lit("")), cell(column(df, "title_original"), 500))
    link = F.coalesce(F.nullif(F.trim(column(df, "article_url")), F.lit("")), F.trim(column(df, "source_url")))
    dimensions = column(df, "survey_dimensions")
    flagged = context.trend_flag(column(df, "industry_trend_flag"))
    impact = context.trend_impact_name(column(df, "industry_trend_impact"))
    trend = F.concat(F.lit("行业趋势标记："), F.coalesce(F.nullif(cell(column(df, "industry_trend_reason"), 500), F.lit("")), F.lit("该新闻涉及品牌或平台整体层面的行业趋势。")))
    note = cell(column(df, "survey_indicator_examples"), 800)
    note = F.when(flagged & (note != ""), F.concat(note, F.lit(" | "), trend)).when(flagged, trend).otherwise(note)
    summary = cell(column(df, "summary"), 600)
    headline = F.coalesce(*(F.nullif(cell(column(df, n), 400), F.lit("")) for n in ("title_display_zh", "title", "title_original")), F.lit(""))
    direction = F.when(flagged & (impact == "Positive"), "Up").when(flagged & (impact == "Negative"), "Down").otherwise("Neutral")
    out = {
        "Tracking Week": dates.week_label(day, F.lit(today).cast("date")),
        "Source Country": F.upper(F.trim(F.lit(code))),
        "Platform": cell(column(df, "platform_label"), 180),
        "NPS Dimension": cell(dimensions, 180),
        "News Title / Event": title,
        "News Type (Media / Official / Community)": news_type(df),
        "Source Name": source_name(df),
        "Publish Date": F.when(day.isNotNull(), dates.slash_date(day)).otherwise(F.trim(column(df, "published_at"))),
        "News URL": link,
        "Key User Segment Affected": segment(df, country),
        "Core Summary": text.once(summary, lambda t: F.when(t != "", t).otherwise(headline)),
        "Sentiment (Positive / Neutral / Negative)": context.sentiment_name(column(df, "briefing_sentiment")),
        "Affected Side (Buyer / Seller / Both)": F.lit("Both"),
        "Impact Direction on NPS (Up / Down / Neutral)": direction,
        "Impacted NPS Metric (Price / Trust / Fulfillment / Content / Assortment)": metric(dimensions),
        "Impact Level (High / Medium / Low)": F.lit("Medium"),
        "Short-term or Lagged Effect": F.lit("Immediate"),
        "Quant Linkage Hypothesis": F.concat(F.lit("可能影响"), metric(dimensions), F.lit("相关分项，并传导至总体 NPS。")),
        "Analyst Note": F.coalesce(F.nullif(note, F.lit("")), F.lit("AI生成失败，需人工复核")),
        "Include in Client Readout (Y/N)": F.lit("Y"),
        "Follow-up Needed (Y/N)": F.lit("Y"),
    }
    if answers is not None:
        given = [h for h in ANSWERS if h in answers.columns]
        renamed = answers.select(F.col("article_id").alias("_of"), *(F.col(f"`{h}`").alias(f"_a{list(ANSWERS).index(h)}") for h in given)).dropDuplicates(["_of"])
        df = df.join(renamed, F.col("article_id") == F.col("_of"), "left")
        for h in given:
            said = F.coalesce(F.nullif(cell(F.col(f"_a{list(ANSWERS).index(h)}"), 1200), F.lit("")), out[h])
            if h == "Key User Segment Affected":
                said = checked_segment(df, said, country)
            elif ANSWERS[h]:
                allowed, default = ANSWERS[h]
                fall = F.lit(default) if default else metric(dimensions)
                said = first_match([(F.lower(F.trim(said)) == v.lower(), v) for v in allowed], None)
                said = F.coalesce(said, fall)
            out[h] = said
    out["NPS Overall Change"] = direction_sign(out["Impact Direction on NPS (Up / Down / Neutral)"])
    return df.select("article_id", *(out[h].alias(h) for h in HEADERS))


def write_briefing(table: DataFrame, path: str) -> None:
    """The table as CSV with its header, a byte order mark and quoted cells, for a spreadsheet to open; one folder of files."""
    table.select(*(F.col(f"`{h}`") for h in HEADERS)).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
