"""Survey matching: dimensions, question ids, decisions of a scorer with fallbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, context, terms, text


def dimensions(c: Column, lookup: dict[str, list[str]], focus: Column | None = None, low: Column | None = None) -> Column:
    """Dimensions of a text: the inferred one, the one searched for, then all with a matching keyword; each once."""
    known = F.array(*map(F.lit, lookup))
    inferred = F.filter(F.array(classify.nps_dimension(c, low)), lambda d: F.array_contains(known, d))
    parts = [inferred] + ([F.filter(F.array(focus), lambda d: F.array_contains(known, d))] if focus is not None else []) + [terms.labels(c, lookup)]
    return F.array_distinct(F.concat(*parts))


def keyword_filter(rows: DataFrame, c: Column, lookup: dict[str, list[str]], questions: dict[str, list[str]]) -> DataFrame:
    """Keeps rows with a dimension and a question id of one of their dimensions. No indicators at all keep everything."""
    columns = rows.columns
    rows = text.let(text.let(rows, "_hay", c), "_low", text.lower(F.coalesce("_hay", F.lit(""))))
    c = F.col("_hay")
    out = text.let(rows, "dimensions", dimensions(c, lookup, low=F.col("_low")))
    ids = F.create_map(*(x for d, q in questions.items() for x in (F.lit(d), F.array(*map(F.lit, q))))) if questions else None
    if ids is None:
        return out.select(*columns, "dimensions", F.array().cast("array<string>").alias("question_ids"))
    allowed = F.flatten(F.transform("dimensions", lambda d: F.coalesce(F.try_element_at(ids, d), F.array().cast("array<string>"))))
    found = text.let(out.where("size(dimensions) > 0"), "question_ids", classify.question_ids(c, allowed, F.col("_low")))
    return found.where("size(question_ids) > 0").select(*columns, "dimensions", "question_ids")


def dimension_histogram(kept: DataFrame) -> DataFrame:
    return kept.select(F.explode("dimensions").alias("dimension")).groupBy("dimension").agg(F.count("*").alias("n"))


def normalise_ids(rows: DataFrame, ids: str, indicators: DataFrame) -> DataFrame:
    """Answers' question ids as the questionnaire writes them: case does not matter, unknown ones go, order stays."""
    lookup = indicators.groupBy(F.lower("question_id").alias("_k")).agg(F.max_by("question_id", "pos").alias("_q"))
    long = rows.select("pos", F.posexplode(ids).alias("_i", "_v")).withColumn("_k", F.lower("_v")).join(F.broadcast(lookup), "_k")
    tidy = long.groupBy("pos").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"])).alias("_ids"))
    return rows.join(tidy, "pos", "left").withColumn(ids, F.coalesce("_ids", F.array().cast("array<string>"))).drop("_ids")


def matched_dimensions(answers: DataFrame, column: str, indicators: DataFrame) -> DataFrame:
    """Answers' dimensions as the questionnaire writes them: equal in any case, else the first one that holds or is held by it."""
    known = indicators.groupBy("dimension").agg(F.min("pos").alias("p")).select(F.col("dimension").alias("_d"), F.lower(text.clean(F.col("dimension"))).alias("_k"), "p")
    long = answers.select("pos", F.posexplode(column).alias("_i", "_v")).withColumn("_w", F.lower(text.clean(F.col("_v")))).where("_w <> ''")
    # The questionnaire's dimensions are a few rows.
    hits = long.join(F.broadcast(known), F.col("_w").contains(F.col("_k")) | F.col("_k").contains(F.col("_w")))
    best = hits.groupBy("pos", "_i").agg(F.min_by("_d", F.struct(F.col("_w") != F.col("_k"), "p")).alias("_d"))
    tidy = best.groupBy("pos").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_d"))), lambda s: s["_d"])).alias("_ds"))
    return answers.join(tidy, "pos", "left").withColumn(column, F.coalesce("_ds", F.array().cast("array<string>"))).drop("_ds")


#: What each dimension's news may do to a user.
TEMPLATES = {
    "Price": "新闻涉及价格、折扣、优惠券、积分或促销变化，可能直接影响用户对平台价格竞争力的感受。",
    "Logistics": "新闻涉及配送、物流或履约体验变化，可能直接影响用户对平台收货效率和服务稳定性的感受。",
    "Post-purchase service": "新闻涉及退换货、退款、客服或售后流程变化，可能直接影响用户对平台售后体验的感受。",
    "Content": "新闻涉及平台内容展示、直播、短视频或导购体验变化，可能直接影响用户对平台内容吸引力和种草效率的感受。",
    "Seller quality": "新闻涉及商家治理、卖家质量或平台信任机制，可能直接影响用户对平台商家可靠性的感受。",
    "Product quality": "新闻涉及正品、质量、安全或商品可靠性，可能直接影响用户对平台商品质量的感受。",
    "Product variety": "新闻涉及品牌、品类或商品丰富度变化，可能直接影响用户对平台可选商品范围的感受。",
    "Product feature": "新闻涉及搜索、支付、下单、推荐或平台功能流程变化，可能直接影响用户对平台使用便利性的感受。",
}
#: Reasons by dimensions, question ids or beginnings of ids, in order; the last one needs a title.
REASONS = [
    (["Quality", "Customer / post-purchase service"], ["B1_2", "B1_3", "B1_4", "B7_5"], "", "新闻涉及平台商品合规、卖家合法性或消费者权益保障，可能影响消费者对平台可信度和售后保障的评价。"),
    (["Price"], [], "B3_", "新闻涉及平台价格、折扣或促销机制，可能影响消费者对价格竞争力和优惠吸引力的评价。"),
    (["Features"], [], "B5_", "新闻涉及平台功能、支付方式、会员权益或使用流程，可能影响消费者对平台便利性和功能吸引力的评价。"),
    (["Variety"], [], "B2_", "新闻涉及平台商品品类或供给范围变化，可能影响消费者对商品丰富度和选择空间的评价。"),
    (["Logistics"], [], "B6_", "新闻涉及配送、履约或收货体验，可能影响消费者对平台物流效率和稳定性的评价。"),
    (["Content"], [], "", "新闻涉及平台内容展示、导购或互动体验，可能影响消费者对平台内容吸引力的评价。"),
]
PLAIN_REASON = "新闻内容与命中的问卷指标相关，可能影响消费者对平台体验和整体评价的判断。"
FILL_REASON = "低量补充复评：该新闻具有平台体验或NPS相关信号，用于补足品牌周度新闻量。"


def _begins(prefix: str):
    return lambda q: q.startswith(prefix)


def fallback_reason(dims: Column, ids: Column, title: Column) -> Column:
    cases = []
    for names, own, prefix, wording in REASONS:
        hit = F.arrays_overlap(dims, F.array(*map(F.lit, names)))
        if own:
            hit = hit | F.arrays_overlap(ids, F.array(*map(F.lit, own)))
        if prefix:
            hit = hit | F.exists(ids, _begins(prefix))
        cases.append((hit, wording))
    return classify.first_match([*cases, (text.clean(title) != "", PLAIN_REASON)], "")


def enrich(rows: DataFrame, indicators: DataFrame, method: str, reason: Column | None = None, confidence: Column | None = None, fill: bool = False) -> DataFrame:
    """What a match says of its article: rows (dimensions, question_ids, title) get survey_relevant, survey_dimensions,
    survey_question_ids, survey_indicator_count, survey_ai_reason, survey_indicator_examples, survey_filter_method,
    survey_filter_confidence and volume_fill. indicators: pos, dimension, question_id, prompt_en, prompt_zh.

    Examples are at most three questions, the reason, then dimensions' templates, four in all.
    """
    said = text.clean(reason) if reason is not None else F.lit("")
    prompt = F.coalesce(F.nullif(text.clean(F.col("prompt_zh")), F.lit("")), F.nullif(text.clean(F.col("prompt_en")), F.lit("")))
    known = indicators.groupBy(F.lower(text.question_id(F.col("question_id"))).alias("k")).agg(F.max_by(F.struct("question_id", "dimension", prompt.alias("prompt")), "pos").alias("v"))
    # The questionnaire is a sheet that a person wrote; as one map it goes along with every row.
    book = F.broadcast(known.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_book")))
    out = rows.join(book, F.lit(True))

    def look(q: Column) -> Column:
        return F.try_element_at("_book", F.lower(text.question_id(q)))

    dims = F.array_distinct(F.filter(F.transform("dimensions", text.clean), lambda x: x != ""))
    ids = F.array_distinct(F.filter(F.transform("question_ids", lambda q: F.coalesce(look(q)["question_id"], text.question_id(q))), lambda x: x != ""))
    out = text.let(text.let(out, "_ids", ids), "_dims", F.when((F.size(dims) == 0) & (F.size("_ids") > 0), F.array_distinct(F.filter(F.transform("_ids", lambda q: look(q)["dimension"]), lambda d: d.isNotNull()))).otherwise(dims))
    wording = F.when(said != "", said).otherwise(fallback_reason(F.col("_dims"), F.col("_ids"), F.col("title"))) if method.startswith("ai") else said
    out = text.let(out, "_why", wording)
    asked = F.slice(F.array_distinct(F.filter(F.transform("_ids", lambda q: F.concat(look(q)["question_id"], F.lit(": "), look(q)["prompt"])), lambda x: x.isNotNull())), 1, 3)
    book_of = F.create_map(*(x for k, v in TEMPLATES.items() for x in (F.lit(k), F.lit(v))))
    made = F.filter(F.transform("_dims", lambda d: F.try_element_at(book_of, d)), lambda x: x.isNotNull())
    own = F.array_distinct(F.concat(asked, F.filter(F.array("_why"), lambda x: x != "")))
    examples = F.slice(F.array_distinct(F.concat(own, made)), 1, 4)
    count = F.when(F.size("_ids") > 0, F.size("_ids")).otherwise(F.size("_dims"))
    new = {
        "survey_relevant": F.lit("yes"), "survey_dimensions": F.array_join("_dims", " | "), "survey_question_ids": F.array_join("_ids", " | "), "survey_indicator_count": count,
        "survey_ai_reason": F.col("_why") if method.startswith("ai") else F.lit(""), "survey_indicator_examples": F.array_join(examples, " | "), "survey_filter_method": F.lit(method),
        "survey_filter_confidence": context.confidence_name(confidence) if confidence is not None else F.lit("high"), "volume_fill": F.lit("true" if fill else ""),
    }
    return out.select(*(c for c in rows.columns if c not in new), *(v.alias(k) for k, v in new.items()))


def scored_filter(rows: DataFrame, decisions: DataFrame, hard: Column, direct: Column, fallback: Column) -> DataFrame:
    """Rows with method and kept: direct ones stay, hard-filtered ones go, decided ones as decided; a missing decision falls
    back to the keyword rule. Direct rows stay even where nothing is left to be scored.
    """
    out = rows.join(decisions.select("pos", "relevant"), "pos", "left")
    method = classify.first_match([(direct, "direct"), (hard, "hard_filter"), (F.col("relevant").isNotNull(), "scored")], "keyword_fallback")
    kept = classify.first_match([(direct, True), (hard, False), (F.col("relevant").isNotNull(), F.col("relevant"))], False)
    return out.withColumn("method", method).withColumn("kept", F.when(F.col("method") == "keyword_fallback", fallback).otherwise(kept)).drop("relevant")


def score_in_batches(rows: DataFrame, scorer: Callable[[list[dict]], dict[int, dict]], schema: str, size: int = 8) -> DataFrame:
    """Calls a scorer on batches of rows (pos and text) in the executors; a failing batch has no decisions.

    scorer: list of {"pos", "text"} -> {pos: values}. schema: ``pos long`` and the values' columns.
    """
    names = [f.split()[0] for f in schema.split(",")][1:]

    def run(frames):
        import pandas as pd

        for frame in frames:
            found = []
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size].to_dict("records")
                try:
                    answer = scorer(part)
                except Exception:  # noqa: BLE001  a scorer is foreign code; its batch falls back
                    continue
                found += [(pos, *(values.get(n) for n in names)) for pos, values in answer.items()]
            yield pd.DataFrame(found, columns=["pos", *names])

    return rows.select("pos", "text").mapInPandas(run, schema)
