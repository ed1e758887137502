"""Text cleaning and features as Column expressions; everything stays inside the JVM."""

from __future__ import annotations

from functools import lru_cache, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it, spelled out so that every regex engine agrees.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NO_BLANK = SPACE[:-1].replace(r"\x{1C}-\x{20}", r"\x{1C}-\x{1F}")
#: White space that is not one plain space already.
RUN = rf"{_NO_BLANK}{SPACE[:-1]}*| {SPACE}"
SEPARATORS = rf"(?:{SPACE})?[|〜~\-–—:：](?:{SPACE})?"
NOT_TITLE = r"[^0-9a-z\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]+"
#: The same for the JVM's engine, which looks single signs below U+0100 up in a table and asks every other part of a class in turn: most
#: signs are told by the table and one range around the rest.
_JVM_SPACE = r"[\x{09}\x{0A}\x{0B}\x{0C}\x{0D}\x{1C}\x{1D}\x{1E}\x{1F}\x{20}\x{85}\x{A0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]+"
_JVM_NOT_TITLE = r"[^0123456789abcdefghijklmnopqrstuvwxyz[\x{3040}-\x{9FFF}&&[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]]]+"
#: A word's edge by ASCII letters, digits and the underscore; regex engines differ on whether other letters are part of a word.
EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
HAN = r"[\x{4E00}-\x{9FFF}]"
KANA = r"[\x{3040}-\x{30FF}]"
#: Words that say nothing about an event.
EVENT_STOP_WORDS = ["news", "report", "update", "media"]


def once(c: Column, f) -> Column:
    """f(c) with c computed once, however often f uses it: inside the function it is a variable."""
    return F.element_at(F.transform(F.array(c), f), 1)


def lower(c: Column) -> Column:
    """A text in lower case as the SQL has it: a capital I with a dot becomes a plain i, which the JVM's makes an i and a dot of its own."""
    return F.lower(F.replace(c, F.lit("İ"), F.lit("i")))


def clean(c: Column) -> Column:
    """White space collapsed to one space and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _JVM_SPACE, " "))


@lru_cache(maxsize=None)
def _collapser(application: str | None):
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("string")
    def collapsed(texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(texts, RUN, " ")

    return collapsed


def clean_long(c: Column) -> Column:
    """``clean`` of texts long enough that the JVM's engine, which looks each sign up in the list of white space, takes most of the
    time; Arrow's passes over a text once and stops only where something changes. Not for use inside functions of array elements."""
    context = SparkContext._active_spark_context
    return F.trim(_collapser(context.applicationId if context else None)(F.coalesce(c, F.lit(""))))


@lru_cache(maxsize=None)
def _keyer(application: str | None):
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("string")
    def keyed(texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(texts, NOT_TITLE, " ")

    return keyed


def title_key_long(c: Column) -> Column:
    """``title_key`` of texts that are long, by Arrow's engine as in ``clean_long``."""
    context = SparkContext._active_spark_context
    return F.trim(_keyer(context.applicationId if context else None)(lower(F.coalesce(c, F.lit("")))))


def first_present_long(*columns: Column) -> Column:
    """``first_present`` of texts that are long."""
    return F.coalesce(*(F.nullif(clean_long(c), F.lit("")) for c in columns), F.lit(""))


def present(c: Column) -> Column:
    """The cleaned text, or null where nothing is left."""
    return once(clean(c), lambda t: F.nullif(t, F.lit("")))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*(present(c) for c in columns), F.lit(""))


def truncate(c: Column, limit: int, ellipsis: bool = False) -> Column:
    if ellipsis:
        return once(clean(c), lambda t: F.when(F.char_length(t) > limit, F.concat(F.left(t, F.lit(limit - 1)), F.lit("…"))).otherwise(t))
    return F.left(clean(c), F.lit(limit))


def title_key(c: Column) -> Column:
    """A title as compared: lower case, only digits, a-z, Han and kana left, each run of separators, signs and white space as one space."""
    return F.trim(F.regexp_replace(lower(F.coalesce(c, F.lit(""))), _JVM_NOT_TITLE, " "))


def without_source(c: Column) -> Column:
    """A title without the name of its source at the end."""
    def cut(t: Column) -> Column:
        return once(F.trim(F.regexp_replace(t, r" (?:-|\||–|—) [^-–—|]{2,80}$", "")), lambda x: F.when(x == "", t).otherwise(x))

    text = once(clean(c), cut)
    text = F.trim(F.regexp_replace(text, r" ?[（(][^（）()]{2,40}[）)] ?$", ""))
    text = F.trim(F.regexp_replace(text, r"(?s) [|｜] .*$", ""))
    text = F.trim(F.regexp_replace(text, r"(?s) [-–—] .*$", ""))
    return F.trim(F.regexp_replace(text, r"(?i) ?(?:-|\||｜) ?(?:Yahoo!?ニュース|雅虎!?消息|Yahoo!? News).*$", ""))


def dedupe_title(c: Column) -> Column:
    """The key of a title without its source, or of the whole title where that leaves nothing."""
    return title_key(once(without_source(c), lambda t: F.when(t == "", c).otherwise(t)))


def title_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(title_key(c), " "), lambda t: F.char_length(t) >= 2))


def event_tokens(c: Column) -> Column:
    return key_event_tokens(title_key(c))


def key_event_tokens(key: Column) -> Column:
    """Event tokens of a text as compared."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: (F.char_length(t) >= 3) & ~t.isin(EVENT_STOP_WORDS)))


#: Kinds of events with the wordings that give them away.
EVENT_PHRASES = {
    "cash_payment": ["cash payment", "cash payments", "pagamenti in contanti", "pagamento in contanti", "paga in contanti", "contanti", "现金支付"],
    "payment_points": ["punti vendita", "punti fisici", "sales points", "physical points", "payment points", "实体点", "销售点", "支付点", "付款点"],
    "promotion_event": ["prime day", "black friday", "cyber monday", "spring sale", "offerte di primavera", "促销", "折扣", "优惠"],
    "investigation_or_penalty": ["investigation", "indagine", "fine", "penalty", "sanzione", "调查", "罚款", "处罚"],
}


def event_phrases(c: Column) -> Column:
    """Kinds of events of which a wording is a substring of the text as compared."""
    return once(title_key(c), key_event_phrases)


def key_event_phrases(key: Column) -> Column:
    return F.array_compact(F.array(*(F.when(any_of([key.contains(p) for p in phrases]), F.lit(name)) for name, phrases in EVENT_PHRASES.items())))


def number_tokens(c: Column) -> Column:
    """Numbers of three digits or more, without their separators; years are none."""
    return clean_number_tokens(clean(c))


def clean_number_tokens(c: Column) -> Column:
    """The numbers of a text that is clean already."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(\d[\d., ]*\d|\d)"), F.lit(1)), lambda x: F.regexp_replace(x, r"[^0-9]", ""))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 3) & ~x.rlike(r"^(?:19|20)\d\d$")))


def ascii_share(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"[^\x{00}-\x{7F}]", "")) / F.char_length(c)


def mostly_ascii(c: Column) -> Column:
    return F.coalesce(ascii_share(F.nullif(clean(c), F.lit(""))) >= 0.85, F.lit(False))


def mostly_chinese(c: Column) -> Column:
    text = F.nullif(clean(c), F.lit(""))
    return F.coalesce((F.char_length(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}]", "")) / F.char_length(text) >= 0.3) & ~contains_kana(text), F.lit(False))


def contains_han(c: Column) -> Column:
    return F.coalesce(c.rlike(HAN), F.lit(False))


def contains_kana(c: Column) -> Column:
    return F.coalesce(c.rlike(KANA), F.lit(False))


def union_text(lists: Column) -> Column:
    """An ordered list of texts as one: cleaned, blanks and repetitions gone, joined by `` | ``."""
    return F.array_join(F.array_distinct(F.filter(F.transform(lists, clean), lambda x: x != "")), " | ")


def brand_list(labels: Column) -> Column:
    """Labels distinct, sorted without regard to case, joined by a comma."""
    tidy = F.array_distinct(F.filter(F.transform(labels, clean), lambda x: x != ""))
    return F.array_join(F.transform(F.array_sort(F.transform(tidy, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda s: s["v"]), ", ")


def split_list(c: Column) -> Column:
    """A delimited text as a list of its distinct parts."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[|,;\n]+"), clean), lambda x: x != ""))


def slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(clean(c)), r"[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("unknown"))


def question_id(c: Column) -> Column:
    return F.translate(clean(c), "（）", "()")


def is_question_id(c: Column) -> Column:
    return question_id(c).rlike(r"^[A-Za-z]\d+(?:[_-]\d+)?(?:\([^)]+\))?$")


def star_key(*columns: Column) -> Column:
    """The id of a starred article: sha1 of its seven trimmed fields."""
    return F.sha1(F.concat_ws("||", *(F.trim(F.coalesce(c, F.lit(""))) for c in columns)).cast("binary"))


def or_block(terms: Column) -> Column:
    """Search terms as ``(a OR "b c")``; terms with a space are quoted."""
    quoted = F.transform(F.array_distinct(F.filter(F.transform(terms, clean), lambda x: x != "")), lambda x: F.when(x.contains(" "), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x))
    return F.when(F.size(quoted) == 1, F.element_at(quoted, 1)).when(F.size(quoted) > 1, F.concat(F.lit("("), F.array_join(quoted, " OR "), F.lit(")"))).otherwise("")


def sentence_cut(c: Column, limit: int = 420) -> Column:
    """A summary of at most ``limit`` characters, ended at its last sentence break if that lies past the half."""

    def cut(t: Column) -> Column:
        head = F.left(t, F.lit(limit))
        ended = F.regexp_extract(head, r"(?s)^(.*[.!?。！？])", 1)
        return F.when(F.char_length(t) <= limit, t).when(F.char_length(ended) > limit // 2, ended).otherwise(F.concat(F.rtrim(head), F.lit("…")))

    return once(clean(c), cut)


def merged(*parts: Column) -> Column:
    """Texts as one: blanks go, and each that an earlier one holds."""
    out = F.lit("")
    for c in parts:
        own = clean(c)
        out = F.when((own == "") | out.contains(own), out).when(out == "", own).otherwise(F.concat(out, F.lit(" "), own))
    return out


def keyword_blocks(c: Column) -> Column:
    """``(a) (b)`` lines as blocks: a line of nothing but parenthesised groups is as many blocks, any other line is one."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), clean), lambda x: x != "")
    group = r"\([^()]*\)"
    return F.flatten(F.transform(lines, lambda x: F.when(F.trim(F.regexp_replace(x, group, "")) == "", F.regexp_extract_all(x, F.lit(f"({group})"), F.lit(1))).otherwise(F.array(x))))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def let(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: a generator of one row keeps the optimizer from copying a costly expression
    into each of its uses."""
    return df.select("*", F.explode(F.array(value)).alias(name))
