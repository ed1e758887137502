"""Date functions: lenient parsing, windows and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean


def parse(c: Column) -> Column:
    """A timestamp from ISO text with or without an offset, or from the date of a feed; null if it is neither."""
    text = clean(c)
    feed = F.regexp_replace(text, r"^[A-Za-z]{3},? ", "")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(feed, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.translate(text, "./", "--"), F.lit("yyyy-M-d")))


def day_key(c: Column) -> Column:
    return F.left(clean(c), F.lit(10))


def close_days(a: Column, b: Column, days: int = 14) -> Column:
    """Whether two date texts are equal, or at most ``days`` apart."""
    gap = F.abs(F.datediff(F.try_to_date(F.left(a, F.lit(10))), F.try_to_date(F.left(b, F.lit(10)))))
    return (a != "") & (b != "") & ((a == b) | F.coalesce(gap <= days, F.lit(False)))


def week_start(day: Column) -> Column:
    """The Monday of a date's week."""
    return F.date_trunc("week", day).cast("date")


def week_label(day: Column, today: Column) -> Column:
    """ISO year and week; a missing date is today's, which the caller gives."""
    d = F.coalesce(day, today)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit(" W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def slash_date(day: Column) -> Column:
    return F.concat_ws("/", F.month(day), F.dayofmonth(day), F.year(day))


def in_range(ts: Column, start: Column, end: Column) -> Column:
    """Inclusive; a missing timestamp is outside."""
    return F.coalesce(ts.between(start, end), F.lit(False))


def window_days(start: Column, end: Column) -> Column:
    """Days of a range, begun ones whole."""
    return F.greatest(F.lit(1), F.ceil((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400)).cast("int")


def seconds_label(s: Column) -> Column:
    t = F.greatest(F.lit(0), s.cast("long"))
    return F.format_string("%02d:%02d:%02d", F.floor(t / 3600).cast("long"), F.floor(F.pmod(t, F.lit(3600)) / 60).cast("long"), F.pmod(t, F.lit(60)))
