"""RSS and Atom feeds: stored documents as a DataFrame, or a folder of them as a data source for batches and streams."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions import dates, text

ATOM = "{http://www.w3.org/2005/Atom}"
FORMAT = "gazette_feeds"
ITEM = "feed_url string, pos long, title string, article_url string, published_at string, summary string, categories array<string>"
_ITEM_NAMES = ["feed_url", "pos", "title", "article_url", "published_at", "summary", "categories"]
_ITEM_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
#: Characters of titles and summaries, and 64 an item, that one batch of items holds; a feed's own text is in memory besides.
BATCH_CHARS = 4 << 20


def items(xml: str | None) -> Iterator[tuple[int, str, str, str, str, list[str]]]:
    """pos, title, link, date, summary and categories of a feed's items, as the parser reads them: the items of an RSS channel, or
    the entries of an Atom feed. XML that is not well formed, or is no feed, has none, however much of it could be read."""
    try:
        root = ET.fromstring(xml or "")
    except (ET.ParseError, ValueError):
        return
    if root.tag.endswith("rss"):
        channel = root.find("channel")
        for pos, x in enumerate(channel.findall("item") if channel is not None else ()):
            found = [x.findtext(name) or "" for name in ("title", "link", "pubDate", "date", "description")]
            yield pos, found[0], " ".join(found[1].split()), found[2] or found[3], found[4], [c.text or "" for c in x.findall("category")]
    else:
        for pos, x in enumerate(root.findall(f"{ATOM}entry")):
            title, published, updated, summary = (x.findtext(f"{ATOM}{name}") or "" for name in ("title", "published", "updated", "summary"))
            link = x.find(f"{ATOM}link")
            yield pos, title, link.get("href") or "" if link is not None else "", published or updated, summary, [c.get("term") or "" for c in x.findall(f"{ATOM}category")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ITEM_TYPES, strict=True)], _ITEM_NAMES)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The items of feeds, gathered to batches of some ``BATCH_CHARS`` of their text: many feeds have an item or two each."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for url, xml in zip(batch.column("feed_url"), batch.column("xml"), strict=True):
            url = url.as_py()
            for item in items(xml.as_py()):
                rows.append((url, *item))
                held += 64 + len(item[1]) + len(item[4])
                if held >= BATCH_CHARS:
                    yield _batch(rows)
                    rows, held = [], 0
    if rows:
        yield _batch(rows)


def feed_items(feeds: DataFrame, start: str, end: str) -> DataFrame:
    """Items of stored RSS and Atom documents (feed_url, xml) within a range of days, each URL once (its first in order of feeds and
    places). Items without a link or a date, and feeds that are no well-formed XML, have none; all references of XML are decoded."""
    raw = feeds.select("feed_url", "xml").mapInArrow(_parsed, ITEM)
    categories = F.filter(F.transform("categories", text.clean), lambda c: c != "")
    rows = raw.select("feed_url", "pos", categories.alias("categories"), text.clean(F.col("title")).alias("title"), "article_url", dates.parse(F.col("published_at")).alias("published_ts"), text.clean(F.col("summary")).alias("summary"))
    rows = rows.where(F.col("published_ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp") + F.expr("interval 1 day") - F.expr("interval 1 second"))).where("article_url <> ''")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("article_url").orderBy("feed_url", "pos"))).where("_n = 1").drop("_n")


def day_of(value: str) -> date | None:
    """The day (in UTC) of an ISO date or time or of the date of a feed; None if it is neither."""
    value = " ".join(value.split())
    try:
        if m := re.fullmatch(r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})", value):
            return date(*map(int, m.groups()))
        when = datetime.fromisoformat(value) if re.match(r"\d{4}-\d\d-\d\d", value) else parsedate_to_datetime(value)
    except (ValueError, TypeError, IndexError):
        return None
    return (when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)).date()


@dataclass
class Files(InputPartition):
    """Some files of a folder, read by one task."""

    names: tuple[str, ...]


def _listed(folder: str) -> list[tuple[int, str, int]]:
    """(time of the last change, name, bytes) of the feeds in a folder, in this order."""
    with os.scandir(folder) as found:
        return sorted((s.st_mtime_ns, x.name, s.st_size) for x in found if x.name.endswith(".xml") and x.is_file() and (s := x.stat()))


def _dealt(files: list[tuple[int, str, int]], limit: int) -> list[Files]:
    """The files as partitions of at most ``limit`` bytes, one file at least."""
    out: list[list[str]] = []
    total = limit
    for _, name, size in files:
        if total + size > limit:
            out.append([])
            total = 0
        out[-1].append(name)
        total += size
    return [Files(tuple(names)) for names in out]


class _Reading:
    """What a batch and a stream read have in common."""

    def __init__(self, options: dict):
        path = options.get("path", "")
        if not path:
            raise ValueError("the data source of feeds needs the path of a folder")
        self.folder = re.sub(r"^file:(//)?", "", path)
        self.limit = int(options.get("partitionBytes", 16 << 20))
        self.low, self.high = date.min, date.max
        self.dated = False

    def rows(self, part: Files) -> Iterator[tuple]:
        for name in part.names:
            try:
                with open(os.path.join(self.folder, name), encoding="utf-8", errors="replace") as f:
                    xml = f.read()
            except FileNotFoundError:
                continue
            for pos, title, link, published, summary, categories in items(xml):
                day = day_of(published)
                # A bound holds for no item without a day.
                if not self.dated or (day is not None and self.low <= day <= self.high):
                    yield name, pos, " ".join(title.split()), link, published, day, " ".join(summary.split()), [c for c in (" ".join(x.split()) for x in categories) if c]


class FeedReader(_Reading, DataSourceReader):
    """A batch read. Bounds on ``published_day`` are applied to an item before anything of it leaves the task."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        one = date.resolution
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("published_day",) or not isinstance(value, date):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, value), min(self.high, value)
            elif isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.low = max(self.low, value + one * isinstance(f, GreaterThan))
            elif isinstance(f, LessThanOrEqual | LessThan):
                self.high = min(self.high, value - one * isinstance(f, LessThan))
            else:
                yield f
                continue
            self.dated = self.dated or self.low > date.min or self.high < date.max

    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.folder), self.limit)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


class FeedStream(_Reading, DataSourceStreamReader):
    """A stream of the files that come into a folder. An offset is the last file's time of change and name: files are to be moved in
    whole, so that a later one never has an earlier time."""

    def initialOffset(self) -> dict:
        return {"time": 0, "name": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.folder)
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((x["time"], x["name"]) for x in (start, end))
        return _dealt([f for f in _listed(self.folder) if low < f[:2] <= high], self.limit)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


class FeedSource(DataSource):
    """``spark.read.format("gazette_feeds").load(folder)``: the items of all ``*.xml`` of a folder that driver and executors share.

    Options: ``path``; ``partitionBytes``, the bytes of files that one task reads. Bounds on ``published_day`` go into
    the read. An empty folder has no item; a file that has gone since it was listed has none either.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "feed_url string, pos long, title string, article_url string, published_at string, published_day date, summary string, categories array<string>"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters be pushed into it, which its reader asks for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
