"""Source divergence audit: how far the word frequencies of each source lie from every other source of its language.

Terms of a language are its words in at least ``MIN_DOCS`` of its documents. With N a group's occurrences of kept terms and V their
number, a term's scaled frequency is p = 1 + floor(SCALE * (count + 2) / (N + 2 V)); two groups differ in a term by
floor((p - q)^2 / (p + q)), and by the sum over all kept terms. All arithmetic is on integers.

Counts are taken a chunk of texts at a time and summed before anything is shuffled by term. For the pairs, a language's groups fall
into blocks and its terms into chunks of vocabulary. Each group's counts, packed by chunk, go to every tile of its block (block by
block, the upper triangle); a tile adds up its matrix of pairs over one chunk after the other, so it holds two blocks of one chunk
at a time, whatever the vocabulary. A term that no group of the tile has differs by the same number each time and is added by
multiplication.

Cases: null texts, languages and sources are empty ones. A group without kept terms is compared like any other; where a language
has no kept term, all differences are 0 and no term is listed. A source alone in its language has no pair. Repeated rows count
each, ids are not read. Very long texts are read whole. Ties go to the smaller item in UTF-8. Other columns are not read. An empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import table

MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Groups of a block and kept terms of a chunk of vocabulary, about: both are dealt by hash.
BLOCK, CHUNK = 32, 16_384

#: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` on lower-cased bytes: a-z and all beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), summed over each chunk of texts; a group's own row has no term."""
    for batch in batches:
        for part in K.chunks(batch):
            langs, sources = (part.column(i).dictionary_encode() for i in (0, 1))
            lang, source = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (langs, sources))
            group, of = np.unique(lang * len(sources.dictionary) + source, return_inverse=True)
            data, offsets = K.column_bytes(part.column(2))
            data = K.LOWER[data]
            starts, ends, first = K.word_spans(data, offsets, LETTERS)
            at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[LETTERS[data]]))]).dictionary_encode()
            terms, width = words.dictionary, max(1, len(words.dictionary))
            term = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), np.diff(first))
            pair, n = np.unique(row * width + term, return_counts=True)
            key, where = np.unique(of[pair // width] * width + pair % width, return_inverse=True)
            total = np.bincount(where, weights=n, minlength=len(key)).astype(np.int64)
            docs = np.bincount(where, minlength=len(key))
            own = np.concatenate([group[key // width], group])
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(own // len(sources.dictionary))),
                    sources.dictionary.take(pa.array(own % len(sources.dictionary))),
                    terms.take(pa.array(np.concatenate([key % width, np.zeros(len(group), np.int64)]), mask=np.arange(len(own)) >= len(key))).cast(pa.large_string()).cast(pa.string()),
                    pa.array(np.concatenate([total, np.zeros(len(group), np.int64)])),
                    pa.array(np.concatenate([docs, np.zeros(len(group), np.int64)]).astype(np.int64)),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it; one row without a term for each group."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))))
    found = plain.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(n: Column, total: Column, kept: Column) -> Column:
    """p of a count, exact for any long."""
    whole = "decimal(20,0)"
    return (F.lit(1) + F.call_function("div", (n + 2).cast(whole) * F.lit(SCALE).cast("decimal(10,0)"), (total + 2 * kept).cast(whole))).cast("long")


def _scaled(n: np.ndarray, under: np.ndarray) -> np.ndarray:
    """p of counts by rows of one denominator each: long division, three digits of a thousand each."""
    whole, rest = np.divmod(n + 2, under)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, under)
        whole = whole * 1000 + digit
    return whole + 1


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Tile:
    """The groups of two blocks (or of one) and the sums of their pairs so far."""

    def __init__(self, key: tuple):
        self.key = key
        self.names: list[str] = []
        self.block: list[int] = []
        self.under: list[int] = []
        self.at: dict[str, int] = {}
        self.kept, self.seen = 0, 0
        self.sums = np.zeros((0, 0), dtype=np.int64)

    def group(self, name: str, block: int, total: int, kept: int) -> None:
        self.at[name] = len(self.names)
        self.names.append(name)
        self.block.append(block)
        self.under.append(total + 2 * kept)
        self.kept = kept

    def close(self) -> None:
        """All groups are known: order them by block."""
        order = sorted(range(len(self.names)), key=lambda k: (self.block[k], self.names[k]))
        self.names, self.block, self.under = ([x[k] for k in order] for x in (self.names, self.block, self.under))
        self.at = {name: k for k, name in enumerate(self.names)}
        self.sums = np.zeros((len(order), len(order)), dtype=np.int64)

    def add(self, rows: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
        """One chunk of vocabulary: (source, places of its terms, counts)."""
        places = np.unique(np.concatenate([r[1] for r in rows]))
        n = np.zeros((len(self.names), len(places)), dtype=np.int64)
        for name, place, count in rows:
            n[self.at[name], np.searchsorted(places, place)] = count
        self.seen += len(places)
        self._sum(_scaled(n, np.array(self.under)[:, None]), 1)

    def _sum(self, p: np.ndarray, times: int) -> None:
        _, i, j = self.key
        split = int(np.searchsorted(self.block, i, side="right"))
        for a in range(split):
            low = a + 1 if i == j else split
            self.sums[a, low:] += times * _differ(p[a], p[low:]).sum(axis=1)

    def rows(self) -> Iterator[pa.RecordBatch]:
        lang, i, j = self.key
        if self.kept > self.seen:
            self._sum(_scaled(np.zeros((len(self.names), 1), dtype=np.int64), np.array(self.under)[:, None]), self.kept - self.seen)
        split = int(np.searchsorted(self.block, i, side="right"))
        for a in range(split):
            others = range(a + 1 if i == j else split, len(self.names))
            value = pa.array(self.sums[a, list(others)])
            one, many = pa.array([self.names[a]] * len(others), pa.string()), pa.array([self.names[b] for b in others], pa.string())
            for x, y in ((one, many), (many, one)):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(others), pa.string()), x, y, value], ["lang", "source", "item", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, i, j, chunk, source, block, total, kept, place, count) in the order of their first four to pairs; chunk -1 names the groups."""
    tile, chunk, held = None, -1, []
    for batch in batches:
        head = [batch.column(k).to_pylist() for k in range(8)]
        for k, (lang, i, j, own, source, block, total, kept) in enumerate(zip(*head, strict=True)):
            if tile is None or tile.key != (lang, i, j) or own != chunk:
                if tile is not None and chunk == -1:
                    tile.close()
                if held:
                    tile.add(held)
                held, chunk = [], own
            if tile is None or tile.key != (lang, i, j):
                if tile is not None:
                    yield from tile.rows()
                tile = _Tile((lang, i, j))
            if own == -1:
                tile.group(source, block, total, kept)
            else:
                held.append((source, batch.column(8)[k].values.to_numpy(zero_copy_only=False), batch.column(9)[k].values.to_numpy(zero_copy_only=False)))
    if tile is not None:
        if chunk == -1:
            tile.close()
        if held:
            tile.add(held)
        yield from tile.rows()


def _pieces(number: int, size: int) -> int:
    return max(1, -(-number // size))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` ranks the other sources of a language by their distance, ``term`` the
    terms by which a source lies above its language, ``TOP`` at most."""
    counted = table(counts(docs, lang, source, text), "counts")
    groups = counted.where("term is null").select("lang", "source")
    terms = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= MIN_DOCS)
    terms = table(terms.select("lang", "term", "lang_n"), "terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    most_terms = langs.agg(F.max("kept")).first()[0] or 0
    most_groups = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks, chunks = _pieces(most_groups, BLOCK), _pieces(most_terms, CHUNK)

    placed = terms.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int"))
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    kept = table(counted.where("term is not null").drop("docs").join(placed, ["lang", "term"]), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sums = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    sums = table(sums, "sums")

    packed = kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("own"))
    packed = packed.select("lang", "source", "chunk", F.col("own.place").alias("place"), F.col("own.n").alias("n"))
    named = sums.select("lang", "source", F.lit(-1).alias("chunk"), F.array().cast("array<int>").alias("place"), F.array().cast("array<bigint>").alias("n"))
    rows = named.unionByName(packed).join(sums, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = dealt.select("lang", "i", "j", "chunk", "source", "block", "total", "kept", "place", "n").repartition("lang", "i", "j").sortWithinPartitions("lang", "i", "j", "chunk")
    pairs = dealt.mapInArrow(_tiles, "lang string, source string, item string, value long")

    both = kept.join(sums, ["lang", "source"])
    p, q = scaled(F.col("n"), F.col("total"), F.col("kept")), scaled(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    above = both.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    above = above.select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(found: DataFrame, part: str) -> DataFrame:
        return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= TOP))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: all of ``documents`` by language and source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), t AS (SELECT lang, source, row, unnest(words) AS term FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), s AS (SELECT lang, source, sum(n) AS n FROM m GROUP BY ALL
), p AS (
  SELECT m.lang, m.source, m.term, m.n,
         1 + 1000000000::HUGEINT * (m.n + 2) // (s.n + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (m.lang_n + 2) // (l.n + 2 * l.v) AS q
  FROM m JOIN s USING (lang, source) JOIN l USING (lang)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
