"""Line deduplication with a log-template tree.

Each line is parsed to a fixed depth: its token count, then its ``LEADING`` first tokens, in which tokens with a digit or of an
address or path are variable fields already. That is its leaf. Within a leaf, lines that agree with one of the leaf's seeds in all
but one in ``VARYING`` of their positions, and all but ``WILDCARDS``, are one template; the positions in which they vary become
wildcards, whatever stands there: of a paragraph, few words. ``tree`` says from and to which token count lines have a leaf; the query
gives one to every line that counts.
Lines that agree with no seed are templates of their own. The seeds of a turn are the lines of the smallest fingerprint in each of
``SEEDS`` slots (twice as many in the next turn, up to ``MOST_SEEDS``); what joined none takes part in the next turn, until nothing is
left: however many templates a leaf has, all are learnt. Two lines that agree have one block of positions in common, of one more blocks
than positions may vary,
so lines that share no block with another one leave before each turn. A seed is one row, so a leaf that holds a third of all lines is
a skewed join, which Spark splits, and never gathered.

Passages recur inside lines, too, so lines are cut into pieces, at the ends of about one sentence in ``STOPS`` and, in sentences of
more than ``ANCHORED`` words, behind one word in ``ANCHOR``, both chosen by the fingerprint of the word before the cut: the same words
in any surroundings give the same cuts. A piece of fewer than ``full_words`` words joins its neighbours: runs are the shortest ones of
that many words from each piece on, and up to each short piece that ends a line. Runs are templates without a tree. What is left of a
passage that begins or ends inside a line are the words up to its first cut and behind its last one.

A template that recurs across documents is kept in the document of the smallest id that holds it, and dropped from all others,
however much of them it is. Exact and near copies (five-word shingles, Jaccard similarity 0.8, by the n-gram join) are one document
here: what only they share stays, and what any other document has first goes from all of them alike. So they are still copies
afterwards, for the near-duplicate operator to decide about. All documents are compared as copies, whatever their share of recurring
lines.

Lines of fewer than ``full_words`` words go where ``many_docs`` documents hold them, those of fewer than ``min_words`` only within
runs: at full size any line of one or two words recurs somewhere, and is no boilerplate for that.

Cases: null and empty texts have no line and come back unchanged, as do all texts that lose nothing. Rows that share an id are one
document: repeated rows count once and lose nothing to each other. Rows without an id lose nothing. Very long texts are parsed
whole, one at a time. Ties between holders go to the smallest id. An empty table gives none. Other columns stay, whatever their
names, but for older ones of the two added names. Templates are 64-bit fingerprints.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .ngram_join import jaccard_components
from .shared import components, drop, fresh, table

MIN_WORDS, FULL_WORDS, MANY_DOCS = 3, 8, 5
#: Bytes of text that are parsed at once; the parse takes about thirty times that.
CHUNK = K.ROW_BYTES
#: Leading tokens of a leaf; one in how many positions may vary, and how many at most; seeds of the first turn and of one at most.
LEADING, VARYING, WILDCARDS, SEEDS, MOST_SEEDS = 3, 4, 8, 8, 32
#: Tokens from and to which a line has a leaf, where the caller doesn't say; and those of every line.
TREE, EVERY_LINE = (8, 32), (0, None)
#: One in how many sentences ends a piece; words beyond which a sentence is cut at anchors, and one in how many words is one.
STOPS, ANCHORED, ANCHOR = 2, 16, 8
#: A run of which more than 1 / VARIABLE_PART is variable (a row of numbers) is compared as it is.
VARIABLE_PART = 4
#: Lines and runs that a worker gathers before it deals them out to blocks, those that one block should hold, and bytes of text that
#: have about one of them (results depend on none of these).
DEAL, BLOCK_UNITS, UNIT_BYTES = 500_000, 250_000, 48
#: Rows of 16 bytes that may be broadcast (checked before); beyond it the join shuffles.
BROADCAST_ROWS = 500_000

_VARIABLE = np.zeros(256, dtype=np.int8)
_VARIABLE[0x30:0x3A] = 1
_VARIABLE[[ord(c) for c in "@/_="]] = 1
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True
_FIELD = K.U64(0x5EED)
_UNITS = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("short", pa.bool_()), ("leaf", pa.int64()), ("tokens", pa.binary())])
_DEALT = pa.schema([*_UNITS, ("block", pa.int32()), ("payload", pa.binary())])


def _runs(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """Fingerprints of runs of words [start, end)."""
    up, down = K._powers(max(K._SEGMENT, len(hashes)))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, K.U64), np.cumsum(hashes * up[: len(hashes)], dtype=K.U64)])
        return K.mix((total[end] - total[start]) * down[start] + (end - start).astype(K.U64) * K.U64(2 * salt + 1))


def _varying(size: int) -> int:
    """In how many positions two lines of one template may differ."""
    return min(size // VARYING, WILDCARDS)


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1]]) if len(ends) else ends


class Parsed:
    """The lines of a chunk of texts, their pieces, and runs of these, as ranges of words with their fingerprints."""

    def __init__(self, batch: pa.RecordBatch, column: str = "text", min_words: int = MIN_WORDS, full_words: int = FULL_WORDS, tree: tuple[int, int | None] = TREE):
        self.min_words, self.full_words = min_words, full_words
        self.data, self.offsets = K.column_bytes(batch.column(batch.schema.get_field_index(column)))
        low = K.LOWER[self.data]
        self.starts, self.ends, self.first = K.word_spans(low, self.offsets, K.SPACE_SEPARATED)
        plain = K.word_hashes(low, self.starts, self.ends)
        marks = np.concatenate([np.zeros(1, np.int32), np.cumsum(_VARIABLE[low], dtype=np.int32)])
        variable = marks[self.ends] > marks[self.starts]
        self.tokens = hashes = np.where(variable, _FIELD, plain)
        fields = np.concatenate([[0], np.cumsum(variable)])
        n = len(hashes)

        breaks = np.concatenate([np.zeros(1, np.int32), np.cumsum(low == 0x0A, dtype=np.int32)])
        row = np.repeat(np.arange(batch.num_rows), np.diff(self.first))
        last = np.ones(n, dtype=bool)
        if n:
            last[:-1] = (row[1:] != row[:-1]) | (breaks[self.starts[1:]] != breaks[self.starts[:-1]])
        stop = last | _STOP[low[self.ends - 1]] if n else last
        sentence = np.flatnonzero(stop) + 1
        size = sentence - _starts(sentence)
        chosen = plain >> K.U64(20)
        anchor = (chosen % K.U64(ANCHOR) == 0) & np.repeat(size > ANCHORED, size) if n else stop
        stop = last | (stop & (chosen % K.U64(STOPS) == 0)) | anchor

        self.line_end = np.flatnonzero(last) + 1
        self.line_start = _starts(self.line_end)
        self.piece_end = np.flatnonzero(stop) + 1
        self.piece_start = _starts(self.piece_end)
        self.line_row, self.piece_row = row[self.line_start], row[self.piece_start]
        self.piece_line = np.searchsorted(self.line_end, self.piece_start, side="right")
        # The shortest runs of enough words from each piece on, and up to each piece that ends a line and is too short for itself.
        pieces = np.arange(len(self.piece_end))
        after = np.searchsorted(self.piece_end, self.piece_start + full_words, side="left")
        short = np.flatnonzero((self.piece_end - self.piece_start < full_words) & (last[self.piece_end - 1] if n else False))
        before = np.searchsorted(self.piece_start, self.piece_end[short] - full_words, side="right") - 1
        a, b = np.concatenate([pieces, before]), np.concatenate([after, short])
        inside = (a >= 0) & (b < len(pieces))
        a, b = a[inside], b[inside]
        inside = self.piece_row[a] == self.piece_row[b]
        order = np.argsort(a[inside], kind="stable")
        self.run_first, self.run_last = a[inside][order], b[inside][order]
        self.run_row = self.piece_row[self.run_first]

        def prints(start, end):
            """Fingerprints of runs of words; where too much is variable, nothing is masked."""
            if not n:
                return np.zeros(0, np.int64), np.zeros(0, bool)
            mostly = (fields[end] - fields[start]) * VARIABLE_PART > end - start
            return np.where(mostly, _runs(plain, start, end, 1), _runs(hashes, start, end, 1)).view(np.int64), mostly

        self.line_key, mostly = prints(self.line_start, self.line_end)
        self.run_key, _ = prints(self.piece_start[self.run_first], self.piece_end[self.run_last])
        size = self.line_end - self.line_start
        self.has_leaf = (size >= max(tree[0], min_words)) & (size <= (size if tree[1] is None else tree[1])) & ~mostly
        lead = _runs(hashes, self.line_start, np.minimum(self.line_start + LEADING, self.line_end), 7) if n else np.zeros(0, K.U64)
        with np.errstate(over="ignore"):
            self.leaf = K.mix(lead + size.astype(K.U64)).view(np.int64)

    def units(self, doc: pa.Array) -> pa.RecordBatch:
        """Lines and runs of every row, each fingerprint once a row."""
        size = self.line_end - self.line_start
        keep = np.flatnonzero(size >= self.min_words)
        row = np.concatenate([self.line_row[keep], self.run_row])
        key = np.concatenate([self.line_key[keep], self.run_key])
        line = np.concatenate([keep, np.full(len(self.run_row), -1)])
        short = np.concatenate([size[keep] < self.full_words, np.zeros(len(self.run_row), bool)])
        order = np.lexsort((-line, key, row))
        row, key, line, short = row[order], key[order], line[order], short[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        row, key, line, short = row[at], key[at], line[at], short[at]
        leafy = (line >= 0) & self.has_leaf[line] if len(self.has_leaf) else np.zeros(len(line), bool)
        bounds = np.concatenate([self.line_start, self.line_end[-1:]]).astype(np.int32) * 2
        values = pa.Array.from_buffers(pa.binary(), max(0, len(bounds) - 1), [None, pa.py_buffer(bounds), pa.py_buffer((self.tokens >> K.U64(48)).astype(np.uint16))])
        chosen = pa.array(np.where(leafy, line, 0), mask=~leafy)
        return pa.RecordBatch.from_arrays([doc.take(pa.array(row)), pa.array(key), pa.array(short), pa.array(self.leaf).take(chosen), values.take(chosen)], schema=_UNITS)

    def without(self, dropped: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(texts, lines and pieces dropped, words dropped) of the rows without the lines and runs that ``dropped`` has for each."""
        rows, (lines, pieces) = len(dropped), (len(self.line_end), len(self.piece_end))
        mark = K.mix(np.arange(1, rows + 1, dtype=K.U64))
        values = dropped.flatten().to_numpy().view(K.U64) ^ np.repeat(mark, np.diff(dropped.offsets.to_numpy()))
        size = self.line_end - self.line_start
        out = np.isin(self.line_key.view(K.U64) ^ mark[self.line_row], values) & (size >= self.min_words)
        met = np.isin(self.run_key.view(K.U64) ^ mark[self.run_row], values)
        edge = np.bincount(self.run_first[met], minlength=pieces + 1) - np.bincount(self.run_last[met] + 1, minlength=pieces + 1)
        covered = np.cumsum(edge[:pieces]) > 0
        # A line of which all pieces are in such runs goes as a line.
        out |= np.bincount(self.piece_line[~covered], minlength=lines) == 0
        part = covered & ~out[self.piece_line]
        words = np.bincount(self.line_row[out], size[out], rows) + np.bincount(self.piece_row[part], (self.piece_end - self.piece_start)[part], rows)
        number = np.bincount(self.line_row[out], minlength=rows) + np.bincount(self.piece_row[part], minlength=rows)

        # Lines from their first byte to their line feed; a text's last one takes the feed before it.
        low, high = self.offsets[self.line_row[out]], self.offsets[self.line_row[out] + 1]
        feeds = np.concatenate([[-1], np.flatnonzero(self.data == 0x0A), [len(self.data)]])
        at = np.searchsorted(feeds, self.starts[self.line_start[out]])
        first, inner = np.maximum(feeds[at - 1] + 1, low), feeds[at - 1] >= low
        end = np.minimum(feeds[np.searchsorted(feeds, self.ends[self.line_end[out] - 1])] + 1, high)
        first -= (end == high) & inner & (self.data[np.maximum(high, 1) - 1] != 0x0A)
        # Pieces up to the next one of their line, the last one from the piece before it on.
        k = np.flatnonzero(part)
        s, e = self.starts[self.piece_start[k]], self.ends[self.piece_end[k] - 1]
        same = np.zeros(pieces + 1, dtype=bool)
        same[1:pieces] = self.piece_line[1:] == self.piece_line[:-1]
        after, before = same[k + 1], same[k] & ~same[k + 1]
        e[after] = self.starts[self.piece_start[k[after] + 1]]
        s[before] = self.ends[self.piece_end[k[before] - 1] - 1]
        edge = np.bincount(np.concatenate([first, s]), minlength=len(self.data) + 1) - np.bincount(np.concatenate([end, e]), minlength=len(self.data) + 1)
        kept = np.cumsum(edge[:-1]) == 0
        offsets = np.concatenate([[0], np.cumsum(kept)])[self.offsets]
        texts = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(self.data[kept])])
        return texts, number, words.astype(np.int64)


def _deal(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, key, short) of what several documents of these parts hold, and a payload for each block of fingerprints: every one
    once, with a document, whether it is short (1) and whether several documents hold it (2)."""
    doc, key, short = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key.view(K.U64))
    doc, key, short = doc[order], key[order], short[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    low = np.minimum.reduceat(doc, at)
    several = low != np.maximum.reduceat(doc, at)
    here = np.flatnonzero(np.repeat(several, np.diff(np.append(at, len(key)))))
    one, flags = key[at], (several * 2 + short[at]).astype(np.uint8)
    block = ((one.view(K.U64) >> K.U64(32)) * K.U64(blocks)) >> K.U64(32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
    payload = [one[a:b].tobytes() + low[a:b].tobytes() + flags[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    given, none = pa.nulls(len(here)), pa.nulls(len(payload))
    for columns in ([doc[here], key[here], short[here], given, given, given, given], [none, none, none, none, none, block[cuts[:-1]], payload]):
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, _DEALT, strict=True)], schema=_DEALT)


def _recurs(dealt: pa.Table) -> pa.Table:
    """(doc, key, short) of what recurs in a block, without the rows that ``_deal`` gave already."""
    raw = [v.as_buffer() for chunk in dealt.column("payload").chunks for v in chunk]
    sizes = [len(r) // 17 for r in raw]
    key, doc = (np.concatenate([np.frombuffer(r, dtype=np.int64, count=n, offset=k * n) for r, n in zip(raw, sizes, strict=True)]) for k in (0, 8))
    flags = np.concatenate([np.frombuffer(r, dtype=np.uint8, offset=16 * n) for r, n in zip(raw, sizes, strict=True)])
    order = np.argsort(key)
    key, doc, flags = key[order], doc[order], flags[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    met = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)) | (np.maximum.reduceat(flags, at) > 1)
    rows = np.repeat(met, np.diff(np.append(at, len(key)))) & (flags < 2)
    return pa.table({"doc": doc[rows], "key": key[rows], "short": flags[rows] == 1})


def units(texts: DataFrame, min_words: int = MIN_WORDS, full_words: int = FULL_WORDS, tree: tuple[int, int | None] = TREE, blocks: int = 1) -> DataFrame:
    """The lines and runs of (doc, text), in rows of three kinds.

    doc, key, short, leaf, tokens (16 bits each): lines that have a leaf. doc, key, short: lines and runs that a worker met in several
    documents. block, payload: all lines and runs, packed by ``_deal``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part in K.chunks(batch, limit=CHUNK):
                own = Parsed(part, "text", min_words, full_words, tree).units(part.column("doc"))
                lines = own.filter(own.column("leaf").is_valid())
                yield pa.RecordBatch.from_arrays([*lines.columns, pa.nulls(lines.num_rows, pa.int32()), pa.nulls(lines.num_rows, pa.binary())], schema=_DEALT)
                parts.append(tuple(own.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "key", "short")))
                held += own.num_rows
                if held > DEAL:
                    yield from _deal(parts, blocks)
                    parts, held = [], 0
        if held:
            yield from _deal(parts, blocks)

    return texts.mapInArrow(run, "doc long, key long, short boolean, leaf long, tokens binary, block int, payload binary")


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each line of a leaf the first seed that it agrees with; a seed that agrees with an earlier one is none."""
    for batch in batches:
        out = []
        known: dict[int, tuple[list[int], np.ndarray]] = {}
        seeds, lines = batch.column("seeds"), batch.column("tokens")
        for i, leaf in enumerate(batch.column("leaf").to_pylist()):
            if leaf not in known:
                keys, rows = [], []
                for s in seeds[i].as_py():
                    tokens = np.frombuffer(s["tokens"], dtype=np.uint16)
                    if not any((r != tokens).sum() <= _varying(len(tokens)) for r in rows):
                        keys.append(s["key"])
                        rows.append(tokens)
                known[leaf] = keys, np.stack(rows)
            keys, rows = known[leaf]
            near = np.flatnonzero((rows != np.frombuffer(lines[i].as_buffer(), dtype=np.uint16)).sum(axis=1) <= _varying(rows.shape[1]))
            out.append(keys[near[0]] if len(near) else None)
        yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("key"), lines, pa.array(out, pa.int64())], ["leaf", "key", "tokens", "seed"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block): fingerprints of each line's blocks of positions behind its leading tokens, one more than positions may differ."""
    for batch in batches:
        for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
            lines = part.column("tokens").to_pylist()
            tokens, size = np.frombuffer(b"".join(lines), dtype=np.uint16), np.array([len(x) // 2 for x in lines], dtype=np.int64)
            leaf, key = (part.column(c).to_numpy() for c in ("leaf", "key"))
            first, lead = np.cumsum(size) - size, np.minimum(size, LEADING)
            blocks = np.minimum(size // VARYING, WILDCARDS) + 1
            line = np.repeat(np.arange(len(lines)), blocks)
            number = np.arange(len(line)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            # The first blocks have one position more where they do not come out even.
            least, more = np.divmod(size - lead, blocks)
            start = (first + lead)[line] + number * least[line] + np.minimum(number, more[line])
            end = start + least[line] + (number < more[line])
            place = np.arange(len(tokens)) - np.repeat(first, size)
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, K.U64), np.cumsum(K.mix(tokens + (place.astype(K.U64) << K.U64(16))), dtype=K.U64)])
                block = K.mix(total[end] - total[start] + K.mix(leaf.view(K.U64)[line] + number.astype(K.U64)))
            yield pa.RecordBatch.from_arrays([pa.array(key[line]), pa.array(block.view(np.int64))], ["key", "block"])


def _with_partner(lines: DataFrame) -> DataFrame:
    """The lines (leaf, key, tokens) that share a block with another one: all that may agree with any are among them."""
    blocks = lines.mapInArrow(_blocks, "key long, block long")
    shared = blocks.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("block")
    alive = blocks.join(shared, "block").select("key").distinct()
    return table(lines.join(alive, "key", "left_semi"), "leaves")


def learn_templates(lines: DataFrame) -> DataFrame:
    """(key, template) of the lines that share a template with another line. lines: leaf, key, tokens, repeated or not."""
    crowded = lines.groupBy("leaf").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("leaf")
    crowded = table(crowded, "crowded")
    once = table(lines.join(_sized(crowded), "leaf").groupBy("leaf", "key").agg(F.first("tokens").alias("tokens")), "leaves")
    rest, found, written, seeds_now = _with_partner(once), None, [crowded, once], SEEDS
    while True:
        written.append(rest)
        slots = rest.groupBy("leaf", F.pmod("key", F.lit(seeds_now)).alias("slot")).agg(F.min(F.struct("key", "tokens")).alias("s"))
        seeds = slots.groupBy("leaf").agg(F.sort_array(F.collect_list("s")).alias("seeds"))
        placed = table(rest.join(seeds, "leaf").mapInArrow(_place, "leaf long, key long, tokens binary, seed long"), "placed")
        written.append(placed)
        joined = placed.where("seed is not null")
        several = joined.groupBy("leaf", "seed").agg(F.count("*").alias("n")).where("n > 1").select("leaf", "seed")
        some = joined.join(several, ["leaf", "seed"]).select("key", F.xxhash64("leaf", "seed").alias("template"))
        found = some if found is None else found.union(some)
        left = placed.where("seed is null")
        if left.isEmpty():
            break
        rest, seeds_now = _with_partner(left.select("leaf", "key", "tokens")), min(2 * seeds_now, MOST_SEEDS)
    found = table(found, "templates")
    drop(*written)
    return found


def copy_groups(docs: DataFrame) -> DataFrame:
    """(node, component) of the ids that have copies of a smaller id; ids that share a row's component are one group."""
    linked = jaccard_components(docs, "doc", "text").where("doc_id <> component_id")
    links = table(linked.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).distinct(), "copies")
    # Where ids are unique, every id has one link and the other end has none. Rows that share an id join their groups.
    if links.groupBy("a").count().where("count > 1").isEmpty() and links.join(links.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
        return links.toDF("node", "component")
    groups = table(components(links), "groups")
    drop(links)
    return groups


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _release(spark) -> None:
    """Shuffle files of finished joins go with the plans that refer to them."""
    gc.collect()
    spark._jvm.System.gc()


def recurring(texts: DataFrame, min_words: int = MIN_WORDS, full_words: int = FULL_WORDS, many_docs: int = MANY_DOCS, tree: tuple[int, int | None] = TREE) -> DataFrame:
    """(doc, dropped): the fingerprints of the lines and runs that each document of (doc, text) is to lose."""
    spark = texts.sparkSession
    groups = copy_groups(texts)
    _release(spark)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = table(units(texts, min_words, full_words, tree, max(1, -(-size // (UNIT_BYTES * BLOCK_UNITS)))), "units")
    lines = found.where("leaf is not null").select("doc", "key", "short", "leaf", "tokens")
    learnt = learn_templates(lines.select("leaf", "key", "tokens"))
    wild = lines.join(_sized(learnt), "key").select("doc", "key", "template", "short")
    several = wild.groupBy("template").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("template")
    wild = wild.join(several, "template").select("doc", "key", "template", "short")
    own = found.where("block is not null").select("block", "payload").groupBy("block").applyInArrow(_recurs, "doc long, key long, short boolean")
    own = own.union(found.where("block is null and leaf is null").select("doc", "key", "short")).select("doc", "key", F.col("key").alias("template"), "short")
    met = table(own.union(wild), "recurring")
    _release(spark)
    drop(found, learnt)
    placed = met.join(groups, F.col("doc") == F.col("node"), "left").select("doc", "key", "template", "short", F.coalesce("component", "doc").alias("copies"))
    holders = placed.groupBy("template").agg(F.min("copies").alias("first"), F.max("copies").alias("last"), F.bool_and("short").alias("short")).where("first <> last")
    many = placed.where("short").select("template", "copies").distinct().groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= many_docs).select("template")
    first = holders.where("not short").select("template", "first").union(holders.where("short").join(many, "template", "left_semi").select("template", "first"))
    return placed.join(first, "template").where("copies <> first").groupBy("doc").agg(F.collect_set("key").alias("dropped"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS, full_words: int = FULL_WORDS, many_docs: int = MANY_DOCS, tree: tuple[int, int | None] = TREE) -> DataFrame:
    """The rows with recurring lines and passages dropped from ``text_column``, and n_dropped, n_dropped_words added."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text")).where("doc is not null")
    docs = docs.drop("n_dropped", "n_dropped_words")
    columns = docs.columns
    place, of, gone = columns.index(text_column), fresh(columns, "of"), fresh(columns, "gone")
    drops = recurring(texts, min_words, full_words, many_docs, tree).toDF(of, gone)
    schema = docs.withColumns({"n_dropped": F.lit(0).cast("long"), "n_dropped_words": F.lit(0).cast("long")}).schema
    joined = docs.join(drops, F.col(id_column).cast("long") == F.col(of), "left").select(*columns, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, text_column, CHUNK):
                hit = part.column(len(columns)).is_valid().to_numpy(zero_copy_only=False)
                lines, words = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                text = part.column(place)
                if hit.any():
                    own = part.filter(pa.array(hit))
                    new, lines[hit], words[hit] = Parsed(own, text_column, min_words, full_words).without(own.column(len(columns)))
                    text = pc.replace_with_mask(text, pa.array(words > 0), new.filter(pa.array(words[hit] > 0)).cast(text.type))
                arrays = [text if j == place else part.column(j) for j in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines), pa.array(words)], [*columns, "n_dropped", "n_dropped_words"])

    return joined.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every whole text of ``documents``, without the lines and passages that recur across documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs.select("doc_id", "text"), tree=EVERY_LINE)
