"""Strings that resemble each other letter by letter, or contain one another: joins that lose no pair.

Two strings of together T letters have a ratio of 2 M / T, where M letters lie in matching stretches of one order. So a ratio of r or
more needs lengths within r / (2 - r) of each other, M letters in common, a common subsequence of M letters, and, since at least one
letter that matches nothing parts two stretches, 3 M - T - 1 pairs of neighbouring letters in common. In a second string of 200 letters
or more, difflib finds stretches by its rare letters only (``AUTOMATIC``): each stretch has one, but for one that both strings begin with.
With k - 1 rare letters these are k stretches at most, so M - k (q - 1) pieces of q letters are in common. Blocks of strings meet by
length, group and time; in a tile of two blocks these bounds are taken from the cheapest one on, the first ones over whole
columns, and only what passes them all is compared.
"""

from __future__ import annotations

import difflib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_DAYS = 14
#: Strings of a block, about: blocks are dealt by hash, and as many as a unit of group, length and time needs.
BLOCK = 256
#: Counters of a string's letters and of its pairs of letters; pairs that share a counter make a bound wider, never too narrow.
LETTERS, PAIRS = 64, 256
#: Letters from which on difflib's second string has popular letters, those of which it has more than one in ``POPULAR`` letters and one more.
AUTOMATIC, POPULAR = 200, 100
#: Letters of a piece of long strings that are counted in common, and counters of pieces.
GRAM, GRAMS = 6, 2048
#: How many times wider than the bound on the lengths a class of lengths is.
COARSE = 4
#: Letters of a piece by which strings that contain one another meet.
PIECE = 16
#: Rows of a block whose tokens are counted, and tokens that one product of matrices counts.
ROWS, TOKENS = 512, 4096
#: Slots of a group's time, each with three hubs at most.
HUBS = 4


def _counts(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and counters of letters and of pairs of letters, of each string."""
    n, one, two = np.zeros(len(strings)), np.zeros((len(strings), LETTERS), dtype=np.int32), np.zeros((len(strings), PAIRS), dtype=np.int32)
    for i, s in enumerate(strings):
        codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        n[i] = len(codes)
        one[i] = np.bincount(codes % LETTERS, minlength=LETTERS)
        two[i] = np.bincount((codes[:-1] * 31 + codes[1:] * 7919) % PAIRS, minlength=PAIRS)
    return n, one, two


class _Subsequence:
    """Whether the longest common subsequence with one string is long enough: all its places at once, as bits of one number."""

    def __init__(self, s: str):
        self.size, self.places = len(s), {}
        for i, c in enumerate(s):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def reaches(self, other: str, least: float) -> bool:
        full = (1 << self.size) - 1
        row = full
        for i, c in enumerate(other):
            hit = row & self.places.get(c, 0)
            row = ((row + hit) | (row - hit)) & full
            if i % 64 == 63 and self.size - row.bit_count() + len(other) - i - 1 < least:
                return False
        return self.size - row.bit_count() >= least


def _stretches(strings: list[str]) -> np.ndarray:
    """How many matching stretches difflib may find with each string as the second one."""
    out = np.full(len(strings), np.inf)
    for i, s in enumerate(strings):
        if len(s) >= AUTOMATIC:
            _, n = np.unique(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)
            out[i] = n[n <= len(s) // POPULAR + 1].sum() + 1
    return out


def _hashed(s: str) -> np.ndarray:
    """Fingerprints of all pieces of ``GRAM`` letters, in order."""
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    piece = np.zeros(max(0, len(codes) - GRAM + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GRAM):
            piece = (piece ^ codes[i : i + len(piece)]) * np.uint64(0x9E3779B97F4A7C15)
            piece ^= piece >> np.uint64(29)
    return piece


def _grams(s: str) -> np.ndarray:
    """The fingerprints, sorted; a piece's second occurrence has one of its own, and so on."""
    piece = np.sort(_hashed(s))
    with np.errstate(over="ignore"):
        piece += (np.arange(len(piece)) - np.searchsorted(piece, piece)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    piece.sort()
    return piece


def _many(strings: list[str]) -> np.ndarray:
    """Counters of the pieces of each long string."""
    out = np.zeros((len(strings), GRAMS), dtype=np.int32)
    for i, s in enumerate(strings):
        if len(s) >= AUTOMATIC:
            out[i] = np.bincount((_hashed(s) % np.uint64(GRAMS)).astype(np.int64), minlength=GRAMS)
    return out


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def close_pairs(left: list[str], right: list[str], least: float, labels: list[int | None] | None = None, other_labels: list[int | None] | None = None):
    """(i, j, ratio of left i to right j, ratio of right j to left i) where either reaches ``least``; without pairs of one label."""
    n, one, two = _counts(left)
    m, other_one, other_two = _counts(right)
    others = np.array([-1 if x is None else x for x in other_labels or [None] * len(right)])
    stretches, other_stretches, pieces, other_pieces = _stretches(left), _stretches(right), {}, {}
    many, other_many = _many(left), _many(right)
    for i, s in enumerate(left):
        total = n[i] + m
        match = least / 2 * total - 1e-6
        may = np.minimum(n[i], m) >= match
        if labels and labels[i] is not None:
            may &= others != labels[i]
        may = np.flatnonzero(may)
        may = may[np.minimum(one[i], other_one[may]).sum(axis=1) >= match[may]]
        most = np.maximum(stretches[i], other_stretches)
        may = may[np.minimum(two[i], other_two[may]).sum(axis=1) >= np.maximum(3 * match[may] - total[may] - 1, match[may] - most[may])]
        may = may[np.minimum(many[i], other_many[may]).sum(axis=1) >= match[may] - most[may] * (GRAM - 1)]
        common = None
        for j in may.tolist():
            if match[j] > most[j] * (GRAM - 1):
                mine = pieces[i] if i in pieces else pieces.setdefault(i, _grams(s))
                theirs = other_pieces[j] if j in other_pieces else other_pieces.setdefault(j, _grams(right[j]))
                at = np.searchsorted(theirs, mine)
                if len(theirs) == 0 or (theirs[np.minimum(at, len(theirs) - 1)] == mine).sum() < match[j] - most[j] * (GRAM - 1):
                    continue
            common = common or _Subsequence(s)
            if common.reaches(right[j], match[j]):
                there, back = _ratio(s, right[j]), _ratio(right[j], s)
                if max(there, back) >= least:
                    yield i, j, there, back


def tiled(rows: DataFrame, block: int, *columns: str) -> tuple[DataFrame, list[str]]:
    """The rows dealt to tiles of two blocks, and the columns that name a tile: rows of one group whose sizes are at most one apart and
    whose spans are at most one apart meet in one tile, on side 0 and side 1 (a block that meets itself is on both). Two rows of which
    both are ``main`` need not meet and do not.

    rows: (id, group, size, span, main, columns). A group of any size is cut into blocks of about ``block`` rows, dealt by hash.
    """
    unit = ["group", "size", "span", "main"]
    units = rows.groupBy(*unit).agg(F.ceil(F.count("*") / block).alias("blocks"))
    near = F.array(*(F.struct(F.lit(x).alias("size"), F.lit(y).alias("span")) for x, y in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))))
    pairs = units.withColumn("to", F.explode(near)).select(*unit, F.col("blocks").alias("mine"), (F.col("size") + F.col("to.size")).alias("size2"), (F.col("span") + F.col("to.span")).alias("span2"))
    pairs = pairs.join(units.toDF("group", "size2", "span2", "main2", "theirs"), ["group", "size2", "span2"]).where("not (main and main2) and (size <> size2 or span <> span2 or main <= main2)")
    own = F.pmod(F.xxhash64("id"), F.col("count")).cast("long")
    tile = [*unit, "size2", "span2", "main2", "u", "v"]

    def side(right: bool) -> DataFrame:
        mine, theirs = ("theirs", "mine") if right else ("mine", "theirs")
        keys = pairs.select(*unit, "size2", "span2", "main2", F.col(mine).alias("count"), F.col(theirs).alias("others"))
        to = rows.select("id", *columns, "group", *(F.col(c).alias(f"{c}2" if right else c) for c in ("size", "span", "main")))
        to = to.join(keys, ["group", "size2", "span2", "main2"] if right else unit).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
        u, v = ("other", "own") if right else ("own", "other")
        # A unit meets itself in the tiles over its diagonal.
        return to.withColumn("u", F.col(u)).withColumn("v", F.col(v)).where("size <> size2 or span <> span2 or main <> main2 or u <= v").select(*tile, F.lit(int(right)).alias("side"), "id", *columns)

    # Tiles take far longer than their bytes tell: as many partitions as a shuffle has, and none joined into one.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return side(False).union(side(True)).repartition(parts, *tile), tile


def _with_main(rows: DataFrame) -> DataFrame:
    """Adds whether a row has its group's most frequent label: such rows meet those of others only."""
    often = rows.where("label is not null").groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("_often"))
    return rows.join(often, "group", "left").withColumn("main", F.coalesce(F.col("label") == F.col("_often"), F.lit(False)))


def span(day) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / WINDOW_DAYS)


def alike(strings: DataFrame, least: float) -> DataFrame:
    """(x, y, xy, yx): pairs of strings of one group, at most ``WINDOW_DAYS`` apart, of which a ratio (of x to y, or of y to x: it is
    not symmetric) reaches ``least``; x is the smaller id.

    strings: (id, group, first, last, s) with distinct ids and the days between which a string occurs. With a ``label``, pairs of one
    label are left out. Empty strings resemble none. A group of any size is cut into tiles; what is emitted are the pairs found.
    """
    # Lengths of one class may be further apart than need be, so that small groups make few tiles.
    step = -COARSE * math.log(least / (2 - least))
    rows = strings.where("s <> ''") if "label" in strings.columns else strings.where("s <> ''").withColumn("label", F.lit(None).cast("long"))
    rows = _with_main(rows).withColumn("size", F.floor(F.log(F.char_length("s").cast("double")) / step)).withColumn("span", F.explode(F.sequence(span(F.col("first")), span(F.col("last")))))

    def run(table: pa.Table) -> pa.Table:
        found = {}
        left, right = (table.filter(pc.equal(table.column("side"), which)) for which in (0, 1))
        (ids, texts, labels), (other_ids, other_texts, other_labels) = ([t.column(c).to_pylist() for c in ("id", "s", "label")] for t in (left, right))
        for i, j, there, back in close_pairs(texts, other_texts, least, labels, other_labels) if ids and other_ids else ():
            x, y = ids[i], other_ids[j]
            if x != y:
                found[min(x, y), max(x, y)] = (there, back) if x < y else (back, there)
        return pa.table({"x": pa.array([k[0] for k in found], pa.int64()), "y": pa.array([k[1] for k in found], pa.int64()), "xy": pa.array([v[0] for v in found.values()], pa.float64()), "yx": pa.array([v[1] for v in found.values()], pa.float64())})

    dealt, tile = tiled(rows, BLOCK, "s", "label")
    return dealt.groupBy(*tile).applyInArrow(run, "x long, y long, xy double, yx double").distinct()


def _common(left: pa.Table, right: pa.Table, one: str, other: str) -> np.ndarray:
    """How many tokens (a list of distinct longs a row) each row of the left side shares with each one of the right side."""

    def flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
        lists = table.column(column).combine_chunks()
        size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(lists)), size), pc.list_flatten(lists).to_numpy(zero_copy_only=False)

    (i, x), (j, y) = flat(left, one), flat(right, other)
    out = np.zeros((left.num_rows, right.num_rows), dtype=np.float32)
    shared = np.intersect1d(x, y)
    if not len(shared):
        return out

    def places(rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
        held = shared[at] == tokens
        rows, at = rows[held], at[held]
        order = np.argsort(at, kind="stable")
        return rows[order], at[order]

    (i, x), (j, y) = places(i, x), places(j, y)
    for low in range(0, len(shared), TOKENS):
        high = min(low + TOKENS, len(shared))
        sides = []
        for rows, at, n in ((i, x, left.num_rows), (j, y, right.num_rows)):
            a, b = np.searchsorted(at, [low, high])
            dense = np.zeros((n, high - low), dtype=np.float32)
            dense[rows[a:b], at[a:b] - low] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out


def _reached(near: np.ndarray, diagonal: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links, same) of a matrix of links between left and right rows: a forest that joins what the matrix joins, and whether two rows are
    joined. On the diagonal left and right rows are the same ones."""
    n, m = near.shape
    if diagonal:
        near = near | near.T
    left, right, links = np.full(n, -1), np.full(m, -1), []
    for start in range(n):
        if left[start] >= 0:
            continue
        left[start], todo = start, [(start, True)]
        while todo:
            k, is_left = todo.pop()
            if diagonal:
                new = np.flatnonzero(near[k] & (left < 0))
                left[new] = start
            elif is_left:
                new = np.flatnonzero(near[k] & (right < 0))
                right[new] = start
            else:
                new = np.flatnonzero(near[:, k] & (left < 0))
                left[new] = start
            links += [(k, x) if is_left else (x, k) for x in new.tolist()]
            todo += [(x, diagonal or not is_left) for x in new.tolist()]
    return links, left[:, None] == (left if diagonal else right)[None, :]


def _matches(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """Of each left and each right row: whether their days fit, whether tokens alone join them, the share of event tokens and the number
    of title tokens in common; and the sizes of both sides' lists."""
    fit = np.abs(left.column("day").to_numpy()[:, None] - right.column("day").to_numpy()[None, :]) <= WINDOW_DAYS
    size = [{c: pc.list_value_length(t.column(c)).fill_null(0).to_numpy() for c in ("titles", "wordings", "events")} for t in (left, right)]
    titles, events = _common(left, right, "titles", "titles"), _common(left, right, "events", "events")
    share = _part(events, size[0]["events"], size[1]["events"])
    cheap = (_common(left, right, "numbers", "numbers") > 0) & (events >= 4) | (titles >= 3) & (events >= 4) | (titles >= 2) & (events >= 5) | (share >= 0.68) & (events >= 6)
    return fit, cheap, share, titles, size


def _part(common: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    return common.astype(np.float64) / np.maximum(mine[:, None] + theirs[None, :] - common, 1)


def hub_links(rows: DataFrame) -> DataFrame:
    """(a, b): links of kind 0 as in ``token_pairs`` between rows and a few hubs of their group: those of the most title tokens, of the most
    event tokens and of the most numbers in each of ``HUBS`` slots of a time. Most rows of a large group share enough with one of these, so that
    few have to meet all others then. rows as for ``token_pairs``; a block makes no more links than it has rows and hubs.
    """
    rows = rows.withColumns({"span": span(F.col("day")), "day": F.datediff("day", F.lit("1970-01-01").cast("date"))})
    slots = rows.groupBy("group", "span", F.pmod(F.xxhash64("id"), F.lit(HUBS)).alias("slot"))
    best = slots.agg(*(F.max_by("id", F.struct(F.size(c), "id")).alias(c) for c in ("titles", "events", "numbers")))
    hubs = best.select("group", F.explode(F.array("titles", "events", "numbers")).alias("id")).distinct()
    blocks = rows.groupBy("group").agg(F.ceil(F.count("*") / ROWS).alias("blocks"))
    columns = ["id", "day", "titles", "wordings", "events", "numbers"]
    dealt = rows.join(blocks, "group").select("group", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(0).alias("side"), *columns)
    held = rows.join(hubs, ["group", "id"]).join(blocks, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), *columns)

    def run(table: pa.Table) -> pa.Table:
        left, right = (table.filter(pc.equal(table.column("side"), which)) for which in (0, 1))
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        left, right = left.sort_by("id"), right.sort_by("id")
        fit, cheap, *_ = _matches(left, right)
        links, _ = _reached(cheap & fit, False)
        x, y = left.column("id").to_numpy()[[k for k, _ in links]], right.column("id").to_numpy()[[k for _, k in links]]
        return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.union(held).repartition(parts, "group", "block").groupBy("group", "block").applyInArrow(run, "a long, b long").where("a <> b")


def token_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, kind) of rows of one group at most ``WINDOW_DAYS`` apart. kind 0: links that join, by way of each other, all rows that share
    a number and four event tokens, three title tokens and four event tokens, two and five, or .68 of all event tokens and six. Of pairs
    that these do not join in their tile, kind 1 share .55 of the title tokens of any wording, 2 share .48 of their event tokens and
    have lengths whose ratio may reach .8, and 3 both.

    rows: (id, group, day, titles, wordings, events, numbers, length), tokens as lists of distinct longs. With a ``label``, rows of one
    label are joined already: pairs of one label may be left out, and rows of a group's most frequent label meet those of others only. In
    a tile all pairs are counted by products of matrices; a block makes no more links than it has rows, however many pairs there are.
    """
    rows = rows.withColumns({"size": F.lit(0).cast("long"), "span": span(F.col("day")), "day": F.datediff("day", F.lit("1970-01-01").cast("date"))})
    rows = _with_main(rows if "label" in rows.columns else rows.withColumn("label", F.lit(None).cast("long")))

    def run(table: pa.Table) -> pa.Table:
        left, right = (table.filter(pc.equal(table.column("side"), which)) for which in (0, 1))
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "kind": pa.array([], pa.int32())})
        left, right = left.sort_by("id"), right.sort_by("id")
        x, y = (t.column("id").to_numpy() for t in (left, right))
        diagonal = len(x) == len(y) and bool((x == y).all())
        fit, cheap, share, titles, size = _matches(left, right)
        one, other = (t.column("label").to_numpy() for t in (left, right))
        # Rows without a label are null, which numpy has as no number and equals nothing.
        fit &= one[:, None] != other[None, :]
        links, same = _reached(cheap & fit, diagonal)
        fit &= ~same
        if diagonal:
            fit &= x[:, None] < y[None, :]
        alike = _part(titles, size[0]["titles"], size[1]["titles"]) >= 0.55
        for one, other in (("titles", "wordings"), ("wordings", "titles"), ("wordings", "wordings")):
            if size[0][one].any() and size[1][other].any():
                alike |= _part(_common(left, right, one, other), size[0][one], size[1][other]) >= 0.55
        n, m = (t.column("length").to_numpy().astype(np.float64) for t in (left, right))
        close = (share >= 0.48) & (2 * np.minimum(n[:, None], m[None, :]) >= 0.8 * np.maximum(n[:, None] + m[None, :], 1))
        i, j = np.nonzero(fit & (alike | close))
        kind = alike[i, j].astype(np.int32) + 2 * close[i, j].astype(np.int32)
        p = np.concatenate([x[[k for k, _ in links]], x[i]]) if links else x[i]
        q = np.concatenate([y[[k for _, k in links]], y[j]]) if links else y[j]
        kind = np.concatenate([np.zeros(len(links), np.int32), kind])
        return pa.table({"a": pa.array(np.minimum(p, q)), "b": pa.array(np.maximum(p, q)), "kind": pa.array(kind)})

    dealt, tile = tiled(rows, ROWS, "day", "titles", "wordings", "events", "numbers", "length", "label")
    return dealt.groupBy(*tile).applyInArrow(run, "a long, b long, kind int")


def inside(strings: DataFrame) -> DataFrame:
    """(x, y): strings of one group, at most ``WINDOW_DAYS`` apart, of which x (``PIECE`` letters long at least) lies in y; ids differ.

    All pieces of y are keys, and of x the one that the fewest strings of its group hold: what contains x holds it.
    """
    long = strings.where(F.char_length("s") >= PIECE)
    pieces = long.select("id", "group", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("s") - PIECE + 1), lambda i: F.substring("s", i, PIECE)))).alias("piece"))
    held = pieces.join(pieces.groupBy("group", "piece").agg(F.count("*").alias("n")), ["group", "piece"])
    rarest = held.groupBy("id", "group").agg(F.min(F.struct("n", "piece")).alias("least")).where("least.n > 1").select(F.col("id").alias("x"), "group", "least.piece")
    pairs = rarest.join(pieces.select(F.col("id").alias("y"), "group", "piece"), ["group", "piece"]).where("x <> y").select("x", "y")
    sides = pairs.join(strings.select(F.col("id").alias("x"), F.col("s").alias("p"), F.col("first").alias("f"), F.col("last").alias("l")), "x").join(strings.select(F.col("id").alias("y"), F.col("s").alias("q"), "first", "last"), "y")
    return sides.where(F.contains("q", "p")).where((F.datediff("first", "l") <= WINDOW_DAYS) & (F.datediff("f", "last") <= WINDOW_DAYS)).select("x", "y")


def chained(keys: DataFrame, *by: str) -> DataFrame:
    """(a, b): links that join all rows of one key that lie at most ``WINDOW_DAYS`` apart, by way of each other, and no others.

    Rows of a day are linked to the first of them, and each day's first row to the next day's: a key of k rows makes k links.
    """
    days = keys.groupBy(*by, "day").agg(F.min("pos").alias("low"))
    same = keys.join(days, [*by, "day"]).where("pos <> low").select(F.col("low").alias("a"), F.col("pos").alias("b"))
    window = Window.partitionBy(*by).orderBy("day")
    next_ = days.select("day", "low", F.lag("day").over(window).alias("before"), F.lag("low").over(window).alias("a")).where(F.datediff("day", "before") <= WINDOW_DAYS)
    return same.union(next_.where("a <> low").select("a", F.col("low").alias("b")))
