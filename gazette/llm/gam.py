"""Quality classifier: a generalised additive model with pairwise interactions over interpretable statistics of a text.

Each statistic is cut into bins. Cyclic boosting goes round the statistics and lets a shallow tree (three leaves over the bins of
one) take a small step down the logistic loss; the steps add up to one lookup table for each statistic. Then the pairs of
statistics whose best four quadrants explain most of what is left get tables of their own, boosted in the same way over coarser
bins. Rounds stop where the loss of a fifth of the rows, not learnt from, is least. A score is the logistic function of an
intercept and one entry of each table: bins and additions, over whole columns.

The fit uses at most ``SAMPLE_ROWS`` labelled ids (smallest hashes of the id) outside the held-out third, with one text each; rows
of equal statistics, as copies have them, weigh as one. Statistics and scores cover all rows. Inputs are of the text only: no
label, language, source or id.

Cases: a null text counts as an empty one, whose statistics are all 0, and is scored by them. Without labelled rows, or with one class
only, every score is that class's share. Repeated rows get equal scores; a repeated id in the labels takes its lowest quality, one in
the texts its smallest statistics. Very long texts are read whole, one at a time. Ties between splits and pairs go to the first in
the order of the statistics. Rows without an id are scored, and never learnt from. Other columns are not read, and stay, but for an
older one of the score's name in any case. An empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from . import kernels as K

SAMPLE_ROWS = 20_000
THRESHOLD = 0.5
BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, PATIENCE, RATE = 400, 30, 0.1
#: Weight of a leaf at least, and what is added to it.
LEAST, SHRINK = 5.0, 2.0
#: Texts of at most so many bytes are measured at once.
CHUNK_BYTES = 2 << 20
SHINGLE = 5

NAMES = (
    "words", "mean_word", "longest_word", "short_words", "distinct_words", "top_word", "repeated_shingles", "lines", "duplicate_lines", "words_in_line",
    "capitals", "digits", "symbols", "stops", "exclamations", "commas", "other_marks", "beyond_ascii", "space", "markup",
)

#: Kinds of bytes; what is none of these is a small letter or a control character.
_KINDS = ("capitals", "digits", "symbols", "stops", "exclamations", "commas", "other_marks", "beyond_ascii", "space", "markup")
_KIND = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate((range(0x41, 0x5B), range(0x30, 0x3A), b"#*$%&|", b".?", b"!", b",;:", b"\"'()-/\\@_=+~^`", range(0x80, 0x100), b" \t\n\v\f\r", b"<>[]{}"), 1):
    _KIND[list(_chars)] = _k
_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, occurrences of the most frequent one) of each row; values meet by 40 bits."""
    key = np.sort(rows.astype(K.U64) << K.U64(40) | values >> K.U64(24))
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    row = (key[head] >> K.U64(40)).astype(np.int64)
    times = np.diff(np.append(head, len(key)))
    most = np.zeros(n)
    np.maximum.at(most, row, times)
    return np.bincount(row, minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for each text."""
    out = [np.zeros((0, len(NAMES)))]
    for part in K.chunks(pa.RecordBatch.from_arrays([texts], ["text"]), limit=CHUNK_BYTES):
        n = part.num_rows
        data, offsets = K.column_bytes(part.column(0))
        row = np.arange(n)
        kinds = np.bincount(np.repeat(row * 16, np.diff(offsets)) + _KIND[data], minlength=16 * n).reshape(n, 16)[:, 1 : len(_KINDS) + 1]
        lower = K.LOWER[data]
        starts, ends, first = K.word_spans(lower, offsets, K.SPACE_SEPARATED)
        words, lengths = np.diff(first), ends - starts
        of = np.repeat(row, words)
        hashes = K.word_hashes(lower, starts, ends)
        distinct, top = _distinct(of, hashes, n)
        runs, at = K.shingles(hashes, first, SHINGLE)
        shingled = np.diff(at)
        kept, _ = _distinct(np.repeat(row, shingled), runs, n)
        begin, end, line = K.word_spans(lower, offsets, _LINE)
        lines = np.diff(line)
        different, _ = _distinct(np.repeat(row, lines), K.word_hashes(lower, begin, end), n)
        longest = np.zeros(n)
        np.maximum.at(longest, of, lengths)
        some, rows_of_lines, bytes_ = np.maximum(words, 1), np.maximum(lines, 1), np.maximum(np.diff(offsets), 1)
        own = {
            "words": words, "mean_word": np.bincount(of, weights=lengths, minlength=n) / some, "longest_word": longest, "short_words": np.bincount(of, weights=lengths == 1, minlength=n) / some,
            "distinct_words": distinct / some, "top_word": top / some, "repeated_shingles": (shingled - kept) / np.maximum(shingled, 1), "lines": lines, "duplicate_lines": (lines - different) / rows_of_lines,
            "words_in_line": words / rows_of_lines, **{k: kinds[:, i] / (bytes_ if k in ("capitals", "digits", "beyond_ascii", "space") else some) for i, k in enumerate(_KINDS)},
        }
        out.append(np.stack([own[k].astype(float) for k in NAMES], axis=1))
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    """Edges of each statistic's bins and a table over them; pairs of statistics with coarser edges and tables over both."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """What each table adds to the log-odds of each row."""
        one = [t[_bin(x[:, f], e)] for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True))]
        two = [t[_bin(x[:, a], self.coarse[a]), _bin(x[:, b], self.coarse[b])] for (a, b), t in zip(self.pairs, self.pair_tables, strict=True)]
        return np.stack([*one, *two], axis=1) if one or two else np.zeros((len(x), 0))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _logistic(self.intercept + self.parts(statistics(texts)).sum(axis=1))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _bin(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, x, side="right")


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles of the values and of the distinct values, half each: rare values get bins too."""
    half = np.linspace(0, 1, bins // 2 + 1)[1:-1]
    return np.unique(np.concatenate([np.quantile(v, half, method="higher") for v in (x, np.unique(x))]))


def _leaf(g, h):
    return g / (h + SHRINK)


def _gain(g, h):
    return np.where(h >= LEAST / 4, g * g / (h + SHRINK), 0.0)


def _tree(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Values over bins of a tree of up to three leaves: the best cut, then the best one of either side. g, h, w: sums of gradients,
    curvatures and weights by bin."""
    pieces = [(0, len(g))]
    for _ in range(2):
        best = (1e-12, None, None)
        for low, high in pieces:
            left, below, rows = (np.cumsum(v[low:high])[:-1] for v in (g, h, w))
            if not len(left):
                continue
            total, above, all_rows = g[low:high].sum(), h[low:high].sum(), w[low:high].sum()
            gain = _gain(left, below) + _gain(total - left, above - below) - _gain(total, above)
            gain[(rows < LEAST) | (all_rows - rows < LEAST)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = gain[k], (low, high), low + k + 1
        if best[1] is None:
            break
        pieces.remove(best[1])
        pieces += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for low, high in pieces if len(pieces) > 1 else []:
        out[low:high] = _leaf(g[low:high].sum(), h[low:high].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values over cells) of the best tree that cuts both statistics once."""
    parts = []
    for v in (g, h, w):
        c = v.cumsum(0).cumsum(1)
        a, b, d = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        parts.append((a, b - a, d - a, c[-1, -1] - b - d + a))
    gain = sum(_gain(x, y) for x, y in zip(parts[0], parts[1], strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        if parts[2][k][i, j] >= LEAST:
            out[rows, cols] = _leaf(parts[0][k][i, j], parts[1][k][i, j])
    return float(gain[i, j]), out


def _boost(bins: list[np.ndarray], widths: list[int], shapes: list[tuple[int, ...]], y: np.ndarray, w: np.ndarray, held: np.ndarray, z: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Cyclic boosting of one table for each column of bins from the log-odds z on: the tables where the held rows' loss is least."""
    tables = [np.zeros(k) for k in widths]
    own = np.where(held, 0.0, w)
    judged = np.where(held, w, 0.0) if held.any() else w

    def loss() -> float:
        return float((judged * np.logaddexp(0, np.where(y > 0, -z, z))).sum())

    best, kept, since = loss(), [t.copy() for t in tables], 0
    for _ in range(ROUNDS):
        for b, width, shape, t in zip(bins, widths, shapes, tables, strict=True):
            p = _logistic(z)
            sums = [np.bincount(b, weights=v, minlength=width) for v in (own * (y - p), own * p * (1 - p), own)]
            step = _tree(*sums) if len(shape) == 1 else _quadrants(*(s.reshape(shape) for s in sums))[1].ravel()
            step *= RATE
            t += step
            z = z + step[b]
        since += 1
        if (now := loss()) < best - 1e-7 * judged.sum():
            best, kept, since = now, [t.copy() for t in tables], 0
        elif since > PATIENCE:
            break
    return kept, sum((t[b] for t, b in zip(kept, bins, strict=True)), np.zeros(len(y)))


def train(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Model:
    """A model of statistics x and labels y; rows in ``held`` only say when to stop."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
        return Model(float(np.log(share / (1 - share))))
    _, group, copies = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    w = 1.0 / copies[group.ravel()]
    share = float(np.clip(np.average(y, weights=w), 0.001, 0.999))
    intercept = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    bins = [_bin(x[:, f], e) for f, e in enumerate(edges)]
    widths = [len(e) + 1 for e in edges]
    tables, z = _boost(bins, widths, [(k,) for k in widths], y, w, held, np.full(len(y), intercept))
    z = z + intercept
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    rough, sizes = [_bin(x[:, f], e) for f, e in enumerate(coarse)], [len(e) + 1 for e in coarse]
    p, own = _logistic(z), np.where(held, 0.0, w)
    found = []
    for a in range(len(coarse)):
        for b in range(a + 1, len(coarse)):
            cell, shape = rough[a] * sizes[b] + rough[b], (sizes[a], sizes[b])
            sums = [np.bincount(cell, weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in (own * (y - p), own * p * (1 - p), own)]
            found.append((-_quadrants(*sums)[0], a, b))
    pairs = [(a, b) for gain, a, b in sorted(found)[:PAIRS] if gain < 0]
    shapes = [(sizes[a], sizes[b]) for a, b in pairs]
    cells = [rough[a] * sizes[b] + rough[b] for a, b in pairs]
    two, _ = _boost(cells, [s * t for s, t in shapes], shapes, y, w, held, z)
    return Model(intercept, edges, tables, coarse, pairs, [t.reshape(s) for t, s in zip(two, shapes, strict=True)])


def held_out(id_column: str) -> Column:
    """True for the third of the ids whose labels are never learnt from; a row without an id is not in it."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled ids outside the held-out third."""

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def measured(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))

    known = labels.select(F.col(id_column).alias("id"), F.col("quality").cast("int").alias("quality")).where("id is not null and quality is not null").where(~held_out("id"))
    known = known.groupBy("id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(rows)
    # rows is the bound of what is broadcast here, 12 bytes each, and of what comes back, one row for each id.
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(known), "id")
    found = texts.select("id", "quality", measured("text").alias("x")).groupBy("id").agg(F.first("quality").alias("quality"), F.min("x").alias("x"))
    sample = found.select("quality", F.expr("pmod(xxhash64(id, 5), 5) = 0").alias("held"), "x").orderBy("id").toArrow()
    y = (sample.column("quality").to_numpy() > 0).astype(float)
    x = np.array(sample.column("x").combine_chunks().flatten() if len(y) else [], dtype=float).reshape(-1, len(NAMES))
    return train(x, y, np.array(sample.column("held").to_pylist(), dtype=bool))


def score(docs: DataFrame, model: Model, text_column: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of good quality as a column."""

    @arrow_udf(T.DoubleType())
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts), pa.float64())

    return docs.withColumn(out, probability(F.col(text_column)))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every whole text of ``documents``, learnt from the labels outside the held-out third."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
