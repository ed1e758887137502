"""Periodic runs of words: stretches that repeat a shorter sequence, found by comparing the word ids with each of their shifts.

A run is a maximal stretch of words whose smallest period is q and which is at least ``max(LEAST, MIN_EXP * q)`` words long.
For each lag q up to n / MIN_EXP the array of word ids is compared with itself shifted by q; a stretch of equal pairs, run-length
coded, is a run of that period. Many texts are one array, parted by ids that equal nothing, longest first, so one comparison
serves all texts that are long enough for the lag. A stretch of lag q has q equal pairs in a row at least, so the comparison looks
at every ``q // GRID``-th pair first, and at all pairs only where that many of these are equal in a row: no stretch is missed, and
all lags together cost n log n comparisons instead of n squared.

By the theorem of Fine and Wilf a stretch of lag q with a smaller period has one that divides q, and is then the very run of
that period: it is known from the smaller lag already, or is found to be so by trying the divisors of q.

Texts of at most ``RANGE_BYTES`` bytes are scanned where they lie. Each longer one becomes ``RANGES`` ranges of lags at most,
dealt out to all tasks; their runs meet by text and never overlap. Word ids are exact (a dictionary of the words themselves).

Cases: a null or empty text, or one of fewer than ``LEAST`` words, has no run; its collapsed text is its words. Repeated rows and
ids are judged row by row. Very long texts are read whole. Ties (runs of one start) are in the order of their periods. Other
columns stay, but for older ones of the added names in any case. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from . import kernels as K
from .shared import fresh, table

LEAST, MIN_EXP = 12, 2
#: Pairs at which a period's length is probed at least, bytes of a text that one task scans in all its lags, ranges of a longer
#: one at most, and lags of a range at least.
GRID, RANGE_BYTES, RANGES, RANGE_LAGS = 8, 1 << 16, 32, 2048

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_RUN_TYPE = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])
_FOUND_TYPE = T.StructType([T.StructField("runs", T.ArrayType(_RUN_TYPE)), T.StructField("collapsed", T.StringType())])


class Words:
    """The words of some texts: their bytes without separators, lengths, first word of each text and the total."""

    def __init__(self, texts: pa.Array):
        data, offsets = K.column_bytes(texts)
        starts, ends, self.first = K.word_spans(data, offsets, K.SPACE_SEPARATED)
        self.data, self.lengths = data[K.SPACE_SEPARATED[data]], ends - starts

    def ids(self) -> np.ndarray:
        """A number for each word, the same for equal ones."""
        at = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(self.lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(self.data))])
        return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32) if len(words) else np.zeros(0, np.int32)

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Each text's kept words with one space between."""
        lengths = self.lengths[keep]
        ends = np.cumsum(lengths + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
        own = np.ones(len(out), dtype=bool)
        own[ends - 1] = False
        out[own] = self.data[np.repeat(keep, self.lengths)]
        words = np.concatenate([[0], np.cumsum(keep)])[self.first]
        stop = np.concatenate([[0], ends])[words]
        # The space behind the last word of a text belongs to none.
        return pa.array([out[a : max(a, b - 1)].tobytes() for a, b in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)], pa.binary()).cast(pa.string())


def _blocks(ids: np.ndarray, q: int, limit: int, step: int, few: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) pair of each stretch of ``few`` or more probed pairs (every ``step``-th) that are equal at lag q."""
    same = np.flatnonzero(ids[: limit - q : step] == ids[q:limit:step])
    if len(same) >= few:
        head = np.flatnonzero(same[few - 1 :] - same[: len(same) - few + 1] == few - 1)
        if len(head):
            cut = np.flatnonzero(np.diff(head) != 1)
            return same[head[np.concatenate([[0], cut + 1])]] * step, same[head[np.append(cut, len(head) - 1)] + few - 1] * step
    return same[:0], same[:0]


def _smaller(ids: np.ndarray, start: int, q: int, low: int) -> int:
    """The smallest period under ``low`` of a stretch with period q, or q."""
    for d in range(1, min(low, q // 2 + 1)):
        if q % d == 0 and np.array_equal(ids[start : start + q], ids[start + d : start + d + q]):
            return d
    return q


def scan(ids: np.ndarray, stops: np.ndarray, sizes: np.ndarray, low: int, high: int) -> np.ndarray:
    """(start, length, period) of the runs with periods from ``low`` up to and without ``high``.

    ids: texts one behind the other, longest first, each followed by an id that nothing else has; stops, sizes: their ends and
    lengths. A stretch that such an id parts is shorter than any run: between a text's end and the end of what it is compared with
    lie fewer than q pairs.
    """
    found: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    known = np.zeros((64, 3), dtype=np.int64)  # start, end, period
    n, count = 0, len(sizes)
    for q in range(low, high):
        while count and sizes[count - 1] < max(LEAST, MIN_EXP * q):
            count -= 1
        if not count:
            break
        limit, need = int(stops[count - 1]), max(LEAST - q, (MIN_EXP - 1) * q)
        step = max(1, q // GRID)
        first, last = _blocks(ids, q, limit, step, need // step)
        if not len(first):
            continue
        if n:
            # What lies within a known run whose period divides q is that run again.
            own = known[:n]
            own = own[(q % own[:, 2] == 0) & (own[:, 1] - own[:, 0] >= q)]
            if len(own):
                own = own[np.argsort(own[:, 0], kind="stable")]
                at = np.searchsorted(own[:, 0], first, side="right") - 1
                new = (at < 0) | (np.maximum.accumulate(own[:, 1])[np.maximum(at, 0)] <= last + q)
                first, last = first[new], last[new]
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            a, b = max(0, a - step + 1), min(limit - q, b + step)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids[a:b] == ids[a + q : b + q]).view(np.int8), [0]])))
            for s, e in zip((edges[::2] + a).tolist(), (edges[1::2] + a).tolist(), strict=True):
                if e - s < need or (s, e + q) in seen:
                    continue
                seen.add((s, e + q))
                period = _smaller(ids, s, q, low)
                if period == q:
                    found.append((s, e + q - s, q))
                if n == len(known):
                    known = np.concatenate([known, np.zeros_like(known)])
                known[n] = s, e + q, period
                n += 1
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def _runs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text of each run, its start, length and period), in order."""
    ids, sizes = words.ids(), np.diff(words.first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= LEAST]
    sizes = sizes[order]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    stops = np.cumsum(sizes + 1) - 1
    row = np.full(int(stops[-1]) + 1, 0, dtype=np.int32)
    row[stops] = -1 - np.arange(len(order), dtype=np.int32)
    begin = stops - sizes
    inside = np.ones(len(row), dtype=bool)
    inside[stops] = False
    row[inside] = ids[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(words.first[order], sizes)]
    found = scan(row, stops, sizes, 1, int(sizes[0]) // MIN_EXP + 1)
    text = np.searchsorted(stops, found[:, 0], side="right")
    found[:, 0] -= begin[text]
    text = order[text]
    by = np.lexsort((found[:, 2], found[:, 0], text))
    return text[by], found[by]


def _collapsed(words: Words, text: np.ndarray, found: np.ndarray) -> pa.Array:
    """Runs (sorted) and collapsed text of each text: of a run only its first period stays."""
    n = len(words.first) - 1
    begin = words.first[:-1][text] + found[:, 0]
    level = np.bincount(begin + found[:, 2], minlength=len(words.lengths) + 1) - np.bincount(begin + found[:, 1], minlength=len(words.lengths) + 1)
    runs = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), runs)
    return pa.StructArray.from_arrays([lists, words.joined(np.cumsum(level)[:-1] == 0)], fields=list(_FOUND))


def _whole(texts: pa.Array) -> pa.Array:
    """Runs and collapsed text of each text, in all lags."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = []
    for part in K.chunks(batch):
        words = Words(part.column(0))
        parts.append(_collapsed(words, *_runs(words)))
    return pa.concat_arrays(parts) if parts else pa.array([], _FOUND)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, low, high, ids): each text's word ids once for each range of its lags."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = Words(pa.array([text.as_py()], pa.large_string())).ids()
            top = len(ids) // MIN_EXP
            width = max(RANGE_LAGS, -(-top // RANGES))
            for low in range(1, top + 1, width):
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([low]), pa.array([min(low + width, top + 1)]), pa.array([ids.tobytes()], pa.binary())], ["key", "low", "high", "ids"])


def _scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, low, high, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            ids = np.frombuffer(packed.as_buffer(), dtype=np.int32)
            found = scan(np.append(ids, np.int32(-1)), np.array([len(ids)]), np.array([len(ids)]), low, high)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key, np.int64)), *(pa.array(found[:, i]) for i in range(3))], ["key", "start", "length", "period"])


@arrow_udf(_FOUND_TYPE)
def _in_all_lags(texts: pa.Array) -> pa.Array:
    return _whole(texts)


@arrow_udf(_FOUND_TYPE)
def _with_runs(texts: pa.Array, runs: pa.Array) -> pa.Array:
    words, lists = Words(texts), runs if isinstance(runs, pa.ListArray) else runs.combine_chunks()
    flat = lists.flatten()
    found = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1).astype(np.int64)
    return _collapsed(words, np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), found)


def find(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds ``runs`` (start, length and period of each run, by start and period, words numbered from 0) and ``collapsed`` (the
    text's words without what a run repeats, one space between)."""
    kept = docs.drop(*(c for c in docs.columns if c.lower() in ("runs", "collapsed") and c != text_column))
    names = [c for c in kept.columns if c.lower() not in ("runs", "collapsed")]
    key, got, text = fresh(kept.columns, "_key"), fresh(kept.columns, "_found"), F.col(text_column)
    long = F.coalesce(F.octet_length(text) > RANGE_BYTES, F.lit(False))

    def out(df: DataFrame) -> DataFrame:
        return df.select(*names, F.col(f"{got}.runs"), F.col(f"{got}.collapsed"))

    short = out(kept.where(~long).withColumn(got, _in_all_lags(text)))
    rest = table(kept.where(long).withColumn(key, F.monotonically_increasing_id()), "long")
    ranges = rest.select(F.col(key).alias("key"), text).mapInArrow(_ranges, "key long, low long, high long, ids binary")
    found = ranges.repartition("key", "low").mapInArrow(_scan_ranges, "key long, start long, length long, period long")
    # As many runs as the text has words, at most.
    by_text = found.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("_sorted"))
    ordered = by_text.select(key, F.transform("_sorted", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias(got))
    joined = rest.join(ordered, key, "left")
    return short.unionByName(out(joined.withColumn(got, _with_runs(text, F.coalesce(F.col(got), F.array().cast(T.ArrayType(_RUN_TYPE)))))))


def planted(doc_id: str, text: str) -> Column:
    """The text whose words repeat from a place on, for ids whose digest ends in 0; else the text itself."""
    h = f"crc32(cast(cast({doc_id} as string) as binary))"
    words = f"filter(split({text}, '[ \\\\t-\\\\r]+'), x -> x <> '')"
    repeated = f"""
        array_join(transform(array(named_struct('w', {words}, 'g', {h} div 10)), s -> array_join(
            transform(sequence(0, size(s.w) - 1), i -> if(i < s.g % size(s.w), s.w[i],
                s.w[cast(s.g % size(s.w) + (i - s.g % size(s.w)) % (1 + (size(s.w) - s.g % size(s.w)) div (3 + s.g % 8)) as int)])), ' ')), '')"""
    return F.expr(f"case when {h} % 10 = 0 and {text} rlike '[^ \\\\t-\\\\r]' then {repeated} else {text} end")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every whole text of ``documents``, one in ten with repeated words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted("doc_id", "text").alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = find(docs).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
