"""Vectorised text kernels over Arrow string columns.

Everything works on the UTF-8 bytes of whole columns: words, 64-bit word fingerprints and word shingles come out as flat
numpy arrays with one offset array per document. Rows are taken in chunks of at most ``CHUNK_BYTES`` of text (a longer
text is a chunk of its own), so memory follows the chunk and not the partition.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 8 << 20
#: Bytes that are hashed at once: a worker keeps two tables of so many powers, 8 bytes each.
_SEGMENT = 1 << 18
#: The limit where a chunk of its own has no use beyond that its rows are handled: what a worker once held it keeps.
ROW_BYTES = 1 << 19
U64 = np.uint64

#: ``[^\x20\x09-\x0D]+`` on bytes: white space separates, all else is part of a word.
SPACE_SEPARATED = np.ones(256, dtype=bool)
SPACE_SEPARATED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on lower-cased bytes: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits with good avalanche."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_ODD = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
_STEP = mix(np.arange(1001, 1033, dtype=U64)) | U64(1)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n + 1, _ODD, dtype=U64)
        down = np.full(n + 1, pow(_ODD, -1, 1 << 64), dtype=U64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n, first = len(col), col.offset
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64, count=first + n + 1)[first:] if n else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total) of the words of all texts; a word never spans two texts."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = table[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word: a polynomial over its bytes, mixed; taken in segments of bounded size."""
    out = np.empty(len(starts), dtype=U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            stop = max(at + 1, int(np.searchsorted(ends, low + _SEGMENT, side="right")))
            high = ends[stop - 1]
            up, down = _powers(max(_SEGMENT, int(high - low)))
            total = np.zeros(high - low + 1, dtype=U64)
            np.cumsum(_BYTE[data[low:high]] * up[: high - low], out=total[1:])
            s, e = starts[at:stop] - low, ends[at:stop] - low
            out[at:stop] = (total[e] - total[s]) * down[s] + (e - s).astype(U64)
            at = stop
    return mix(out)


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, first of each text and the total): runs of ``width`` words; a shorter text's words as one run."""
    counts = np.diff(first)
    keep = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(keep)])
    padded = np.concatenate([words, np.zeros(width, dtype=U64)])
    with np.errstate(over="ignore"):
        runs = np.zeros(len(words), dtype=U64)
        for j in range(width):
            runs += padded[j : j + len(words)] * _STEP[j]
        out = runs[np.arange(at[-1]) - np.repeat(at[:-1], keep) + np.repeat(first[:-1], keep)] if len(words) else runs
        for i in np.flatnonzero((counts > 0) & (counts < width)):
            own = words[first[i] : first[i + 1]]
            out[at[i]] = (own * _STEP[: len(own)]).sum(dtype=U64) + _STEP[width + len(own)]
    return mix(out), at


def flat_sets(batch: pa.RecordBatch, column: str = "text", width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first of each text and the total): the sorted distinct shingles of each text of a batch, one text after the other.

    A-Z are lower-cased, words parted by ASCII white space.
    """
    data, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, SPACE_SEPARATED)
    runs, at = shingles(word_hashes(data, starts, ends), first, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        runs[a:b].sort()
    new = np.ones(len(runs) + 1, dtype=bool)
    new[1:-1] = runs[1:] != runs[:-1]
    new[at] = True
    return runs[new[:-1]], np.concatenate([[0], np.cumsum(new[:-1])])[at]


def shingle_sets(batch: pa.RecordBatch, column: str = "text", width: int = 5) -> list[np.ndarray]:
    """The sets of ``flat_sets``, an array each."""
    tokens, at = flat_sets(batch, column, width)
    return [tokens[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _set_sums(values: np.ndarray, at: np.ndarray, step: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
        return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U64) * step).view(np.int64)


def set_ids(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit id (signed) of each set of ``flat_sets``, the same for equal sets."""
    return _set_sums(mix(tokens ^ U64(_ODD)), at, _STEP[0])


def set_marks(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Second ids of sets, independent of ``set_ids``: the two make 128 bits."""
    with np.errstate(over="ignore"):
        return _set_sums(mix(tokens * _STEP[1] + _STEP[2]), at, _STEP[3])
