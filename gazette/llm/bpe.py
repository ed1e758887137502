"""Byte-level BPE encoding and decoding with a local rank file and the tiktoken library.

Each match of the splitting pattern is merged by itself, so a text may be cut wherever a match must end. A letter or digit
followed by a space or line feed is such a place: no match goes on from a character that is not white space to one that is,
and what follows is matched without looking back. Texts beyond ``PIECE_CHARS`` are cut there, at the last such place of each
stretch; a stretch without one is taken whole. Decoding joins the raw bytes of the tokens, so any text comes back exactly.

Cases: a null text is an empty one and has no token. Strings of special tokens in a text are ordinary text. Lone surrogates
cannot occur in a Spark string. Repeated rows are encoded one by one; an empty table gives none; other columns pass through
``encode`` untouched.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 100_000
RANK_FILE = "byte_bpe_50k.tiktoken"
_SAFE = re.compile(r"[^\W_](?=[ \n])")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once in each process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """The text in stretches of about ``limit`` characters, cut at safe places only."""
    at = 0
    while len(text) - at > limit:
        cut = 0
        for back in (200, limit):
            for m in _SAFE.finditer(text, max(at, at + limit - back), at + limit):
                cut = m.end()
            if cut:
                break
        if not cut:
            m = _SAFE.search(text, at + limit - 1)
            if m is None:
                break
            cut = m.end()
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str, limit: int = PIECE_CHARS) -> np.ndarray:
    """Token ids of a text as unsigned 32-bit integers."""
    parts = [enc.encode_ordinary(p) for p in pieces(text, limit)] if len(text) > limit else [enc.encode_ordinary(text)]
    return np.concatenate([np.array(p, dtype="<u4") for p in parts])


def _paths(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path(RANK_FILE), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, text_column: str = "text", ids_column: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the token ids of a text column as an array of longs."""
    from pyspark.sql.pandas.functions import arrow_udf

    path, pattern = _paths(path, pattern)

    @arrow_udf("array<bigint>")
    def ids(col: pa.Array) -> pa.Array:
        enc = encoding(path, pattern)
        return pa.array([encode_text(enc, t or "").astype(np.int64) for t in col.to_pylist()], pa.list_(pa.int64()))

    return docs.withColumn(ids_column, ids(F.col(text_column)))


def decode(encoded: DataFrame, ids_column: str = "ids", out_column: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the raw bytes that the ids stand for; a null list gives no bytes."""
    from pyspark.sql.pandas.functions import arrow_udf

    path, pattern = _paths(path, pattern)

    @arrow_udf("binary")
    def raw(col: pa.Array) -> pa.Array:
        enc = encoding(path, pattern)
        return pa.array([enc.decode_bytes(t or []) for t in col.to_pylist()], pa.binary())

    return encoded.withColumn(out_column, raw(F.col(ids_column)))


def round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encodes, decodes the ids, and keeps digests only."""
    path, pattern = _paths(path, pattern)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                ids = encode_text(enc, value.as_py() or "")
                back = hashlib.sha256()
                for at in range(0, len(ids), 1 << 16):
                    back.update(enc.decode_bytes(ids[at : at + (1 << 16)].tolist()))
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema=schema)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every whole text of ``documents`` through the ranks of the 50k byte-level vocabulary and back."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
