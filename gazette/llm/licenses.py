"""License scan with a positional index of rare tokens.

Every template has a mandatory phrase, a part of its wording. Of the phrase's words the ``RARE`` of highest inverse document
frequency, counted over all texts, are the index: word -> (template, position). Of a text's licence words only these are looked up;
each posting says where its template would begin, and places on which all rare words of a phrase agree are candidates. A candidate
is a find where the whole phrase stands word by word, and the words around it, each at its place or up to ``DRIFT`` words beside it,
carry at least ``SHARE`` of the template's weight. As a phrase that stands has its rare words in place, no find is lost. Places of the
base phrases are always found, on all texts, and their labels stay.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Cases: a null or empty text has no word, no place and
empty labels; ties between words of equal frequency go to the later one; repeated rows are scanned one by one; an empty table gives no
row, and every word then weighs the same. A very long text is a chunk of its own and scanned whole, in a number of array operations
that does not depend on its licence words. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SHARE = 0.6
RARE = 2
#: Words by which wording around a phrase may be shifted: some that were left out or put in.
DRIFT = 2
#: Candidates that are verified at once.
AT_ONCE = 20_000

#: Phrases whose places are counted, with their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Label, wording, the mandatory phrase within the wording.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2", "licensed under the gpl version 2", "gpl version 2"),
    ("gpl-2", "licensed under gplv2", "gplv2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "licensed under the gpl version 3", "gpl version 3"),
    ("gpl-3", "licensed under gplv3", "gplv3"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("mpl-2", "licensed under the mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", "cc0 1 0"),
)


def _hash(text: str) -> np.ndarray:
    data, offsets = K.column_bytes(pa.array([text]))
    starts, ends, _ = K.word_spans(K.LOWER[data], offsets, K.ALNUM)
    return K.word_hashes(K.LOWER[data], starts, ends)


def vocabulary(templates=TEMPLATES) -> np.ndarray:
    """The fingerprints of all templates' words, sorted."""
    return np.unique(np.concatenate([_hash(text) for _, text, _ in templates]))


def _look_up(known: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``words`` of words in ``known`` (sorted), and which ones they are."""
    near = np.zeros(1 << 16, dtype=bool)
    near[known & K.U64(0xFFFF)] = True
    at = np.flatnonzero(near[words & K.U64(0xFFFF)])
    place = np.minimum(np.searchsorted(known, words[at]), len(known) - 1)
    same = known[place] == words[at]
    return at[same], place[same]


class _Index:
    """Postings of the phrases' rarest words, and the templates to verify. weight: of each word of the vocabulary."""

    def __init__(self, weight: np.ndarray, templates=TEMPLATES):
        known = vocabulary(templates)
        self.labels = [label for label, _, _ in templates]
        self.words = [_hash(text) for _, text, _ in templates]
        self.weights = [weight[np.searchsorted(known, w)] for w in self.words]
        self.phrase, self.needed, postings = [], [], []
        for t, (_, text, phrase) in enumerate(templates):
            own, all_words = phrase.split(), text.split()
            begin = next(i for i in range(len(all_words)) if all_words[i : i + len(own)] == own)
            self.phrase.append((begin, begin + len(own)))
            rare = sorted(range(begin, begin + len(own)), key=lambda p: (-self.weights[t][p], -p))[:RARE]  # noqa: B023
            self.needed.append(len(rare))
            postings += [(int(self.words[t][p]), t, p) for p in rare]
        postings.sort()
        self.rare = np.unique(np.array([h for h, _, _ in postings], dtype=K.U64))
        self.template = np.array([t for _, t, _ in postings])
        self.position = np.array([p for _, _, p in postings])
        self.cut = np.searchsorted(np.array([h for h, _, _ in postings], dtype=K.U64), np.append(self.rare, K.U64(0xFFFFFFFFFFFFFFFF)))

    def finds(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(template, rows, shares) of the finds in a chunk of texts. first: where each text's words begin, and the total."""
        at, which = _look_up(self.rare, words)
        if not len(at):
            return
        size = self.cut[which + 1] - self.cut[which]
        posting = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.cut[which], size)
        template, begin = self.template[posting], np.repeat(at, size) - self.position[posting]
        order = np.lexsort((begin, template))
        template, begin = template[order], begin[order]
        new = np.ones(len(template), dtype=bool)
        new[1:] = (template[1:] != template[:-1]) | (begin[1:] != begin[:-1])
        start = np.flatnonzero(new)
        votes = np.diff(np.append(start, len(new)))
        agreed = votes == np.array(self.needed)[template[start]]
        template, begin = template[start][agreed], begin[start][agreed]
        for t in np.unique(template).tolist():
            every = begin[template == t]
            for k in range(0, len(every), AT_ONCE):
                rows, shares = self._verified(t, every[k : k + AT_ONCE], words, first)
                if len(rows):
                    yield t, rows, shares

    def _verified(self, t: int, begin: np.ndarray, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, weight, (a, b) = self.words[t], self.weights[t], self.phrase[t]
        row = np.searchsorted(first, np.clip(begin + a, 0, len(words) - 1), side="right") - 1
        inside = (begin + a >= first[row]) & (begin + b <= first[row + 1])
        begin, row = begin[inside], row[inside]
        stands = (words[begin[:, None] + np.arange(a, b)] == own[a:b]).all(axis=1)
        begin, row = begin[stands], row[stands]
        met = np.zeros((len(begin), len(own)), dtype=bool)
        for d in range(-DRIFT, DRIFT + 1):
            place = begin[:, None] + np.arange(len(own)) + d
            there = (place >= first[row][:, None]) & (place < first[row + 1][:, None])
            met |= there & (words[np.clip(place, 0, len(words) - 1)] == own)
        share = met @ weight / weight.sum()
        return row[share >= SHARE], share[share >= SHARE]


def _places(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand one after the other."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(words[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[words[at + k] == phrase[k]]
    return at


def _scan(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.column_bytes(part.column("text"))
    data = K.LOWER[data]
    starts, ends, first = K.word_spans(data, offsets, K.ALNUM)
    return K.word_hashes(data, starts, ends), first


def word_weights(texts: DataFrame) -> np.ndarray:
    """Inverse document frequency of the templates' words over all texts: one row a word and task is shuffled."""
    known = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(known), dtype=np.int64), 0
        for batch in batches:
            for part in K.chunks(batch):
                words, first = _scan(part)
                at, which = _look_up(known, words)
                row = np.searchsorted(first, at, side="right") - 1
                counts += np.bincount(np.unique(row * len(counts) + which) % len(counts), minlength=len(counts))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(counts)), -1)), pa.array(np.append(counts, n))], ["word", "rows"])

    found = {r["word"]: r["rows"] for r in texts.mapInArrow(run, "word long, rows long").groupBy("word").agg(F.sum("rows").alias("rows")).collect()}
    total = found.get(-1, 0)
    return np.array([math.log((total + 1) / (found.get(i, 0) + 1)) + 0.1 for i in range(len(known))])


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    index = _Index(word_weights(texts.select("text")))
    phrases = [(_hash(phrase), label) for phrase, label in BASE]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                words, first = _scan(part)
                n = part.num_rows
                count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: list[set[str]] = [set() for _ in range(n)]
                found: list[set[str]] = [set() for _ in range(n)]
                score = np.zeros(n)
                for phrase, label in phrases:
                    # A place whose words reach into the next text is none.
                    at = _places(words, phrase)
                    row = np.searchsorted(first, at, side="right") - 1
                    inside = at + len(phrase) <= first[row + 1] if len(at) else np.zeros(0, bool)
                    at, row = at[inside], row[inside]
                    count += np.bincount(row, minlength=n)
                    np.minimum.at(low, row, at - first[row])
                    np.maximum.at(high, row, at - first[row])
                    for r in np.unique(row).tolist():
                        base[r].add(label)
                for t, row, share in index.finds(words, first):
                    np.maximum.at(score, row, np.minimum(share, 1.0))
                    for r in np.unique(row).tolist():
                        found[r].add(index.labels[t])
                score[count > 0] = 1.0
                none = count == 0
                columns = [np.diff(first).astype(np.int64), count, pa.array(low, mask=none), pa.array(high, mask=none), [",".join(sorted(b)) for b in base], [",".join(sorted(b | f)) for b, f in zip(base, found, strict=True)], score]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, kind) if not isinstance(c, pa.Array) else c for c, kind in zip(columns, schema.types[1:], strict=True))], schema=schema)

    return texts.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every whole text of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
