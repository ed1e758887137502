"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posterior labels.

Voters are a fixed lexicon, words and word beginnings mined from the labelled rows, and patterns (shouting, exclamation runs).
The given label is one more voter: it too may be wrong. Expectation maximisation estimates how often each voter fires on
toxic and on clean rows; voters that still fire together within a class are correlated, and share one vote. A logistic
regression over word and beginning features is then fitted to the posterior labels. It sees the text only: no label,
language, source or id is an input of a score.

Copies of one text that carry a wrong label would outvote the rest, so rows that share most of their rarest fingerprints are one
group, and each of its rows weighs its share of one.

The fit uses at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the id among those that may be learnt from; everything
else runs over all rows. Scoring looks words up in a table of ``FEATURES`` entries that goes along with the function.

Cases: a null or empty text, or one without words, gets the score of the intercept. Without labelled rows, or with one class
only, every score is that class's share. Repeated rows get equal scores; a repeated id in the labels counts as toxic if any
of its rows does. Very long texts are read whole, one at a time; ties between tokens go to the smaller fingerprint; an empty table
gives none. Rows without an id are scored, and never learnt from. Other columns of the texts are not read, and stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SAMPLE_ROWS = 10_000
FEATURES = 4_096
MINED = 256
THRESHOLD = 0.7
#: Smallest fingerprints by which labelled rows are compared, and how many of them copies share.
SKETCH, COPIES_SHARE = 16, 8
#: How sure the lift of a mined voter is (in standard errors), rows that it fires on at least, and the round of expectation
#: maximisation, classes being apart by then, that measures which voters go together.
SURE, LEAST, CORRELATED = 4.0, 5, 8
#: Lengths in bytes of the word beginnings that count as features.
BEGINNINGS = (4, 5, 6)
#: A general lexicon of insults and slurs against persons.
LEXICON = (
    "idiot idiots moron morons stupid dumb dumbass imbecile cretin fool clown loser losers pathetic worthless disgusting trash scum garbage filth vermin pig pigs "
    "ugly hate hated shut kill die bastard bitch crap damn fuck fucking shit asshole jerk freak creep retard retarded whore slut"
).split()

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True
_SHOUT = re.compile(r"[A-Z]{4,}[^a-z]{1,40}[A-Z]{4,}")
_CRY = re.compile(r"!{2,}")


def _features(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    """Per text (one array for each kind: words, then beginnings) 32-bit fingerprints, with their text's index."""
    data, offsets = K.column_bytes(batch.column(0))
    data = K.LOWER[data]
    starts, ends, first = K.word_spans(data, offsets, _LETTERS)
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    values, rows = [K.word_hashes(data, starts, ends)], [row]
    for n in BEGINNINGS:
        long = ends - starts > n
        values.append(K.mix(K.word_hashes(data, starts[long], starts[long] + n) + K.U64(n)))
        rows.append(row[long])
    return np.concatenate(values).astype(np.uint32), np.concatenate(rows)


def _fingerprints(words: list[str]) -> np.ndarray:
    return _features(pa.RecordBatch.from_pydict({"text": pa.array([" ".join(words)])}))[0][: len(words)]


@dataclass(frozen=True)
class Model:
    """Fingerprints (sorted) with their weights, which of them are lexicon words, and the weights of one and of two of these."""

    tokens: np.ndarray
    weights: np.ndarray
    intercept: float
    listed: np.ndarray
    groups: tuple[float, float] = (0.0, 0.0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        out = []
        seen = np.zeros(1 << 16, dtype=bool)
        seen[self.tokens & 0xFFFF] = True
        for part in K.chunks(batch, limit=K.ROW_BYTES):
            total = np.full(part.num_rows, self.intercept)
            if len(self.tokens):
                value, row = _features(part)
                near = seen[value & 0xFFFF]
                value, row = value[near], row[near]
                at = np.minimum(np.searchsorted(self.tokens, value), len(self.tokens) - 1)
                hit = self.tokens[at] == value
                pairs = np.unique(row[hit].astype(np.int64) * len(self.tokens) + at[hit])
                row, at = pairs // len(self.tokens), pairs % len(self.tokens)
                total += np.bincount(row, weights=self.weights[at], minlength=part.num_rows)
                words = np.bincount(row[self.listed[at]], minlength=part.num_rows)
                total += (words >= 1) * self.groups[0] + (words >= 2) * self.groups[1]
            out.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def held_out(id_column: str) -> Column:
    """True for the third of the ids whose labels are never learnt from; a row without an id is not in it."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, rows: int) -> pa.Table:
    known = labels.select(F.col(id_column).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null").where(~held_out("id"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(rows)

    def run(batches):
        schema = pa.schema([("toxic", pa.int32()), ("tokens", pa.binary()), ("marks", pa.int32())])
        for batch in batches:
            for part in K.chunks(batch, limit=K.ROW_BYTES):
                value, row = _features(part.select(["text"]))
                cut = np.searchsorted(row[order := np.argsort(row, kind="stable")], np.arange(part.num_rows + 1))
                value = value[order]
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("toxic"),
                        pa.array([np.unique(value[cut[i] : cut[i + 1]]).tobytes() for i in range(part.num_rows)], pa.binary()),
                        pa.array([2 * bool(_SHOUT.search(t)) + bool(_CRY.search(t)) for t in texts], pa.int32()),
                    ],
                    schema=schema,
                )

    # rows is the bound of what is broadcast here, 12 bytes each.
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(known), "id")
    return texts.select("text", "toxic").mapInArrow(run, "toxic int, tokens binary, marks int").toArrow()


def _row_weights(tokens: list[np.ndarray]) -> np.ndarray:
    """1 over the number of labelled rows that are copies of each: rows whose sketches of smallest fingerprints mostly agree.

    A row is compared with the first row of each group that shares a fingerprint of its sketch.
    """
    group = np.zeros(len(tokens), dtype=np.int64)
    by_token: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        sketch = np.sort(K.mix(t.astype(K.U64)))[:SKETCH].tolist()
        shared: dict[int, int] = {}
        for x in sketch:
            for g in by_token.get(x, ()):
                shared[g] = shared.get(g, 0) + 1
        best = max(shared, key=lambda g: (shared[g], -g), default=None)
        if best is not None and shared[best] * SKETCH >= COPIES_SHARE * max(1, len(sketch)):
            group[i] = best
        else:
            group[i] = i
            for x in sketch:
                by_token.setdefault(x, []).append(i)
    return 1.0 / np.bincount(group, minlength=len(tokens))[group]


def _vote_model(votes: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """P(toxic) of each row from the voters (fires or abstains) and the given label, by expectation maximisation over weighted rows."""
    share = float(np.clip(np.average(label, weights=weight), 0.01, 0.99))
    # A label that some voter supports is believed at first, one that stands alone much less: where it is wrong, nothing else fires.
    fired = votes.any(axis=1)
    alone = 0.3 if (fired & (label > 0)).any() else 0.9
    p = np.where(label > 0, np.where(fired, 0.9, alone), 0.02)
    power = np.ones(votes.shape[1])
    for turn in range(rounds):
        one, none = weight * p, weight * (1 - p)
        pos, neg = one.sum() + 2, none.sum() + 2
        fire = np.clip(np.stack([(votes.T @ none + 0.1) / neg, (votes.T @ one + 0.1) / pos]), 1e-4, 1 - 1e-4)
        told = np.clip([(none @ label + 1) / neg, (one @ label + 1) / pos], 1e-3, 1 - 1e-3)
        if turn == CORRELATED:
            # Correlation of voters within each class; a voter in a clique of k correlated ones has 1/k of a vote.
            rest = (votes - np.outer(1 - p, fire[0]) - np.outer(p, fire[1])) * np.sqrt(weight)[:, None]
            cov = rest.T @ rest
            norm = np.sqrt(np.diag(cov)) + 1e-9
            power = 1 / np.maximum(1, (np.abs(cov / np.outer(norm, norm)) > 0.3).sum(0))
        odds = np.log(share / (1 - share)) + label * np.log(told[1] / told[0]) + (1 - label) * np.log((1 - told[1]) / (1 - told[0]))
        gain = power * np.log(fire[1] / fire[0])
        lose = power * np.log((1 - fire[1]) / (1 - fire[0]))
        odds = odds + votes @ (gain - lose) + lose.sum()
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        share = float(np.clip(np.average(new, weights=weight), 1e-3, 1 - 1e-3))
        if turn > CORRELATED and np.abs(new - p).max() < 1e-4:
            p = new
            break
        p = new
    return p


def _logistic(rows: np.ndarray, cols: np.ndarray, target: np.ndarray, weight: np.ndarray, width: int, l2: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on 0/1 features of weighted rows, by Adam over all rows."""
    w = np.zeros(width + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    own = weight / weight.sum()
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(rows, weights=w[cols], minlength=len(target))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * own
        grad = np.append(np.bincount(cols, weights=err[rows], minlength=width) + l2 * w[:-1], err.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled rows outside the held-out third."""
    sample = _sample(docs, labels, id_column, text_column, rows)
    label = sample.column("toxic").to_numpy().astype(float)
    none = np.zeros(0, dtype=np.uint32)
    if not len(label) or label.min() == label.max():
        share = float(np.clip(label.mean(), 0.02, 0.98)) if len(label) else 0.02
        return Model(none, np.zeros(0), float(np.log(share / (1 - share))), np.zeros(0, dtype=bool))
    marks = sample.column("marks").to_numpy()
    tokens = [np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in sample.column("tokens")]
    size = np.array([len(t) for t in tokens])
    weight = _row_weights(tokens)
    lexicon = _fingerprints(LEXICON)
    # Millions of tokens: what stands for each is 32 bits wide, a part of the rows is looked up at a time, and what is done with goes.
    known = np.unique(np.concatenate([*tokens, lexicon]))
    col = np.empty(size.sum(), dtype=np.int32)
    k1, k = np.zeros(len(known)), np.zeros(len(known))
    ends = np.cumsum(size)
    for i, (t, end) in enumerate(zip(tokens, ends, strict=True)):
        own = np.searchsorted(known, t)
        col[end - len(t) : end] = own
        k1[own] += weight[i] * label[i]
        k[own] += weight[i]
    del tokens, sample
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    n1, n0 = (weight * label).sum(), (weight * (1 - label)).sum()
    k0 = k - k1
    lift = np.log((k1 + 0.5) / (n1 + 1)) - np.log((k0 + 0.5) / (n0 + 1))
    # How sure a token's lift is: its logarithm against its standard error.
    sure = lift / np.sqrt(1 / (k1 + 0.5) + 1 / (k0 + 0.5))
    rank = np.argsort(-np.abs(sure), kind="stable")
    rank = rank[((k1 + k0)[rank] >= 3) & (np.abs(sure[rank]) > 2.5)][:FEATURES]
    mined = np.flatnonzero((sure > SURE) & (k1 >= LEAST))
    mined = mined[np.argsort(-sure[mined], kind="stable")][:MINED]
    listed = np.flatnonzero(np.isin(known, lexicon))
    voters = np.unique(np.concatenate([mined, listed]))
    place = np.full(len(known), -1, dtype=np.int32)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((len(label), len(voters) + 2))
    fires = place[col] >= 0
    votes[row[fires], place[col[fires]]] = 1
    del fires
    votes[:, -2], votes[:, -1] = marks & 1, marks >> 1
    truth = _vote_model(votes, label, weight)
    del votes
    place = np.full(len(known), -1, dtype=np.int32)
    chosen = np.sort(np.unique(np.concatenate([rank, voters])))
    place[chosen] = np.arange(len(chosen))
    used = place[col] >= 0
    rows_used, cols_used = row[used], place[col[used]]
    del row, col, used
    in_lexicon = np.isin(known[chosen], lexicon)
    words = np.bincount(rows_used[in_lexicon[cols_used]], minlength=len(label))
    one, two = np.flatnonzero(words >= 1), np.flatnonzero(words >= 2)
    rows_used = np.concatenate([rows_used, one, two]).astype(np.intp)
    cols_used = np.concatenate([cols_used, np.full(len(one), len(chosen)), np.full(len(two), len(chosen) + 1)]).astype(np.intp)
    weights, intercept = _logistic(rows_used, cols_used, truth, weight, len(chosen) + 2)
    return Model(known[chosen], weights[:-2], intercept, in_lexicon, (float(weights[-2]), float(weights[-1])))


def score(docs: DataFrame, model: Model, text_column: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of being toxic as a column."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts), pa.float64())

    return docs.withColumn(out, probability(F.col(text_column)))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every whole text of ``documents``, learnt from the labels outside the held-out third."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
