"""The quality classifier: statistics and scores by hand, trees against all cuts, what it learns, and held-out rows."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from gazette.llm import gam

from .test_llm import SF, lower, nothing, odd  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The statistics of one text, one after the other."""
    raw, low = (text or "").encode(), lower(text or "").encode()
    words = [w.encode() for w in WORD.findall(low.decode())]
    n = len(words)
    runs = [tuple(words[i : i + 5]) for i in range(n - 4)] if n >= 5 else [tuple(words)] if words else []
    lines = [x for x in low.split(b"\n") if x]
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    some, size = max(n, 1), max(len(raw), 1)
    return [
        n, sum(map(len, words)) / some, max(map(len, words), default=0), sum(len(w) == 1 for w in words) / some, len(set(words)) / some, max(Counter(words).values(), default=0) / some,
        (len(runs) - len(set(runs))) / max(len(runs), 1), len(lines), (len(lines) - len(set(lines))) / max(len(lines), 1), n / max(len(lines), 1),
        count(range(65, 91)) / size, count(range(48, 58)) / size, count(b"#*$%&|") / some, count(b".?") / some, count(b"!") / some, count(b",;:") / some, count(b"\"'()-/\\@_=+~^`") / some,
        count(range(128, 256)) / size, count(b" \t\n\v\f\r") / size, count(b"<>[]{}") / some,
    ]


def test_statistics(odd, monkeypatch):  # noqa: F811
    texts = [t for _, t in odd[0]] + ["A b!! B\nA b!! B\n\n[x] <y> 12,5 #tag", "Dé, dé; a|b|c\t\v(e) 100%\n" * 7]
    want = np.array([plain(t) for t in texts])
    for limit in (2 << 20, 100):
        monkeypatch.setattr(gam, "CHUNK_BYTES", limit)
        assert np.allclose(gam.statistics(pa.array(texts, pa.string())), want)


def test_tree_takes_the_best_cut():
    rng = np.random.default_rng(2)
    for _ in range(30):
        g, h, w = rng.normal(size=9), rng.uniform(2, 5, 9), np.full(9, 10.0)
        value = lambda parts: sum(g[a:b].sum() ** 2 / (h[a:b].sum() + gam.SHRINK) for a, b in parts)
        first = max(range(1, 9), key=lambda k: value([(0, k), (k, 9)]))
        cuts = max((sorted({first, k}) for k in range(1, 9) if k != first), key=lambda c: value(list(itertools.pairwise([0, *c, 9]))))
        if value([(0, first), (first, 9)]) <= value([(0, 9)]):
            continue
        got = gam._tree(g, h, w)
        for a, b in itertools.pairwise([0, *cuts, 9]):
            assert np.allclose(got[a:b], g[a:b].sum() / (h[a:b].sum() + gam.SHRINK))
        gg, hh, ww = rng.normal(size=(5, 4)), rng.uniform(2, 5, (5, 4)), np.full((5, 4), 10.0)
        four = lambda i, j: sum(gg[r, c].sum() ** 2 / (hh[r, c].sum() + gam.SHRINK) for r in (slice(0, i), slice(i, 5)) for c in (slice(0, j), slice(j, 4)))
        assert gam._quadrants(gg, hh, ww)[0] == pytest.approx(max(four(i, j) for i in range(1, 5) for j in range(1, 4)))


def test_learns_a_pair():
    """Labels that only two statistics together tell are learnt by a pair's table; labels of one by its own."""
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(6000, len(gam.NAMES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    held = np.arange(6000) % 5 == 0
    model = gam.train(x[:5000], y[:5000], held[:5000])
    assert model.pairs[0] == (3, 7)
    own = model.parts(x[5000:]).sum(axis=1) + model.intercept
    assert ((own > 0) == (y[5000:] > 0)).mean() > 0.9
    model = gam.train(x[:5000], (x[:5000, 2] > 0.3).astype(float), held[:5000])
    parts = model.parts(x[5000:])
    assert np.abs(parts[:, 2]).mean() > 10 * np.abs(np.delete(parts, 2, axis=1)).mean(axis=0).max()


def test_scores_by_hand(spark, odd, nothing):  # noqa: F811
    """Scores are the intercept and one entry of each table; labels with repeats, nulls and one class only."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = gam.fit(docs, labels)
    rows = odd[0]
    got = gam.score(odd[1], model).select("doc_id", "text", "score", "words").collect()
    assert len(got) == len(rows)
    for r in got:
        x = plain(r["text"])
        z = model.intercept
        for f, (edges, values) in enumerate(zip(model.edges, model.tables, strict=True)):
            z += values[sum(e <= x[f] for e in edges)]
        for (a, b), values in zip(model.pairs, model.pair_tables, strict=True):
            z += values[sum(e <= x[a] for e in model.coarse[a]), sum(e <= x[b] for e in model.coarse[b])]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z))) and r["words"] == "clash"
    assert gam.score(nothing, model).count() == 0
    none = gam.fit(docs, labels.limit(0))
    assert none.tables == [] and none.scores(pa.array(["a", None])).tolist() == [0.5, 0.5]
    twice = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert gam.fit(docs.union(docs), twice).intercept < 0
    assert gam.fit(nothing, labels).tables == []


def test_on_held_out_rows(spark):
    """Fitted without a third of the ids: nearly all bad texts of that third are found, and nearly no good one is lost."""
    base = "/root/testdata/sf0.1"
    scored = gam.query(spark, base)
    assert {f.name: f.dataType.simpleString() for f in scored.schema} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = scored.join(spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    bad, good = ([r for r in held if r["quality"] == q] for q in (0, 1))
    assert len(bad) > 150 and sum(r["predicted"] == 0 for r in bad) >= 0.97 * len(bad) and sum(r["predicted"] == 1 for r in good) >= 0.995 * len(good)
