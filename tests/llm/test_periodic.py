"""Periodic runs against a plain search over all lags."""

import hashlib
import random
import re
import zlib

import pytest
from gazette.llm import periodic

from .test_llm import docs, nothing, odd  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TYPES = "doc_id long, text string"


def plain(w):
    """(start, length, period) of all runs, by their definition."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(12, 2 * q) and not any(w[i : i + size - p] == w[i + p : i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def check(got, texts):
    for r, t in zip(got, texts, strict=True):
        w = WORD.findall(t or "")
        want = plain(w)
        assert [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == collapsed(w, want)


def made(seed, count=300):
    rnd = random.Random(seed)
    out = []
    for _ in range(count):
        few, n = rnd.choice([1, 2, 3, 5, 30]), rnd.choice([0, 5, 11, 12, 13, 40, 90, 200])
        w = [f"w{rnd.randrange(few)}" for _ in range(n)]
        if rnd.random() < 0.6 and n > 20:
            p, at = rnd.randrange(1, n // 2), rnd.randrange(n // 2)
            w = w[:at] + w[at : at + p] * rnd.randrange(2, 6) + w[at:]
        out.append(rnd.choice([" ", "\n", " \t "]).join(w))
    return out


@pytest.mark.parametrize("limit", [1 << 16, 60])
def test_all_runs(spark, monkeypatch, limit):
    """Texts scanned where they lie, and dealt out in ranges of lags, against all lags by hand."""
    monkeypatch.setattr(periodic, "RANGE_BYTES", limit)
    monkeypatch.setattr(periodic, "RANGE_LAGS", 9)
    texts = made(limit)
    df = spark.createDataFrame(list(enumerate(texts)), TYPES)
    got = periodic.find(df).orderBy("doc_id").collect()
    check(got, texts)
    assert sum(len(r["runs"]) for r in got) > 100


def test_odd_rows(spark, odd, nothing, monkeypatch):  # noqa: F811
    monkeypatch.setattr(periodic, "RANGE_BYTES", 1000)
    long = " ".join(str(i) for i in range(30_000))
    rows = [*((i, t) for i, t in odd[0]), (7, "x " * 13), (7, "x " * 13), (None, "a b " * 6), (8, long), (9, f"{long} {long}"), (10, "é日 " * 12), (11, " \t\n ")]
    df = spark.createDataFrame([(i, t, "mine", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, RUNS string, n long")
    got = periodic.find(df).orderBy("n").collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "n", "runs", "collapsed"}
    for r, (i, t) in zip(got, rows, strict=True):
        w = WORD.findall(t or "")
        assert (r["doc_id"], r["text"]) == (i, t)
        if len(w) < 2000:
            check([r], [t])
    whole = next(r for r in got if r["text"] == f"{long} {long}")
    assert [tuple(x) for x in whole["runs"]] == [(0, 60_000, 30_000)] and whole["collapsed"] == long
    assert periodic.find(nothing).count() == 0


def test_query(spark, docs):  # noqa: F811
    """The query's digests on the smallest table by hand, planted repetitions included."""
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: r for r in periodic.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(source)
    planted = 0
    for d in source:
        w = WORD.findall(d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = plain(w)
        r = got[d["doc_id"]]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert planted > 10
