"""The source divergence audit against loops over all groups, pairs and terms, and against its SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from gazette.llm import divergence

from .test_llm import SF, lower, nothing, odd  # noqa: F401

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows):
    """(lang, source, part, item, value, rank) of rows (lang, source, text)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", TERM.findall(lower(text))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 10]
        own = {s: counts[lang, s] for x, s in groups if x == lang}
        everything = sum(own.values(), Counter())

        def scaled(count):
            under = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // under for t in kept}

        p, q = {s: scaled(c) for s, c in own.items()}, scaled(everything)
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            above = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(above)[:10], 1)]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("block,chunk", [(32, 16_384), (3, 20), (1, 1_000)])
def test_tiles_and_chunks(spark, monkeypatch, block, chunk):
    """Any tiling and any chunks give the pairs of the loop, groups without terms and languages without kept terms included."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    vocab = [f"{'ABCdefghij'[k % 10]}x{'éß日q'[k % 4]}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(120)]
    rows = [(rng.choice(["en", "de"]), f"s{rng.zipf(1.5) % 11}", " ".join(rng.choice(vocab, rng.integers(0, 60)))) for _ in range(300)]
    rows += [("en", "empty", ""), ("de", "none", None), ("xx", "a", "few words"), ("xx", "b", "few words"), (None, None, vocab[0]), (None, "é", None), ("yy", "alone", "w"), *[("en", "s1", rows[0][2])] * 40]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, term int")
    assert collected(divergence.audit(df)) == plain(rows)


def test_large_counts(spark):
    """Scaled frequencies are exact beyond what SCALE times a count fits into."""
    n, under = 7_000_000_000_001, np.array([[9_000_000_000_000_007]])
    assert divergence._scaled(np.array([[n]]), under)[0, 0] == 1 + 10**9 * (n + 2) // int(under[0, 0])
    from pyspark.sql import functions as F

    got = spark.range(1).select(divergence.scaled(F.lit(n), F.lit(9_000_000_000_000_001), F.lit(3))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // 9_000_000_000_000_007


def test_odd_rows(spark, odd, nothing):  # noqa: F811
    rows = [("en", "s", t) for _, t in odd[0]]
    assert collected(divergence.audit(odd[1])) == plain(rows)
    assert divergence.audit(nothing).count() == 0


def test_query_and_sql(spark):
    got = collected(divergence.query(spark, SF))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(tuple(r) for r in con.sql(divergence.ORACLE_SQL).select("lang, source, part, item, value, rank").fetchall())
    assert got == plain([(r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
