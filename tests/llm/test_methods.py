"""HTML extraction, the licence scan and toxicity against plain versions of their methods."""

import math
import re
import time
from collections import defaultdict
from html import unescape

import numpy as np
from gazette.llm import html, licenses, toxicity
from gazette.llm import kernels as K

from .test_llm import SF, docs, lower, odd  # noqa: F401

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def article(page):
    """The text of the only article of a page of the given tables, by its tags alone."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(" ".join(unescape(re.sub(r"<[^>]*>", "\0", re.sub(r"</?b>", "", re.sub(r"<br>", " ", inside)))).replace("\0", " ").split()).split())


def test_every_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert got.keys() == want.keys() and len(got) == 250
    assert all(got[i] == want[i] for i in want)


def bare(page):
    """A page without any markup that says what its parts are."""
    return re.sub(r"<(/?)(?:nav|article|footer|header|aside|main)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", page))


def test_the_cut_changes_labels(spark):
    """Where markup says nothing, the cut differs from the classifier on some pages, and is right more often."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy("page_id").limit(1200).collect()]
    model = html.train(pages[:400])
    assert model.ties[0] > 0 and all(w != p for w, p in zip(model.weights[:7], html.PRIOR[:7], strict=True))
    differ = right_alone = right_cut = total = 0
    for page in pages[400:]:
        truth, found = [html.told(b) > 0 for b in html.blocks(page)], html.blocks(bare(page))
        labels, odds = html.label(found, model)
        alone = [o > 0 for o in odds]
        differ += labels != alone
        right_alone += sum(a == b for a, b in zip(alone, truth, strict=True))
        right_cut += sum(a == b for a, b in zip(labels, truth, strict=True))
        total += len(truth)
    assert differ >= 0.01 * 800 and right_cut > right_alone > 0.85 * total


def test_long_pages_and_broken_tags(spark):
    page = "<body><nav><a href=/>x</a></nav><article>" + "<p>A paragraph of the story with some words in it.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    text = html.main_text(page)
    assert len(page) > 900_000 and got == {1: text, 2: ""}
    assert text.count("A paragraph") == 20_000
    assert html.main_text("<article><p title='x>One two three four five six.</p><p>Seven eight nine ten.</p></article>").endswith("Seven eight nine ten.")
    # Deep nests take time in proportion, open and closed, of elements known and unknown.
    for nest in ("<x-a>" * 100_000 + "<p>One two three four.</p>" + "</x-a>" * 100_000, "<div>" * 50_000 + "</span-x>" * 50_000, "<x><y>" * 40_000 + "</z>" * 40_000, "<body>" * 40_000):
        began = time.time()
        html.blocks(nest)
        assert time.time() - began < 10
    for bad in ('<a "' * 20_000, "<a" * 50_000, '<a href="x>' * 10_000, "<!--" * 10_000):
        assert html.main_text(bad) == "" or len(html.main_text(bad)) <= len(bad)


def places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def test_licence_labels(spark, odd):  # noqa: F811
    """Every text against every template by loops."""
    rng = np.random.default_rng(9)
    rows = [(i, t) for i, t in odd[0] if i is not None and i < 15]
    for k, (_, text, phrase) in enumerate(licenses.TEMPLATES):
        own = text.split()
        filler = ["word%d" % x for x in rng.integers(0, 50, 12)]
        less = [w for w in own if w in phrase.split() or rng.random() < 0.6]
        rows += [(1000 + 10 * k, " ".join(filler + own + filler)), (1001 + 10 * k, " ".join(filler + less)), (1002 + 10 * k, f"{phrase} " + " ".join(filler)), (1003 + 10 * k, " ".join(own[: len(own) // 2])), (1004 + 10 * k, " ".join(own) * 2), (1005 + 10 * k, "x " + text.upper().replace(" ", ", "))]
    rows.append((5000, " ".join(rng.choice(" ".join(t for _, t, _ in licenses.TEMPLATES).split(), 3000))))
    words = {i: ALNUM.findall(lower(t)) for i, t in rows}
    seen = defaultdict(set)
    for i, w in words.items():
        for x in w:
            seen[x].add(i)
    weight = lambda x: math.log((len(rows) + 1) / (len(seen.get(x, ())) + 1)) + 0.1
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = 0
    for i, w in words.items():
        labels, best = set(), 0.0
        for label, text, phrase in licenses.TEMPLATES:
            own, p = text.split(), phrase.split()
            offset = places(own, p)[0]
            for at in places(w, p):
                begin = at - offset
                met = [any(0 <= begin + k + d < len(w) and w[begin + k + d] == x for d in range(-2, 3)) for k, x in enumerate(own)]
                share = sum(weight(x) for x, m in zip(own, met, strict=True) if m) / sum(map(weight, own))
                if share >= licenses.SHARE - 1e-12:
                    labels.add(label)
                    best = max(best, share)
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == labels | base, i
        assert abs(got[i]["score"] - (1.0 if base else min(best, 1.0))) < 1e-9
        found += bool(labels)
    assert found > 3 * len(licenses.TEMPLATES)
    many = " ".join(" ".join(t for _, t, _ in licenses.TEMPLATES) for _ in range(1000))
    assert licenses.scan(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()["n_base"] == 4000


def test_toxicity_scores_by_hand(spark, docs):  # noqa: F811
    """A score is the logistic of the intercept and the weights of the text's distinct words, beginnings and lexicon counts."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert len(model.tokens)
    weights = dict(zip(model.tokens.tolist(), model.weights.tolist(), strict=True))
    listed = {int(t) for t, is_listed in zip(model.tokens, model.listed, strict=True) if is_listed}

    def print_of(raw: bytes) -> int:
        data = np.frombuffer(raw, dtype=np.uint8)
        return int(K.word_hashes(data, np.array([0]), np.array([len(data)]))[0])

    for r in toxicity.score(docs, model).select("text", "score").collect():
        own = set()
        for raw in re.findall(rb"[a-z\x80-\xff]+", lower(r["text"]).encode()):
            own.add(print_of(raw) & 0xFFFFFFFF)
            for n in toxicity.BEGINNINGS:
                if len(raw) > n:
                    own.add(int(K.mix(np.array([print_of(raw[:n]) + n], dtype=np.uint64))[0]) & 0xFFFFFFFF)
        hit = own & weights.keys()
        words = len(hit & listed)
        total = model.intercept + sum(weights[t] for t in hit) + (words >= 1) * model.groups[0] + (words >= 2) * model.groups[1]
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))) < 1e-9


def test_toxicity_on_held_out_rows(spark):
    base = "/root/testdata/sf0.1"
    out = toxicity.query(spark, base).where("held_out").join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    caught = sum(r["predicted"] and r["toxic"] for r in out)
    assert caught >= 0.75 * sum(r["toxic"] for r in out) > 50 and caught >= 0.97 * sum(r["predicted"] for r in out)
    none = spark.createDataFrame([(None, "x")], "doc_id long, text string")
    assert none.select(toxicity.held_out("doc_id")).first()[0] is False
