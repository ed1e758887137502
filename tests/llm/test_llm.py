"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gazette.llm import bpe, chat, decontamination, html, licenses, line_dedup, ngram_join, quality, sharding, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, words string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k=5):
    w = WORD.findall(lower(t))
    return frozenset({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else ())


def odd_rows():
    rng = np.random.default_rng(5)
    vocab = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(vocab, 60)) for _ in range(6)]
    texts = [None, "", " \n\t", "One", "one", "a b c", "ÄÖ ß é", "x" * 50_000 + " y z", " ".join(rng.choice(vocab, 20_000)), *base, *base[:3]]
    for t in base:
        for k in (1, 2, 3, 5, 9):
            w = t.split()
            for i in rng.choice(60, k, replace=False):
                w[i] = "edit%d" % rng.integers(1000)
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[10], (None, "no id at all"), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    return rows, spark.createDataFrame([(i, t, "en", "s", 1, 7, "clash") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            n = len(a & b)
            if a and b and 100 * n >= 80 * (len(a) + len(b) - n):
                parent[find(x)] = find(y)
    low = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        if i is not None:
            low[find(x)].append(i)
    return sorted((i, len(s), min(low[find(x)], default=None)) for x, (i, s) in enumerate(sets) if i is not None)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_ngram_join(spark, odd, docs, which):
    rows, df = odd if which == "odd" else ([tuple(r) for r in docs.select("doc_id", "text").collect()], docs)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect() if r["doc_id"] is not None)
    assert got == brute_components(rows)


def test_ngram_join_of_nothing(nothing):
    assert ngram_join.jaccard_components(nothing).count() == 0


def test_decontamination(spark, odd):
    rows, df = odd
    long = next(t for i, t in rows if i == 8).split()
    items = [(1, " ".join(long[500:520])), (2, " ".join(long[900:915]) + " other words go here"), (3, None), (4, ""), (5, "a b c"), (6, rows[9][1])]
    asked = spark.createDataFrame(items, "item_id long, text string")
    items.append((7, "b C"))
    want = set()
    for k, q in items:
        width = min(5, len(WORD.findall(q or "")))
        s = shingles(q, width) if width else ()
        for i, t in rows:
            own = shingles(t, width) if width and len(WORD.findall(t or "")) >= width else frozenset()
            if s and i is not None and 100 * len(s & own) >= 80 * len(s):
                want.add((i, k))
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(df, asked).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and len(want) > 3
    assert decontamination.contaminated(df.limit(0), asked).count() == 0
    assert decontamination.contaminated(df, asked.limit(0)).count() == 0


def test_chat(spark):
    m = spark.createDataFrame(
        [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.5), (1, 3, 1, "assistant", "good <|im_end|>", 2.0), (1, 4, 3, "user", None, 0.0), (2, 1, 99, "ro\nle", "<\\|x", None)],
        "tree long, node long, parent long, role string, text string, score double",
    )
    out = {r["tree"]: r for r in chat.format_trees(m).collect()}
    assert chat.read_turns(out[1]["formatted"]) == [("user", "q"), ("assistant", "good <|im_end|>"), ("user", "")]
    assert chat.read_turns(out[2]["formatted"]) == [("ro\nle", "<\\|x")]
    assert [chat.unescape(out[1]["formatted"][s["start"] : s["end"]]) for s in out[1]["loss"]] == ["good <|im_end|>"]
    assert chat.format_trees(m, best=5).count() == 3
    assert chat.format_trees(m.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.format_trees(spark.createDataFrame([(1, 1, 2, "u", "t", 1.0), (1, 2, 1, "u", "t", 1.0)], m.schema)).count()


def test_chat_query(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect():
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-1] = [(r, "<|im_end|><|im_start|>assistant ok") for r in ("user", "assistant")]
    got = {r["conv_id"]: r for r in chat.query(spark, SF).collect()}
    assert got.keys() == turns.keys()
    for i, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert got[i]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert (got[i]["n_turns"], got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(ts), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def repeated(words):
    seen = defaultdict(list)
    for j in range(len(words) - 7):
        seen[tuple(words[j : j + 8])].append(j)
    return len({k for at in seen.values() if len(at) > 1 for j in at for k in range(j, j + 8)})


def test_quality_statistics(spark, odd):
    rows, df = odd
    extra = "a b c d e f g h i j " * 3 + "\nline one\nline one\n\n\nline one\n## $5 <b>|"
    more = spark.createDataFrame([(900, extra, "en", "s", 1, 7, "c")], DOCS)
    got = {(r["doc_id"], r["text"]): r for r in quality.judge(df.union(more), []).collect()}
    for i, t in [*rows, (900, extra)]:
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i, t]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeated(w))
        assert r["base_failed"] == (len(w) < 20 or 100 * repeated(w) > 30 * len(w)) and r["words"] in ("clash", "c")


def test_quality_learns_a_rule(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join("w%d" % x + ("###" if i % 4 == 0 else "") for x in rng.integers(0, 300, 60)) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)], "doc_id long, quality int")
    rules = quality.learn(df, labels)
    assert rules and "symbol" in str(rules[0])
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in quality.judge(df, rules).collect())
    assert quality.learn(df, labels.limit(0)) == []


def test_quality_verdict_by_hand(spark, docs):
    """The learnt list applied in plain Python to the statistics gives the same verdicts; any column name may be there already."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality.learn(docs, labels) or [quality.Rule((("symbols_per_word", True, 0.2), ("words", False, 200.0)), 1, 1.0)]
    names = {"_w": 1, "_l": 2, "_h": 3, "_o": 4, "_p": 5, "_x": 6, "N_WORDS": 7, "kept": 8, "symbols_per_word": 9}
    got = quality.judge(docs.withColumns({k: F.lit(v) for k, v in names.items()}), rules)
    assert set(names) - set(got.columns) == {"N_WORDS"} and "n_words" in got.columns
    for r in got.collect():
        n = max(r["n_words"], 1)
        ratios = {
            "words": r["n_words"], "mean_word": r["word_chars"] / n, "symbols_per_word": r["n_symbols"] / n, "symbol_share": r["n_symbols"] / max(r["word_chars"], 1), "dup_lines": r["n_dup_lines"], "dup_line_share": r["n_dup_lines"] / max(r["n_lines"], 1),
            "repeat_share": r["n_repeat_words"] / n, "distinct_share": r["n_distinct"] / n, "digit_share": r["n_digits"] / max(r["word_chars"], 1),
        }
        fires = any(all(ratios[f] >= c if up else ratios[f] < c for f, up, c in rule.conditions) for rule in rules)
        assert r["kept"] == (not r["base_failed"] and not fires) and r["_w"] == 1
    assert quality.judge(docs.limit(0), rules).count() == 0


def best_capacity(sizes, k):
    low, high = max(max(sizes), -(-sum(sizes) // k)), sum(sizes)

    def needs(c):
        n, left = 1, c
        for s in sizes:
            if s > left:
                n, left = n + 1, c
            left -= s
        return n

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needs(mid) <= k else (mid + 1, high)
    return low


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_sharding(spark, odd, docs, which):
    df = odd[1] if which == "odd" else docs
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    out = sharding.shard(df).collect()
    assert len(out) == len(rows) and {r["shard"] for r in out} <= set(range(8)) and {r["law"] for r in out} == {"bytes"}
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, loads = defaultdict(list), defaultdict(int)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(int)
    for _, t in rows:
        raw = (t or "").encode()
        groups[hashlib.md5(raw).hexdigest()] += len(raw) + 1
    assert max(loads.values()) == best_capacity([groups[k] for k in sorted(groups)], 8)
    assert sharding.shard(df.limit(0)).count() == 0


def test_sharding_sends_few_rows_to_the_driver(spark, docs, monkeypatch):
    """Digit by digit: no fetch brings more than its bound, whatever the number of groups, and the cuts stay the best ones."""
    rows = docs.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size")).withColumn("bucket", F.conv(F.substring("digest", 1, 4), 16, 10).cast("int")).persist()
    want = sharding.minimax_cuts(groups, 8)
    monkeypatch.setattr(sharding, "DIGITS", 1)
    monkeypatch.setattr(sharding, "CHILDREN", 16)
    monkeypatch.setattr(sharding, "HELD", 64)
    lines = []
    monkeypatch.setattr(sharding, "_Line", type("Seen", (sharding._Line,), {"__init__": lambda self, g: (lines.append(self), super(type(self), self).__init__(g))[0] and None}))
    assert sharding.minimax_cuts(groups, 8) == want and groups.count() > 100
    assert lines[0].most_fetched <= 16 and sum(len(n[0]) for n in lines[0].nodes.values()) <= 64
    groups.unpersist()


def test_bpe(spark, odd):
    rows, df = odd
    import public_tokenizers

    enc = bpe.encoding(public_tokenizers.path(bpe.RANK_FILE), public_tokenizers.PATTERN)
    for r in bpe.round_trip(df.where("doc_id is not null")).collect():
        texts = [t or "" for i, t in rows if i == r["doc_id"]]
        assert r["decoded_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for t in texts}
        assert r["ids_sha256"] in {hashlib.sha256(np.array(enc.encode_ordinary(t), "<u4").tobytes()).hexdigest() for t in texts}
    text = "It's 12,5 <|endoftext|>  é\n\n ß  " * 400 + "x" * 300 + "\t\n a  b"
    for limit in (7, 50, 333):
        assert "".join(bpe.pieces(text, limit)) == text and list(bpe.encode_text(enc, text, limit)) == enc.encode_ordinary(text)
    assert bpe.round_trip(df.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(df))
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect())


def test_line_dedup(spark, odd):
    passage = "This passage of many words is found in more than one of all these documents here."
    name = lambda *x: "".join(chr(97 + i) for i in x)
    own = ["alpha%s beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi %s" % (name(i), " ".join("own" + name(i, k % 26, k // 26) for k in range(30))) for i in range(12)]
    rows = [(i, f"{own[i]}\n{passage}\nlast{name(i)} line of it") for i in range(10)] + [(10, own[10]), (11, f"{own[11]} First {own[10][:5]}x. {passage}"), (12, None), (13, ""), (None, passage)]
    rows += [(20, "Page 3 of 10 was seen by you on this day\n" + "q%s " % "ab" * 30), (21, "Page 7 of 12 was seen by you on this day\n" + "r%s " % "cd" * 30)]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, doc string, template string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[0]["text"] == rows[0][1] and got[10]["text"] == own[10] and got[12]["text"] is None and got[13]["text"] == "" and got[None]["text"] == passage
    assert all(passage not in got[i]["text"] and own[i] in got[i]["text"] and f"last{name(i)}" in got[i]["text"] and got[i]["n_dropped_words"] == 16 for i in range(1, 10))
    assert passage not in got[11]["text"] and own[11] in got[11]["text"]
    assert got[20]["n_dropped"] == 0 and got[21]["n_dropped"] == 1 and got[21]["text"].startswith("r")
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    whole = {r["doc_id"]: r for r in line_dedup.dedup_lines(odd[1]).where("n_dropped = 0").collect()}
    assert all(whole[i]["text"] == t for i, t in odd[0] if i in whole and i is not None)


def test_line_dedup_drops_whatever_the_share(spark):
    """A passage that is most of a short document goes; copies of one document lose nothing to each other."""
    passage = " ".join("shared" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(60))
    word = lambda i, k: "own" + chr(97 + i) + chr(97 + k % 26) + chr(97 + k // 26)
    rows = [(i, passage + "\n" + " ".join(word(i, k) for k in range(20))) for i in range(4)] + [(7, passage)]
    rows += [(i, "\n".join(" ".join(word(20, 10 * j + k) for k in range(10)) for j in range(20)) + end) for i, end in ((8, ""), (9, ""), (10, "\nlast words of it"))]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_dropped_words"] for i in range(4)] == [0, 60, 60, 60] and got[7]["text"] == ""
    assert all(passage not in got[i]["text"] and word(i, 19) in got[i]["text"] for i in range(1, 4))
    assert all(got[i]["text"] == t for i, t in rows if i in (8, 9, 10))


def test_line_dedup_joins_short_units(spark):
    """A passage of lines and sentences of one to five words goes as a whole where two documents share it."""
    word = lambda i, k: "own" + chr(97 + i) + chr(97 + k % 26) + chr(97 + k // 26)
    own = ["\n".join(" ".join(word(i, 12 * j + k) for k in range(12)) for j in range(6)) for i in range(4)]
    shared = [" ".join(word(20, 5 * j + k) for k in range(1 + j % 5)) for j in range(20)]
    verse, inline = "\n".join(shared), ". ".join(shared) + "."
    rows = [(0, f"{own[0]}\n{verse}\n{own[0][::-1]}"), (1, f"{own[1]}\n{verse}\n{own[1][::-1]}"), (2, f"{own[2]}. {inline}"), (3, f"{own[3]}. {inline}"), (4, "Yes.\nNo."), (5, "Yes.\nNo.")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["text"] for i in (0, 2, 4, 5)] == [rows[i][1] for i in (0, 2, 4, 5)]
    assert got[1]["text"] == f"{own[1]}\n{own[1][::-1]}" and got[1]["n_dropped_words"] == len(verse.split())
    assert got[3]["text"].strip() == f"{own[3]}."


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, as all do.</p></div><article><h1>Head &amp; shoulders</h1><p>First <b>par</b>agraph,
with   words.<p>Second one&nbsp;here.<div class="ad">Buy now.</div><ul><li>item one</li></ul><div id="comments"><p>Nice text, thank you all for it.</p></div></article>
<aside><p>Other stories that you may like to read today.</p></aside><form><p>Your mail</p><input></form><script>var a="<p>no</p>"</script><footer>&copy; us</footer>"""


def test_html(spark):
    assert html.main_text(PAGE) == "Head & shoulders First paragraph, with words. Second one here. item one"
    assert html.main_text("") == html.main_text("<p") == html.main_text("<p class='x") == "" and isinstance(html.main_text("<a <b> & &#xZZ; <!-- "), str)
    plain = "<div><div>" + "".join(f"<a href=/{i}>link {i}</a> " for i in range(9)) + "</div><div><p>" + "A long sentence of the story with many words in it goes here. " * 4 + "</p><p>" + "It goes on with another paragraph of words. " * 4 + "</p></div></div>"
    assert html.main_text(plain).startswith("A long sentence") and "link 3" not in html.main_text(plain)
    df = spark.createDataFrame([(1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, 3), (None, "v", "", 3), (4, "w", "<p>" * 3000 + "deep" * 1000, 3)], "page_id long, url string, html string, text int")
    got = html.extract(df).collect()
    assert len(got) == 5 and sum(r["text"].startswith("Head") for r in got) == 2 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(df.limit(0)).count() == 0


def test_min_cut_is_minimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        own = (rng.integers(-40, 40, n) / 10).tolist()
        ties = [(i, j, float(rng.integers(0, 30)) / 10) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]

        def cost(x):
            return sum(max(o, 0) if not k else max(-o, 0) for o, k in zip(own, x, strict=True)) + sum(c for i, j, c in ties if x[i] != x[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html.min_cut(own, ties)) - best) < 1e-6


def test_toxicity(spark, odd):
    rng = np.random.default_rng(2)
    vocab = ["w%s" % "".join(rng.choice(list("abcdefgh"), 5)) for _ in range(500)]
    rows = []
    for i in range(900):
        w = list(rng.choice(vocab, 80))
        bad = i % 9 == 0
        if bad:
            for k in rng.choice(80, 4, replace=False):
                w[k] = str(rng.choice(["idiot", "scum", "zorgblat" + str(rng.choice(list("xyz"))), "zorgblin"]))
        rows.append((i, " ".join(w), int(bad) if rng.random() > 0.03 else int(not bad), bad))
    df = spark.createDataFrame([(i, t, "en") for i, t, _, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r["p"] for r in toxicity.score(df, model, out="p").collect()}
    out = [(got[i] >= 0.7, bad) for i, _, _, bad in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p and not b for p, b in out) <= 1 and sum(p and b for p, b in out) >= 0.9 * sum(b for _, b in out)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(df, flipped)
    assert np.array_equal(model.tokens, again.tokens) and np.array_equal(model.weights, again.weights)
    strange = toxicity.score(odd[1], model).collect()
    assert len(strange) == len(odd[0]) and all(0 <= r["score"] <= 1 for r in strange)
    empty = toxicity.fit(df, labels.limit(0))
    assert toxicity.score(df, empty).agg(F.max("score")).first()[0] < 0.7
    assert toxicity.score(df.limit(0), model).count() == 0


def test_licenses(spark, odd):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    tricky = [(100, "cc by"), (101, "nc CC-BY-NC 4.0 x"), (102, "Licensed under the Apache License, Version 2.0 cc by nc cc by nc"), (103, "under the"), (104, "MIT license"), (105, "This work is licensed under the GNU General Public License, version 3.")]
    rows = [*odd[0], *tricky]
    df = odd[1].select("doc_id", "text", "n", "words").union(spark.createDataFrame([(i, t, 1, "x") for i, t in tricky], "doc_id long, text string, n int, words string"))
    got = defaultdict(list)
    for r in licenses.scan(df).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(j, label) for p, label in phrases.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        want = (len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert want in [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got[i]]
    assert got[105][0]["labels"] == "gpl-3" and got[104][0]["base_labels"] == "" and got[102][0]["labels"] == "apache-2,cc-by-nc"
    assert licenses.scan(df.limit(0)).count() == 0


def test_copies_with_boilerplate_end_as_one(spark):
    """Exact and near copies that hold a passage of an earlier document are one document after the third stage."""
    import corpus_pipeline as pipe

    word = lambda i, k: "own" + chr(97 + i) + chr(97 + k % 26) + chr(97 + k // 26)
    lines = lambda i: [" ".join(word(i, 10 * j + k) for k in range(10)) for j in range(12)]
    passage = lines(20)
    copy = "\n".join([*lines(1), *passage])
    near = "\n".join([*lines(1)[:-1], word(25, 0) + lines(1)[-1], *passage])
    texts = {0: "\n".join([*lines(0), *passage]), 3: copy, 5: copy, 6: near, 9: "\n".join(passage[:3] + lines(2))}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for name, stage in pipe.STAGES[1:3]:
        kept = pipe.table(stage(spark, kept, SF), "test")
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(got) == {0, 3, 9} and got[0] == texts[0] and got[3].strip() == "\n".join(lines(1)) and got[9].strip() == "\n".join(lines(2))


def test_pipeline(spark):
    """Each stage against brute force over what the one before it kept."""
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [r for r in docs.collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in pipe.STAGES:
        before, docs = kept, pipe.table(stage(spark, docs, SF), "test")
        kept = docs.collect()
        if name == "toxicity":
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in kept}
            model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            scores = dict(zip([r["doc_id"] for r in before], model.scores(pa.array([r["text"] for r in before], pa.string())), strict=True))
            assert gone == {i for i, x in scores.items() if x >= 0.7} and not any(labels.get(i) == 0 for i in gone)
        elif name == "line dedup":
            from .test_line_dedup import brute

            left = brute([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"]: WORD.findall(lower(r["text"])) for r in kept} == left and all(r["n_chars"] == len(r["text"]) for r in kept)
        elif name.startswith("n-gram"):
            want = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in before])}
            assert {r["doc_id"] for r in kept} == want
        elif name.startswith("benchmark"):
            hit = {r["doc_id"] for r in before if any(s and 100 * len(s & shingles(r["text"])) >= 80 * len(s) for s in items)}
            assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in before} - hit
        else:
            texts = {r["doc_id"]: r["text"] for r in before}
            assert {r["doc_id"]: r["decoded_sha256"] for r in kept} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
        if len(docs.columns) > 4:
            assert docs.columns == pipe.COLUMNS


def test_near_copies_by_row(spark):
    """Rows are linked, not ids: nothing is lost whose component keeps no row."""
    import corpus_pipeline as pipe

    rng = np.random.default_rng(8)
    words = lambda: [str(w) for w in rng.choice(["v%d" % i for i in range(500)], 80)]
    a, b, c = words(), words(), words()
    near = " ".join([*b[:-1], "edit"])
    a, b, c = (" ".join(x) for x in (a, b, c))
    rows = [(1, a), (5, a), (5, b), (7, near), (9, c), (9, c), (None, c), (None, a + " x"), (11, None), (12, ""), (12, ""), (None, "alone without an id at all")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in pipe.drop_near_copies(spark, docs, SF).collect())
    assert got == sorted([(1, a), (5, b), (9, c), (11, ""), (12, ""), (12, ""), (-1, "alone without an id at all")])
    assert pipe.drop_near_copies(spark, docs.limit(0), SF).count() == 0
    linked = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert {(1, 1), (5, 1), (5, 5), (7, 5), (9, 9), (None, 9), (None, 1), (12, 12), (None, None)} <= linked


def test_ngram_join_tiles_of_long_lists(spark, odd):
    """Posting lists longer than a tile give the same links."""
    rows, df = odd
    before, ngram_join.TILE_ROWS = ngram_join.TILE_ROWS, 3
    rounds, ngram_join.PIVOT_ROUNDS = ngram_join.PIVOT_ROUNDS, 0
    try:
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect() if r["doc_id"] is not None)
    finally:
        ngram_join.TILE_ROWS, ngram_join.PIVOT_ROUNDS = before, rounds
    assert got == brute_components(rows)


def test_components_by_stars_and_by_one_task(spark, monkeypatch):
    from gazette.llm import shared

    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + k, 401 + k) for k in range(50)] + [(500, 600 + k) for k in range(50)]
    links = spark.createDataFrame(edges, "a long, b long")
    few = {r["node"]: r["component"] for r in shared.components(links).collect()}
    monkeypatch.setattr(shared, "FEW_EDGES", 0)
    many = {r["node"]: r["component"] for r in shared.components(links).collect()}
    assert few == many and few[450] == 400 and few[649] == 500 and 400 not in few
    assert shared.components(links.limit(0)).count() == 0


def test_ngram_join_without_pruning(spark, docs):
    a, b = (sorted((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(docs, prune=p).collect()) for p in (True, False))
    assert a == b


def test_pipeline_stages_take_odd_rows(spark, odd):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables pass through every stage."""
    import corpus_pipeline as pipe

    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in odd[0]], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, SF).collect()
        nothing = stage(spark, docs.limit(0), SF)
        assert nothing.count() == 0
        if name != "byte-level BPE":
            assert nothing.columns == pipe.COLUMNS
        if name in ("toxicity", "line dedup", "byte-level BPE", "benchmark decontamination"):
            assert len(out) == len(odd[0])
        else:
            texts = {t for _, t in odd[0] if t}
            assert {r["text"] for r in out if r["text"]} <= texts and sum(not r["text"] for r in out) == sum(not t for _, t in odd[0])
