"""Line deduplication against a plain Python version of its template tree, runs and copy groups."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from gazette.llm import kernels as K
from gazette.llm import line_dedup

from .test_llm import SF, WORD, brute_components, docs, lower, nothing, odd  # noqa: F401

FIELD = re.compile(r"[0-9@/_=]")


def word_print(w, cache={}):  # noqa: B006
    if w not in cache:
        raw = np.frombuffer(w.encode(), dtype=np.uint8)
        cache[w] = int(K.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
    return cache[w]


def ident(words):
    """What a run of words is compared by."""
    masked = tuple("<*>" if FIELD.search(w) else w for w in words)
    return tuple(words) if 4 * masked.count("<*>") > len(words) else masked


def line_print(line):
    return int(line_dedup.Parsed(pa.RecordBatch.from_pydict({"text": pa.array([line])})).line_key[0])


class Plain:
    def __init__(self, text, min_words=3, full=8):
        self.lines = [WORD.findall(x) for x in lower(text).split("\n")]
        self.pieces, self.runs = [], []
        for k, line in enumerate(self.lines):
            sentence, piece = [], []
            for j, w in enumerate(line):
                sentence.append(w)
                if w[-1] in ".!?" or j == len(line) - 1:
                    for i, w in enumerate(sentence):
                        piece.append(w)
                        if (len(sentence) > 16 and (word_print(w) >> 20) % 8 == 0) or (i == len(sentence) - 1 and ((word_print(w) >> 20) % 2 == 0 or j == len(line) - 1)):
                            self.pieces.append((k, piece))
                            piece = []
                    sentence = []
        for i, (_, piece) in enumerate(self.pieces):
            run = []
            for j in range(i, len(self.pieces)):
                run += self.pieces[j][1]
                if len(run) >= full:
                    self.runs.append((ident(run), i, j))
                    break
            ends = i == len(self.pieces) - 1 or self.pieces[i + 1][0] != self.pieces[i][0]
            if len(piece) < full and ends:
                run = []
                for j in range(i, -1, -1):
                    run = self.pieces[j][1] + run
                    if len(run) >= full:
                        self.runs.append((ident(run), j, i))
                        break
        self.units = {ident(x): len(x) < full for x in self.lines if len(x) >= min_words}
        self.units.update({u: False for u, _, _ in self.runs})

    def left(self, dropped, min_words=3):
        covered = {i for u, a, b in self.runs if u in dropped for i in range(a, b + 1)}
        out = {k for k, x in enumerate(self.lines) if x and (len(x) >= min_words and ident(x) in dropped)}
        out |= {k for k, x in enumerate(self.lines) if x and all(i in covered for i, (line, _) in enumerate(self.pieces) if line == k)}
        return [w for i, (k, piece) in enumerate(self.pieces) if k not in out and i not in covered for w in piece]


def tree(lines):
    """Template of each line (given by what it is compared by) that shares one. lines: identity -> its words as they are."""
    leaves = defaultdict(dict)
    for u, words in lines.items():
        masked = tuple("<*>" if FIELD.search(w) else w for w in words)
        if 8 <= len(words) <= 32 and 4 * masked.count("<*>") <= len(words):
            leaves[len(words), masked[:3]][line_print(" ".join(words))] = masked
    found = {}
    for leaf, rest in leaves.items():
        if len(rest) < 2:
            continue
        agree = lambda a, b: np.mean([x == y for x, y in zip(a, b, strict=True)]) >= 0.75
        number = 8
        while True:
            # A line without any block in common has no partner: it neither is a seed nor takes part.
            blocks = {k: {(j, tuple(masked[i] for i in places)) for j, places in enumerate(np.array_split(np.arange(3, len(masked)), len(masked) // 4 + 1))} for k, masked in rest.items()}
            held = Counter(x for own in blocks.values() for x in own)
            assert not any(agree(a, b) and not blocks[j] & blocks[k] for (j, a), (k, b) in itertools.combinations(rest.items(), 2))
            rest = {k: v for k, v in rest.items() if any(held[x] > 1 for x in blocks[k])}
            if not rest:
                break
            slots = {}
            for k in sorted(rest):
                slots.setdefault(k % number, k)
            number = min(2 * number, 32)
            seeds = []
            for k in sorted(slots.values()):
                if not any(np.mean([x == y for x, y in zip(rest[k], rest[s], strict=True)]) >= 0.75 for s in seeds):
                    seeds.append(k)
            joined = defaultdict(list)
            for k in list(rest):
                near = [s for s in seeds if np.mean([x == y for x, y in zip(rest[k], rest[s], strict=True)]) >= 0.75]
                if near:
                    joined[near[0]].append(k)
            for s, ks in joined.items():
                if len(ks) > 1:
                    found.update({rest[k]: (leaf, s) for k in ks})
            gone = {k for ks in joined.values() for k in ks}
            rest = {k: v for k, v in rest.items() if k not in gone}
    return found


def brute(rows, min_words=3, full=8, many=5):
    """Words that each document keeps, and which documents lose some."""
    plain = {i: Plain(t or "") for i, t in rows}
    templates = tree({ident(x): x for p in plain.values() for x in p.lines if len(x) >= min_words})
    group = {i: c for i, _, c in brute_components(rows)}
    holders, short = defaultdict(set), {}
    for i, p in plain.items():
        for u, s in p.units.items():
            holders[u].add(group[i])
            short[u] = s and short.get(u, True)
        for x in p.lines:
            if ident(x) in templates:
                holders["tree", templates[ident(x)]].add(group[i])
    kept = {}
    for i, p in plain.items():
        goes = lambda u: len(holders[u]) > 1 and (not short.get(u) or len(holders[u]) >= many) and min(holders[u]) != group[i]  # noqa: E731, B023
        dropped = {u for u in p.units if goes(u)} | {ident(x) for x in p.lines if ident(x) in templates and goes(("tree", templates[ident(x)]))}
        kept[i] = p.left(dropped)
    return kept


def compare(df, rows):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect() if r["doc_id"] is not None}
    want = brute(rows)
    lost = 0
    for i, t in rows:
        assert WORD.findall(lower(got[i]["text"])) == want[i], i
        words = len(WORD.findall(t or ""))
        assert got[i]["n_dropped_words"] == words - len(want[i])
        assert got[i]["n_dropped"] or got[i]["text"] == t
        lost += got[i]["n_dropped"] > 0
    return lost


def test_against_plain_python(spark, docs):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert compare(docs, rows) > 3


@pytest.mark.parametrize("seed", [1, 2])
def test_log_lines_against_plain_python(spark, seed):
    """Lines with variable words, passages inside unpunctuated lines, short lines, copies."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    some = [word() for _ in range(30)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(rng.integers(1, 25))) for _ in range(4)]
        lines.insert(int(rng.integers(4)), f"posted by user {rng.choice(some)} in the section {rng.choice(some)} of this site on day {rng.integers(99)}")
        if rng.random() < 0.5:
            lines.append(f"session was opened for {rng.choice(some)} from the host {rng.choice(some)} without any error at all")
        if rng.random() < 0.3:
            lines.append("see also this")
        if rng.random() < 0.3:
            lines.append(" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]))
        rows.append((i, "\n".join(lines)))
    rows += [(60 + k, rows[k][1] + ("" if k % 2 else " more")) for k in range(0, 20, 3)] + [(90, None), (91, ""), (92, "\n \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert compare(df, rows) > 30


def test_wildcards(spark):
    """Positions that vary among similar lines of a leaf are wildcards; other lines of the leaf stay apart."""
    line = "the quick report of %s was sent to %s in the morning hours today"
    texts = [line % p for p in [("alpha", "beta"), ("gamma", "delta"), ("eps", "zeta")]] + ["the quick report " + " ".join("w" + c for c in "abcdefghij")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {0: texts[0], 1: "", 2: "", 3: texts[3]}
    found = line_dedup.units(df.withColumnRenamed("doc_id", "doc"))
    learnt = line_dedup.learn_templates(found.where("leaf is not null").select("leaf", "key", "tokens")).collect()
    assert len(learnt) == 3 and len({r["template"] for r in learnt}) == 1


def test_crowded_leaf(spark):
    """More unlike lines in one leaf than there are seeds."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows = [(i, "all of them " + " ".join(word() for _ in range(9))) for i in range(40)]
    rows += [(40 + i, rows[i][1].rsplit(" ", 1)[0] + " " + word()) for i in range(0, 40, 5)]
    assert compare(spark.createDataFrame(rows, "doc_id long, text string"), rows) > 3


def test_every_template_of_a_leaf(spark):
    """Forty templates of two documents each in one leaf, among many unlike lines: all are learnt, and their second lines go."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    lines = ["all of them " + " ".join(word() for _ in range(9)) for _ in range(40)]
    rows = [*enumerate(lines), *((100 + i, x.rsplit(" ", 1)[0] + " " + word()) for i, x in enumerate(lines)), *((200 + i, "all of them " + " ".join(word() for _ in range(9))) for i in range(100))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert compare(df, rows) == 40


def test_near_copies_lose_nothing_to_each_other(spark):
    """Documents of 50 to 110 words with one word edited: whatever share of their pieces still recurs, they are copies, and stay so."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), 6))
    rows = []
    for i in range(200):
        words = [word() + ("." if rng.random() < 0.1 else "") for _ in range(rng.integers(50, 111))]
        edited = list(words)
        edited[int(rng.integers(len(words)))] = "edited"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
    alike = {i for i, _, c in brute_components(rows) if c != i}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert len(alike) > 150 and all(got[i]["n_dropped"] == 0 and got[i - 1]["n_dropped"] == 0 for i in alike)


def test_passages_inside_lines(spark):
    """A passage of over 50 words goes wherever it begins and ends, but for its edges."""
    rng = np.random.default_rng(4)
    words = lambda n: ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(n)]
    passages = [words(80) for _ in range(12)]
    rows = [(i, " ".join(words(40) + passages[i % 12] + words(40))) for i in range(24)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_dropped"] == 0 for i in range(12))
    assert all(0 < got[i]["n_dropped_words"] <= 80 for i in range(12, 24)) and np.mean([got[i]["n_dropped_words"] for i in range(12, 24)]) > 55


def test_names_repeats_and_nothing(spark, odd, nothing):  # noqa: F811
    line = "a line of more than eight words that two documents hold"
    rows = [(1, "short one here", 1, 2, 3, 4)] * 4 + [(2, "short one here\n" + line, 1, 2, 3, 4), (3, line, 1, 2, 3, 4), (None, line, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "DOC_ID long, text string, of int, gone int, key int, n_dropped int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["DOC_ID", "text", "of", "gone", "key", "n_dropped", "n_dropped_words"]
    out = [(r[0], r["text"], r["of"]) for r in got.collect()]
    assert sorted(out, key=str) == sorted([(1, "short one here", 1)] * 4 + [(2, "short one here\n" + line, 1), (3, "", 1), (None, line, 1)], key=str)
    assert line_dedup.dedup_lines(nothing).count() == 0
    whole = {r["doc_id"]: r for r in line_dedup.dedup_lines(odd[1]).where("n_dropped = 0").collect()}
    assert all(whole[i]["text"] == t for i, t in odd[0] if i in whole and i is not None)
    assert line_dedup.dedup_lines(df.withColumn("text", F.lit(None).cast("string"))).where("text is not null").count() == 0


def test_every_line_meets_the_tree(spark, tmp_path):
    """The query's templates have lines of any length: paragraphs that differ in up to eight places, and short lines that five documents hold."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), 6))
    paragraph = [word() for _ in range(60)]

    def edited(places):
        return " ".join(word() if i in places else w for i, w in enumerate(paragraph))

    few, many = [set(range(4, 60, 7))] * 3, [set(range(4, 60, 5))] * 2
    texts = [" ".join(paragraph), *(edited(x) for x in few), *(edited(x) for x in many), *(f"it was seen by {word()}" for _ in range(6)), *(f"it is held by {word()}" for _ in range(4))]
    own = [" ".join(word() for _ in range(20)) for _ in texts]
    rows = [(i, f"{a}\n{b}") for i, (a, b) in enumerate(zip(own, texts, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in line_dedup.query(spark, str(tmp_path)).collect()}
    kept = {i for i, t in got.items() if t == rows[i][1]}
    assert kept >= {0, 4, 5, 6, 12, 13, 14, 15} and not kept & {1, 2, 3, 7, 8, 9, 10, 11}
    assert all(got[i] == own[i] for i in got if i not in kept)


@pytest.mark.parametrize("workers, blocks", [(1, 1), (5, 3), (40, 7)])
def test_what_recurs_is_found_in_payloads(workers, blocks):
    """Lines and runs leave a worker packed, each once; what it met in several documents is a row at once, the rest where a block shows it."""
    rng = np.random.default_rng(workers)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 300)
    doc, key = rng.integers(0, 90, 900), keys[np.minimum(rng.geometric(0.01, 900), 300) - 1]
    short = key % 2 == 0
    dealt = [b for i in range(workers) for b in line_dedup._deal([(doc[i::workers], key[i::workers], short[i::workers])], blocks)]
    dealt = pa.Table.from_batches(dealt)
    packed = dealt.filter(dealt.column("block").is_valid())
    got = dealt.filter(dealt.column("block").is_null()).select(["doc", "key", "short"]).to_pylist()
    for b in range(blocks):
        if (own := packed.filter(pc.equal(packed.column("block"), b))).num_rows:
            got += line_dedup._recurs(own).to_pylist()
    holders = defaultdict(set)
    for d, k in zip(doc.tolist(), key.tolist(), strict=True):
        holders[k].add(d)
    assert packed.num_rows <= workers * blocks
    assert {(r["doc"], r["key"], r["short"]) for r in got} == {(d, k, k % 2 == 0) for k, ds in holders.items() if len(ds) > 1 for d in ds}


def every_line(lines):
    """As ``tree``, for lines of any length: at most one in four of their positions and eight in all may vary."""
    leaves = defaultdict(dict)
    for u, words in lines.items():
        masked = tuple("<*>" if FIELD.search(w) else w for w in words)
        if 4 * masked.count("<*>") <= len(words):
            leaves[len(words), masked[:3]][line_print(" ".join(words))] = masked
    found = {}
    for leaf, rest in leaves.items():
        varying, number = min(leaf[0] // 4, 8), 8
        agree = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) <= varying  # noqa: E731, B023
        while len(rest) > 1:
            blocks = {k: {(j, tuple(masked[i] for i in places)) for j, places in enumerate(np.array_split(np.arange(min(3, leaf[0]), leaf[0]), varying + 1))} for k, masked in rest.items()}
            held = Counter(x for own in blocks.values() for x in own)
            rest = {k: v for k, v in rest.items() if any(held[x] > 1 for x in blocks[k])}
            slots, seeds, joined = {}, [], defaultdict(list)
            for k in sorted(rest):
                slots.setdefault(k % number, k)
            number = min(2 * number, 32)
            for k in sorted(slots.values()):
                if not any(agree(rest[k], rest[s]) for s in seeds):
                    seeds.append(k)
            for k in rest:
                if near := [s for s in seeds if agree(rest[k], rest[s])]:
                    joined[near[0]].append(k)
            found.update({rest[k]: (leaf, s) for s, ks in joined.items() if len(ks) > 1 for k in ks})
            gone = {k for ks in joined.values() for k in ks}
            rest = {k: v for k, v in rest.items() if k not in gone}
    return found


def test_pipeline_stage_of_every_line(spark, docs, monkeypatch):  # noqa: F811
    """The pipeline's stage drops what op7 drops: lines of under 8 and over 32 tokens meet the tree, too."""
    import corpus_pipeline as pipe

    monkeypatch.setitem(globals(), "tree", every_line)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: WORD.findall(lower(r["text"] or "")) for r in pipe.drop_lines(spark, docs, SF).collect()}
    assert got == brute(rows)
    monkeypatch.undo()
    assert sum(map(len, got.values())) < sum(map(len, brute(rows).values()))
