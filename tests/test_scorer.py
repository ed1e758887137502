"""Calls of a scorer: bounded, timed, tried again, and remembered; a slow, a failing and a restarted one."""

import json
import os
import time

from pyspark.sql import functions as F

from gazette.operators import messages, scorer


def test_time_limit_and_tries():
    calls = scorer.Calls(seconds=0.2, tries=3, pause=0.01)
    began = time.time()
    assert scorer.patiently(lambda r: time.sleep(30), "x", calls) == (None, "no answer in 0.2 s", 3) and time.time() - began < 5
    seen = []

    def flaky(r):
        seen.append(r)
        if len(seen) < 3:
            raise OSError(f"down {len(seen)}")
        return r.upper()

    assert scorer.patiently(flaky, "x", calls) == ("X", None, 3)
    assert scorer.patiently(lambda r: 1 / 0, "x", calls) == (None, "division by zero", 3)
    assert scorer.patiently(lambda r: None, "x", calls) == (None, "no answer", 3)


def noted(folder, fail=(), slow=()):
    """A scorer that leaves a file for each call, as it may run in any process."""

    def call(request):
        with open(os.path.join(folder, f"{request}-{time.time_ns()}-{os.getpid()}"), "w"):
            pass
        if request in slow:
            time.sleep(20)
        if request in fail:
            raise RuntimeError("refused")
        return request.upper()

    return call


def asked(folder):
    return sorted(x.split("-")[0] for x in os.listdir(folder))


def test_no_request_is_asked_twice(spark, tmp_path):
    store, first, second, third = (str(tmp_path / x) for x in ("store", "a", "b", "c"))
    for folder in (first, second, third):
        os.mkdir(folder)
    df = spark.createDataFrame([(f"r{i % 12}",) for i in range(40)] + [(None,)], "request string")
    calls = scorer.Calls(at_once=8, in_task=4, seconds=1.0, tries=2, pause=0.01, wave=5)
    got = {r["request"]: r for r in scorer.ask(df, noted(first, fail=("r3",), slow=("r4",)), calls, store, "s").collect()}
    assert len(got) == 12 and got["r5"]["answer"] == "R5" and (got["r3"]["answer"], got["r3"]["error"], got["r3"]["tries"]) == (None, "refused", 2) and got["r4"]["error"].startswith("no answer")
    assert asked(first) == sorted([f"r{i}" for i in range(12)] + ["r3", "r4"])
    # A rerun asks for what failed and for what is new, and for nothing else.
    again = df.union(spark.createDataFrame([("new",)], "request string"))
    got = {r["request"]: r for r in scorer.ask(again, noted(second), calls, store, "s").collect()}
    assert asked(second) == ["new", "r3", "r4"] and got["r3"]["answer"] == "R3" and got["r5"]["tries"] == 0 and len(got) == 13
    assert scorer.ask(again, noted(third), calls, store, "s").where("answer = upper(request)").count() == 13 and asked(third) == []
    # Another scorer has no answers yet; without a store everything is asked.
    assert scorer.ask(df.limit(1), noted(third), calls, store, "t").count() == 1 and scorer.ask(df.limit(1), noted(third), calls).count() == 1 and len(asked(third)) == 2


def test_a_run_that_breaks_off(spark, tmp_path, monkeypatch):
    """What was saved before the driver died is not asked again."""
    store, folder = str(tmp_path / "store"), str(tmp_path / "calls")
    os.mkdir(folder)
    df = spark.createDataFrame([(f"r{i}",) for i in range(20)], "request string")
    calls = scorer.Calls(at_once=4, in_task=2, wave=4)
    save, saved = scorer.versions.save, []

    def dies(*args, **kwargs):
        if len(saved) == 2:
            raise KeyboardInterrupt
        saved.append(args[0].count())
        return save(*args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(scorer.versions, "save", dies)
        try:
            scorer.ask(df, noted(folder), calls, store)
            raise AssertionError
        except KeyboardInterrupt:
            pass
    before = len(asked(folder))
    assert scorer.ask(df, noted(folder), calls, store).where("answer is not null").count() == 20
    assert before < 20 and len(asked(folder)) - before == 20 - sum(saved)


def test_calls_at_once(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i}",) for i in range(30)], "request string")
    folder = str(tmp_path)

    def counts(request):
        mark = os.path.join(folder, request)
        open(mark, "w").close()
        busy = len(os.listdir(folder))
        time.sleep(0.1)
        os.remove(mark)
        return str(busy)

    got = scorer.ask(df, counts, scorer.Calls(at_once=6, in_task=3)).collect()
    assert 1 < max(int(r["answer"]) for r in got) <= 6


def test_decisions_and_translations(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"title {i}", "P") for i in range(20)], "pos long, title string, platform string")
    batches = messages.batch_messages(rows, "survey", "s", "t", size=8)

    def judge(request):
        articles = json.loads(json.loads(request)[1]["content"])["articles"]
        if any(a["article_id"] == "9" for a in articles):
            raise RuntimeError("refused")
        return json.dumps({"decisions": [{"article_id": a["article_id"], "relevant": int(a["article_id"]) % 2 == 0, "confidence": "high"} for a in articles]})

    got = {r["pos"]: r["relevant"] for r in scorer.decisions(batches, judge, scorer.Calls(tries=1), str(tmp_path / "s")).collect()}
    assert got == {i: i % 2 == 0 for i in range(20) if not 8 <= i < 16}
    out = scorer.translations(rows.withColumn("summary", F.lit("title 1")), ["title", "summary"], lambda t: t[::-1], store=str(tmp_path / "t")).where("pos = 1").first()
    assert (out["title_translated"], out["summary_translated"]) == ("1 eltit", "1 eltit")
