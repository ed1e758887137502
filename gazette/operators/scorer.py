"""Calls of a foreign scorer from the tasks: a bounded number at once, each with a time limit and retries, and none asked twice.

A request is a text (a batch of articles as messages, a text to translate). Answers are kept in a store of versions by a digest of
scorer and request, so a run that was broken off, or one over articles that were asked about before, asks only for what is missing.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import versions
from .stored import stored

ANSWERS = "digest string, answer string, error string, tries int"


@dataclass(frozen=True)
class Calls:
    """How a scorer may be called: calls at once in all tasks together and in one, seconds for one call, tries, and the pause before
    the second one (twice as long before each further one); requests that are asked before their answers are saved."""

    at_once: int = 24
    in_task: int = 4
    seconds: float = 180.0
    tries: int = 3
    pause: float = 0.5
    wave: int = 100_000


class TooSlow(Exception):
    """A call took more than its time."""


def timed(scorer: Callable[[str], str], request: str, seconds: float) -> str:
    """The scorer's answer; ``TooSlow`` if it takes longer. A call that hangs is left behind and holds no one up."""
    out: list = []

    def run() -> None:
        try:
            out.append((scorer(request), None))
        except Exception as e:  # noqa: BLE001  foreign code; what it raises is handed on
            out.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not out:
        raise TooSlow(f"no answer in {seconds:g} s")
    answer, error = out[0]
    if error is not None:
        raise error
    return answer


def patiently(scorer: Callable[[str], str], request: str, calls: Calls) -> tuple[str | None, str | None, int]:
    """(answer, error, tries) of a request: an answer of a try, or the last one's error. Pauses vary by a half, so that tasks that
    failed together do not come back together."""
    error = ""
    for k in range(calls.tries):
        if k:
            time.sleep(calls.pause * 2 ** (k - 1) * (0.75 + random.random() / 2))
        try:
            answer = timed(scorer, request, calls.seconds)
            if answer is not None:
                return str(answer), None, k + 1
            error = "no answer"
        except Exception as e:  # noqa: BLE001  foreign code; its request has no answer
            error = " ".join(str(e).split()) or type(e).__name__
    return None, error, calls.tries


def digest(request: Column, name: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(name), request), 256)


def _asked(requests: DataFrame, scorer: Callable[[str], str], calls: Calls) -> DataFrame:
    """Answers to (digest, request), of which each task has ``in_task`` on their way at most, and holds a few."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(calls.in_task) as pool:
            for frame in frames:
                for at in range(0, len(frame), 8 * calls.in_task):
                    part = frame.iloc[at : at + 8 * calls.in_task]
                    found = list(pool.map(lambda r: patiently(scorer, r, calls), part["request"]))
                    yield pd.DataFrame([(d, *f) for d, f in zip(part["digest"], found, strict=True)], columns=["digest", "answer", "error", "tries"])

    return requests.repartition(max(1, calls.at_once // calls.in_task)).mapInPandas(run, ANSWERS)


def _answered(requests: DataFrame, scorer: Callable[[str], str], calls: Calls, store: str | None, name: str) -> DataFrame:
    """(digest, answer, error, tries) of each distinct digest of (digest, request). A request is moved only where it is asked."""
    spark = requests.sparkSession
    if store is None:
        return stored(_asked(requests.dropDuplicates(["digest"]), scorer, calls))
    known = versions.read(spark, store) if versions.version(spark, store).number else spark.createDataFrame([], f"{ANSWERS}, _step string")
    known = known.select("digest", "answer", F.lit(None).cast("string").alias("error"), F.lit(0).alias("tries"))
    digests = stored(requests.select("digest").distinct())
    missing = requests.join(known.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    count = digests.join(known.select("digest"), "digest", "left_anti").count()
    waves = -(-count // calls.wave)
    # What several waves read is kept for them.
    if waves > 1:
        missing = stored(missing.withColumn("wave", F.pmod(F.xxhash64("digest"), F.lit(waves)).cast("int")))
    new = []
    for k in range(waves):
        part = missing.where(F.col("wave") == k).drop("wave") if waves > 1 else missing
        answers = stored(_asked(part.select("digest", "request"), scorer, calls))
        new.append(answers)
        step = f"{versions.version(spark, store).number + 1}-{k}-{random.getrandbits(64):016x}"
        versions.save(answers.where("answer is not null").withColumn("_step", F.lit(step)), store, ("_step",))
    every = known.join(digests, "digest", "left_semi")
    for answers in new:
        every = every.union(answers)
    return every


def ask(requests: DataFrame, scorer: Callable[[str], str], calls: Calls = Calls(), store: str | None = None, name: str = "") -> DataFrame:
    """(request, answer, error, tries) of each distinct request (a column of that name; null ones are not asked).

    With a ``store`` answers of a scorer of this ``name`` are taken from there, and new ones are saved there wave by wave: a run that
    breaks off loses a wave at most. Failures are not saved: the next run asks again. Tries are 0 for an answer that was there.
    A task that is lost asks its own requests of the wave again.
    """
    keyed = requests.where("request is not null").select("request").withColumn("digest", digest(F.col("request"), name))
    return keyed.dropDuplicates(["digest"]).join(_answered(keyed, scorer, calls, store, name), "digest").select("request", "answer", "error", "tries")


def decisions(batches: DataFrame, scorer: Callable[[str], str], calls: Calls = Calls(), store: str | None = None, name: str = "survey") -> DataFrame:
    """Decisions about the articles of ``messages.batch_messages`` (batch, n, messages); a batch that has no answer has none."""
    from . import messages

    keyed = batches.where("messages is not null").select("batch", F.col("messages").alias("request"), digest(F.col("messages"), name).alias("digest"))
    answers = _answered(keyed.select("digest", "request"), scorer, calls, store, name)
    return messages.decisions(keyed.select("batch", "digest").join(answers, "digest").where("answer is not null").select("batch", F.col("answer").alias("payload")))


def translations(rows: DataFrame, columns: list[str], translator: Callable[[str], str], calls: Calls = Calls(), store: str | None = None, name: str = "translation", suffix: str = "_translated") -> DataFrame:
    """Adds translated columns: every distinct text is asked for once, here and in all runs with the same store; null where it failed."""
    from ..functions import text

    texts = rows.select(F.explode(F.array(*(text.present(F.col(c)) for c in columns))).alias("request"))
    known = ask(texts, translator, calls, store, name).select(F.col("request").alias("_t"), F.col("answer").alias("_to"))
    out = rows
    for c in columns:
        out = out.withColumn("_t", text.present(F.col(c))).join(known, "_t", "left").withColumn(c + suffix, F.col("_to")).drop("_t", "_to")
    return out
