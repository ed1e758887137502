"""The state of running jobs, from their updates: time in a stage, what is left of it, a steady countdown and a monotone percentage.

One step takes a job's state and an update and gives the new state and what a reader is shown. ``status`` takes it over a stored
log, ``streaming.jobs`` over a stream with the state in a store; both give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

SECOND = 1_000_000
SHOWN = "kind string, seq long, stage string, stage_seconds long, stage_remaining long, remaining long, percent long, overdue boolean, signature string"
#: Stages whose messages count units, with the part that the plan keeps in the estimate and the slack that the plan is given.
UNITS = {"promo_search": (0.3, 1.1), "translation": (0.65, 1.2), "survey_filter": (0.65, 1.2), "ai_dedupe": (0.65, 1.2)}
#: Stages of which no time is kept.
UNTIMED = ("", "queued", "done")


@dataclass(frozen=True)
class Plan:
    """Stages in their order with the seconds that each is expected to take."""

    stages: tuple[tuple[str, int], ...]
    expected: Mapping[str, int] = field(init=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "expected", {k: max(1, v) for k, v in self.stages})

    def seconds(self, stage: str) -> int:
        return self.expected.get(stage, 1)

    @property
    def names(self) -> list[str]:
        return [k for k, _ in self.stages if k != "done"]


@dataclass
class Job:
    """What is remembered of a job between two updates; times in microseconds."""

    started: int
    stage: str
    stage_started: int
    at: int
    signature: str = ""
    remaining: int = -1
    percent: int = -1


def counts(message: str) -> tuple[int, int]:
    """The first ``n/m`` of a message; zeros where there is none."""
    m = re.search(r"(\d+)\s*/\s*(\d+)", message or "")
    return (int(m[1]), int(m[2])) if m else (0, 0)


def stage_remaining(stage: str, spent: int, expected: int, total: int, done: int, active: int, units: tuple[int, int]) -> int:
    """Seconds that are left of a stage: the plan's rest, mixed with the rest by sites or units at the plan's pace or the observed one."""
    rest = max(0, expected - spent)
    if stage == "crawl_site" and total > 0:
        left = max(0, total - done)
        if not left:
            return 0
        pace = expected * (left / total)
        if done > 0 and spent > 0:
            pace = min(spent / done * left, pace * 1.25)
        mixed = rest * 0.6 + pace * 0.4
        return max(1, round(mixed * 0.92 if active > 0 else mixed))
    if stage in UNITS and units[1] >= units[0] > 0:
        share, slack = UNITS[stage]
        left = units[1] - units[0]
        pace = min(spent / units[0] * left, expected * (left / units[1]) * slack)
        return max(1, round(rest * share + pace * (1 - share)))
    return max(1, rest)


def advance(job: Job | None, update, plan: Plan, timings: dict[str, int]) -> tuple[Job, tuple]:
    """The job after an update (at, seq, stage, total_sites, completed_sites, active_sites, message), and its row of ``SHOWN``.

    ``timings`` gets the seconds of a stage that ends. An update without a stage stays in the job's.
    """
    at, seq, stage, total, done, active, message = update
    total, done, active, stage = total or 0, done or 0, active or 0, stage or ""
    if job is None:
        job = Job(at, stage, at, at)
    elif stage and stage != job.stage:
        spent = round((at - job.stage_started) / SECOND)
        if job.stage not in UNTIMED and spent > 0:
            timings[job.stage] = timings.get(job.stage, 0) + spent
        job.stage, job.stage_started = stage, at
    units = counts(message)
    signature = "||".join(map(str, (job.stage, done, total, *units)))
    spent, elapsed, expected = max(0, at - job.stage_started) // SECOND, max(0, at - job.started) // SECOND, plan.seconds(job.stage)
    rest = stage_remaining(job.stage, spent, expected, total, done, active, units)
    names = plan.names
    place = names.index(job.stage) if job.stage in names else 0
    remaining = rest + sum(plan.seconds(k) for k in names[place + 1 :])
    if job.remaining >= 0:
        # The countdown goes on as time does; news of the job may add three seconds, silence none.
        remaining = min(remaining, max(0, job.remaining - max(0, at - job.at) // SECOND) + (0 if signature == job.signature else 3))
    whole = sum(plan.seconds(k) for k in names)
    estimate = max(elapsed + 1, elapsed + remaining, min(max(1, whole), elapsed + remaining + 1))
    if job.stage in names:
        before = sum(plan.seconds(k) for k in names[:place])
        share = (before + expected - max(0, min(expected, rest))) / max(whole, 1) * 100
    else:
        share = elapsed / max(estimate, 1) * 100
    job.percent = max(job.percent, min(99, max(2, round(share))))
    job.signature, job.remaining, job.at = signature, max(0, remaining), at
    return job, ("update", seq, job.stage, spent, rest, job.remaining, job.percent, elapsed > max(1, whole) and estimate > elapsed, signature)


UPDATE = ("at", "seq", "stage", "total_sites", "completed_sites", "active_sites", "message")


def status(updates: DataFrame, plan: Plan) -> DataFrame:
    """job and a row of ``SHOWN`` for each update (job string, at in microseconds, seq, stage, total_sites, completed_sites,
    active_sites, message), in the order of at and seq.

    A task goes over its jobs' updates in their order and holds one job's state at a time, however long its log is.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, job = None, None
        for frame in frames:
            rows = []
            for own, *update in zip(frame["job"], *(frame[c].astype(object).where(frame[c].notna(), None) for c in UPDATE), strict=True):
                if job is None or own != name:
                    name, job = own, None
                update = [int(v) if k in (0, 1, 3, 4, 5) and v is not None else v for k, v in enumerate(update)]
                job, shown = advance(job, update, plan, {})
                rows.append((own, *shown))
            yield pd.DataFrame(rows, columns=["job", *(x.split()[0] for x in SHOWN.split(", "))])

    ordered = updates.select("job", *UPDATE).where("job is not null and at is not null").repartition("job").sortWithinPartitions("job", "at", "seq")
    return ordered.mapInPandas(run, f"job string, {SHOWN}")


def as_row(job: Job) -> tuple:
    return tuple(asdict(job).values())
