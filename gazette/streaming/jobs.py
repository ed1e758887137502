"""Running jobs as a stream: each update's row as it comes, and one when a job falls silent or is forgotten."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.jobs import SECOND, SHOWN, UPDATE, Job, Plan, advance, as_row

#: The state store that keyed variables and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JOB = "started long, stage string, stage_started long, at long, signature string, remaining long, percent long"
_NAMES = ["job", *(x.split()[0] for x in SHOWN.split(", "))]


class Jobs(StatefulProcessor):
    """State of a job: its variables, the seconds of its finished stages, and two timers of event time that each update moves on.

    After ``stall`` seconds without an update a row ``stalled`` says so; after ``forget`` seconds a row ``expired`` gives the seconds
    of all stages in its signature, and the state goes.
    """

    def __init__(self, plan: Plan, stall: int, forget: int):
        self.plan, self.stall, self.forget = plan, stall, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _JOB)
        self.stages = handle.getMapState("stages", "stage string", "seconds long")

    def _timers(self, at: int) -> tuple[int, int]:
        return tuple(at // 1000 + 1000 * s for s in (self.stall, self.forget))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        job = Job(*self.job.get()) if self.job.exists() else None
        for timer in self._timers(job.at) if job else ():
            self.handle.deleteTimer(timer)
        timings: dict[str, int] = {}
        # A batch has a job's updates in no order.
        for update in sorted((tuple(r[c] for c in UPDATE) for r in rows), key=lambda u: u[:2]):
            job, shown = advance(job, update, self.plan, timings)
            yield Row(*_NAMES)(key[0], *shown)
        for stage, seconds in timings.items():
            held = self.stages.getValue((stage,)) if self.stages.containsKey((stage,)) else None
            self.stages.updateValue((stage,), ((held[0] if held else 0) + seconds,))
        self.job.update(as_row(job))
        for timer in self._timers(job.at):
            self.handle.registerTimer(timer)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if not self.job.exists():
            return
        job = Job(*self.job.get())
        stalled, forgotten = self._timers(job.at)
        spent = max(0, job.at - job.stage_started) // SECOND
        if expiredTimerInfo.getExpiryTimeInMs() < forgotten:
            yield Row(*_NAMES)(key[0], "stalled", None, job.stage, spent, None, job.remaining, job.percent, None, job.signature)
            return
        seconds = {k[0]: v[0] for k, v in self.stages.iterator()}
        if spent:
            seconds[job.stage] = seconds.get(job.stage, 0) + spent
        yield Row(*_NAMES)(key[0], "expired", None, job.stage, spent, None, job.remaining, job.percent, None, "||".join(f"{k}={seconds[k]}" for k in sorted(seconds)))
        self.job.clear()
        self.stages.clear()

    def close(self) -> None:
        pass


def status(updates: DataFrame, plan: Plan, stall: int = 3600, forget: int = 30 * 86400, late: str = "1 hour") -> DataFrame:
    """The rows of ``operators.jobs.status`` of a stream of updates (with ts, their time), and its ``stalled`` and ``expired`` ones.

    An update later than ``late`` is dropped; one that comes after a later one of its job counts from where the job is. The session
    needs ``STORE`` as ``spark.sql.streaming.stateStore.providerClass``.
    """
    rows = updates.where("job is not null and ts is not null").withWatermark("ts", late).select("job", "ts", F.unix_micros("ts").alias("at"), *(c for c in UPDATE if c != "at"))
    return rows.groupBy("job").transformWithState(Jobs(plan, stall, forget), outputStructType=f"job string, {SHOWN}", outputMode="append", timeMode="eventTime")
