"""What the jobs of a piece of work cost, by Spark's own task metrics."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass
class Cost:
    """Sums over all tasks: seconds, and megabytes."""

    wall_s: float = 0.0
    jobs: int = 0
    stages: int = 0
    tasks: int = 0
    run_s: float = 0.0
    cpu_s: float = 0.0
    gc_s: float = 0.0
    python_s: float = 0.0
    input_mb: float = 0.0
    shuffle_read_mb: float = 0.0
    shuffle_write_mb: float = 0.0
    memory_spill_mb: float = 0.0
    disk_spill_mb: float = 0.0

    def __add__(self, other: Cost) -> Cost:
        return Cost(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(Cost)))

    def line(self) -> str:
        return (
            f"{self.wall_s:8.3f} s  {self.jobs:4d} jobs  tasks {self.tasks:5d}: run {self.run_s:8.2f} s, cpu {self.cpu_s:8.2f} s, gc {self.gc_s:6.2f} s, python {self.python_s:6.2f} s  "
            f"read {self.input_mb:8.1f} MB  shuffle {self.shuffle_read_mb:8.1f} / {self.shuffle_write_mb:8.1f} MB  spill {self.disk_spill_mb:6.1f} MB"
        )


def _settle(spark: SparkSession) -> None:
    """Waits until the status store has heard of everything."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)


#: The metric of plans with Python workers: time that these ran, in milliseconds.
_PYTHON = "time to run Python workers"


def _seconds(text: str) -> float:
    """A timing metric as the store shows it: its total, such as 1.2 s, 350 ms or 1.5 m."""
    first = text.split("\n")[1].split("(")[0].strip() if "\n" in text else text.strip()
    number, _, unit = first.partition(" ")
    scale = {"ms": 1e-3, "s": 1.0, "m": 60.0, "min": 60.0, "h": 3600.0}
    return float(number.replace(",", "")) * scale.get(unit, 0.0)


def _python(spark: SparkSession, jobs: set[int]) -> float:
    """Seconds of Python workers in the plans that ran these jobs."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0.0
    runs = store.executionsList()
    for k in range(runs.size()):
        run = runs.apply(k)
        own = run.jobs().keySet().iterator()
        if not any(own.hasNext() and own.next() in jobs for _ in range(run.jobs().size())):
            continue
        values, metrics = store.executionMetrics(run.executionId()), run.metrics()
        for i in range(metrics.size()):
            m = metrics.apply(i)
            if m.name() == _PYTHON and (text := values.get(m.accumulatorId())).isDefined():
                total += _seconds(text.get())
    return total


@contextmanager
def measured(spark: SparkSession) -> Iterator[Cost]:
    """The cost of the jobs that run within, filled in at the end. Jobs of other threads don't count.

    The status store keeps a bounded number of jobs and stages; a piece of work beyond that is counted in part.
    """
    sc, group, cost, began = spark.sparkContext, f"measured-{uuid.uuid4().hex}", Cost(), time.perf_counter()
    before = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
    sc.setJobGroup(group, group)
    try:
        yield cost
    finally:
        cost.wall_s = time.perf_counter() - began
        for k, v in before.items():
            sc.setLocalProperty(k, v)
        _settle(spark)
        tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
        jobs, seen = set(tracker.getJobIdsForGroup(group)), set()
        for job in jobs:
            info = tracker.getJobInfo(job)
            seen |= set(info.stageIds) if info else set()
        cost.jobs = len(jobs)
        for stage in sorted(seen):
            try:
                s = store.lastStageAttempt(stage)
            except Exception:  # skipped, or let go
                continue
            if not s.numCompleteTasks():
                continue
            cost.stages += 1
            cost.tasks += s.numCompleteTasks()
            cost.run_s += s.executorRunTime() / 1e3
            cost.cpu_s += s.executorCpuTime() / 1e9
            cost.gc_s += s.jvmGcTime() / 1e3
            cost.input_mb += s.inputBytes() / 1e6
            cost.shuffle_read_mb += s.shuffleReadBytes() / 1e6
            cost.shuffle_write_mb += s.shuffleWriteBytes() / 1e6
            cost.memory_spill_mb += s.memoryBytesSpilled() / 1e6
            cost.disk_spill_mb += s.diskBytesSpilled() / 1e6
        cost.python_s = _python(spark, jobs)
