"""How far a run is while it goes on: files done and failed, pace, time left, and Spark's tasks.

Counts of files come from accumulators that tasks send when they end, counts of tasks from Spark's status tracker, for the
jobs of the run's own group. A task that Spark runs again counts its files again, so the counts of a run that lost an
executor can be too high, never the results."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Files a second that are taken for granted before the first ones are done.
DEFAULT_RATE = 25.0


@dataclass(frozen=True)
class State:
    total: int
    ok: int
    errors: int
    elapsed: float
    tasks: int
    tasks_done: int

    @property
    def rate(self) -> float:
        """Files a second; 0 before the first."""
        done = self.ok + self.errors
        return done / self.elapsed if done and self.elapsed > 0 else 0.0

    @property
    def eta(self) -> float:
        """Seconds left."""
        return max(0, self.total - self.ok - self.errors) / (self.rate or DEFAULT_RATE)

    def text(self) -> str:
        """The line of a run that goes on, as assetloom.functions.records.progress_text has it."""
        s = int(self.eta)
        left = f"{s}s" if s < 60 else f"{s // 60}m {s % 60}s" if s < 3600 else f"{s // 3600}h {s % 3600 // 60}m"
        return f"{self.rate:.1f} img/s | {self.ok} ok | {self.errors} errors | ETA: {left}"


class Progress:
    """``with Progress(spark, total, tell): ...`` calls tell(State) every so many seconds, and once at the end. Work in the block
    that is to count files calls ``count`` in its tasks."""

    def __init__(self, spark: SparkSession, total: int, tell: Callable[[State], None], every: float = 1.0):
        self.context, self.total, self.tell, self.every = spark.sparkContext, total, tell, every
        self.group, self._end = f"assetloom-{uuid.uuid4().hex}", threading.Event()
        self._ok, self._errors = self.context.accumulator(0), self.context.accumulator(0)

    @property
    def count(self) -> Callable[[bool], None]:
        """A function for tasks: one more file, and whether it worked."""
        ok, errors = self._ok, self._errors
        return lambda good: ok.add(1) if good else errors.add(1)

    def state(self) -> State:
        tracker = self.context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(self.group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        known = [x for s in stages if (x := tracker.getStageInfo(s)) and x.numActiveTasks + x.numCompletedTasks]  # begun, not skipped
        return State(self.total, self._ok.value, self._errors.value, time.monotonic() - self._began, sum(x.numTasks for x in known), sum(x.numCompletedTasks for x in known))

    def _run(self) -> None:
        while not self._end.wait(self.every):
            self.tell(self.state())

    def __enter__(self) -> Progress:
        self._began = time.monotonic()
        self._before = self.context.getLocalProperty("spark.jobGroup.id")
        self.context.setJobGroup(self.group, "assetloom")
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._end.set()
        self._thread.join()
        self.tell(self.state())
        self.context.setLocalProperty("spark.jobGroup.id", self._before)
