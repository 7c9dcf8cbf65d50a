"""Progress, rate and remaining time of a running action."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Progress:
    """Rows counted so far, tasks ended and known, and seconds since the start."""

    rows: int
    tasks: int
    known_tasks: int
    seconds: float
    #: Rows that are expected, if that is known.
    expected: int | None = None

    @property
    def share(self) -> float:
        if self.expected:
            return min(1.0, self.rows / self.expected)
        return self.tasks / self.known_tasks if self.known_tasks else 0.0

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds else 0.0

    @property
    def remaining_seconds(self) -> float | None:
        """At the rate so far; None before anything has ended."""
        return self.seconds * (1 - self.share) / self.share if self.share else None


class Watch:
    """Counts the rows that pass through DataFrames and tells how far the actions over them have come. A task's rows count once
    it ends; those of a task that runs twice count twice."""

    def __init__(self, df: DataFrame, expected: int | None = None):
        spark = df.sparkSession
        self.context, self.expected = spark.sparkContext, expected
        self.group, self.began, self.best = f"watch-{uuid.uuid4().hex}", time.time(), (0, 0)
        counter = self.counter = self.context.accumulator(0)

        def run(batches):
            n = 0
            for batch in batches:
                n += batch.num_rows
                yield batch
            counter.add(n)

        #: The rows, to be used in place of the DataFrame.
        self.rows = df.mapInArrow(run, df.schema)

    def now(self) -> Progress:
        tracker, ended, known = self.context.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            for stage in info.stageIds if (info := tracker.getJobInfo(job)) else []:
                if found := tracker.getStageInfo(stage):
                    # A job that has ended may have left out stages whose results were there.
                    ended, known = ended + found.numCompletedTasks, known + (found.numTasks if info.status == "RUNNING" else found.numCompletedTasks)
        self.best = max(ended, self.best[0]), max(known, ended, self.best[0])  # Spark forgets old stages
        return Progress(self.counter.value, *self.best, time.time() - self.began, self.expected)

    def run(self, action: Callable[[DataFrame], object], report: Callable[[Progress], None], every: float = 1.0) -> object:
        """What action gives for the rows, reporting until it ends and once after."""
        out: list = []

        def work():
            self.context.setJobGroup(self.group, "watched")
            try:
                out.append((action(self.rows), None))
            except BaseException as e:  # raised again in the caller's thread
                out.append((None, e))

        self.began = time.time()
        thread = InheritableThread(target=work, session=self.rows.sparkSession)
        thread.start()
        while thread.is_alive():
            thread.join(every)
            report(self.now())
        value, error = out[0]
        if error is not None:
            raise error
        return value
