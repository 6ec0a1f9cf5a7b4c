"""A run in stages: each is told as an event, and none begins once the run is cancelled."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .model import job_state

EVENTS = "job_id long, seq long, status string, completed int, total int"


class Cancelled(Exception):
    """The run was cancelled; what its stages have written was taken away."""


class Run:
    """Stages of one job. `cancelled` is asked before and after each stage, and every `every` seconds while one runs: then the jobs of
    the stage are stopped. Events are appended to the Parquet folder `events`. What a stage leaves for later is handed to `undo`, and
    is taken away, last first, if the run does not end."""

    def __init__(self, spark: SparkSession, job_id: int, events: str, cancelled: Callable[[], bool], every: float = 1.0) -> None:
        self.spark, self.job_id, self.events, self.cancelled, self.every = spark, job_id, events, cancelled, every
        self.seq, self._undo = 0, []

    def tell(self, status: str, completed: int = 0, total: int = 0) -> None:
        """One more event, unless the run is cancelled: after that, nothing but CANCELLED is told."""
        self.seq += 1
        row = self.spark.createDataFrame([(self.job_id, self.seq, status, completed, total)], EVENTS)
        row.coalesce(1).write.mode("append").parquet(self.events)

    def undo(self, action: Callable[[], None]) -> None:
        self._undo.append(action)

    @contextmanager
    def stage(self, status: str, completed: int = 0, total: int = 0) -> Iterator[None]:
        self._ask()
        self.tell(status, completed, total)
        group, over = f"run-{self.job_id}-{self.seq}", threading.Event()
        sc = self.spark.sparkContext
        sc.setJobGroup(group, status, interruptOnCancel=True)
        stopped = threading.Event()

        def watch() -> None:
            while not over.wait(self.every):
                if self.cancelled():
                    stopped.set()
                    sc.cancelJobGroup(group)

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        fault: Exception | None = None
        try:
            yield
        except Exception as e:  # noqa: BLE001  raised again below, when the watcher no longer stops jobs
            fault = e
        finally:
            over.set()
            watcher.join()
            sc.setLocalProperty("spark.jobGroup.id", None)
        if fault is not None and not isinstance(fault, Cancelled):
            if stopped.is_set() or self.cancelled():
                self._end("CANCELLED")
                raise Cancelled(status) from None
            self._end("FAILED")
            raise fault
        self._ask()

    def done(self, total: int = 0) -> None:
        self._ask()
        self._undo.clear()
        self.tell("COMPLETED", total, total)

    def _ask(self) -> None:
        if self.cancelled():
            self._end("CANCELLED")
            raise Cancelled

    def _end(self, status: str) -> None:
        while self._undo:
            self._undo.pop()()
        self.tell(status)


def states(spark: SparkSession, events: str) -> DataFrame:
    """(job_id, status, progress) of the runs whose events are in the folder."""
    return job_state(spark.read.schema(EVENTS).parquet(events))
