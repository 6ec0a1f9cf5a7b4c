"""Job states and re-analysis as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.model import job_state as job_states  # noqa: F401  the same states, from all events at once

#: The store that keyed state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATES = "job_id long, status string, progress int, timed_out boolean"
#: Statuses after which no more is expected of a job. CANCELLED wins over any other event, whatever their order.
FINAL = ["COMPLETED", "FAILED", "CANCELLED"]
_HELD = "seq long, status string, completed long, total long"


class JobState(StatefulProcessor):
    """The state of each job, from events in any order and number. Kept are the first CANCELLED and the last event by their
    numbers, so repeated and late events change nothing that they should not. A job without a final status of which nothing is
    heard for `idle` milliseconds is said once more, as timed out; a later event takes that back."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cancelled = handle.getValueState("cancelled", _HELD)
        self.last = handle.getValueState("last", _HELD)
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, stop = self._of(self.last), self._of(self.cancelled)
        before, silent = (best, stop), best is not None and best[1] not in FINAL and stop is None and not self.due.exists()
        for batch in rows:
            for e in batch.itertuples(index=False):
                event = (int(e.seq), e.status, None if pd.isna(e.completed) else int(e.completed), None if pd.isna(e.total) else int(e.total))
                if e.status == "CANCELLED" and (stop is None or event[0] < stop[0]):
                    stop = event
                if best is None or event[0] > best[0]:
                    best = event
        if best is not None and (best, stop) != before:
            self.last.update(best)
            if stop is not None:
                self.cancelled.update(stop)
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if stop is None and best[1] not in FINAL:
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(at)
            self.due.update((at,))
        if (best, stop) != before or silent:
            yield self._row(key, stop or best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        stop, best = self._of(self.cancelled), self._of(self.last)
        if stop is None and best is not None and best[1] not in FINAL:
            yield self._row(key, best, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _of(state) -> tuple | None:
        return tuple(state.get()) if state.exists() else None

    @staticmethod
    def _row(key, event: tuple, timed_out: bool) -> pd.DataFrame:
        _, status, completed, total = event
        done = 0 if not total else (completed or 0) * 100 // total
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [done], "timed_out": [timed_out]})


def state_changes(events: DataFrame, idle_minutes: float = 30) -> DataFrame:
    """STATES of each job whenever it changes, from a stream of events (job_id, seq, status, completed, total). Events may come
    in any order and more than once, however late: there is no watermark, and state is a few numbers for each job."""
    events.sparkSession.conf.set(*STORE)
    processor = JobState(int(idle_minutes * 60_000))
    return events.groupBy("job_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=STATES, outputMode="Update", timeMode="ProcessingTime")


def watch(spark: SparkSession, folder: str, schema: str, run: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs `run` on each batch of new snapshot files (Parquet) in `folder`; the started query."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
