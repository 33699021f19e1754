"""A stream from source to sink as one call: processed, drained by one writer, stopped on request or by its first error."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: What makes rows, what changes them, what takes each finished batch with its number.
Source = Callable[[SparkSession], DataFrame]
Process = Callable[[DataFrame], DataFrame]
Sink = Callable[[DataFrame, int], None]


class Cancelled(RuntimeError):
    """The flow was stopped before its source was drained."""


@dataclass
class Flow:
    """source -> process -> sink over micro-batches; a batch is the bound of what is under way at once.

    A batch that fails ends the flow with its error, and what later batches would have done is not done. After a failure
    or a lost driver the flow goes on at the batch that was not finished, from its checkpoint; a sink that writes a
    batch under its number writes it once.
    """

    source: Source
    process: Process
    sink: Sink
    checkpoint: str
    rows: int = 0
    batches: int = 0
    query: StreamingQuery | None = field(default=None, repr=False)
    stopped: bool = False

    def run(self, spark: SparkSession, seconds: float | None = None) -> Flow:
        """All that the source has now. Beyond `seconds`, or after `cancel`, the flow stops and Cancelled is raised."""
        began = time.monotonic()
        made = self.process(self.source(spark))
        self.query = made.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        while not self.query.awaitTermination(1):
            if seconds is not None and time.monotonic() - began > seconds:
                self.cancel()
        if self.stopped:
            raise Cancelled(f"stopped after {self.batches} batches")
        return self

    def _batch(self, df: DataFrame, number: int) -> None:
        if self.stopped:
            raise Cancelled(f"stopped before batch {number}")
        self.sink(df, number)
        self.batches += 1

    def cancel(self) -> None:
        """Stops the flow: the batch under way is cancelled and stays unfinished in the checkpoint."""
        self.stopped = True
        if self.query is not None:
            self.query.stop()
