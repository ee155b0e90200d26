"""Progress, observation and cancellation of running work."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Cancelled(RuntimeError):
    """The work was cancelled."""


class Cancellation:
    """Cancels Spark work from another thread: jobs begun inside ``run`` carry a tag of their own."""

    def __init__(self, spark: SparkSession):
        self._context, self._tag, self.cancelled = spark.sparkContext, f"rasterloom-{uuid.uuid4().hex}", False

    def check(self) -> None:
        """A check point between two steps on the driver."""
        if self.cancelled:
            raise Cancelled("CANCELLED")

    def cancel(self) -> None:
        self.cancelled = True
        self._context.cancelJobsWithTag(self._tag)

    def run(self, action: Callable[[], Any]) -> Any:
        self.check()
        self._context.addJobTag(self._tag)
        try:
            return action()
        except Exception as e:
            if self.cancelled:
                raise Cancelled("CANCELLED") from e
            raise
        finally:
            self._context.removeJobTag(self._tag)


def observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, Observation]:
    """``df`` and the measures that are taken while it is computed, without a second pass."""
    seen = Observation()
    return df.observe(seen, *[c.alias(k) for k, c in measures.items()]), seen


class ProgressSink(StreamingQueryListener):
    """Hands (query name, batch, rows read) of every micro-batch to a callable."""

    def __init__(self, sink: Callable[[str | None, int, int], None]):
        self._sink = sink

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._sink(p.name, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
