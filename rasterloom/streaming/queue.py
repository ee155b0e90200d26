"""A queue of compression jobs: arrivals, start and pause, the engine's state, and at most one active job.

An event is (queue_id, seq, job_id, attempt, type, stage, code, recoverable). Events of a job go through the
fold of ``jobs``; those without a job concern the queue and reach all jobs they apply to. A queue is one user's
session, so it is folded in one place; different queues are independent.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame

from . import jobs

#: Fixed value: how long the engine may take to get ready.
START_TIMEOUT_MS = 30_000
SNAPSHOT = "queue_id string, job_id string, position int, status string, stage string, attempt int, code string, recoverable boolean, engine string, paused boolean"
#: Events of the whole queue that fail its jobs; what they act on is told by ``jobs.CONTROL``.
FAILING = ("engine_error", "start_timeout", "crash")


def fresh() -> dict:
    """An empty queue: the engine is loading, nothing is paused. ``jobs`` keeps the order of arrival."""
    return {"engine": "loading", "paused": False, "jobs": {}}


def _everyone(queue: dict, kind: str) -> None:
    queue["jobs"] = {k: jobs.step(s, {"type": kind, "attempt": None}) for k, s in queue["jobs"].items()}


def _engine_event(queue: dict, kind: str) -> None:
    if kind == "ready" and queue["engine"] == "loading":
        queue["engine"] = "ready"
    elif kind == "engine_error" or kind == "crash" or (kind == "start_timeout" and queue["engine"] == "loading"):
        queue["engine"] = "error"
        _everyone(queue, kind)


def _job_event(queue: dict, e: dict) -> None:
    kind, name = e["type"], e["job_id"]
    if kind == "add":
        queue["jobs"].setdefault(name, jobs.fresh(name))
        if queue["engine"] == "error":
            queue["jobs"][name] = jobs.step(queue["jobs"][name], {"type": "engine_error", "attempt": None})
    elif kind == "remove":
        if queue["jobs"].get(name, {}).get("status") != "processing":
            queue["jobs"].pop(name, None)
    elif name in queue["jobs"]:
        before = queue["jobs"][name]
        after = queue["jobs"][name] = jobs.step(before, e)
        if kind == "cancel" and before["status"] == "processing" and after["status"] == "cancelled":
            queue["engine"] = "loading"  # the worker that held the job is replaced
        elif kind == "retry" and after["attempt"] > before["attempt"] and queue["engine"] == "error":
            queue["engine"] = "loading"


def apply(queue: dict, e: dict) -> dict:
    """The queue after one event; then the first waiting job starts if the engine is ready, nothing is paused
    and no job is active."""
    kind = e["type"]
    if kind in ("start", "pause"):
        queue["paused"] = kind == "pause"
        if kind == "start" and queue["engine"] == "error":
            queue["engine"] = "loading"
    elif e["job_id"] is None:
        _engine_event(queue, kind)
    else:
        _job_event(queue, e)
    states = queue["jobs"]
    if queue["engine"] == "ready" and not queue["paused"] and all(s["status"] != "processing" for s in states.values()):
        waiting = next((k for k, s in states.items() if s["status"] == "queued"), None)
        if waiting is not None:
            states[waiting] = jobs.step(states[waiting], {"type": "dispatch", "attempt": None})
    return queue


def _snapshot(name: str, queue: dict) -> pd.DataFrame:
    cols = [c.split()[0] for c in SNAPSHOT.split(", ")]
    rows = [s | {"queue_id": name, "position": i, "engine": queue["engine"], "paused": queue["paused"]} for i, s in enumerate(queue["jobs"].values())]
    return pd.DataFrame([[r[c] for c in cols] for r in rows], columns=cols).astype(object)


def queue_states(events: DataFrame) -> DataFrame:
    """Every job of every queue after all events, in order of seq. A queue without jobs gives no row."""

    def run(key, pdf):
        queue = fresh()
        for e in jobs._records([pdf]):
            apply(queue, e)
        return _snapshot(key[0], queue)

    return events.groupBy("queue_id").applyInPandas(run, SNAPSHOT)


def stream_queues(events: DataFrame, timeout_ms: int = START_TIMEOUT_MS) -> DataFrame:
    """The same over a stream: each batch emits the snapshots of the queues it touched. An engine that isn't
    ready ``timeout_ms`` after it began to load fails the waiting jobs."""

    def run(key, frames: Iterable[pd.DataFrame], held):
        queue = json.loads(held.get[0]) if held.exists else fresh()
        if held.hasTimedOut:
            apply(queue, {"type": "start_timeout", "job_id": None, "attempt": None})
        else:
            for e in jobs._records(frames):
                apply(queue, e)
        held.update((json.dumps(queue),))
        if queue["engine"] == "loading":
            held.setTimeoutDuration(timeout_ms)
        yield _snapshot(key[0], queue)

    return events.groupBy("queue_id").applyInPandasWithState(run, SNAPSHOT, "queue string", "update", "ProcessingTimeTimeout")


def snapshots_to(events: DataFrame, listener: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream that hands every batch of snapshots to ``listener``."""
    return stream_queues(events).writeStream.outputMode("update").foreachBatch(listener).option("checkpointLocation", checkpoint)
