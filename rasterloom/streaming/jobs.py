"""Lifecycle of compression jobs as a fold over an event log, in batch and as a stream.

An event is (seq, job_id, attempt, type, stage, code, recoverable). ``attempt`` fences late messages: what a
worker says about an earlier attempt is ignored. Control events carry no attempt.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "job_id string, status string, stage string, attempt int, code string, recoverable boolean, applied long, ignored long"
#: Control events and the statuses they act on; worker messages and the status they lead to.
CONTROL = {"dispatch": {"queued"}, "cancel": {"queued", "processing"}, "retry": {"error", "cancelled"}, "engine_error": {"queued"}, "start_timeout": {"queued"}, "crash": {"queued", "processing"}, "read_failed": {"processing"}}
FAILURES = {"engine_error": "ENGINE_UNAVAILABLE", "start_timeout": "WORKER_START_TIMEOUT", "crash": "WORKER_CRASH", "read_failed": "FILE_READ_FAILED"}
MESSAGES = {"complete": "complete", "error": "error", "cancelled": "cancelled"}


def fresh(job_id: str) -> dict:
    return {"job_id": job_id, "status": "queued", "stage": None, "attempt": 0, "code": None, "recoverable": None, "applied": 0, "ignored": 0}


def step(s: dict, e: dict) -> dict:
    """State after one event; an event that doesn't fit the state counts as ignored."""
    kind = e["type"]
    change: dict | None = None
    if kind in CONTROL:
        stuck = kind == "retry" and s["status"] == "error" and s["recoverable"] is False
        if s["status"] in CONTROL[kind] and not stuck:
            if kind in FAILURES:
                change = {"status": "error", "code": FAILURES[kind], "recoverable": True, "stage": None}
            elif kind == "dispatch":
                change = {"status": "processing", "stage": "decoding"}
            elif kind == "cancel":
                change = {"status": "cancelled", "stage": None, "attempt": s["attempt"] + 1}
            else:
                change = {"status": "queued", "code": None, "recoverable": None, "attempt": s["attempt"] + 1}
    elif e["attempt"] == s["attempt"]:
        if kind == "progress":
            change = {"stage": e["stage"]}
        elif kind in MESSAGES:
            change = {"status": MESSAGES[kind], "stage": None} | ({"code": e["code"], "recoverable": e["recoverable"]} if kind == "error" else {})
    return s | (change or {}) | {"applied": s["applied"] + (change is not None), "ignored": s["ignored"] + (change is None)}


def fold(state: dict, events: Iterable[dict]) -> dict:
    for e in events:
        state = step(state, e)
    return state


def _records(frames: Iterable[pd.DataFrame]) -> list[dict]:
    pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
    pdf = pdf.astype(object).where(pdf.notna(), None)
    return pdf.to_dict("records")


def latest_states(events: DataFrame) -> DataFrame:
    """State of every job after all of its events, in order of seq."""

    def run(key, pdf):
        return pd.DataFrame([fold(fresh(key[0]), _records([pdf]))])

    return events.groupBy("job_id").applyInPandas(run, STATE)


def stream_states(events: DataFrame) -> DataFrame:
    """The same fold over a stream; every batch emits the states of the jobs it touched."""

    def run(key, frames, held):
        names = [c.split()[0] for c in STATE.split(", ")]
        state = dict(zip(names, held.get)) if held.exists else fresh(key[0])
        state = fold(state, _records(frames))
        held.update(tuple(state[n] for n in names))
        yield pd.DataFrame([state])

    return events.groupBy("job_id").applyInPandasWithState(run, STATE, STATE, "update", "NoTimeout")


def fenced(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Messages with whether their attempt is the current one: the number of attempts begun before them."""
    over = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    current = F.coalesce(F.sum(F.col("type").isin("cancel", "retry").cast("int")).over(over), F.lit(0))
    return events.withColumn("current", current.cast("long")).withColumn("accepted", F.col("attempt") == F.col("current"))


def fifo_head(jobs: DataFrame) -> DataFrame:
    """The queued job that came first."""
    return jobs.where("status = 'queued'").agg(F.min_by("job_id", "seq").alias("job_id"), F.min("seq").alias("seq"))
