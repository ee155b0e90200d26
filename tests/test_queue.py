import threading
import time

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import optimize as op
from rasterloom.operators import reports, tiles
from rasterloom.streaming import control, queue

SCHEMA = "queue_id string, seq long, job_id string, attempt int, type string, stage string, code string, recoverable boolean"


def run(*events):
    q = queue.fresh()
    for kind, job, *more in events:
        queue.apply(q, {"type": kind, "job_id": job, "attempt": more[0] if more else 0, "stage": "analyzing", "code": "X", "recoverable": True})
    return q


def statuses(q):
    return [s["status"] for s in q["jobs"].values()]


def test_one_job_at_a_time_in_order_of_arrival():
    q = run(("add", "a"), ("add", "b"), ("add", "a"))
    assert statuses(q) == ["queued", "queued"]
    assert statuses(run(("add", "a"), ("add", "b"), ("ready", None))) == ["processing", "queued"]
    assert statuses(run(("add", "a"), ("add", "b"), ("ready", None), ("complete", "a"))) == ["complete", "processing"]
    assert statuses(run(("add", "a"), ("add", "b"), ("ready", None), ("remove", "a"), ("remove", "b"))) == ["processing"]


def test_nothing_starts_while_paused():
    held = [("ready", None), ("pause", None), ("add", "a")]
    assert statuses(run(*held)) == ["queued"] and statuses(run(*held, ("start", None))) == ["processing"]
    assert statuses(run(("ready", None), ("add", "a"), ("add", "b"), ("pause", None), ("complete", "a"))) == ["complete", "queued"]


def test_engine_failures_reach_every_job_they_concern():
    two = [("add", "a"), ("add", "b")]
    late = run(*two, ("start_timeout", None))
    assert statuses(late) == ["error", "error"] and late["engine"] == "error" and late["jobs"]["a"]["code"] == "WORKER_START_TIMEOUT"
    assert statuses(run(*two, ("ready", None), ("start_timeout", None))) == ["processing", "queued"]
    crashed = [*two, ("ready", None), ("complete", "a"), ("crash", None)]
    assert statuses(run(*crashed)) == ["complete", "error"]
    assert statuses(run(*crashed, ("add", "c"))) == ["complete", "error", "error"]
    back = run(*crashed, ("retry", "b"))
    assert statuses(back) == ["complete", "queued"] and back["engine"] == "loading"
    assert statuses(run(*crashed, ("retry", "b"), ("ready", None), ("complete", "b", 1))) == ["complete", "complete"]


def test_cancelling_the_active_job_reloads_the_engine():
    q = run(("add", "a"), ("add", "b"), ("ready", None), ("cancel", "a"))
    assert statuses(q) == ["cancelled", "queued"] and q["engine"] == "loading"
    assert statuses(run(("add", "a"), ("add", "b"), ("ready", None), ("cancel", "b"))) == ["processing", "cancelled"]


def streamed(spark, path, timeout_ms, done):
    """The last snapshot of every job, once ``done`` holds."""
    seen = {}

    def keep(df, _):
        seen.update({(r.queue_id, r.job_id): r for r in df.collect()})

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/log")
    q = queue.stream_queues(stream, timeout_ms).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/cp").start()
    until = time.time() + 60
    while time.time() < until and not done(seen):
        time.sleep(0.2)
    q.stop()
    return seen


def test_stream_equals_batch(spark, tmp_path):
    steps = [("add", "a"), ("add", "b"), ("ready", None), ("complete", "a"), ("add", "c")]
    rows = [("q", i, j, 0, k, None, None, None) for i, (k, j) in enumerate(steps)]
    want = {(r.queue_id, r.job_id): r for r in queue.queue_states(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k in range(3):
        spark.createDataFrame(rows[k * 2 : k * 2 + 2], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log" / f"b{k}"))
    assert streamed(spark, tmp_path, 60_000, lambda seen: len(seen) == len(want)) == want


def test_stream_fails_jobs_of_an_engine_that_never_gets_ready(spark, tmp_path):
    spark.createDataFrame([("q", 0, "a", 0, "add", None, None, None)], SCHEMA).write.parquet(str(tmp_path / "log" / "b"))
    got = streamed(spark, tmp_path, 300, lambda seen: any(r.code for r in seen.values()))[("q", "a")]
    assert (got.status, got.code, got.engine) == ("error", "WORKER_START_TIMEOUT", "error")


def test_cancelled_work_stops(spark):
    c, failed = control.Cancellation(spark), []

    def sleepy(frames):
        import time as t

        for f in frames:
            t.sleep(30)
            yield f

    def work():
        try:
            c.run(lambda: spark.range(8).mapInPandas(sleepy, "id long").count())
        except control.Cancelled as e:
            failed.append(str(e))

    t = threading.Thread(target=work)
    began = time.time()
    t.start()
    time.sleep(3)
    c.cancel()
    t.join(60)
    assert failed == ["CANCELLED"] and time.time() - began < 25
    with pytest.raises(control.Cancelled):
        c.check()


def test_measures_come_with_the_result(spark):
    df, seen = control.observed(spark.range(10), rows=F.count("*"), largest=F.max("id"))
    assert df.count() == 10 and seen.get == {"rows": 10, "largest": 9}


def test_optimizing_reports_stages_and_stops_between_them():
    import numpy as np

    from rasterloom.sources import images

    png, heard = images.write_png(np.full((4, 4, 4), 255, np.uint8)), []
    assert op.optimize_one("p", png, lambda p, s: heard.append(s))["error"] is None
    assert heard == ["decoding", "analyzing", "compressing", "finalizing"]
    stopped = op.optimize_one("p", png, cancelled=lambda: True)
    assert stopped["error"] == "CANCELLED" and stopped["output"] == png


def test_tile_scorer_prepares_each_reference_once(spark):
    tile = "image string, rank int, content binary"
    refs = spark.createDataFrame([("a", 0, bytearray(b"aa")), ("a", 1, bytearray(b"bb")), ("a", 2, bytearray(b"cc"))], tile)
    cand = spark.createDataFrame([("a", r, q, bytearray([97 + r, 97 + r + q - 70])) for r in (0, 1) for q in (70, 73)], "image string, rank int, quality int, content binary")
    got = tiles.score_tiles(refs, cand, lambda ref: sum(ref), lambda ready, c: 100 - abs(sum(c) - ready), ["image"])
    assert {(r["rank"], r.quality): r.score for r in got.collect()} == {(0, 70): 100, (0, 73): 97, (1, 70): 100, (1, 73): 97}
    weakest = tiles.tile_scores(got, ["image"]).collect()
    assert {r.quality: (r.score, r.weakest) for r in weakest} == {70: (100, 0), 73: (97, 0)}
    for bad in (("a", 7, 70, bytearray(b"aa")), ("a", 0, 70, bytearray(b"a"))):
        with pytest.raises(Exception, match="METRIC_FAILED"):
            tiles.score_tiles(refs, spark.createDataFrame([bad], cand.schema), sum, lambda a, b: 0, ["image"]).collect()


def test_quality_is_chosen_from_scores_or_falls_back(spark):
    rows = [("a", q, 60.0 + q - 68, 71) for q in range(68, 93)] + [("none", 68, None, 71)]
    got = {r.image: r.quality for r in tiles.choose_quality(spark.createDataFrame(rows, "image string, quality int, score double, target int"), ["image"]).collect()}
    assert 79 <= got["a"] <= 81 and got["none"] == tiles.FALLBACK


def test_names_without_a_value_and_columns_of_their_own(spark):
    df = spark.createDataFrame([(1, "x.png", "k"), (2, None, "k"), (3, "x.png", "l"), (4, "x-2.png", "m")], "seq long, name string, note string")
    got = {r.seq: (r.unique_name, r.note) for r in reports.unique_names(df, "name", "seq").collect()}
    assert got == {1: ("x.png", "k"), 2: (None, "k"), 3: ("x-2.png", "l"), 4: ("x-2-2.png", "m")}


def test_summaries():
    assert reports.saved_line({"original_bytes": 10, "optimized_bytes": 10, "saved_percent": 0.0}, "o") == "Already optimized → o"
    assert reports.saved_line({"original_bytes": 1000, "optimized_bytes": 750, "saved_percent": 25.0}, "o") == "Saved 25.0% (1000 → 750 bytes) → o"
    assert reports.metrics_lines({"ssimulacra2": None, "butteraugli": 0.5}) == "SSIMULACRA2: \nButteraugli: 0.50000"
    assert reports.timed_line("a", 3.14, 12.6) == "a: 3.1% saved in 13 ms"
