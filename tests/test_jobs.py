import random

import pytest

from rasterloom.operators import reports, tiles
from rasterloom.streaming import jobs

SCHEMA = "seq long, job_id string, attempt int, type string, stage string, code string, recoverable boolean"


def event(seq, job, kind, attempt=None, stage=None, code=None, recoverable=None):
    return (seq, job, attempt, kind, stage, code, recoverable)


def state(events):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return jobs.fold(jobs.fresh("j"), [dict(zip(names, e)) for e in events])


def test_one_request_runs_through():
    s = state([event(1, "j", "dispatch"), event(2, "j", "progress", 0, "compressing"), event(3, "j", "complete", 0)])
    assert (s["status"], s["stage"], s["attempt"], s["applied"]) == ("complete", None, 0, 3)


def test_crash_then_retry_fences_the_old_attempt():
    s = state([event(1, "j", "dispatch"), event(2, "j", "crash"), event(3, "j", "retry"), event(4, "j", "complete", 0)])
    assert (s["status"], s["attempt"], s["ignored"]) == ("queued", 1, 1)


def test_cancel_timeout_and_final_errors():
    assert state([event(1, "j", "dispatch"), event(2, "j", "cancel"), event(3, "j", "progress", 0, "x")])["status"] == "cancelled"
    assert state([event(1, "j", "start_timeout")])["code"] == "WORKER_START_TIMEOUT"
    assert state([event(1, "j", "engine_error"), event(2, "j", "dispatch")])["code"] == "ENGINE_UNAVAILABLE"
    stuck = state([event(1, "j", "dispatch"), event(2, "j", "error", 0, code="DECODE_FAILED", recoverable=False), event(3, "j", "retry")])
    assert (stuck["status"], stuck["attempt"]) == ("error", 0)


def log():
    rng = random.Random(2)
    kinds = [*jobs.CONTROL, *jobs.MESSAGES, "progress"]
    return [event(i, f"j{rng.randrange(5)}", rng.choice(kinds), rng.randrange(3), "analyzing", "X", rng.random() < 0.8) for i in range(200)]


def test_batch_equals_stream(spark, tmp_path):
    rows = log()
    batch = {r.job_id: r for r in jobs.latest_states(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log" / f"b{k}"))
    seen = {}

    def keep(df, _):
        seen.update({r.job_id: r for r in df.collect()})

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "log"))
    q = jobs.stream_states(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == batch


@pytest.mark.parametrize("threshold", [70, 75, 83, 90])
def test_quality_search_is_close_with_few_scores(threshold):
    asked = []

    def score(q):
        asked.append(q)
        return 71 + (q - threshold) * 0.7

    found = tiles.search_quality(score, 71)
    assert 0 <= found - threshold <= 2 and len(asked) <= 6 and all(68 <= q <= 92 for q in asked)


def test_quality_search_limits():
    assert tiles.search_quality(lambda q: 100, 71) == 68 and tiles.search_quality(lambda q: 0, 71) == 92


def test_tile_sizes_and_names(spark, tmp_path):
    assert tiles.tile_size(1024, 512) == 256 and tiles.tile_size(100, 90) == 80 and tiles.tile_size(60, 900) == 48
    assert reports.unique_names_in_order(["x.jpg", "x.jpg", "x-2.jpg", "y"]) == ["x.jpg", "x-2.jpg", "x-2-2.jpg", "y"]
    df = spark.createDataFrame([("b.png", bytearray(b"1")), ("b.png", bytearray(b"2")), ("c.png", None)], "name string, output binary")
    import zipfile

    assert reports.zip_outputs(df, str(tmp_path / "o.zip")) == 2 and sorted(zipfile.ZipFile(tmp_path / "o.zip").namelist()) == ["b-2.png", "b.png"]
    assert reports.zip_outputs(df.limit(0), str(tmp_path / "none.zip")) == 0 and not (tmp_path / "none.zip").exists()


def test_asking_for_an_unknown_tile_is_an_error(spark):
    sampled = spark.createDataFrame([("a", 0, 0, 0, 1.0), ("a", 1, 256, 0, 2.0)], "image string, rank int, tx int, ty int, activity double")
    ask = lambda *ranks: tiles.known_tiles(sampled, spark.createDataFrame([("a", r) for r in ranks], "image string, rank int"), ["image"])
    assert sorted(r.tx for r in ask(0, 1).collect()) == [0, 256]
    with pytest.raises(Exception, match="unknown tile 7"):
        ask(0, 7).collect()


def test_tiles_of_different_images_stay_apart(spark):
    px = spark.createDataFrame([(k, x, 0, x) for k in "ab" for x in range(4)], "image string, x int, y int, g int")
    picked = spark.createDataFrame([("a", 0, 0), ("b", 2, 0)], "image string, tx int, ty int")
    got = tiles.tile_pixels(px, picked, 2, ["image"]).collect()
    assert sorted((r.image, r.x, r.in_x) for r in got) == [("a", 0, 0), ("a", 1, 1), ("b", 2, 0), ("b", 3, 1)]
