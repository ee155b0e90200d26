import math
from collections import defaultdict

from rasterloom.llm.mixing import mix_sources


def water_fill(sizes: dict) -> dict:
    """Share by weight, stop at three times the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        free = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return full | share
        full |= over


def test_targets_and_copies(spark):
    rows = []
    for i in range(900):
        source = [None, "a", "b", "c", "Z", "é"][0 if i % 50 == 0 else 1 if i % 3 == 0 else 2 + i % 4]
        rows.append((i, "w " * (i * 37 % 90) if i % 11 else None, source, 1))
    rows += [(3, "w w", "a", 1)] * 2 + [(None, "w", "b", 2), (1000, "w " * 30_000, "c", 1)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, size int")).collect()
    assert len(got) == len(rows)
    sizes, by_id = defaultdict(int), {}
    for d, t, s, _ in rows:
        sizes[s] += len((t or "").split())
        by_id[d] = s
    want = water_fill(sizes)
    taken = defaultdict(int)
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.05 * want[s], 100) or s == "c"
    again = mix_sources(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string, size int")).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).collect() == []
    got = mix_sources(spark.createDataFrame([(1, None, "a"), (2, " \n", None)], schema)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2
