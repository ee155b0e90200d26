import random
import re

import numpy as np
import pytest

from rasterloom.llm import hyperminhash as hm
from rasterloom.llm.components import connected

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, size=4, threshold=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        c = min(ids, default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    common = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 12, 60, 200, 800]))]
        if rng.random() < 0.5:
            base += common
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 30) + 1)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(x.upper() if rng.random() < 0.3 else x for x in w))
    rows += ["", None, " \n", "", "a b", "A\tB", "é É", "a b c d e", "a b c d e", "x " * 40_000, "y " * 30_000 + "z"]
    return [(i * 5 % 997, t) for i, t in enumerate(rows)]


def test_components_match_brute_force(spark):
    rows = corpus() + [(None, "null id text that stands alone"), (17, "a b")]
    df = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id long, text string, n int, regs binary").repartition(3)
    assert sorted(map(tuple, hm.near_duplicates(df).collect()), key=str) == brute(rows)


def test_residual_blocks_find_links_that_leaders_miss(spark, monkeypatch):
    """A chain: neighbours are linked, ends are not; small blocks cut the buckets."""
    monkeypatch.setattr(hm, "BLOCK", 2)
    w = [f"t{i}" for i in range(400)]
    rows = [(100 - i, " ".join(w[i * 9 : i * 9 + 100])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, hm.near_duplicates(df).collect()), key=str) == brute(rows)


def test_estimate_is_close_and_corrected():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        n, share = int(rng.integers(300, 2000)), rng.uniform(0.3, 0.95)
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate((a[: int(n * share)], rng.integers(0, 2**64, n - int(n * share), dtype=np.uint64)))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        agree = (hm.registers(np.sort(a)) == hm.registers(np.sort(b))).sum()
        errors.append(hm.estimate(agree, n, n) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_connected(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if k != v}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "only one")]])
def test_tiny_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, hm.near_duplicates(df).collect()), key=str) == brute(rows)


def edited(n, apart, name):
    """A text of n shingles and one that lacks the first so many of them."""
    w = [f"{name}x{k}" for k in range(n + 3)]
    return " ".join(w), " ".join(w[apart:])


def test_every_link_between_small_sets_is_found(spark):
    """Pairs at and just below the threshold, of sets with few to more than SMALL shingles."""
    rows = []
    for k in range(40):
        for n in (5, 10, 20, 40, 245, 310):
            for apart in (n // 5, n // 5 + 1):
                rows += edited(n, apart, f"n{n}k{k}a{apart}")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in hm.near_duplicates(df).collect()}
    for i in range(0, len(rows), 2):
        a, b = (set(zip(*(t.split()[k:] for k in range(4)))) for t in rows[i : i + 2])
        linked = 100 * len(a & b) >= 80 * len(a | b)
        assert (got[i], got[i + 1]) == ((i, i) if linked else (i, i + 1)) or min(len(a), len(b)) >= hm.SMALL


def test_prefixes_meet_and_registers_never_overrule():
    rng = np.random.default_rng(5)
    for _ in range(2000):
        n = int(rng.integers(1, 320))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        gone, new = rng.integers(0, n // 5 + 1), rng.integers(0, n // 5 + 1)
        b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 2**64, new, dtype=np.uint64))))
        counts = rng.integers(0, 3, 1 << 8)
        both = len(np.intersect1d(a, b))
        if min(len(a), len(b)) < hm.SMALL and 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(hm.prefix(a, 80, counts), hm.prefix(b, 80, counts)))
            ra, rb = hm.own_registers(a), hm.own_registers(b)
            assert len(np.intersect1d(hm.candidate_keys(a, ra, 80, counts), hm.candidate_keys(b, rb, 80, counts)))
            assert (ra != rb).sum() <= hm.most_apart(len(a), len(b), 80)


@pytest.mark.parametrize("n", [256, 300, 400, 700, 1500])
def test_recall_of_links_between_larger_sets(n):
    """Pairs at the threshold meet in a band and pass the estimate; exact confirmation follows."""
    rng, found, pairs = np.random.default_rng(n), 0, 400
    for _ in range(pairs):
        both = rng.integers(0, 2**64, n, dtype=np.uint64)
        apart = n // 5
        a, b = np.sort(both), np.sort(both[: n - apart])
        ra, rb = hm.registers(a), hm.registers(b)
        met = len(np.intersect1d(hm.band_keys(ra), hm.band_keys(rb))) > 0
        found += met and hm.estimate((ra == rb).sum(), len(a), len(b)) >= hm.least_estimate(0.8)
    assert found >= 0.99 * pairs


def test_every_member_of_a_crowded_bucket_is_compared(spark, monkeypatch):
    """Texts share a template and differ in a tail; only some pairs of tails are close enough to be linked."""
    monkeypatch.setattr(hm, "BLOCK", 3)
    rng = random.Random(9)
    template = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        tail = [f"g{i % 20}k{k}" for k in range(18)]
        for _ in range(2):
            tail[rng.randrange(18)] = f"r{rng.randrange(10**6)}"
        rows.append((i, " ".join(template + tail)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, hm.near_duplicates(df).collect()), key=str) == brute(rows)


def test_shingles_are_ordered_by_counts_of_all_documents(spark, monkeypatch):
    seen, sketches = [], hm._sketches
    monkeypatch.setattr(hm, "_sketches", lambda size, threshold, shared: seen.append(shared.value) or sketches(size, threshold, shared))
    rows = corpus()
    hm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = np.zeros(1 << hm.COUNTERS, np.int64)
    for _, t in rows:
        np.add.at(want, (hm.shingle_set(t, 4) & np.uint64((1 << hm.COUNTERS) - 1)).astype(np.int64), 1)
    assert len(seen) == 1 and np.array_equal(seen[0], want)
