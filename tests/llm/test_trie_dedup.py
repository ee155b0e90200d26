import hashlib
import random
import re

import pytest

from rasterloom.llm.trie_dedup import NODE, PatriciaTrie, exact_owners


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    out = []
    for d, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_forks_merges_and_spills():
    rng = random.Random(3)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(2000)]
    want = {}
    for i, k in enumerate(keys):
        want[k] = min(want.get(k, i), i)
    for limit in (1 << 30, 200 * NODE, 20 * NODE):
        trie = PatriciaTrie(min, limit)
        for i, k in enumerate(keys):
            trie.insert(k, i)
        assert (trie.spills > 0) == (limit < 1 << 30) and trie.forks > 10
        assert dict(trie.items()) == want


def rows():
    rng = random.Random(1)
    texts = ["a  b", "a b", "a\tb", "", None, "x" * 200_000, "ab", "abc", "Ünï çødé", " a b"]
    made = [(i, rng.choice(texts)) for i in range(300)] + [(None, "a b"), (None, "alone"), (5, "a b"), (5, "a b")]
    stem = "one stem that all of these share "
    return made + [(1000 + i, stem + "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 9)))) for i in range(1500)]


@pytest.mark.parametrize("limit", [64 << 20, 30 * NODE])
def test_exact_owners_equals_brute_force_and_spills(spark, limit):
    made = rows()
    df = spark.createDataFrame([(d, t, "s", b"") for d, t in made], "doc_id long, text string, sha string, bytes binary").repartition(5)
    sc = spark.sparkContext
    forks, spills = sc.accumulator(0), sc.accumulator(0)
    got = sorted(map(tuple, exact_owners(df, limit, forks=forks, spills=spills).collect()), key=str)
    assert got == brute(made)
    # many strings share a trie of the second level, and it spills by subtree beyond the limit
    assert forks.value > 100 and (spills.value > 0) == (limit < 1 << 20)


@pytest.mark.parametrize("made", [[], [(1, None)], [(3, "x"), (2, "x")]])
def test_tiny_tables(spark, made):
    got = exact_owners(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(made)
