import random

import numpy as np
import pytest

from rasterloom.llm import decontaminate as dc


def slow_score(a, b):
    h, best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)], 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_textbook():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 25))
        score, start, end = dc.align(a, b)
        assert score == slow_score(a, b) and (score == 0 or slow_score(a, b[start:end]) == score)


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 6, 30, 60])))) for i in range(30)]
    docs = []
    for d in range(90):
        w, leaked = [rng.choice(vocab) for _ in range(rng.choice([0, 30, 100]))], None
        if d % 3 == 0:
            i, text = rng.choice(items)
            copy = [x.upper() + "," if rng.random() < 0.3 else x for x in text.split()]
            if len(copy) > 10:
                for _ in range(len(copy) // 8):
                    copy[rng.randrange(len(copy))] = rng.choice(vocab)
            at = rng.randrange(len(w) + 1)
            w[at:at] = copy
            leaked = i
        docs.append((d, " ".join(w), leaked))
    return items, docs


@pytest.mark.parametrize("block_words", [500_000, 40])
def test_finds_copies_as_full_alignment_does(spark, monkeypatch, block_words):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block_words)
    items, docs = corpus()
    d = spark.createDataFrame([(i, t, 1.0) for i, t, _ in docs] + [(900, None, 0.0), (901, "", 0.0)], "doc_id long, text string, score double").repartition(3)
    b = spark.createDataFrame(items + [(99, None), (98, " .")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in dc.contaminated(d, b).collect()}
    want = {}
    for i, t, _ in docs:
        for k, text in items:
            a = dc.plain_words(text)
            if (s := slow_score(a, dc.plain_words(t)) / len(a)) >= dc.LEAST:
                want[i, k] = s
    assert {(i, k) for i, _, k in docs if k is not None} <= set(got)
    # seeds are exact runs: only alignments without any rare run of SEED words may be missed
    long = {p: s for p, s in want.items() if len(dc.plain_words(items[p[1]][1])) > 6}
    assert long.items() <= got.items() and got.items() <= want.items()
    kept = {r.doc_id for r in dc.clean(d, b).collect()}
    assert kept == ({i for i, *_ in docs} | {900, 901}) - {i for i, _ in got}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(d, b).collect() == [] and dc.clean(d, b).count() == 1
    assert dc.contaminated(d.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []


@pytest.mark.parametrize("share", [0.15, 0.3])
@pytest.mark.parametrize("exact", [0, 3])
def test_finds_edited_copies_alone_and_beside_exact_ones(spark, share, exact):
    rng = random.Random(int(share * 100))
    items = [(i, " ".join(f"i{i}w{k}" for k in range(40))) for i in range(8)]
    docs = []
    for i, text in items:
        copy = text.split()
        for at in rng.sample(range(len(copy)), int(share * len(copy))):
            copy[at] = f"new{rng.getrandbits(40)}"
        docs.append((i, " ".join([f"a{k}" for k in range(15)] + copy + [f"z{k}" for k in range(15)])))
    docs += [(100 + n * 100 + i, text) for n in range(exact) for i, text in items]
    want = {}
    for d, t in docs:
        i, b = d % 100, dc.plain_words(t)
        a = dc.plain_words(items[i][1])
        s = slow_score(a, b) / len(a)
        # an alignment without any run of SEED words of the item has no seed
        if s >= dc.LEAST and {tuple(a[k : k + dc.SEED]) for k in range(len(a) - 2)} & {tuple(b[k : k + dc.SEED]) for k in range(len(b) - 2)}:
            want[d, i] = s
    assert sum(d < 100 for d, _ in want) == len(items)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in dc.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_popular_half_and_scattered_additions():
    item = [f"w{k}" for k in range(20)]
    block = dc.Block([7], [dc.word_hashes(item)])
    # the kept half may be the popular one
    assert [h[:2] for h in block.hits(" ".join(["x"] * 9 + item[:10] + ["y"] * 9))] == [(7, 0.5)]
    # one run is whole, a word is added after each other word
    spread = [x for w in item[:17] for x in (w, "more")] + item[17:]
    for words in (spread, ["x"] * 60 + spread + ["y"] * 60):
        assert [h[1] for h in block.hits(" ".join(words))] == [slow_score(item, words) / 20]
