import random
import zlib

import numpy as np

from rasterloom.llm import quality as q


def corpus(n, seed=3):
    rng, words = random.Random(seed), ["river", "stone", "walks", "under", "light", "again", "house", "green"]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 80)))
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "### "), " ".join(w for x in text.split() for w in [x] * 6)])
        rows.append((i, text, "en", "s", 9.9))
        labels.append((i, int(good), 0))
    return rows, labels


def tables(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_quality_and_edges(spark):
    rows, labels = corpus(600)
    rows += [(9000, None, None, None, None), (9001, "", "x", "s", 0.0), (None, "river", "x", "s", 0.0), (9002, "river stone " * 50_000, "x", "s", 0.0)]
    labels += [(9001, None, None), (None, 1, 0)]
    got = {r.doc_id: r for r in q.quality(*tables(spark, rows, labels)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[d].score, y) for d, y, _ in labels[:600] if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, *_ in labels[:600])
    a, b = (np.array([s for s, y in held if y == k]) for k in (1, 0))
    assert (a[:, None] > b[None]).mean() > 0.97 and got[9000].score == got[9001].score


def test_held_out_labels_have_no_effect(spark):
    rows, labels = corpus(200)
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y, t) for d, y, t in labels]
    a, b = (sorted(q.quality(*tables(spark, rows, x)).collect()) for x in (labels, flipped))
    assert a == b


def test_without_labels_or_rows(spark):
    rows, labels = corpus(3)
    docs, lab = tables(spark, rows, labels)
    assert {r.score for r in q.quality(docs, lab.limit(0)).collect()} == {0.5}
    assert q.quality(docs.limit(0), lab).collect() == []


def test_scores_equal_a_plain_loop(spark):
    """Tokens, mean vectors and both layers, one number after the other."""
    import math
    import re

    rows, labels = corpus(120)
    model = q.train([t for _, t, *_ in rows], [y for _, y, _ in labels])
    texts = [t for _, t, *_ in rows[:12]] + ["", "UNSEEN word ### 12 river", "river " * 30_000, rows[0][1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in q.quality_scores(df, model).collect()}
    for i, text in enumerate(texts):
        ids = []
        for token in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text):
            known = model.vocabulary.get(q.key(token))
            ids.append(model.vocabulary.get(q.shape(token), 0) if known is None else known)
        x = [0.0] * (q.DIM + 3)
        for k in range(q.DIM):
            x[k] = sum(n * float(model.vectors[t][k]) for t, n in ((t, ids.count(t)) for t in set(ids))) / max(1, len(ids))
        if ids:
            x[q.DIM] = sum(a == b for a, b in zip(ids, ids[1:])) / (len(ids) - 1) if len(ids) > 1 else 0
            x[q.DIM + 1], x[q.DIM + 2] = len(set(ids)) / len(ids), math.log1p(len(ids)) / 10
        z = [(v - float(m)) / float(s) for v, m, s in zip(x, model.mean, model.scale)]
        hidden = [max(0.0, sum(z[k] * float(model.w1[k][j]) for k in range(len(z))) + float(model.b1[j])) for j in range(q.HIDDEN)]
        logit = sum(h * float(w) for h, w in zip(hidden, model.w2)) + float(model.b2[0])
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit / model.temperature))))
        assert math.isclose(got[i].score, want, abs_tol=1e-3) and got[i].predicted == (got[i].score >= q.THRESHOLD)
    assert got[0].score == got[15].score


def test_repeated_ids_and_two_labels(spark):
    rows, labels = corpus(60)
    docs, lab = tables(spark, rows + rows[:20], labels + [(d, 1 - y, t) for d, y, t in labels[:5]])
    got = q.quality(docs, lab).collect()
    assert len(got) == 80 and len({(r.doc_id, r.score) for r in got}) == 60
