import random
import zlib

import pytest

from rasterloom.llm import language_id as li

SYLLABLES = {"aa": ["th", "er", "ing", "wh", "ou"], "bb": ["que", "ció", "ñ", "os", "la"], "cc": ["sch", "ung", "ü", "ei", "tz"]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 60))]
        rows.append((i, " ".join(words), lang, "s", 0.0))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(400) + [(1000, None, "aa", "s", 0.0), (1001, "12 %%", None, "s", 0.0), (1002, "", "bb", "s", 0.0), (None, "the thing", None, None, None), (5000, "ther wherou " * 60_000, None, "s", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    got = {r.doc_id: r for r in li.language_id(df).collect()}
    assert len(got) == len(rows)
    for d, *_ in rows:
        assert got[d].held_out == (zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2) and 0 <= got[d].score <= 1
    held = [r for r in rows[:400] if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    for d in (1000, 1001, 1002):
        assert got[d].lang_pred == "und" and got[d].rejected
    assert got[5000].lang_pred == "aa"


def test_labels_of_held_out_rows_have_no_effect(spark):
    rows = corpus(200)
    swapped = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 4 == 2 else lang, "q", 1.0) for d, t, lang, *_ in rows]
    schema = "doc_id long, text string, lang string, source string, score double"
    a, b = (sorted(li.language_id(spark.createDataFrame(r, schema)).collect()) for r in (rows, swapped))
    assert a == b


def test_narrow_margin_is_rejected():
    c = li.Classifier({"a": b"same content here", "b": b"same content here", "c": b"same content here"})
    _, score = c.predict("same")
    assert score == pytest.approx(1 / 3) and score < li.LEAST


def test_empty_and_unlabelled(spark):
    schema = "doc_id long, text string, lang string"
    assert li.language_id(spark.createDataFrame([], schema)).collect() == []
    assert li.language_id(spark.createDataFrame([(1, "abc", None)], schema)).first().lang_pred == "und"


def test_predictions_equal_a_plain_loop(spark):
    """Sizes of pieces with each dictionary, added up; the smallest sum names the language."""
    import re

    import zstandard

    rows = corpus(60) + [(700, "ther wherou " * 5_000 + " queció" * 5_000, None, "s", 0.0), (701, "Ünter 12 THE", None, "s", 0.0), (3, "the ther", "aa", "s", 0.0)]
    schema = "doc_id long, text string, lang string, source string, score double"
    df = spark.createDataFrame(rows, schema).repartition(3)
    content = li.fit(df)
    got = sorted((r.row.doc_id, r.row.text, r.lang_pred, r.score) for r in li.identify(df, content).collect())
    want = []
    for d, t, *_ in rows:
        data = " ".join(re.findall(r"[^\W\d_]+", t.lower())).encode()
        sums = {}
        for lang, c in content.items():
            z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sums[lang] = 0
            for i in range(0, len(data), li.PIECE):
                sums[lang] += len(z.compress(data[i : i + li.PIECE]))
        best = min(sums, key=lambda k: (sums[k], k))
        want.append((d, t, best, 1 / sum(2.718281828459045 ** (-li.STEEP * (s - sums[best])) for s in sums.values())))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert all(a[3] == pytest.approx(b[3], rel=1e-6) for a, b in zip(got, sorted(want)))


def test_dictionaries_hold_whole_documents_up_to_a_bound(spark, monkeypatch):
    rows = corpus(50)
    monkeypatch.setattr(li, "BYTES", 1000)
    content = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double"))
    texts = {t for _, t, *_ in rows}
    assert all(len(c) <= 1000 + c.count(b"\n") and set(c.decode().split("\n")) <= texts for c in content.values())


def test_rows_keep_their_columns_whatever_their_names(spark):
    rows = corpus(80)
    df = spark.createDataFrame([(d, t, lang, "x", True, None, 1) for d, t, lang, *_ in rows], "doc_id long, text string, lang string, lang_pred string, rejected boolean, row string, letters int")
    kept = li.kept(df, li.fit(df))
    assert kept.schema == df.schema and sorted(kept.collect(), key=str) == sorted(df.collect(), key=str)
