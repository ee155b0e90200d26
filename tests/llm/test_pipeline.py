import random
import re
import zlib

import numpy as np

import corpus_pipeline as cp
from rasterloom.llm import decontaminate as dc
from rasterloom.llm import language_id as li
from rasterloom.llm.mixing import mix_sources
from rasterloom.llm.subwords import Encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng, rows = random.Random(8), []
    syl = {"en": ["th", "er", "ing", "wh", "ou"], "es": ["que", "ció", "ñ", "os", "la"]}
    word = lambda lang: "".join(rng.choice(syl[lang]) for _ in range(rng.randrange(1, 5)))
    items = [(i, " ".join(word("en") + str(i) for _ in range(25))) for i in range(3)]
    for i in range(150):
        lang = rng.choice(["en", "es"])
        w = [word(lang) for _ in range(rng.randrange(20, 90))]
        if i % 15 == 1:
            w[5:5] = rng.choice(items)[1].upper().split()
        rows.append((i, " ".join(w), lang, f"s{i % 4}", 0))
    for i in range(150, 180):
        base = rows[rng.randrange(20)][1].split()
        base[rng.randrange(len(base))] = "edited"
        rows.append((i, " ".join(base), None, "s1", 0))
    return rows + [(500, None, "en", "s0", 0), (501, "", None, None, 0), (502, "12 34", "en", "s2", 0)], items


def kept_brute(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1].lower())
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))})
    top = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    top[i] = top[j] = min(top[i], top[j])
        if top == (top := [top[t] for t in top]):
            break
    return [r for i, r in enumerate(rows) if top[i] == i]


def test_stages_match_plain_versions(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got.append(docs.collect())
    assert all(docs_out[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"] for docs_out in got[:-1])
    ids = lambda rs: sorted(r[0] for r in rs)

    train = spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2], SCHEMA)
    classifier = li.Classifier(li.fit(train))
    letters = lambda t: re.sub(r"[^a-zñó]+", " ", (t or "").lower()).strip()
    want = [r for r in rows if letters(r[1]) and classifier.predict(letters(r[1]))[1] >= li.LEAST]
    assert ids(got[0]) == ids(want) and len(want) >= len(rows) - 4

    want = kept_brute(sorted(want))
    assert ids(got[1]) == ids(want)

    plain = {k: dc.plain_words(t) for k, t in items}
    share = lambda t, k: dc.align(np.array([hash(x) for x in plain[k]]), np.array([hash(x) for x in dc.plain_words(t)]))[0] / len(plain[k])
    want = [r for r in want if all(share(r[1], k) < dc.LEAST for k in plain)]
    assert ids(got[2]) == ids(want)

    copies = {r[0]: sum(x[0] == r[0] for x in got[3]) for r in want}
    assert set(ids(got[3])) <= set(ids(want)) and all(0 <= c <= 3 for c in copies.values())
    size = lambda r: len(r[1].split())
    total, weights = sum(map(size, want)), {"s0": 1, "s1": 2, "s2": 3, "s3": 1}
    for s, w in weights.items():
        assert abs(sum(copies[r[0]] * size(r) for r in want if r[3] == s) - total * w / 7) < 0.15 * total * w / 7

    lib, at, wanted = Encoder(vocabulary()).library, 0, []
    for r in sorted(got[3]):
        e = lib.encode(r.text, add_special_tokens=False).ids + [2]
        wanted.append((r.doc_id, at, len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
        at += len(e)
    assert sorted(map(tuple, got[4]), key=lambda r: r[1]) == wanted


def test_run_on_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []


ODD = SCHEMA + ", lang_pred string, rejected int, held int, number long, many string, letters string, row string"


def odd_rows():
    """Repeated rows, null ids, null and very long texts, and columns with names that operators use."""
    extra = ("p", 7, 8, 9, "m", "l", "r")
    base = [(i, " ".join(f"word{i}x{k} the und que" for k in range(20)), "en", f"s{i % 3}", 0, *extra) for i in range(30)]
    base += [base[3]] * 4 + [(None, "no id here but some words " * 3, "en", "s0", 0, *extra)] * 3 + [(None, "another text with no id", None, "s1", 0, *extra)]
    return base + [(40, None, None, None, 0, *extra), (41, "", "en", "s0", 0, *extra), (42, "long the word " * 30_000, "en", "s1", 0, *extra)]


def test_odd_rows_and_columns_pass_every_stage(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame([(0, "alpha beta gamma delta epsilon")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert {tuple(r) for r in docs.collect()} <= set(rows)
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_near_dedup_keeps_one_row_of_each_repeated_text(spark, tmp_path):
    got = [r[:2] for r in cp.drop_near_duplicates(spark, spark.createDataFrame(odd_rows(), ODD).repartition(3), str(tmp_path)).collect()]
    assert len(got) == len(set(got)) == len({r[:2] for r in odd_rows()})


def test_mixing_takes_repeated_rows_one_by_one(spark, tmp_path):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    taken = sum(r.taken for r in mix_sources(docs).collect())
    got = cp.mix_to_weights(spark, docs, str(tmp_path)).collect()
    assert sum(len((r.text or "").split()) for r in got) == taken
    assert sum(r.doc_id == 3 for r in got) <= 3 * 5 and sum(r.doc_id is None for r in got) <= 3 * 4


def test_near_dedup_stage_orders_shingles_by_all_documents(spark, monkeypatch):
    from rasterloom.llm import hyperminhash as hm

    seen, sketches = [], hm._sketches
    monkeypatch.setattr(hm, "_sketches", lambda size, threshold, shared: seen.append(shared.value) or sketches(size, threshold, shared))
    rows = [(i, f"one two three four five{i % 9} six{i}") for i in range(40)]
    cp.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert len(seen) == 1 and seen[0].sum() == 40 * 3
