import random
import zlib

import numpy as np
import pyarrow.fs

from rasterloom.llm import token_files as tf
from rasterloom.llm.subwords import Encoder, vocabulary

PARTS = [" ", "  ", "\n", "\n\n", "a", "Bc", "é", "12", ".", "!!", "'s", "\t", "\x1c", "\r\n", "word", "😀", "<|endoftext|>", "\x85", "日本"]


def test_encoder_equals_library():
    enc, rng = Encoder(vocabulary()), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(9)))
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.library.encode(text, add_special_tokens=False).ids


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start int, part string").repartition(3)


def test_round_trip(spark):
    rng = random.Random(2)
    texts = [None, "", "one two\nthree", "x" * 50_000, "w " * 9000] + ["".join(rng.choice(PARTS) for _ in range(30)) for _ in range(60)]
    rows = [(i * 3 - 7, t, 1, "p") for i, t in enumerate(texts)]
    lib = Encoder(vocabulary()).library
    want, at = [], 0
    for d, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tf.token_digest(docs_of(spark, rows)).collect())) == want


def test_sequences_are_views_with_masks(spark):
    folder = tf.new_folder(spark, "test")
    rows = [(i, "tok " * i, 1, "p") for i in range(50)]
    manifest = tf.write_token_files(docs_of(spark, rows), folder, length=16, rows=4).orderBy("part").collect()
    fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
    for m in manifest:
        part = tf.PartReader(fs, m.path)
        n = sum(part.file.get_batch(b).num_rows for b in range(part.file.num_record_batches))
        assert n == -(-m.n_tokens // 16)
        flat, masks = [], 0
        for i in range(n):
            ids, mask = part.sequence(i)
            assert not ids.flags.owndata and len(ids) == 16
            flat += ids.tolist()
            masks += sum(mask.to_pylist())
        assert masks == m.n_tokens and flat[: m.n_tokens] == part.tokens(0, m.n_tokens).tolist()


def test_empty_nulls_and_repeats(spark):
    assert tf.token_digest(docs_of(spark, []).limit(0)).collect() == []
    got = sorted(map(tuple, tf.token_digest(docs_of(spark, [(None, None, 1, "p"), (4, "a", 1, "p"), (4, "a", 1, "p")])).collect()), key=lambda r: r[1])
    assert [r[:3] for r in got] == [(None, 0, 1), (4, 1, 2), (4, 3, 2)]
