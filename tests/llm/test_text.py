import random

import pyarrow as pa

from rasterloom.llm.text import LONG, RUN, hashed_words, words


def test_hashed_words_are_equal_where_words_are():
    rng = random.Random(4)
    parts = ["a", "B", "ab", "ba", "Straße", "é", " ", "x" * (LONG - 1), "x" * LONG, "X" * LONG, "y" * 5000, "0"]
    texts = ["".join(rng.choice(parts + [" ", "\t", "\r\n", "\x0b", "\x0c", "  "]) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    texts += ["", None, " ", "a", "no end", "\n", "z " * (RUN // 2 + 100), "w" * (RUN + 500) + " tail", "a"]
    column = pa.array(texts, pa.string())
    for got, want in ((column, texts), (column.slice(7, 290), texts[7:297]), (column.cast(pa.large_string()), texts), (column.slice(0, 0), [])):
        h, at = hashed_words(got)
        assert len(at) == len(want) + 1 and at[-1] == len(h)
        names = {}
        for i, t in enumerate(want):
            ws = words(t)
            assert len(ws) == at[i + 1] - at[i]
            for w, x in zip(ws, h[at[i] : at[i + 1]].tolist()):
                assert names.setdefault(w, x) == x
        assert len(set(names.values())) == len(names)


def test_hashes_of_many_short_words_differ():
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789.-"
    text = " ".join(a + b + c + d for a in alphabet for b in alphabet for c in alphabet[:20] for d in alphabet[:20])
    h, _ = hashed_words(pa.array([text]))
    assert len(set(h.tolist())) == len(h)
