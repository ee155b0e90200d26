import random

from rasterloom import catalog


def test_palettes_hold_every_pixel(spark, tmp_path):
    """Pixels after the 64th count, and a document of more than 256 colours has no exact palette."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    colors = [f"c{k:03d}" for k in range(257)]
    texts = {1: [word() for _ in range(20)], 2: ["aaaa"] * 64 + ["bbbb", "cccc", "aaaa"], 3: colors[:256] * 2, 4: colors}
    spark.createDataFrame([(d, "".join(t)) for d, t in texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    palettes, planes = {}, {}
    for r in catalog.QUERIES["exact_palette"](spark, str(tmp_path)).collect():
        palettes.setdefault(r.doc_id, {})[r.idx] = (r.color, r.pixels)
    for r in catalog.QUERIES["palette_index_plane"](spark, str(tmp_path)).collect():
        planes.setdefault(r.doc_id, {})[r.i] = r.idx
    assert set(palettes) == set(planes) == {1, 2, 3}
    for d in palettes:
        seen = list(dict.fromkeys(texts[d]))
        assert palettes[d] == {i: (int.from_bytes(c.encode(), "big"), texts[d].count(c)) for i, c in enumerate(seen)}
        assert planes[d] == {i: seen.index(c) for i, c in enumerate(texts[d])}
