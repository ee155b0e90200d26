import struct
import zlib

import numpy as np
import pytest

from rasterloom.operators import analysis, metrics, palette, quantize
from rasterloom.sources import headers, images


def ramp(h=24, w=32):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([x * 7 % 256, y * 9 % 256, (x + y) * 3 % 256, np.full_like(x, 255)], -1).astype(np.uint8)


def art():
    y, x = np.mgrid[0:48, 0:64]
    px = np.zeros((48, 64, 4), np.uint8)
    px[:] = (0, 0, 255, 255)
    px[(x + y) % 3 == 0] = (255, 180, 0, 128)
    px[:, :16] = 0
    return px


def test_png_round_trips_and_keeps_display_chunks():
    for px in (ramp(), art(), np.random.default_rng(1).integers(0, 65536, (9, 5, 4)).astype(np.uint16)):
        data = images.write_png(px, [("gAMA", b"\0\0\xb1\x8f"), ("pHYs", b"123456789")])
        assert np.array_equal(images.read_png(data), px)
        info = headers.png_header(data)
        assert [c["name"] for c in info["chunks"]] == ["gAMA", "pHYs"] and info["bit_depth"] == (16 if px.dtype == np.uint16 else 8)


@pytest.mark.parametrize("colors", [2, 3, 16, 200])
def test_indexed_png_round_trip(colors):
    rng = np.random.default_rng(colors)
    table = rng.integers(0, 256, (colors, 4)).astype(np.uint8)
    table[1:, 3] = 255
    index = rng.integers(0, colors, (7, 13))
    assert np.array_equal(images.read_png(images.write_indexed_png(index, table)), table[index])


def test_all_png_filters():
    px = ramp(10, 6)[..., :3]
    raw, rows = b"", px.reshape(10, -1).astype(int)
    for y in range(10):
        kind, up = y % 5, rows[y - 1] if y else np.zeros(18, int)
        left, corner = np.concatenate((np.zeros(3, int), rows[y][:-3])), np.concatenate((np.zeros(3, int), up[:-3]))
        p = left + up - corner
        order = np.stack([left, up, corner])
        paeth = order[np.abs(order - p).argmin(0), np.arange(18)]
        raw += bytes([kind]) + ((rows[y] - [0, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    data = headers.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 10, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.array_equal(images.read_png(data)[..., :3], px)


def test_scan_guards_and_decoding(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PNG").write_bytes(images.write_png(ramp()))
    (tmp_path / "y.jpg").write_bytes(b"not a jpeg")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "z.txt").write_bytes(b"text")
    files = images.image_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["x.PNG", "y.jpg"]
    good = images.supported(files)
    assert [r.format for r in good.collect()] == ["png"]
    (raster,) = images.png_rasters(good).collect()
    assert (raster.width, raster.height) == (32, 24) and bytes(raster.content) == ramp().tobytes()
    assert images.decoded(spark, str(tmp_path / "a")).count() == 1


def test_alpha_outside_the_sample():
    px = np.full((1001 * 400, 4), 255, np.uint8)
    px[-2, 3] = 1
    got = analysis.content_stats(px, 1001)
    assert got["has_alpha"] and got["stride"] == 1
    big = np.full((1317 * 1030, 4), 255, np.uint8)
    assert analysis.content_stats(big, 1317)["stride"] == 5


def test_quality_scale_and_colour_round_trip():
    assert [quantize.mse_to_quality(quantize.quality_to_mse(q)) for q in (0, 30, 70, 90, 97, 100)] == [0, 30, 70, 90, 97, 100]
    rgba = np.array([[255, 255, 255, 255], [12, 200, 40, 255], [90, 30, 5, 128], [7, 7, 7, 0]], np.uint8)
    back = quantize.to_bytes(quantize.working(rgba)).astype(int)
    assert np.abs(back[:3] - rgba[:3]).max() <= 1 and not back[3].any()
    black, white, clear = (quantize.working(np.array([c], np.uint8)) for c in ([0, 0, 0, 255], [255, 255, 255, 255], [0, 0, 0, 0]))
    assert quantize.differences(black, white[0])[0] > 5 and quantize.differences(black, clear[0])[0] > 2


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(7)
    pal = quantize.working(rng.integers(0, 256, (64, 4)).astype(np.uint8))
    pts = quantize.working(rng.integers(0, 256, (2000, 4)).astype(np.uint8))
    index, diff = quantize.nearest(pts, pal, block=97)
    want = np.stack([quantize.differences(pts, p) for p in pal], 1)
    assert np.array_equal(index, want.argmin(1)) and np.allclose(diff, want.min(1))


def test_histogram_cap_and_transparent_merge():
    px = np.array([[9, 9, 9, 0], [1, 2, 3, 0], [5, 5, 5, 255], [5, 5, 5, 255]], np.uint8)
    h = quantize.Histogram(px, None, 100)
    assert len(h.color) == 2 and h.weight.max() == pytest.approx(0.4)
    red = np.zeros((256, 4), np.uint8)
    red[:, 0], red[:, 3] = np.arange(256), 255
    h = quantize.Histogram(red, None, 100)
    assert h.bits == 2 and len(h.color) <= 100


def test_gradient_and_soft_alpha():
    got = quantize.quantize(ramp())
    assert len(got.palette) <= 256 and got.quality >= 55 and got.indices.max() < len(got.palette)
    y, x = np.mgrid[0:20, 0:30]
    soft = np.stack([x * 6, y * 9, x + y, 60 + x * 3], -1).astype(np.uint8)
    soft[:, :10] = 0
    got = quantize.quantize(soft)
    assert (got.palette[got.indices][:, :10, 3] == 0).all()
    alpha = got.palette[:, 3]
    assert (np.diff((alpha == 255).astype(int)) >= 0).all() or len(alpha) > 16
    assert quantize.quantize(ramp(), colors=2, min_quality=99) is None


def test_few_colours_stay_exact():
    strategy, table, index, quality = quantize.select_palette(art(), 3)
    px = art()
    px[px[..., 3] == 0] = 0
    assert strategy == "exact" and len(table) == 3 and quality == 100 and np.array_equal(table[index], px)


def test_blur_and_maps_match_plain_loops():
    m = np.random.default_rng(3).integers(0, 256, (9, 11)).astype(np.uint8)
    pad = lambda r, i: r[min(max(i, 0), len(r) - 1)]
    one = np.array([[sum(int(pad(r, i + d)) for d in range(-2, 4)) // 6 for i in range(11)] for r in m])
    two = np.array([[sum(int(pad(c, i + d)) for d in range(-2, 4)) // 6 for i in range(9)] for c in one.T]).T
    assert np.array_equal(quantize.blur(m), two)
    flat = np.ones((8, 8, 4), np.float32) * 0.5
    noise, edges = quantize.contrast_maps(flat)
    assert (noise == 255).all() and (edges == 255).all() and quantize.contrast_maps(flat[:3]) is None


def test_pixel_histogram_drops_bits(spark):
    px = spark.createDataFrame([(1, i, i, 0, 0, 255) for i in range(256)] + [(2, 0, 9, 9, 9, 0), (2, 1, 1, 1, 1, 0)], "k int, i int, r int, g int, b int, a int")
    got = palette.histogram(px, "k", 100).groupBy("k", "bits").count().collect()
    assert {(r.k, r.bits): r["count"] for r in got} == {(1, 2): 64, (2, 0): 1}


def test_lossless_sees_size_and_ignores_hidden_colour(spark):
    one = [(1, bytearray([5, 5, 5, 0, 1, 2, 3, 255])), (2, bytearray([1, 1, 1, 255])), (3, bytearray([1, 1, 1, 255])), (4, bytearray()), (5, None)]
    other = [bytearray([7, 7, 7, 0, 1, 2, 3, 255]), bytearray([1, 1, 2, 255]), bytearray([1, 1, 1, 255] * 2), bytearray(), bytearray(4)]
    pairs = spark.createDataFrame([(*p, q) for p, q in zip(one, other)], "k int, content binary, other binary")
    got = {r.k: r for r in metrics.compared(pairs, "k").collect()}
    assert {k: r.lossless for k, r in got.items()} == {1: True, 2: False, 3: False, 5: False}
    assert {k for k, r in got.items() if r.error == "METRIC_FAILED" and r.ssimulacra2 is None} == {3, 5}


def test_dithering_picks_the_nearest_entry_of_every_cell():
    rng = np.random.default_rng(2)
    palette = quantize.working(rng.integers(0, 256, (40, 4)).astype(np.uint8))
    entries = quantize.Entries(palette, 16)
    for p in rng.uniform(-0.1, 1.1, (3000, 4)):
        want = [((p[1:] - e[1:]) ** 2).sum() + ((p[1:] - e[1:] + e[0] - p[0]) ** 2).sum() for e in palette.astype(float)]
        assert want[entries.pick(*p)[0]] == pytest.approx(min(want))


def _png(w, h, depth, kind, rows, extra=b"", interlaced=0):
    """A PNG of unfiltered rows, written without the library's writer."""
    import struct
    import zlib

    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, interlaced)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _key(*values):
    import struct
    import zlib

    body = struct.pack(f">{len(values)}H", *values)
    return struct.pack(">I", len(body)) + b"tRNS" + body + struct.pack(">I", zlib.crc32(b"tRNS" + body))


@pytest.mark.parametrize(
    ("depth", "kind", "row", "key", "clear"),
    [
        (8, 2, bytes([1, 2, 3, 9, 9, 9, 1, 2, 3]), (1, 2, 3), [0, 2]),
        (8, 0, bytes([5, 6, 5]), (5,), [0, 2]),
        (2, 0, bytes([0b01101100]), (1,), [0]),
        (16, 2, bytes([0, 1, 0, 2, 0, 3, 0, 1, 0, 2, 1, 3, 0, 1, 0, 2, 0, 3]), (1, 2, 3), [0, 2]),
        (16, 0, bytes([0, 7, 1, 7, 0, 7]), (7,), [0, 2]),
    ],
)
def test_colour_key_is_transparent_and_survives(depth, kind, row, key, clear):
    data = _png(3, 1, depth, kind, b"\0" + row, _key(*key))
    px = images.read_png(data)
    assert np.flatnonzero(px[0, :, 3] == 0).tolist() == clear
    assert np.array_equal(images.read_png(images.write_png(px)), px)


def test_interlaced_png():
    PASSES = images.PASSES

    rng = np.random.default_rng(3)
    want = rng.integers(0, 256, (11, 13, 3), np.uint8)
    rows = b"".join(b"\0" + line.tobytes() for x, y, dx, dy in PASSES for line in want[y::dy, x::dx] if line.size)
    got = images.read_png(_png(13, 11, 8, 2, rows, interlaced=1))
    assert np.array_equal(got[..., :3], want) and (got[..., 3] == 255).all()
    bits = rng.integers(0, 2, (9, 10), np.uint8)
    rows = b"".join(b"\0" + np.packbits(line).tobytes() for x, y, dx, dy in PASSES for line in bits[y::dy, x::dx] if line.size)
    assert np.array_equal(images.read_png(_png(10, 9, 1, 0, rows, interlaced=1))[..., 0], bits * 255)


def test_writer_uses_every_filter_and_reads_back():
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:40, 0:50]
    for px in (np.stack([x * 5, y * 6, (x + y) * 2, np.full_like(x, 255)], -1), np.stack([x * y % 256, (x * x + y * y) % 256, x ^ y, x * 3], -1), rng.integers(0, 256, (40, 50, 4))):
        px = px.astype(np.uint8)
        assert np.array_equal(images.read_png(images.write_png(px)), px)
        assert np.array_equal(images.read_png(images.write_png(px.astype(np.uint16) * 257)), px.astype(np.uint16) * 257)
