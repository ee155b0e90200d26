import json

import numpy as np

from rasterloom import cli
from rasterloom.operators import optimize as op
from rasterloom.sources import headers, images, manifests
from tests.test_images import art, ramp


def test_reports_for_each_kind_of_file(spark, tmp_path):
    deep = (np.arange(48 * 64 * 4, dtype=np.uint32) * 257 % 65536).astype(np.uint16).reshape(48, 64, 4)
    noisy = images.write_png(ramp(), [("gAMA", b"\0\0\xb1\x8f"), ("tEXt", b"k\0v")], level=0)
    files = {"ramp.png": noisy, "art.png": images.write_png(art(), level=0), "deep.png": images.write_png(deep, level=0), "x.gif": b"GIF89a", "e.png": b"", "cut.png": noisy[:60], "p.jpg": b"\xff\xd8\xff\xd9"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    got = {r.path: r for r in op.optimize_files(df).collect()}
    assert {k: r.error for k, r in got.items() if r.error} == {"x.gif": "UNSUPPORTED_FORMAT", "e.png": "RESOURCE_LIMIT", "cut.png": "DECODE_FAILED"}
    r = got["ramp.png"]
    assert r.encoder == "palette" and not r.lossless and r.optimized_bytes < r.original_bytes and [c["name"] for c in headers.png_header(bytes(r.output))["chunks"]] == ["gAMA"]
    assert got["art.png"].lossless and got["art.png"].palette_colors == 3 and op.same_pixels(images.read_png(bytes(got["art.png"].output)), art())
    assert got["deep.png"].lossless and got["deep.png"].encoder == "lossless" and np.array_equal(images.read_png(bytes(got["deep.png"].output)), deep)
    assert got["p.jpg"].encoder == "passthrough" and got["p.jpg"].saved_percent == 0
    again = op.optimize_one("a", bytes(got["art.png"].output))
    assert again["encoder"] == "passthrough" and again["output"] == bytes(got["art.png"].output)


def test_guards_come_before_decoding():
    assert op.guard(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\x08acTL" + bytes(12))[0] == "ANIMATED_PNG"
    big = images.write_png(np.zeros((1, 1, 4), np.uint8))
    big = big[:16] + (100_000).to_bytes(4, "big") * 2 + big[24:]
    assert op.guard(big)[0] == "RESOURCE_LIMIT"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.png").write_bytes(images.write_png(art(), level=0))
    assert cli.main(["optimize", str(tmp_path / "a.png"), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["encoder"] == "palette" and (tmp_path / "a.optimized.png").exists()
    assert cli.main(["benchmark", str(tmp_path), "--csv", "--runs", "2"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == op.CSV_HEAD and len(lines) == 3 and all(len(x.split(",")) == 9 for x in lines)
    small = images.write_png(np.full((4, 4, 4), 255, np.uint8))
    (tmp_path / "s.png").write_bytes(small)
    assert cli.main(["metrics", str(tmp_path / "s.png"), str(tmp_path / "s.png")]) == 0 and "100.0" in capsys.readouterr().out


def test_manifests(spark, tmp_path):
    item = {"path": "x/a.png", "license": "CC0", "width": 3}
    (tmp_path / "m.json").write_text(json.dumps({"items": [item, {"path": "b.jpg"}]}))
    (tmp_path / "l.json").write_text(json.dumps([item]))
    got = manifests.read_manifest(spark, str(tmp_path / "m.json")).orderBy("path").collect()
    assert [(r.path, r.license, r.width) for r in got] == [("b.jpg", None, None), ("x/a.png", "CC0", 3)]
    assert manifests.read_manifest(spark, str(tmp_path / "l.json")).count() == 1
    import hashlib

    (tmp_path / "s.txt").write_text(f"{hashlib.sha256(b'1').hexdigest()}  a.png\n{'0' * 64}  b.jpg\n")
    files = spark.createDataFrame([("file:/x/a.png", bytearray(b"1"))], "path string, content binary")
    assert {r.path: r.ok for r in manifests.verified(files, manifests.read_checksums(spark, str(tmp_path / "s.txt"))).collect()} == {"a.png": True, "b.jpg": False}
    df = spark.createDataFrame([("{}",), ('{"minQuality": 7}',), ("[1]",), ("nope",), (None,)], "t string")
    assert [(r.o.minQuality, r.o.code) for r in df.select(manifests.options(df.t).alias("o")).collect()] == [(40, None), (7, None), (40, "INVALID_OPTIONS"), (40, "INVALID_OPTIONS"), (40, "INVALID_OPTIONS")]
