import struct

import pytest

from rasterloom.sources import headers as h

END = b"\xff\xda\x00\x02"


def sof(n, marker=b"\xc2"):
    return b"\xff" + marker + b"\x00\x08\x08\x00\x01\x00\x01" + bytes([n])


def app2(profile, seq=1, total=1):
    body = b"ICC_PROFILE\0" + bytes([seq, total]) + profile
    return b"\xff\xe2" + struct.pack(">H", len(body) + 2) + body


def profile(primaries, gamma, size=None):
    fixed = lambda v: struct.pack(">i", round(v * 65536))
    tags = [(n, b"XYZ \0\0\0\0" + b"".join(map(fixed, p))) for n, p in zip((b"rXYZ", b"gXYZ", b"bXYZ"), primaries)]
    tags.append((b"rTRC", b"curv\0\0\0\0" + struct.pack(">IH", 1, round(gamma * 256))))
    table, body, at = b"", b"", 132 + 12 * len(tags)
    for n, t in tags:
        table += n + struct.pack(">II", at + len(body), len(t))
        body += t
    total = 132 + len(table) + len(body)
    head = struct.pack(">I", total) + bytes(12) + b"RGB " + bytes(16) + b"acsp" + bytes(88)
    return head + struct.pack(">I", len(tags)) + table + body


def test_components_orientation_and_truncation():
    assert h.jpeg_header(b"\xff\xd8" + sof(4) + END)["components"] == 4
    assert h.jpeg_header(b"\xff\xd8" + sof(3, b"\xc4") + END)["components"] == 0
    turned = h.insert_segments(b"\xff\xd8" + sof(3) + END, [h.orientation_segment(6)])
    assert h.jpeg_header(turned)["orientation"] == 6 and h.jpeg_header(b"\xff\xd8" + sof(3) + END)["orientation"] == 1
    assert h.jpeg_header(b"\xff\xd8\xff\xe2\x00\xff") is None and h.jpeg_header(b"") is None
    assert h.exif_orientation(b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x08\0\0\0") == 8 and h.exif_orientation(b"XX") is None


def test_profiles():
    srgb, adobe = h.PRIMARIES["srgb"], ((0.6097, 0.3111, 0.0195), (0.2053, 0.6257, 0.0609), (0.1492, 0.0632, 0.7446))
    kinds = [h.rgb_profile_kind(profile(p, g)) for p, g in ((srgb, 2.2), (srgb, 1.8), (adobe, 2.2), (h.PRIMARIES["display-p3"], 2.2))]
    assert kinds == ["srgb", "other", "other", "display-p3"]
    whole = profile(srgb, 2.2)
    data = b"\xff\xd8" + app2(whole[100:], 2, 2) + app2(whole[:100], 1, 2) + sof(3) + END
    info = h.jpeg_header(data)
    assert info["icc_space"] == "RGB " and h.join_icc(info["icc"]) == whole and h.valid_icc(whole)
    assert h.join_icc(info["icc"][:1]) is None and not h.valid_icc(whole[:90]) and not h.valid_icc(None)


@pytest.mark.parametrize(
    "tag, want",
    [
        (b"curv\0\0\0\0\0\0\0\0", 0.5),
        (b"curv\0\0\0\0" + struct.pack(">IHHH", 3, 0, 13107, 65535), 0.2),
        (b"para\0\0\0\0" + struct.pack(">HHi", 0, 0, 2 * 65536), 0.25),
        (b"para\0\0\0\0" + struct.pack(">HH4i", 2, 0, 65536, 65536, 0, 6554), 0.6),
        (b"para\0\0\0\0" + struct.pack(">HH5i", 3, 0, 65536, 65536, 0, 32768, 65536), 0.25),
        (b"curv\0\0\0\0" + struct.pack(">I", 9), None),
        (b"none", None),
    ],
)
def test_tone_curves(tag, want):
    assert h.tone(tag, 0.5) == (want if want is None else pytest.approx(want, abs=1e-4))


def test_animation_flag():
    chunk = lambda n, b=b"": struct.pack(">I", len(b)) + n + b + b"\0\0\0\0"
    assert h.png_header(h.PNG_SIGNATURE + chunk(b"acTL", b"12345678"))["animated"]
    # a truncated control chunk says nothing
    assert not h.png_header(h.PNG_SIGNATURE + struct.pack(">I", 8) + b"acTL")["animated"]
    assert not h.png_header(h.PNG_SIGNATURE + chunk(b"IEND") + chunk(b"acTL"))["animated"]
    assert h.png_header(b"")["bit_depth"] == 8
