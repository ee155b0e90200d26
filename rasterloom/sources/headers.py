"""Readers of JPEG and PNG headers. Plain functions over bytes, and Arrow maps that apply them to a column."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map

#: Signatures, and the PNG chunks that change how pixels are shown.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
DISPLAY_CHUNKS = ("cICP", "iCCP", "sRGB", "gAMA", "cHRM", "pHYs", "eXIf")
#: D50 colourants of red, green and blue, tolerance, and the tone curve at one half.
PRIMARIES = {
    "srgb": ((0.4361, 0.2225, 0.0139), (0.3851, 0.7169, 0.0971), (0.1431, 0.0606, 0.7141)),
    "display-p3": ((0.5151, 0.2412, -0.0011), (0.292, 0.6922, 0.0419), (0.1571, 0.0666, 0.7841)),
}
PRIMARY_TOLERANCE, HALF, HALF_TOLERANCE = 0.003, 0.214, 0.01


def format_of(content: Column) -> Column:
    """``jpeg``, ``png`` or null, by the first bytes."""
    starts = lambda magic: F.substring(content, 1, len(magic)) == F.lit(magic)
    return F.when(starts(b"\xff\xd8\xff"), "jpeg").when(starts(PNG_SIGNATURE), "png")


def mime_of(content: Column) -> Column:
    """The type that the first bytes tell, whatever a file was announced as; null if neither format."""
    return F.concat(F.lit("image/"), format_of(content))


def png_chunks(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Chunks in order up to IEND; stops where a chunk runs over the end of the data."""
    at = len(PNG_SIGNATURE)
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            return
        yield name.decode("latin-1"), data[at + 8 : at + 8 + size]
        if name == b"IEND":
            return
        at += 12 + size


def png_header(data: bytes) -> dict:
    """Size, bit depth (8 if absent), animation flag and display chunks; nothing is said about a truncated
    chunk, decoding decides about that."""
    names, kept = [], []
    for name, body in png_chunks(data):
        names.append(name)
        if name in DISPLAY_CHUNKS:
            kept.append({"name": name, "data": body})
    animated = "acTL" in names
    w, h = struct.unpack_from(">II", data, 16) if len(data) >= 24 else (None, None)
    return {"width": w, "height": h, "bit_depth": data[24] if len(data) > 24 else 8, "animated": animated, "chunks": kept}


def exif_orientation(tiff: bytes) -> int | None:
    order = {b"I": "<", b"M": ">"}.get(tiff[:1])
    if order is None or len(tiff) < 8:
        return None
    (ifd,) = struct.unpack_from(order + "I", tiff, 4)
    if ifd + 2 > len(tiff):
        return None
    (count,) = struct.unpack_from(order + "H", tiff, ifd)
    for at in range(ifd + 2, min(ifd + 2 + 12 * count, len(tiff) - 11), 12):
        tag, value = struct.unpack_from(order + "H6xH", tiff, at)
        if tag == 0x0112:
            return value if 1 <= value <= 8 else None
    return None


def orientation_segment(value: int) -> bytes:
    """An APP1 segment with nothing but the orientation."""
    tiff = b"MM\x00\x2a" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, value, 0, 0)
    return b"\xff\xe1" + struct.pack(">H", 2 + 6 + len(tiff)) + b"Exif\0\0" + tiff


def insert_segments(jpeg: bytes, segments: list[bytes]) -> bytes:
    return jpeg[:2] + b"".join(segments) + jpeg[2:]


def jpeg_header(data: bytes) -> dict | None:
    """components, orientation and raw ICC segments, from the markers before the first scan; None if they
    are malformed."""
    icc, components, orientation, at = [], 0, 1, 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker in (0xDA, 0xD9):
            return {"components": components, "orientation": orientation, "icc": icc, "icc_space": icc_space(icc)}
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        if size < 2 or at + 2 + size > len(data):
            return None
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE2 and body.startswith(b"ICC_PROFILE\0"):
            icc.append(data[at : at + 2 + size])
        elif marker == 0xE1 and body.startswith(b"Exif\0\0"):
            orientation = exif_orientation(body[6:]) or orientation
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            components = body[5] if len(body) > 5 else 0
        at += 2 + size
    return None


def join_icc(segments: list[bytes]) -> bytes | None:
    """The profile of segments numbered 1 to N of N; None if any is missing, repeated or disagrees."""
    parts = sorted((s[16], s[17], s[18:]) for s in segments if len(s) >= 18)
    if not parts or len(parts) != len(segments) or [p[0] for p in parts] != list(range(1, parts[0][1] + 1)) or len({p[1] for p in parts}) > 1:
        return None
    return b"".join(p[2] for p in parts)


def valid_icc(profile: bytes | None) -> bool:
    return profile is not None and len(profile) >= 128 and profile[36:40] == b"acsp" and 128 <= struct.unpack_from(">I", profile)[0] <= len(profile)


def icc_space(segments: list[bytes]) -> str | None:
    first = next((s for s in segments if len(s) > 16 and s[16] == 1), segments[0] if segments else b"")
    return first[34:38].decode("latin-1") if len(first) >= 38 else None


def tone(tag: bytes | None, x: float) -> float | None:
    """An ICC tone curve at ``x``: sampled (interpolated) or one of the five parametric kinds."""
    if not tag or len(tag) < 12:
        return None
    if tag[:4] == b"curv":
        (n,) = struct.unpack_from(">I", tag, 8)
        if n == 0:
            return x
        if len(tag) < 12 + 2 * n:
            return None
        points = struct.unpack_from(f">{n}H", tag, 12)
        if n == 1:
            return x ** (points[0] / 256)
        low = int(x * (n - 1))
        high = min(n - 1, low + 1)
        return (points[low] + (points[high] - points[low]) * (x * (n - 1) - low)) / 65535
    if tag[:4] == b"para":
        (kind,) = struct.unpack_from(">H", tag, 8)
        need = {0: 1, 1: 3, 2: 4, 3: 5, 4: 7}.get(kind)
        if need is None or len(tag) < 12 + 4 * need:
            return None
        g, a, b, c, d, e, f = (*(v / 65536 for v in struct.unpack_from(f">{need}i", tag, 12)), *[0.0] * (7 - need))
        if kind == 0:
            return x**g
        if kind in (1, 2):  # c is the offset of kind 2
            return ((a * x + b) ** g if x >= -b / a else 0.0) + c
        return (a * x + b) ** g + (e if kind == 4 else 0.0) if x >= d else c * x + (f if kind == 4 else 0.0)
    return None


def rgb_profile_kind(profile: bytes | None) -> str | None:
    """``srgb``, ``display-p3`` or ``other``; None without a readable profile."""
    if profile is None or len(profile) < 132:
        return None
    (count,) = struct.unpack_from(">I", profile, 128)
    tags = {}
    for at in range(132, min(132 + 12 * count, len(profile) - 11), 12):
        name, start, size = struct.unpack_from(">4sII", profile, at)
        if start + size <= len(profile):
            tags[name] = profile[start : start + size]
    found = []
    for name in (b"rXYZ", b"gXYZ", b"bXYZ"):
        tag = tags.get(name, b"")
        if len(tag) < 20 or tag[:4] != b"XYZ ":
            return "other"
        found.append([v / 65536 for v in struct.unpack_from(">3i", tag, 8)])
    half = tone(tags.get(b"rTRC"), 0.5)
    if half is None or abs(half - HALF) > HALF_TOLERANCE:
        return "other"
    near = lambda want: all(abs(x - y) <= PRIMARY_TOLERANCE for row, got in zip(want, found) for x, y in zip(row, got))
    return next((kind for kind, want in PRIMARIES.items() if near(want)), "other")


PNG_INFO = "width long, height long, bit_depth int, animated boolean, chunks array<struct<name:string,data:binary>>"
JPEG_INFO = "ok boolean, components int, orientation int, icc_parts int, icc_valid boolean, icc_space string, icc_kind string"


def png_info(files: DataFrame, key: str = "path") -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [{key: k} | png_header(c.as_py() or b"") for k, c in zip(batch[key].to_pylist(), batch["content"])]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(key, batch[key].type), ("width", pa.int64()), ("height", pa.int64()), ("bit_depth", pa.int32()), ("animated", pa.bool_()), ("chunks", pa.list_(pa.struct([("name", pa.string()), ("data", pa.binary())])))]))

    return arrow_map(files.select(key, "content"), run, f"{key} {dict(files.dtypes)[key]}, {PNG_INFO}")


def jpeg_info(files: DataFrame, key: str = "path") -> DataFrame:
    def info(data: bytes) -> dict:
        h = jpeg_header(data)
        if h is None:
            return {"ok": False}
        profile = join_icc(h["icc"])
        kind = rgb_profile_kind(profile) if h["icc_space"] == "RGB " else None
        return {"ok": True, "components": h["components"], "orientation": h["orientation"], "icc_parts": len(h["icc"]), "icc_valid": valid_icc(profile), "icc_space": h["icc_space"], "icc_kind": kind}

    def run(batches):
        kinds = [("ok", pa.bool_()), ("components", pa.int32()), ("orientation", pa.int32()), ("icc_parts", pa.int32()), ("icc_valid", pa.bool_()), ("icc_space", pa.string()), ("icc_kind", pa.string())]
        for batch in batches:
            rows = [{key: k} | info(c.as_py() or b"") for k, c in zip(batch[key].to_pylist(), batch["content"])]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(key, batch[key].type), *kinds]))

    return arrow_map(files.select(key, "content"), run, f"{key} {dict(files.dtypes)[key]}, {JPEG_INFO}")
