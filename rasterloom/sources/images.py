"""Image files: guarded scan, PNG reading and writing with the standard library, JVM decoding of JPEG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.encode import MAX_BYTES, MAX_PIXELS
from ..runtime import arrow_map
from .headers import PNG_SIGNATURE, format_of, png_chunks, png_header


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of all JPEG and PNG names below ``folder``, whatever their case. The length
    guard reaches the listing, so oversize files are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin("jpg", "jpeg", "png"))
    return named.where((F.col("length") > 0) & (F.col("length") <= MAX_BYTES)).select("path", "length", "content")


def supported(files: DataFrame) -> DataFrame:
    """Files that their first bytes name, with that format."""
    return files.withColumn("format", format_of(F.col("content"))).where("format is not null")


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, data): JVM decoding of JPEG and PNG, 8 bits, blue first; broken files
    are left out. Orientation is not applied."""
    return spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(folder).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").where("height > 0")


def _unfilter(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Undo the row filters; rows of none and up are whole-row operations."""
    out = np.zeros((height + 1, stride + step), np.uint8)
    for y in range(height):
        kind, line, above, row = raw[y * (stride + 1)], raw[y * (stride + 1) + 1 : (y + 1) * (stride + 1)], out[y], out[y + 1]
        if kind == 0:
            row[step:] = line
        elif kind == 2:
            row[step:] = line + above[step:]
        elif kind == 1:
            for c in range(step):
                row[step + c :: step] = np.add.accumulate(line[c::step], dtype=np.uint8)
        else:
            cur, up, now = line.tolist(), above.tolist(), row.tolist()
            for i, v in enumerate(cur):
                left, over, corner = now[i], up[i + step], up[i]
                if kind == 3:
                    guess = (left + over) // 2
                else:
                    p = left + over - corner
                    guess = min((left, over, corner), key=lambda c, p=p: abs(p - c))
                now[i + step] = (v + guess) & 255
            row[:] = now
    return out[1:, step:]


#: Fixed values of interlacing: first column and row of each pass, and its steps.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _samples(raw: np.ndarray, w: int, h: int, depth: int, samples: int) -> np.ndarray:
    """(h, w, samples) values of filtered rows."""
    bits = depth * samples
    rows = _unfilter(raw, h, (w * bits + 7) // 8, max(1, bits // 8))
    if depth == 16:
        return rows.copy().view(">u2").astype(np.uint16).reshape(h, w, samples)
    if depth == 8:
        return rows.reshape(h, w, samples)
    each = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
    return (each @ (1 << np.arange(depth)[::-1]))[:, :w, None].astype(np.uint8)


def _interlaced(raw: np.ndarray, w: int, h: int, depth: int, samples: int) -> np.ndarray:
    out, at = np.zeros((h, w, samples), np.uint16 if depth == 16 else np.uint8), 0
    for x, y, dx, dy in PASSES:
        n, m = -(-(w - x) // dx), -(-(h - y) // dy)
        if n > 0 and m > 0:
            size = m * (1 + (n * depth * samples + 7) // 8)
            out[y::dy, x::dx] = _samples(raw[at : at + size], n, m, depth, samples)
            at += size
    return out


def read_png(data: bytes) -> np.ndarray | None:
    """(height, width, 4) pixels of a PNG, 16-bit ones as uint16; None if it can't be read. A colour key makes
    the pixels that equal it transparent."""
    chunks = list(png_chunks(data))
    if not data.startswith(PNG_SIGNATURE) or not chunks or chunks[0][0] != "IHDR":
        return None
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[0][1])
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if samples is None or w * h > MAX_PIXELS:
        return None
    raw = np.frombuffer(zlib.decompress(b"".join(b for n, b in chunks if n == "IDAT")), np.uint8)
    v = (_interlaced if interlaced else _samples)(raw, w, h, depth, samples)
    clear = next((b for n, b in chunks if n == "tRNS"), b"")
    if kind == 3:
        table = np.zeros((256, 4), np.uint8)
        table[:, 3] = 255
        for b in (b for n, b in chunks if n == "PLTE"):
            table[: len(b) // 3, :3] = np.frombuffer(b, np.uint8).reshape(-1, 3)
        table[: len(clear), 3] = np.frombuffer(clear, np.uint8)
        return table[v[..., 0]]
    out = np.full((h, w, 4), 65535 if depth == 16 else 255, np.uint16 if depth == 16 else np.uint8)
    if kind in (0, 4):
        out[..., :3] = v[..., :1] * np.uint8(255 // ((1 << depth) - 1)) if depth < 8 else v[..., :1]
    else:
        out[..., :3] = v[..., :3]
    if kind in (4, 6):
        out[..., 3] = v[..., -1]
    elif len(clear) >= 2 * samples:
        out[(v == np.frombuffer(clear, ">u2", samples)).all(-1), 3] = 0
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def _filtered(rows: np.ndarray, step: int) -> bytes:
    """Each row by the filter (none, left, up, mean or Paeth) that leaves the smallest sum of signed residues."""
    side = np.pad(rows, ((1, 0), (step, 0))).astype(np.int16)
    left, up, corner = side[1:, :-step], side[:-1, step:], side[:-1, :-step]
    guess = left + up - corner
    far = np.abs(np.stack([left, up, corner]) - guess)
    paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
    kinds = np.stack([rows, *(rows - p.astype(np.uint8) for p in (left, up, (left + up) >> 1, paeth))])
    best = np.abs(kinds.view(np.int8).astype(np.int32)).sum(-1).argmin(0)
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = kinds[best, np.arange(len(rows))]
    return out.tobytes()


def write_png(pixels: np.ndarray, chunks: list[tuple[str, bytes]] = (), level: int = 9) -> bytes:
    """RGBA (or RGB where all is opaque) PNG of 8 or 16 bits, with display chunks copied after the header."""
    h, w, _ = pixels.shape
    deep = pixels.dtype == np.uint16
    opaque = (pixels[..., 3] == (65535 if deep else 255)).all()
    v = pixels[..., : 3 if opaque else 4]
    rows = (v.astype(">u2").view(np.uint8) if deep else v).reshape(h, -1)
    rows = np.ascontiguousarray(rows).view(np.uint8)
    step = v.shape[2] * (2 if deep else 1)
    head = struct.pack(">IIBBBBB", w, h, 16 if deep else 8, 2 if opaque else 6, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(n.encode(), b) for n, b in chunks) + _chunk(b"IDAT", zlib.compress(_filtered(rows, step), level)) + _chunk(b"IEND", b"")


def write_indexed_png(indices: np.ndarray, palette: np.ndarray, chunks: list[tuple[str, bytes]] = (), level: int = 9) -> bytes:
    """Palette PNG with the least bit depth that fits; translucent entries should come first."""
    h, w = indices.shape
    depth = next(d for d in (1, 2, 4, 8) if len(palette) <= 1 << d)
    if depth < 8:
        per = 8 // depth
        padded = np.pad(indices, ((0, 0), (0, -w % per))).reshape(h, -1, per).astype(np.uint8)
        rows = (padded << (np.arange(per)[::-1] * depth).astype(np.uint8)).sum(-1).astype(np.uint8)
    else:
        rows = indices.astype(np.uint8)
    flat = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    alpha = palette[:, 3].astype(np.uint8)
    shown = int(np.flatnonzero(alpha < 255)[-1]) + 1 if (alpha < 255).any() else 0
    body = _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 3, 0, 0, 0)) + b"".join(_chunk(n.encode(), b) for n, b in chunks)
    body += _chunk(b"PLTE", palette[:, :3].astype(np.uint8).tobytes()) + (_chunk(b"tRNS", alpha[:shown].tobytes()) if shown else b"")
    return PNG_SIGNATURE + body + _chunk(b"IDAT", zlib.compress(flat, level)) + _chunk(b"IEND", b"")


def png_rasters(files: DataFrame) -> DataFrame:
    """(path, width, height, content RGBA8) of readable, still PNG files. Size guards use the header, before
    anything is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, c in zip(batch["path"].to_pylist(), batch["content"]):
                data = c.as_py()
                info = png_header(data)
                if info["animated"] or not info["width"] or info["width"] * info["height"] > MAX_PIXELS:
                    continue
                px = read_png(data)
                if px is not None:
                    px = (px >> 8).astype(np.uint8) if px.dtype == np.uint16 else px
                    rows.append({"path": path, "width": px.shape[1], "height": px.shape[0], "content": px.tobytes()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return arrow_map(files.where("format = 'png'").select("path", "content"), run, "path string, width long, height long, content binary")
