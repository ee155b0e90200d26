"""Optimizing PNG files, their reports and benchmark runs. JPEG files get a plan; encoding them is left to
external codecs, so they pass through."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import encode
from ..runtime import arrow_map
from ..sources.headers import PNG_SIGNATURE, jpeg_header, png_header
from ..sources.images import read_png, write_indexed_png, write_png
from ..streaming.control import Cancelled
from .analysis import content_stats, kind_of
from .quantize import select_palette
from .reports import csv_cell, optional_number, run_percentiles

REPORT = "path string, format string, original_bytes long, optimized_bytes long, saved_percent double, width long, height long, kind string, encoder string, lossless boolean, palette_colors int, quality int, warnings array<string>, error string, elapsed_ms double, output binary"
_FIELDS = [("path", pa.string()), ("format", pa.string()), ("original_bytes", pa.int64()), ("optimized_bytes", pa.int64()), ("saved_percent", pa.float64()), ("width", pa.int64()), ("height", pa.int64()), ("kind", pa.string()), ("encoder", pa.string()), ("lossless", pa.bool_()), ("palette_colors", pa.int32()), ("quality", pa.int32()), ("warnings", pa.list_(pa.string())), ("error", pa.string()), ("elapsed_ms", pa.float64()), ("output", pa.binary())]


def same_pixels(one: np.ndarray, other: np.ndarray) -> bool:
    """Equal everywhere but where both are transparent."""
    return one.shape == other.shape and bool(((one == other).all(-1) | ((one[..., 3] == 0) & (other[..., 3] == 0))).all())


def guard(data: bytes) -> tuple[str | None, dict | None]:
    """(error code or None, header), from the cheapest check to the dearest; nothing is decoded."""
    if not 0 < len(data) <= encode.MAX_BYTES:
        return "RESOURCE_LIMIT", None
    if data.startswith(b"\xff\xd8\xff"):
        return None, {"format": "jpeg"} | (jpeg_header(data) or {})
    if not data.startswith(PNG_SIGNATURE):
        return "UNSUPPORTED_FORMAT", None
    h = png_header(data) | {"format": "png"}
    if h["animated"]:
        return "ANIMATED_PNG", h
    pixels = (h["width"] or 0) * (h["height"] or 0)
    if pixels > encode.MAX_PIXELS or 20 * pixels + 2 * len(data) > encode.MAX_MEMORY:
        return "RESOURCE_LIMIT", h
    return (None if pixels else "DECODE_FAILED"), h


def optimize_one(path: str, data: bytes, observe: Callable[[str, str], None] | None = None, cancelled: Callable[[], bool] | None = None) -> dict:
    """Report and bytes for one file. The original is kept unless the result is smaller.

    ``observe`` hears (path, stage) as each stage begins; before each, ``cancelled`` may end the work with the
    original and the code CANCELLED. Both are called where the file is worked on."""
    try:
        return _optimized(path, data, observe or (lambda *_: None), cancelled or (lambda: False))
    except Cancelled:
        return {"path": path, "format": None, "original_bytes": len(data), "optimized_bytes": len(data), "saved_percent": 0.0, "warnings": [], "output": data, "encoder": "passthrough", "lossless": True, "error": "CANCELLED", "elapsed_ms": None}


def _optimized(path: str, data: bytes, observe: Callable[[str, str], None], cancelled: Callable[[], bool]) -> dict:
    began = time.perf_counter()

    def stage(name: str) -> None:
        if cancelled():
            raise Cancelled("CANCELLED")
        observe(path, name)

    stage("decoding")
    error, head = guard(data)
    out = {"path": path, "format": head and head["format"], "original_bytes": len(data), "warnings": [], "output": data, "encoder": "passthrough", "lossless": True, "error": error}
    if error is None and head["format"] == "png":
        try:
            px = read_png(data)
        except Exception as e:  # broken streams raise from several layers
            px, out["warnings"] = None, [str(e)]
        if px is None:
            out["error"] = "DECODE_FAILED"
        else:
            h, w, _ = px.shape
            deep = px.dtype == np.uint16
            rgba = (px >> 8).astype(np.uint8) if deep else px
            stage("analyzing")
            stats = content_stats(np.ascontiguousarray(rgba).reshape(-1, 4), w)
            chunks = [(c["name"], c["data"]) for c in head["chunks"]]
            speed = 3 if stats["estimated_colors"] <= encode.THOROUGH_COLORS or w * h <= encode.THOROUGH_PIXELS else 5
            stage("compressing")
            picked = None if deep else select_palette(rgba, speed)
            if picked:
                strategy, palette, indices, quality = picked
                made, lossless = write_indexed_png(indices, palette, chunks), strategy == "exact"
                out |= {"palette_colors": len(palette), "quality": quality}
            else:
                made, lossless = write_png(px, chunks), True
            stage("finalizing")
            out |= {"width": w, "height": h, "kind": kind_of(stats)}
            if lossless and not same_pixels(read_png(made), px):
                out["error"] = "ENCODE_FAILED"
            elif len(made) < len(data):
                out |= {"output": made, "encoder": "palette" if picked else "lossless", "lossless": lossless}
            else:
                out["warnings"] = ["already optimized"]
    elif error is None:
        out["warnings"] = ["jpeg encoding is external"]
    out["optimized_bytes"] = len(out["output"])
    out["saved_percent"] = 100 * (1 - out["optimized_bytes"] / len(data)) if data else 0.0
    out["elapsed_ms"] = (time.perf_counter() - began) * 1000
    return out


def optimize_files(files: DataFrame, observe: Callable[[str, str], None] | None = None, cancelled: Callable[[], bool] | None = None) -> DataFrame:
    """files (path, content): one report row with the bytes for each. The callables travel to the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, c in zip(batch["path"].to_pylist(), batch["content"]):
                yield pa.RecordBatch.from_pylist([optimize_one(path, c.as_py() or b"", observe, cancelled)], schema=pa.schema(_FIELDS))

    return arrow_map(files.select("path", "content"), run, REPORT)


def benchmark_runs(files: DataFrame, runs: int = 5, warmup: int = 1) -> DataFrame:
    """(path, run, elapsed_ms, report) of repeated runs; warm-up runs come first and have negative numbers."""
    fields = [*_FIELDS[:-1], ("run", pa.int32())]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, c in zip(batch["path"].to_pylist(), batch["content"]):
                rows = [optimize_one(path, c.as_py() or b"") | {"run": i} for i in range(-warmup, max(1, runs))]
                yield pa.RecordBatch.from_pylist([{k: r.get(k) for k, _ in fields} for r in rows], schema=pa.schema(fields))

    return arrow_map(files.select("path", "content"), go, REPORT.removesuffix(", output binary") + ", run int")


def benchmark_summary(timed: DataFrame) -> DataFrame:
    """(path, format, original_bytes, optimized_bytes, saved_percent, runs, median, p95) by path."""
    counted = timed.where("run >= 0 and error is null")
    last = counted.where("run = 0").select("path", "format", "original_bytes", "optimized_bytes", "saved_percent")
    return last.join(run_percentiles(counted, "path", "elapsed_ms"), "path").orderBy("path")


def benchmark_csv(timed: DataFrame) -> DataFrame:
    """The nine-column benchmark table as lines; quotes doubled, missing metrics empty."""
    rows = benchmark_summary(timed)
    none = F.lit(None).cast("double")
    cells = [csv_cell(F.col("path")), F.col("format"), F.col("original_bytes").cast("string"), F.col("optimized_bytes").cast("string"), F.format_string("%.4f", "saved_percent"), optional_number(none), optional_number(none), F.format_string("%.3f", "median"), F.format_string("%.3f", "p95")]
    return rows.select(F.concat_ws(",", *cells).alias("line"))


CSV_HEAD = "file,format,original_bytes,optimized_bytes,saved_percent,ssimulacra2,butteraugli,median_ms,p95_ms"


def measure(one: bytes, other: bytes) -> dict:
    """Substitute metrics of two PNG files of equal size; larger images than 8 pixels a side get none."""
    a, b = read_png(one), read_png(other)
    if a is None or b is None or a.shape != b.shape:
        raise ValueError("METRIC_FAILED: two readable images of equal size are needed")
    if min(a.shape[:2]) >= 8:
        return {"ssimulacra2": None, "butteraugli": None}
    d = np.abs(a[..., :3].astype(int) - b[..., :3].astype(int)).sum(-1)
    return {"ssimulacra2": float(np.clip(100 - 100 * d.mean() / 765, 0, 100)), "butteraugli": float(3 * d.max() / 765)}


def report_json(row: dict) -> str:
    return json.dumps({k: v for k, v in row.items() if k != "output"}, indent=2, ensure_ascii=False)
