"""Content statistics of images. One image is one row, so the statistics are computed where it lies: a
vectorised function per Arrow batch, without a shuffle of pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map

#: Pixels sampled at most, capped colour counts, difference limits of edge, noise and flat.
SAMPLE, COLOR_CAP, ESTIMATE_CAP = 250_000, 65_536, 16_777_216
EDGE, NOISE_LOW, FLAT = 42, 12, 5

STATS = "pixels long, stride long, sampled long, entropy double, estimated_colors long, edge_density double, noise double, flat_area_ratio double, has_alpha boolean"


def content_stats(rgba: np.ndarray, width: int) -> dict:
    """Statistics of a flat (pixels, 4) raster. Every ``stride``-th pixel is sampled; its neighbours to the
    left and above need not be. Alpha is looked for in all pixels. Shares are of all sampled pixels."""
    n = len(rgba)
    stride = max(1, n // SAMPLE)
    at = np.arange(0, n, stride)
    rgb = rgba[:, :3].astype(np.int32)
    s = rgb[at]
    hist = np.bincount((s @ np.array([54, 183, 19])) >> 8, minlength=256)
    p = hist[hist > 0] / len(at)
    colors = len(np.unique(s @ np.array([65536, 256, 1])))
    inner = at[(at % width > 0) & (at >= width)]
    near = lambda step: np.abs(rgb[inner] - rgb[inner - step]).sum(1) // 3
    diff = np.maximum(near(1), near(width))
    return {
        "pixels": n, "stride": stride, "sampled": len(at), "entropy": float(-(p * np.log2(p)).sum()) + 0.0,
        "estimated_colors": min(min(colors, COLOR_CAP) * stride, ESTIMATE_CAP),
        "edge_density": float((diff > EDGE).sum() / len(at)), "noise": float(((diff >= NOISE_LOW) & (diff <= EDGE)).sum() / len(at)),
        "flat_area_ratio": float((diff < FLAT).sum() / len(at)), "has_alpha": bool((rgba[:, 3] != 255).any()),
    }


def analyze(images: DataFrame, key: str, width: int) -> DataFrame:
    """images (key, content): statistics of the content read as RGBA rows; fewer than 4 bytes give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, c in zip(batch[key].to_pylist(), batch["content"]):
                if c.is_valid and (n := len(c.as_buffer()) // 4):
                    rows.append({key: k} | content_stats(np.frombuffer(c.as_buffer(), np.uint8, n * 4).reshape(n, 4), width))
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return arrow_map(images.select(key, "content"), run, f"{key} long, {STATS}")


#: Kinds in order, each with what makes an image one; for columns and for plain numbers alike.
KINDS = [
    ("screenshot", lambda s: (s["flat_area_ratio"] > 0.72) & (s["edge_density"] > 0.04)),
    ("graphic", lambda s: (s["estimated_colors"] < 2000) & (s["flat_area_ratio"] > 0.55)),
    ("photo", lambda s: (s["entropy"] > 6.8) & (s["noise"] > 0.18)),
]
OTHER_KIND = "mixed"


def kind_of(stats: dict) -> str:
    """Content kind of one image's statistics."""
    return next((name for name, fits in KINDS if fits(stats)), OTHER_KIND)


def content_kind(stats: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(fits(stats), name) for name, fits in KINDS], F.lit(OTHER_KIND))


def with_kind(stats: DataFrame) -> DataFrame:
    return stats.withColumn("kind", content_kind({c: F.col(c) for c in ("entropy", "estimated_colors", "edge_density", "noise", "flat_area_ratio")}))
