"""Differences of image pairs and the lossless check. A pair is one row with both RGBA planes, so it is compared
where it lies, without a shuffle of pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map

#: Least visible difference, and the largest sum of RGB differences.
VISIBLE, WHOLE = 3, 765.0

COMPARED = "ssimulacra2 double, butteraugli double, changed long, total long, max_delta int, lossless boolean, error string"
_FIELDS = [("ssimulacra2", pa.float64()), ("butteraugli", pa.float64()), ("changed", pa.int64()), ("total", pa.int64()), ("max_delta", pa.int32()), ("lossless", pa.bool_()), ("error", pa.string())]


def compare(one: bytes | None, other: bytes | None) -> dict | None:
    """All measures of two planes; None where both are without a pixel. Alpha counts for losslessness alone:
    pixels transparent on both sides are equal. Missing planes or unequal sizes are an error, never lossless."""
    if one is None or other is None or len(one) // 4 != len(other) // 4:
        return {"lossless": False, "error": "METRIC_FAILED"}
    n = len(one) // 4 * 4
    if not n:
        return None
    a, b = (np.frombuffer(p, np.uint8, n).reshape(-1, 4) for p in (one, other))
    d = np.abs(a[:, :3].astype(np.int16) - b[:, :3])
    total, largest = d.sum(1, dtype=np.int32), d.max(1)
    hidden = (a[:, 3] == 0) & (b[:, 3] == 0)
    return {
        "ssimulacra2": min(100.0, max(0.0, 100 - 100 * float(total.mean()) / WHOLE)), "butteraugli": 3 * float(total.max()) / WHOLE,
        "changed": int((largest >= VISIBLE).sum()), "total": len(a), "max_delta": int(largest.max()),
        "lossless": bool(((largest == 0) & (a[:, 3] == b[:, 3]) | hidden).all()),
    }


def compared(pairs: DataFrame, key: str) -> DataFrame:
    """pairs (key, content, other): the small-image substitutes for the perceptual metrics, the difference
    counts, whether the pair is lossless, and an error for pairs that can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(key), *_FIELDS])
            # one plane at a time as Python bytes: a batch of large images is not held twice
            found = ((k, compare(x.as_py(), y.as_py())) for k, x, y in zip(batch[key].to_pylist(), batch["content"], batch["other"]))
            yield pa.RecordBatch.from_pylist([{key: k} | m for k, m in found if m], schema=schema)

    of = pairs.schema[key].dataType.simpleString()
    return arrow_map(pairs.select(key, "content", "other"), run, f"{key} {of}, {COMPARED}")


def heat_color(delta: Column) -> Column:
    """Red with less green and more alpha the larger the difference; null where it is not visible."""
    return F.when(delta >= VISIBLE, F.struct(F.lit(255).alias("r"), F.greatest(F.lit(48), 238 - delta * 2).alias("g"), F.lit(0).alias("b"), F.least(F.lit(220), 45 + delta * 7).alias("a")))
