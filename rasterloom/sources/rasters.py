"""Pixel relations: any bytes read as RGBA, and the generated fixture rasters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import arrow_map

#: Width that a byte raster is given.
WIDTH = 32


def with_bytes(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, b, n): the text's UTF-8 bytes and how many whole RGBA pixels they hold; fewer than one: no row."""
    rows = df.select(key, F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("b"))
    return rows.withColumn("n", F.floor(F.length("b") / 4).cast("int")).where("n > 0")


def _word(b: str, i: Column) -> Column:
    return F.conv(F.hex(F.substring(F.col(b), i * 4 + 1, F.lit(4))), 16, 10).cast("long")


def channels(v: Column) -> list[Column]:
    """r, g, b, a of a big-endian word."""
    return [F.shiftright(v, s).bitwiseAND(255).cast("int") for s in (24, 16, 8, 0)]


def byte_raster(df: DataFrame, text: str, key: str, spread: bool = True) -> DataFrame:
    """(key, i, x, y, v, r, g, b, a), one row per pixel. The rows are generated where the bytes are read."""
    rows = with_bytes(df, text, key)
    px = rows.select(key, "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    px = px.select(key, "i", (F.col("i") % WIDTH).alias("x"), F.floor(F.col("i") / WIDTH).cast("int").alias("y"), _word("b", F.col("i")).alias("v"))
    return px.select("*", *[c.alias(n) for n, c in zip("rgba", channels(F.col("v")))])


def with_posterized(images: DataFrame, key: str, bits: int) -> DataFrame:
    """images (key, content): both planes of RGBA bytes, the second without the low ``bits`` of its colours.
    Bytes after the last whole pixel don't count."""
    level = np.arange(256, dtype=np.uint8)
    level = (level >> bits << bits) | ((level & ((255 >> bits) ^ 255)) >> (8 - bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, other = [], []
            for c in batch["content"].to_pylist():
                px = np.frombuffer(c or b"", np.uint8, len(c or b"") // 4 * 4).reshape(-1, 4)
                flat = px.copy()
                flat[:, :3] = level[px[:, :3]]
                whole.append(px.tobytes())
                other.append(flat.tobytes())
            yield pa.RecordBatch.from_arrays([batch[key].cast(pa.int64()), pa.array(whole, pa.binary()), pa.array(other, pa.binary())], [key, "content", "other"])

    return arrow_map(images.select(key, "content"), run, f"{key} long, content binary, other binary")


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    i = F.col("id")
    return spark.range(width * height).select((i % width).cast("int").alias("x"), F.floor(i / width).cast("int").alias("y"))


def fixture_png(spark: SparkSession, width: int = 1317, height: int = 1030, sparse_alpha: bool = False) -> DataFrame:
    """Flat fields with low-amplitude noise: a 32-bit hash of the position, rotated by the column."""
    x, y = F.col("x"), F.col("y")
    field = (F.floor(x / 64) + F.floor(y / 48)) % 3
    h = (x.cast("long") * 73856093 + y.cast("long") * 19349663) % 4294967296
    up = (x % 17 + 1).cast("int")
    noise = (F.expr("shiftleft(h, up) % 4294967296") + F.expr("shiftright(h, 32 - up)")).alias("noise")
    px = grid(spark, width, height).select("x", "y", field.alias("field"), h.alias("h"), up.alias("up")).select("x", "y", "field", noise)
    low = lambda k: F.shiftright("noise", k).bitwiseAND(7)
    alpha = F.when((x == width - 1) & (y == height - 1), 1).otherwise(255) if sparse_alpha else F.lit(255)
    level = lambda base, step, k: F.least(F.lit(255), base + F.col("field") * step + low(k)).cast("int")
    return px.select("x", "y", level(72, 38, 0).alias("r"), level(94, 28, 3).alias("g"), level(54, 19, 6).alias("b"), alpha.cast("int").alias("a"))


def fixture_jpeg(spark: SparkSession, width: int = 1600, height: int = 1200) -> DataFrame:
    """An XOR wave over a vertical horizon."""
    x, y = F.col("x"), F.col("y")
    wave = (F.floor(x / 17).cast("int") * 29).bitwiseXOR(F.floor(y / 23).cast("int") * 47).bitwiseAND(255)
    horizon = F.floor(y * 180 / height).cast("int").bitwiseAND(255)
    px = grid(spark, width, height).select("x", "y", wave.alias("wave"), horizon.alias("horizon"))
    part = lambda c, d: F.floor(c / d).cast("int")
    w, h = F.col("wave"), F.col("horizon")
    return px.select("x", "y", *[F.least(F.lit(255), v).alias(n) for n, v in (("r", 30 + part(h, 2) + part(w, 10)), ("g", 48 + h + part(w, 9)), ("b", 82 + part(255 - h, 3) + part(w, 11)))])


def oriented(x: Column, y: Column, width: Column, height: Column, orientation: Column) -> Column:
    """Where a pixel goes under an EXIF orientation: struct(x, y); values other than 2 to 8 move nothing."""
    far_x, far_y = width - 1 - x, height - 1 - y
    moves = {2: (far_x, y), 3: (far_x, far_y), 4: (x, far_y), 5: (y, x), 6: (far_y, x), 7: (far_y, far_x), 8: (y, far_x)}
    out = F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    for value, (to_x, to_y) in moves.items():
        out = F.when(orientation == value, F.struct(to_x.cast("int").alias("x"), to_y.cast("int").alias("y"))).otherwise(out)
    return out
