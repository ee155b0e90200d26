"""Two-dimensional neighbourhood operators. Over one large image they are windows partitioned by row and by
column; over many images the array forms in ``quantize`` work image by image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rows(key: list[str]):
    return Window.partitionBy(*key, "y").orderBy("x")


def _columns(key: list[str]):
    return Window.partitionBy(*key, "x").orderBy("y")


def neighbours(c: Column, key: list[str] = ()) -> dict[str, Column]:
    """Left, right, up and down values; at an edge the pixel's own."""
    across, down = _rows(list(key)), _columns(list(key))
    return {"left": F.coalesce(F.lag(c).over(across), c), "right": F.coalesce(F.lead(c).over(across), c), "up": F.coalesce(F.lag(c).over(down), c), "down": F.coalesce(F.lead(c).over(down), c)}


def _most(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def contrast(px: DataFrame, channels: list[str], key: list[str] = ()) -> DataFrame:
    """Second differences (horizontal, vertical) of the strongest channel, and both before smoothing maps as
    whole numbers: edges and amplified noise, on channels scaled to 0..1."""
    across, down = [], []
    for name in channels:
        n = neighbours(F.col(name), key)
        across.append(F.abs(n["left"] + n["right"] - 2 * F.col(name)))
        down.append(F.abs(n["up"] + n["down"] - 2 * F.col(name)))
    out = px.select(*key, "x", "y", _most(across).alias("h"), _most(down).alias("v"))
    h, v = F.col("h") / 255.0, F.col("v") / 255.0
    edge = F.greatest(h, v)
    z = F.lit(1.0) - F.greatest(edge - F.abs(h - v) * 0.5, F.least(h, v))
    to_byte = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.round(c * 256, 6)))).cast("int")
    return out.select("*", to_byte(z * z * z * z).alias("noise"), to_byte(1.0 - edge).alias("edges"))


def morphology(px: DataFrame, value: str, key: list[str] = ()) -> DataFrame:
    """Largest and smallest value of the plus-shaped neighbourhood."""
    n = neighbours(F.col(value), key)
    return px.select(*key, "x", "y", F.greatest(value, *n.values()).alias("max5"), F.least(value, *n.values()).alias("min5"))


def box_blur(px: DataFrame, value: str, size: int, width: int, height: int, key: list[str] = ()) -> DataFrame:
    """Separable mean of 2 * size cells, from size - 1 before to size after, edges repeated, whole-number
    division after each pass. Rasters with a side below 2 * size + 1 stay as they are."""
    if min(width, height) < 2 * size + 1:
        return px.select(*key, "x", "y", F.col(value).alias("blurred"))

    def one(df: DataFrame, c: str, along: str, other: str, length: int) -> DataFrame:
        over = Window.partitionBy(*key, other).orderBy(along)
        run = F.sum(c).over(over.rowsBetween(1 - size, size))
        whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(c).over(whole), F.last(c).over(whole)
        before, after = F.greatest(F.lit(0), size - 1 - F.col(along)), F.greatest(F.lit(0), F.col(along) + size - (length - 1))
        return df.withColumn("blurred", F.floor((run + before * first + after * last) / (2 * size)).cast("int"))

    rows = one(px, value, "x", "y", width).select(*key, "x", "y", F.col("blurred").alias("_pass"))
    return one(rows, "_pass", "y", "x", height).select(*key, "x", "y", "blurred")


def runs(px: DataFrame, value: str, key: list[str] = ()) -> DataFrame:
    """Runs of equal values along rows: (y, begin, length, value, above, below), with how many pixels of the
    run have the same value above and below them."""
    across, down = _rows(list(key)), _columns(list(key))
    same = lambda c: F.coalesce((c == F.col(value)).cast("int"), F.lit(0))
    marked = px.select(
        *key, "x", "y", value,
        F.when(F.lag(value).over(across) == F.col(value), 0).otherwise(1).alias("starts"),
        same(F.lag(value).over(down)).alias("up"), same(F.lead(value).over(down)).alias("down"),
    )
    island = F.sum("starts").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("island", island).groupBy(*key, "y", "island").agg(F.min("x").alias("begin"), F.count("*").alias("length"), F.first(value).alias("value"), F.sum("up").alias("above"), F.sum("down").alias("below")).drop("island")
