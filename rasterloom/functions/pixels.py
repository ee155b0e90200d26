"""Pixel and colour arithmetic as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gamma of the working colour space and of sRGB input.
INTERNAL_GAMMA, SRGB_GAMMA = 0.5499, 0.45455
GAMMA = INTERNAL_GAMMA / SRGB_GAMMA


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(54 * r + 183 * g + 19 * b, 8)


def rgb_key(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b).cast("long")


def rgba_key(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Little-endian: red lowest."""
    return r.cast("long") + g * 256 + b * 65536 + a.cast("long") * 16777216


def channel_difference(one: list[Column], other: list[Column]) -> Column:
    """Whole-number mean of the absolute RGB differences."""
    return F.floor(sum((F.abs(x - y) for x, y in zip(one, other)), F.lit(0)) / 3).cast("int")


def premultiplied(r: Column, g: Column, b: Column, a: Column) -> dict[str, Column]:
    """Working colour: gamma-adjusted channels times alpha."""
    alpha = a / F.lit(255.0)
    return {"a": alpha} | {n: F.pow(c / F.lit(255.0), F.lit(GAMMA)) * alpha for n, c in (("r", r), ("g", g), ("b", b))}


def to_bytes(c: dict[str, Column]) -> dict[str, Column]:
    """Back from a working colour; nearly transparent ones become all zero."""
    gone = c["a"] < 1.0 / 256.0
    back = {n: F.least(F.lit(255), F.floor(F.pow(c[n] / c["a"], F.lit(1 / GAMMA)) * 256)) for n in "rgb"}
    back["a"] = F.least(F.lit(255), F.floor(c["a"] * 256))
    return {n: F.when(gone, 0).otherwise(v).cast("int") for n, v in back.items()}


def color_difference(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Squared distance over black plus that over white."""
    alphas = y["a"] - x["a"]
    black = [x[n] - y[n] for n in "rgb"]
    return sum((d * d + (d + alphas) * (d + alphas) for d in black[1:]), black[0] * black[0] + (black[0] + alphas) * (black[0] + alphas))


def min_color_difference(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Least squared distance over any background."""
    alphas = y["a"] - x["a"]
    parts = [F.least(d * d, (d + alphas) * (d + alphas)) * 2 for d in (x[n] - y[n] for n in "rgb")]
    return parts[0] + parts[1] + parts[2]


def posterized(c: Column, bits: int) -> Column:
    """Drops the low bits of a byte and repeats its high bits there."""
    if not bits:
        return c
    return c.bitwiseAND(255 >> bits << bits).bitwiseOR(F.shiftright(c.bitwiseAND((255 >> bits) ^ 0xFF), 8 - bits))


def quality_to_mse(q: Column) -> Column:
    low = F.greatest(F.lit(0.016) / (F.lit(0.001) + q) - 0.001, F.lit(0.0))
    curve = low + F.lit(2.5) / F.pow(F.lit(210.0) + q, F.lit(1.2)) * (F.lit(100.1) - q) / 100.0
    return F.when(q == 0, F.lit(1e20)).when(q >= 100, F.lit(0.0)).otherwise(curve)


def second_difference(before: Column, here: Column, after: Column) -> Column:
    return F.abs(before + after - 2 * here)


def human_size(n: Column) -> Column:
    """1024-based; two decimals below ten, else one; whole bytes below 1024."""
    size, unit = F.abs(n) / 1024, F.lit("KB")
    steps = F.when(size < 1024, 0).when(size < 1024 * 1024, 1).otherwise(2)
    scaled = size / F.pow(F.lit(1024.0), steps)
    unit = F.element_at(F.array(F.lit("KB"), F.lit("MB"), F.lit("GB")), steps + 1)
    text = F.when(scaled >= 10, F.format_string("%.1f", scaled)).otherwise(F.format_string("%.2f", scaled))
    return F.when(F.abs(n) < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(F.when(n < 0, "−").otherwise(""), text, F.lit(" "), unit))


def modal_size(n: Column) -> Column:
    """Kilobytes with one decimal below a megabyte, megabytes with two from there on."""
    small = F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB"))
    return F.when(n < 1024 * 1024, small).otherwise(F.concat(F.format_string("%.2f", n / 1024.0 / 1024.0), F.lit(" MB")))


def opaque_channels(r: Column, g: Column, b: Column, gray: Column) -> Column:
    """Channels without alpha: the red one alone for grey images."""
    return F.when(gray, F.array(r)).otherwise(F.array(r, g, b))


def linear(c: Column) -> Column:
    """Linear light (0 to 1) of an sRGB byte."""
    v = c / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
