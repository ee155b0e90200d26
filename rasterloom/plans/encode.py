"""Encoding plans: which settings an encoder would get, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.headers import DISPLAY_CHUNKS

#: Fixed values of the plans.
THOROUGH_PIXELS, THOROUGH_COLORS, BALANCED_PIXELS, BRUTE_PIXELS = 500_000, 65_536, 4_000_000, 1_000_000
ZOPFLI_THOROUGH, ZOPFLI = 65_536, 300_000
MAX_BYTES, MAX_PIXELS, MAX_MEMORY = 100 * 1024 * 1024, 24_000_000, 768 * 1024 * 1024
LOSSY_SHARE = 0.9


def quantizer_speed(pixels: Column, colors: Column) -> Column:
    return F.when((colors <= THOROUGH_COLORS) | (pixels <= THOROUGH_PIXELS), 3).otherwise(5)


def speed_settings(speed: Column) -> dict[str, Column]:
    """Iterations, limit, trials, histogram entries and use of the two maps for a speed of 1 to 10."""
    s = F.least(F.greatest(speed, F.lit(1)), F.lit(10))
    left = F.greatest(8 - s, F.lit(0))
    return {
        "iterations": (left + F.floor(left * left / 2)).cast("int"),
        "iteration_limit": F.lit(1.0) / F.pow(F.lit(2.0), 23 - s),
        "trials": F.greatest(56 - 9 * s, F.lit(0)).cast("int"),
        "histogram_entries": (131072 + 262144 * (10 - s)).cast("long"),
        "dither_map": s <= 5,
        "contrast_maps": s <= 7,
    }


def png_preset(pixels: Column, colors: Column) -> Column:
    few = colors <= THOROUGH_COLORS
    return F.when((pixels <= BRUTE_PIXELS) | (few & (pixels <= 2 * BALANCED_PIXELS)), 4).when(pixels <= BALANCED_PIXELS, 2).otherwise(1)


def png_options(pixels: Column, colors: Column) -> Column:
    """struct(preset, zopfli, optimize_alpha, keep): effort by size and colours; hidden colours may change, and
    only the chunks that tell how to show the image stay."""
    keep = F.array(*map(F.lit, DISPLAY_CHUNKS))
    return F.struct(png_preset(pixels, colors).alias("preset"), zopfli_iterations(pixels).alias("zopfli"), F.lit(True).alias("optimize_alpha"), keep.alias("keep"))


def zopfli_iterations(pixels: Column) -> Column:
    return F.when(pixels <= ZOPFLI_THOROUGH, 15).when(pixels <= ZOPFLI, 3)


def jpeg_quality(kind: Column) -> Column:
    return F.when(kind.isin("graphic", "screenshot"), 90).otherwise(88)


def jpeg_chroma(kind: Column) -> Column:
    return F.when(kind == "photo", "4:2:0").when(kind == "mixed", "4:2:2").otherwise("4:4:4")


def browser_chroma(kind: Column, gray: Column) -> Column:
    return F.when(gray, "gray").when(kind.isin("graphic", "screenshot"), "4:4:4").otherwise("4:2:0")


def profile_plan(has_icc: Column, gray: Column, space: Column, kind: Column) -> Column:
    """struct(convert, keep): what happens to an embedded colour profile."""
    pair = lambda convert, keep: F.struct(F.lit(convert).alias("convert"), F.lit(keep).alias("keep"))
    color = F.when((space == "RGB ") & (kind == "srgb"), pair(False, False)).when((space == "RGB ") & (kind == "display-p3"), pair(False, True)).otherwise(pair(True, False))
    return F.when(~has_icc, pair(False, False)).when(gray, F.when(space == "GRAY", pair(False, True)).otherwise(pair(True, False))).otherwise(color)


def admission(size: Column, mime: Column, pixels: Column) -> Column:
    """The first guard that rejects a file, in the order that spares work; null if it is admitted."""
    memory = 20 * pixels + 2 * size
    return (
        F.when((size <= 0) | (size > MAX_BYTES), "RESOURCE_LIMIT:bytes")
        .when(~mime.isin("image/jpeg", "image/png"), "UNSUPPORTED_FORMAT")
        .when(pixels > MAX_PIXELS, "RESOURCE_LIMIT:pixels")
        .when(memory > MAX_MEMORY, "RESOURCE_LIMIT:memory")
    )


def no_growth(before: Column, after: Column) -> dict[str, Column]:
    """The original is kept if the result isn't smaller."""
    kept = after >= before
    out = F.when(kept, before).otherwise(after)
    saved = before - out
    return {"output": out, "saved": saved, "saved_percent": F.when(before > 0, saved / before * 100).otherwise(F.lit(0.0)), "already_optimized": kept}


def choose_lossy(lossy: Column, lossless: Column) -> Column:
    """A lossy result must be clearly smaller than the lossless rewrite."""
    return F.when(lossy <= lossless * LOSSY_SHARE, "lossy").otherwise("lossless")


def jpeg_passthrough(components: Column) -> Column:
    """Files of four components are passed on as they are."""
    return F.coalesce(components == 4, F.lit(False))


def chroma_code(chroma: Column) -> Column:
    """What the encoder calls a subsampling: 1 for full chroma, 0 for halved both ways."""
    return F.when(chroma == "4:4:4", 1).when(chroma == "4:2:0", 0)
