"""Tile sampling by local detail, and the guarded quality search."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship

#: Fixed values of sampling and search.
TILE, TILES, LEAST_TILE, SMOOTH = 256, 6, 64, 6.0
TARGET, SMOOTH_TARGET = 71, 77
LOW, HIGH, START, PER_QUALITY, EVALUATIONS, FALLBACK = 68, 92, 72, 0.5, 6, 80


def tile_size(width: int, height: int) -> int:
    return min(TILE, width // 16 * 16, height // 16 * 16)


def tile_activity(px: DataFrame, width: int, height: int, key: list[str] = ()) -> DataFrame:
    """(tx, ty, activity): mean of the green differences to the right and below, on every second pixel."""
    size = tile_size(width, height)
    if size < LEAST_TILE:
        return px.select(*key, F.lit(0).alias("tx"), F.lit(0).alias("ty"), F.lit(0.0).alias("activity")).limit(0)
    right = F.lead("g").over(Window.partitionBy(*key, "y").orderBy("x"))
    below = F.lead("g").over(Window.partitionBy(*key, "x").orderBy("y"))
    at = px.select(*key, "x", "y", (F.abs(F.col("g") - right) + F.abs(F.col("g") - below)).alias("d"))
    tx, ty = F.floor(F.col("x") / size) * size, F.floor(F.col("y") / size) * size
    inside = (tx + size <= width) & (ty + size <= height) & ((F.col("x") - tx) % 2 == 0) & ((F.col("y") - ty) % 2 == 0) & (F.col("x") - tx < size - 1) & (F.col("y") - ty < size - 1)
    return at.where(inside).groupBy(*key, tx.cast("int").alias("tx"), ty.cast("int").alias("ty")).agg(F.avg("d").alias("activity"))


def sample_tiles(activity: DataFrame, key: list[str] = (), count: int = TILES) -> DataFrame:
    """Tiles at evenly spaced ranks of activity, and the target score, which is higher for smooth images."""
    over = Window.partitionBy(*key)
    ranked = activity.withColumn("rank", F.row_number().over(over.orderBy("activity", "ty", "tx")) - 1).withColumn("n", F.count("*").over(over))
    at75 = F.max(F.when(F.col("rank") == F.floor((F.col("n") - 1) * 0.75), F.col("activity"))).over(over)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("n") - 1) / (count - 1) + 0.5))
    target = F.when(at75 < SMOOTH, SMOOTH_TARGET).otherwise(TARGET)
    picked = ranked.withColumn("target", target).where((F.col("n") <= count) | F.array_contains(wanted, F.col("rank").cast("long")))
    return picked.select(*key, F.col("rank").cast("int").alias("rank"), "tx", "ty", "activity", "target")


def tile_pixels(px: DataFrame, tiles: DataFrame, size: int, key: list[str] = ()) -> DataFrame:
    """Pixels of each tile of the same image (``key``), with coordinates inside it; an equality of corners."""
    corner = lambda c: (F.floor(F.col(c) / size) * size).cast("int")
    cornered = px.withColumns({"tx": corner("x"), "ty": corner("y")})
    wanted = tiles.select(*key, F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"))
    return cornered.join(wanted, [*key, "tx", "ty"]).withColumn("in_x", F.col("x") - F.col("tx")).withColumn("in_y", F.col("y") - F.col("ty"))


def known_tiles(tiles: DataFrame, wanted: DataFrame, key: list[str] = ()) -> DataFrame:
    """The sampled tiles (rank) that ``wanted`` (key, rank) asks for; asking for one that doesn't exist is an
    error that names the rank."""
    found = wanted.join(tiles, [*key, "rank"], "left")
    missing = F.concat(F.lit("unknown tile "), F.col("rank").cast("string"))
    return found.withColumn("tx", F.when(F.col("tx").isNull(), F.raise_error(missing).cast("int")).otherwise(F.col("tx")))


def score_tiles(references: DataFrame, candidates: DataFrame, prepare: Callable, score: Callable, key: list[str] = ()) -> DataFrame:
    """references (key, rank, content), candidates (key, rank, quality, content): (key, rank, quality, score).
    ``prepare`` sees each tile's reference once; ``score`` gets what it returned and a candidate. Candidates
    of a tile that has no reference, or whose size differs from it, are an error."""
    by = [*key, "rank"]
    names = [*by, "quality", "score"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame(columns=names)
        if not len(left):
            raise ValueError(f"METRIC_FAILED: unknown tile {right['rank'].iloc[0]}")
        known = left["content"].iloc[0]
        if any(len(c) != len(known) for c in right["content"]):
            raise ValueError(f"METRIC_FAILED: sizes differ in tile {right['rank'].iloc[0]}")
        ready = prepare(known)
        return right[[*by, "quality"]].assign(score=[float(score(ready, c)) for c in right["content"]])

    types = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in names[:-1])
    ship(references.sparkSession)
    return references.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInPandas(run, f"{types}, score double")


def choose_quality(curves: DataFrame, key: list[str]) -> DataFrame:
    """curves (key, quality, score) of every quality, target: the quality the guarded search ends at; images
    without tiles have null scores and get the fallback."""
    by = F.transform(F.sort_array(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("quality", "score")))), lambda p: p["score"])
    return search_scored(curves.groupBy(*key).agg(by.alias("scores"), F.first("target").alias("target")), key, "scores", "target")


def tile_scores(scored: DataFrame, key: list[str] = ()) -> DataFrame:
    """scored (key, quality, rank, score): an image is as good at a quality as its weakest tile."""
    return scored.groupBy(*key, "quality").agg(F.min("score").alias("score"), F.min(F.struct("score", "rank"))["rank"].alias("weakest"))


def search_quality(score: Callable[[int], float], target: float) -> int:
    """Lowest quality found that reaches the target, given that scores rise with quality.

    ``low`` misses the target and ``high`` reaches it, or is the last resort. Each probe lies where the nearest
    known scores meet the target; where a probe left more than half of the interval, the next one halves it."""
    low, high, margin, probe = LOW - 1, HIGH, {}, START
    while True:
        margin[probe] = score(probe) - target
        width = high - low
        low, high = (low, probe) if margin[probe] >= 0 else (probe, high)
        if high - low <= 2 and (high in margin or low >= HIGH - 2) or high - low <= 1 or len(margin) == EVALUATIONS:
            return high
        if low in margin and high in margin:
            meets = low + (high - low) * margin[low] / (margin[low] - margin[high]) if margin[high] > margin[low] else low
            if 2 * (high - low) > width:
                meets = (low + high) / 2
        else:
            meets = probe - margin[probe] / PER_QUALITY
        probe = min(max(math.ceil(meets), low + 1), high - 1)


def search_scored(curves: DataFrame, key: str | list[str], scores: str, target: str) -> DataFrame:
    """curves (key, scores array for qualities LOW to HIGH, target): the quality the search ends at."""

    @F.pandas_udf("int")
    def found(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([FALLBACK if v is None or not len(v) else search_quality(lambda q, v=v: float(v[q - LOW]), goal) for v, goal in zip(s, t)], dtype="int32")

    return curves.select(*([key] if isinstance(key, str) else key), found(scores, target).alias("quality"))
