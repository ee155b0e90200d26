"""Corpus manifests, checksum lists, published result tables and option documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "path string, source string, license string, format string, width int, height int, orientation int, alpha boolean, colorProfile string, kind string, licenseUrl string, page string, recipe string, derivedFrom string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of a JSON document ``{"items": [...]}`` or a bare list; absent keys are null."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("value", F.trim("value"))
    wrapped = F.from_json("value", f"items array<struct<{ITEM.replace(' ', ':')}>>".replace(",:", ","))["items"]
    bare = F.from_json("value", f"array<struct<{ITEM.replace(' ', ':')}>>".replace(",:", ","))
    return raw.select(F.explode(F.when(F.col("value").startswith("["), bare).otherwise(wrapped)).alias("i")).select("i.*")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, path) of a checksum list."""
    line = spark.read.text(path).where(F.trim("value") != "")
    return line.select(F.regexp_extract("value", r"^([0-9a-f]{64})", 1).alias("sha256"), F.regexp_extract("value", r"^[0-9a-f]{64}\s+\*?(.*)$", 1).alias("path"))


def verified(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """(path, ok): whether each listed file is there with its checksum; files match by the end of their path.
    Names meet by equality, so only files that are listed by name are hashed."""
    last = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    have = files.select(F.col("path").alias("file"), last("path").alias("name"), "content")
    same = (have["name"] == last(checksums["path"])) & have["file"].endswith(checksums["path"])
    return checksums.join(have, same, "left").withColumn("have", F.sha2("content", 256)).select("path", F.coalesce(F.col("have") == F.col("sha256"), F.lit(False)).alias("ok"))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A published result table with an explicit schema; empty cells are null."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"')


def options(text: Column) -> Column:
    """struct(minQuality, targetQuality, code): values with defaults, or INVALID_OPTIONS for other shapes."""
    p = F.from_json(text, "minQuality int, targetQuality int, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    bad = ~F.trim(text).startswith("{") | p["_corrupt"].isNotNull()
    return F.struct(F.coalesce(p["minQuality"], F.lit(40)).alias("minQuality"), F.coalesce(p["targetQuality"], F.lit(97)).alias("targetQuality"), F.when(F.coalesce(bad, F.lit(True)), "INVALID_OPTIONS").alias("code"))
