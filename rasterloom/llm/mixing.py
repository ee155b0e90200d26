"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each document expects ``target / source size`` copies. The expected copies are summed in order within the
source, one offset in [0, 1) is added, and the document is emitted once for each whole number that its
interval crosses. Rows are ordered by size class, so every class gets its share; the running sum is built
from counts of (source, size class, salt) cells, so no task ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import staged
from .text import WORD, unused

#: No document is taken more often than this, and no target is above this many times its source's size.
MOST_COPIES = 3
#: Cells that one size class of a source is dealt into.
SALTS = 64


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, size): one row per source, with its rank by code point (null last), weight 1, 2, 3
    repeating, and target. Targets stop at MOST_COPIES times the source's size, and the excess is shared
    again by weight: sources that stop come first when ordered by cap over weight."""
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    total = total.withColumn("rank", F.row_number().over(by_name)).withColumn("w", (F.col("rank") - 1) % 3 + 1)
    total = total.withColumn("cap", F.col("source_size") * MOST_COPIES)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sharing = F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = total.withColumn("level", (F.sum("source_size").over(every) - stopped).cast("double") / sharing)
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))
    level = level.withColumn("level", F.min(fits).over(every)["level"])
    return level.select("source", "rank", "source_size", F.least(F.col("level") * F.col("w"), F.col("cap").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, seed: int = 7, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, text, source, ...), and the column
    ``row``, a number that tells rows apart, if it is named.

    Size is the number of words (null text: 0). A null source is a source of its own, the last. Documents
    of no words are never taken and sources of no words have target 0. Repeated rows of one doc_id are
    separate documents; rows that tie in size and doc_id are ordered by ``row``, or are alike without it. Very
    long texts count by their words like others. Other columns are ignored, whatever their names; an empty
    table gives none. The offset comes from the seed and the source's rank, so reruns agree.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    bits = F.bin("size")
    number = F.lit(0).cast("long") if row is None else F.col(row)
    narrow = docs.select(F.col("doc_id").cast("long"), "source", size.alias("size"), number.alias("row")).select(
        "*",
        F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(F.concat(bits, F.lit("000")), 1, 4)).alias("class"),
        (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2), 16, 10).cast("int") % SALTS).alias("salt"),
    )
    narrow = staged(narrow, "mix")
    cell = ["source", "class", "salt"]
    counts = narrow.groupBy(*cell).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    targets = source_targets(narrow)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("rank").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "target", rate.alias("rate"), offset.alias("offset"))
    cells = cells.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source", "n")
    cells = cells.select(*[F.col(c).alias(f"c_{c}") for c in cell], "before", "source_size", "target", "rate", "offset")
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("size", F.col("doc_id").asc_nulls_last(), "row"))
    ranked = narrow.withColumn("k", rank)
    # the null source can't meet itself in a plain equality
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class")) & (F.col("salt") == F.col("c_salt"))
    k = F.col("before") + F.col("k")
    copies = F.floor(F.col("rate") * k + F.col("offset")) - F.floor(F.col("rate") * (k - 1) + F.col("offset"))
    return ranked.join(cells, same).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), *([] if row is None else [F.col("row").alias(row)]))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes each; those that it doesn't take
    go. Rows are numbered in a written copy, so that repeated rows and rows without doc_id meet only their own
    copies and no key is hot."""
    number, many = unused(docs.columns, "number"), unused(docs.columns, "many")
    rows = staged(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    taken = mix_sources(rows, seed, number).where("taken > 0").select(number, (F.col("taken") / F.col("size")).cast("int").alias(many))
    copies = rows.join(taken, number).withColumn(many, F.explode(F.sequence(F.lit(1), F.col(many))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
n AS (SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size) || '000', 1, 4) AS class,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2))::INT % 64 AS salt FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM n GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, (rank - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(w) OVER (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT level FROM l WHERE level * w <= cap ORDER BY cap::DOUBLE / w, rank LIMIT 1),
t AS (SELECT source, source_size, least(v.level * w, cap::DOUBLE) AS target,
             ('0x' || substr(md5('7:' || rank::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS off FROM l, v),
k AS (SELECT n.*, source_size, target, off, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
             row_number() OVER (PARTITION BY n.source ORDER BY class, salt, size, doc_id NULLS LAST) AS k
      FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate * k + off) - floor(rate * (k - 1) + off)) * size)::BIGINT AS taken FROM k"""
