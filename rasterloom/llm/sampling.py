"""Bounded training samples for classifiers."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, by: str, per_class: int, key: str = "doc_id") -> DataFrame:
    """At most ``per_class`` rows' keys for each value of ``by``: the id's hash deals rows into so many
    cells and each cell gives its smallest hash. Only partial minima are shuffled. Returns (by, key)."""
    h = F.xxhash64(F.col(key))
    cells = rows.groupBy(by, F.pmod(h, F.lit(per_class)).alias("cell")).agg(F.min(F.struct(h.alias("h"), F.col(key).alias("id"))).alias("least"))
    return cells.select(by, F.col("least.id").alias(key))


def fetch_texts(docs: DataFrame, chosen: DataFrame, most: int, text: Column | None = None) -> list[tuple]:
    """(class, whole text) of a bounded choice (class, doc_id), in order of class and id. Of each class, texts
    are taken in order of id as long as they fit into ``most`` bytes together; one that doesn't fit is passed
    over. Of rows that repeat an id, the one with the smallest text counts; an id chosen for two classes gives
    its text to both.

    The choice is collected first and its ids filter the scan, so no text is shuffled but those chosen."""
    classes = defaultdict(set)
    for c, d in chosen.collect():
        classes[d].add(c)
    if not classes:
        return []
    whole = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    picked = docs.where(F.col("doc_id").isin(list(classes))).select("doc_id", whole.alias("text"))
    # texts beyond the bound are never moved, and each id leaves one
    sizes = picked.groupBy("doc_id").agg(F.min(F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("least"))
    wanted, room = defaultdict(list), defaultdict(lambda: most)
    for d, (n, _) in sorted(sizes.collect()):
        for c in classes[d]:
            if n <= room[c]:
                room[c] -= n
                wanted[d].append(c)
    if not wanted:
        return []
    least = picked.where(F.col("doc_id").isin(list(wanted)) & (F.octet_length("text") <= most)).groupBy("doc_id").agg(F.min(F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"), "text")).alias("least"))
    return sorted(((c, d, t) for d, t in least.select("doc_id", "least.text").collect() for c in wanted[d]), key=lambda x: (x[0], x[1]))
