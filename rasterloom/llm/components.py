"""Connected components of an edge table by parent pointers; nothing is gathered on the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import staged


def _roots(parents: DataFrame) -> DataFrame:
    """parents (node, label) with label < node, one row per node: follow the pointers to their ends."""
    while True:
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = staged(parents.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved")), "jump")
        moved = jumped.where("moved").limit(1).count()
        parents = jumped.select("node", "label")
        if not moved:
            return parents


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b) that isn't the smallest of its component; label is that
    smallest node. Each round, every node takes its smallest neighbour if that is smaller than itself, the
    pointers are followed to their ends, and edges inside a component vanish."""
    edges, labels = staged(edges.where("a <> b").distinct(), "edges"), None
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "a"))
        parents = both.groupBy("node").agg(F.min("label").alias("label")).where("label < node")
        step = _roots(staged(parents, "parents"))
        fresh = step if labels is None else relabel(labels, step, "label").unionByName(step.join(labels.select("node"), "node", "left_anti"))
        labels = staged(fresh, "labels")
        edges = staged(relabel(relabel(edges, step, "a"), step, "b").where("a <> b").distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def relabel(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by its label where it has one."""
    named = labels.select(F.col("node").alias(column), F.col("label").alias("_label"))
    return rows.join(named, column, "left").withColumn(column, F.coalesce("_label", column)).drop("_label").select(*rows.columns)
