"""Moves in the trees of JSON lines, over the rows of json_tree: parents come before what is below them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visible(nodes: DataFrame, collapsed: DataFrame | None = None, by: str = "line_no") -> DataFrame:
    """The nodes that show when the given nodes (by, path) are collapsed: those that none of them is above."""
    if collapsed is None:
        return nodes
    shut = collapsed.select(by, F.array_join("path", "\u0001").alias("_shut")).distinct()
    above = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.array_join(F.slice("path", 1, n), "\u0001"))
    d = nodes.withColumn("_above", F.when(F.size("path") > 1, above).otherwise(F.expr("cast(array() as array<string>)")))
    hidden = d.select(by, "ord", F.explode("_above").alias("_shut")).join(shut, [by, "_shut"]).select(by, "ord").distinct()
    return d.drop("_above").join(hidden, [by, "ord"], "left_anti")


def moves(nodes: DataFrame, by: str = "line_no") -> DataFrame:
    """nodes with next_path and prev_path (the visible nodes after and before; null at the ends), next_expandable, and is_last.

    nodes: (by, ord, path, kind, value) of visible(); an object or array is expandable unless it is empty.
    """
    order = Window.partitionBy(by).orderBy("ord")
    later = order.rowsBetween(1, Window.unboundedFollowing)
    expandable = F.col("kind").isin("object", "array") & ~F.col("value").isin("{}", "[]")
    d = nodes.withColumn("next_path", F.lead("path").over(order)).withColumn("prev_path", F.lag("path").over(order))
    return d.withColumn("next_expandable", F.first(F.when(expandable, F.col("path")), True).over(later)).withColumn("is_last", F.col("next_path").isNull())
