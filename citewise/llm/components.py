"""Connected components by smallest label and pointer jumping, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewise.plans.materialize import settle


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, component): the smallest id reachable from every id of the edges (a, b).

    A round takes the smallest label of the neighbours, then the label of the label; labels only fall, so it ends. ``parts`` bounds the
    files of a table, see settle.
    """
    both = settle(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), parts)
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), parts)
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        lower = settle(lower, parts)
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        moved = settle(lower.join(jump, "label", "left").select("id", "before", F.least("label", F.coalesce("further", "label")).alias("label")), parts)
        labels = moved.select("id", "label")
        if moved.filter(F.col("label") != F.col("before")).isEmpty():
            return labels.withColumnRenamed("label", "component")
