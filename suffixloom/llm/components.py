"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label``: for every node of ``edges (a, b)`` the least node it is connected with.

    A round takes the least label among the neighbours and then the label of that label.
    All joins are between written tables, so a node with very many edges is split by
    adaptive execution; only a count of changed labels reaches the driver."""
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                        .filter("a <> b").distinct(), "edges")
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("b"))
                          .select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        low = scratch.save(labels.join(near, "node").select("node", F.least("label", "near").alias("low"),
                                                            F.col("label").alias("was")), "least")
        up = low.select(F.col("node").alias("low"), F.col("low").alias("root"))
        moved = scratch.save(low.join(up, "low", "left").select(
            "node", F.least("low", F.coalesce("root", "low")).alias("label"), "was"), "labels")
        labels = moved.select("node", "label")
        if not moved.filter("label <> was").limit(1).count():
            return labels
