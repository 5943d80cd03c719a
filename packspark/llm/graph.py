"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packspark.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): the smallest node reachable.  Null ends are no links.

    Each round takes the smallest label around a node and then the label of that label, so chains
    shorten by doubling; rounds are written to the shared folder and end when no label changes."""
    both = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialise(both, "edges")
    label = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")) \
        .select("node", F.least("node", "near").alias("comp"))
    label = materialise(label, "labels")
    while True:
        around = edges.join(label.select(F.col("node").alias("b"), "comp"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        seen = label.join(around, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = materialise(seen.join(jump, "comp", "left").select(
            "node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        label = new.select("node", "comp")
        if new.where(F.col("old") != F.col("comp")).isEmpty():
            return label
