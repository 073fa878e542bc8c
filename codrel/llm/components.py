"""Connected components by rounds of smallest neighbours with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of an edge; ``edges`` has columns a and b of one orderable type."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter(F.col("a") != F.col("b")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("c"))
        near = both.join(of, "b").groupBy("a").agg(F.min("c").alias("c"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        moved = written(hooked.join(jump, "component", "left").select("node", "old", F.coalesce("far", "component").alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.filter(F.col("old") != F.col("component")).isEmpty():
            return labels
