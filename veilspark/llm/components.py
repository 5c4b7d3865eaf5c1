"""Connected components by label propagation with pointer jumping, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def components(edges: DataFrame) -> DataFrame:
    """From a, b (long): node, label (the smallest node it reaches), for all nodes with an edge."""
    both = scratch(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropDuplicates(), "edges")
    labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = scratch(nearer.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")), "labels")
        if after.filter(F.col("label") < F.col("old")).isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
