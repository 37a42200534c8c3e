"""Connected components by joins: labels sink to the smallest node, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of links (a, b). A round costs two joins; the number of rounds grows with the logarithm of the longest path, as a rule."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        sunk = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("far"))
        new = written(sunk.join(jump, "c", "left").select("node", "was", F.least("c", "far").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels
