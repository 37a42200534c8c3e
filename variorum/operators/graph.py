"""Connected components by joins."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder that the cluster shares; one is made only where none is named and there is one machine."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def components(pairs: DataFrame) -> DataFrame:
    """node and component (its smallest member) of all nodes of pairs (a, b): labels sink to the least neighbour, with pointer jumping, until nothing moves."""
    edges = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component"))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        sunk = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        far = labels.select(F.col("node").alias("c"), F.col("component").alias("far"))
        new = cut(sunk.join(far, "c", "left").select("node", "was", F.least("c", "far").alias("component")))
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels
