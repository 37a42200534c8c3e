"""The rate limit as a stream: requests a minute and user, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def over_limit(events: DataFrame, limit: int = 60, late: str = "5 minutes") -> DataFrame:
    """user_id, start and n of each minute with more requests than the limit; works on streams and on tables."""
    w = F.window("ts", "1 minute")
    n = events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") > limit).select("user_id", F.col("w.start").alias("start"), "n")
