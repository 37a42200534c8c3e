"""Numbering of all rows of a table in an order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the leading key.
RANGES = 256


def numbered(df: DataFrame, by: list[str], name: str, ranges: int = RANGES) -> DataFrame:
    """df with its row number in the order of `by` (first column: a number without nulls; ties of all columns in any order).

    The leading key is cut at approximate quantiles; rows are numbered within each range, and start at the number of rows
    in the ranges before. Only the bounds and a count for each range are gathered.
    """
    bounds = sorted(set(df.approxQuantile(by[0], [i / ranges for i in range(1, ranges)], 0.001)))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(by[0]))) if bounds else F.lit(0)
    rows = df.withColumn("_range", place)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return rows.withColumn(name, own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col(name)).drop("_range", "_start")
