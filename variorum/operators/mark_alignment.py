"""punctuation compared across texts that differ in characters as well.

The texts without marks and white space are aligned (variants folded). Marks of either text find their segment as an
as-of join: segments and marks of a text are one ordered union, and each mark carries the last segment that began. Marks
of paired characters meet by position; those of characters that the other text lacks stand alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import align
from .graph import cut
from .marks import mark_map

_SEGMENT = ["k", "type", "i1", "i2", "j1", "j2"]


def _placed(marks: DataFrame, segments: DataFrame, begin: str, end: str) -> DataFrame:
    """marks (key, pos, marks) with the segment that holds pos."""
    at = segments.where(F.col(end) > F.col(begin)).select("key", F.col(begin).alias("pos"), F.lit(0).alias("order"), F.struct(*_SEGMENT).alias("s"), F.lit(None).cast("string").alias("marks"))
    both = at.unionByName(marks.where("pos >= 0").select("key", F.col("pos").cast("int").alias("pos"), F.lit(1).alias("order"), F.lit(None).cast(at.schema["s"].dataType).alias("s"), "marks"))
    w = Window.partitionBy("key").orderBy("pos", "order").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("s", F.last("s", ignorenulls=True).over(w)).where(F.col("marks").isNotNull()).select("key", "pos", "marks", "s.*")


def mark_differences(pairs: DataFrame, key: str, one: str, two: str, fold: tuple[str, str] = ("", "")) -> DataFrame:
    """key, id (from 1), pos1, pos2, character1, character2 ('' where the other text has none), x, y (marks of either text), kind. Of several at one pos1 the first in the order of the alignment stays; where a text lacks a character, the one before it stands for its place."""
    rows = pairs.select(F.col(key).alias("key"), F.col(one).alias("one"), F.col(two).alias("two")).withColumns({"a": T.strip_marks(F.col("one")), "b": T.strip_marks(F.col("two"))})
    aligned = align.align(rows.select("key", "a", "b"), "a", "b", fold, autojunk=True).select("key", F.posexplode("segments").alias("k", "s"))
    segments = cut(aligned.select("key", "k", "s.type", "s.i1", "s.i2", "s.j1", "s.j2"))  # aligned once for both sides
    p = _placed(mark_map(rows.select("key", "one"), "key", "one"), segments, "i1", "i2")
    q = _placed(mark_map(rows.select("key", "two"), "key", "two"), segments, "j1", "j2")
    both = F.least(F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1"))
    p = p.withColumn("nth", F.col("pos") - F.col("i1"))
    q = q.withColumn("nth", F.col("pos") - F.col("j1"))
    paired = lambda d: d.where(F.col("nth") < both)
    left = paired(p).select("key", "k", F.col("pos").alias("pos1"), (F.col("j1") + F.col("nth")).alias("pos2"), F.col("marks").alias("x"))
    right = paired(q).select("key", "k", (F.col("i1") + F.col("nth")).alias("pos1"), F.col("pos").alias("pos2"), F.col("marks").alias("y"))
    met = left.join(right, ["key", "k", "pos1", "pos2"], "full").select("key", "k", "pos1", "pos2", F.coalesce("x", F.lit("")).alias("x"), F.coalesce("y", F.lit("")).alias("y"), F.lit(True).alias("has1"), F.lit(True).alias("has2")).where("x <> y")
    before = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    lost = p.where(F.col("nth") >= both).select("key", "k", F.col("pos").alias("pos1"), before("j2").alias("pos2"), F.col("marks").alias("x"), F.lit("").alias("y"), F.lit(True), F.lit(False))
    won = q.where("type = 'insert'").select("key", "k", before("i1").alias("pos1"), F.col("pos").alias("pos2"), F.lit("").alias("x"), F.col("marks").alias("y"), F.lit(True), F.lit(True))
    found = met.union(lost).union(won)
    once = found.withColumn("nth", F.row_number().over(Window.partitionBy("key", "pos1").orderBy("k", "pos2"))).where("nth = 1")
    char: Column = lambda t, at: F.substring(t, F.col(at) + 1, F.lit(1))
    told = once.withColumn("id", F.row_number().over(Window.partitionBy("key").orderBy("pos1"))).join(rows.select("key", "a", "b"), "key")  # numbered before the texts come in
    return told.select(F.col("key").alias(key), "id", "pos1", "pos2", char(F.col("a"), "pos1").alias("character1"), F.when(F.col("has2"), char(F.col("b"), "pos2")).otherwise("").alias("character2"), "x", "y", T.mark_difference(F.col("x"), F.col("y")).alias("kind"))
