"""Aligned texts for the eye: replaced text refined character by character, and blocks of bounded length on both sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .align import opcodes

#: The length of a block, and that below which it joins the one before.
LENGTH, LEAST = 80, 20
PART = StructType([StructField(n, StringType()) for n in ("text1", "text2", "type", "category")])
_PART = pa.list_(pa.struct([(n, pa.string()) for n in PART.names]))


def is_transposed(a: str, b: str) -> bool:
    return 2 <= len(a) <= 6 and a != b and sorted(a) == sorted(b)


def refined(rows: DataFrame, fold: tuple[str, str] = ("", "")) -> DataFrame:
    """rows (type, text1, text2, ...) with parts: equal text whole; what one side alone has, by character (omission, addition); a transposition whole, as an error; replaced text by an inner alignment: pairs of equally long parts character by character (variant where both fold to one, else error), others as omissions and additions."""
    at = [rows.columns.index(c) for c in ("type", "text1", "text2")]
    table = str.maketrans(*fold)
    alone = {"delete": lambda t: [(c, "", "delete", "omission") for c in t], "insert": lambda t: [("", c, "insert", "addition") for c in t]}

    def inner(a: str, b: str, codes: list) -> list[tuple]:
        out: list[tuple] = []
        for kind, i1, i2, j1, j2 in codes:
            x, y = a[i1:i2], b[j1:j2]
            if kind == "equal":
                out += [(c, c, "equal", None) for c in x]
            elif len(x) == len(y):
                out += [(c, d, "replace", "variant" if c.translate(table) == d.translate(table) else "error") for c, d in zip(x, y, strict=True)]
            else:
                out += alone["delete"](x) + alone["insert"](y)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, one, two = (b.column(i).to_pylist() for i in at)
            deep = [k for k, (t, x, y) in enumerate(zip(kind, one, two, strict=True)) if t == "replace" and not is_transposed(x, y)]
            codes = dict(zip(deep, opcodes([one[k] for k in deep], [two[k] for k in deep]), strict=True))
            found = []
            for k, (t, x, y) in enumerate(zip(kind, one, two, strict=True)):
                if k in codes:
                    found.append(inner(x, y, codes[k]))
                elif t == "equal":
                    found.append([(x, y, "equal", None)])
                elif t in alone:
                    found.append(alone[t](x or y))
                else:
                    found.append([(x, y, "replace", "error")])
            items = pa.array([[dict(zip(PART.names, p, strict=True)) for p in ps] for ps in found], _PART)
            yield pa.RecordBatch.from_arrays([*b.columns, items], [*b.schema.names, "parts"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("parts", ArrayType(PART))]))


def chunks(segments: Column, length: int = LENGTH) -> Column:
    """An array of (type, text1, text2, size, cut): segments longer than a block are cut on both sides at once; size: of the longer side."""

    def of(s: Column) -> Column:
        size = F.greatest(F.length(s["text1"]), F.length(s["text2"]))
        n = F.greatest(F.ceil(size / length).cast("int"), F.lit(1))

        def one(k: Column) -> Column:
            x, y = (F.substring(s[c], (k * length + 1).cast("int"), F.lit(length)) for c in ("text1", "text2"))
            return F.struct(s["type"].alias("type"), x.alias("text1"), y.alias("text2"), F.greatest(F.length(x), F.length(y)).alias("size"), (size > length).alias("cut"))

        return F.transform(F.sequence(F.lit(0), n - 1), one)

    return F.flatten(F.transform(segments, of))


def numbered(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rows (chunks) with block: the number of each chunk's block. A block takes chunks while they fit; a cut one stands alone."""
    at = rows.columns.index("chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(at)
            flat = lists.flatten()
            size, cut = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("size", "cut"))
            edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            block = np.zeros(len(size), np.int32)
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                number, held = -1, length
                for k, (n, alone) in enumerate(zip(size[i:j].tolist(), cut[i:j].tolist(), strict=True), i):
                    if alone or held + n > length or number < 0:
                        number, held = number + 1, 0
                    held = length + 1 if alone else held + n
                    block[k] = number
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(block))], [*b.schema.names, "block"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("block", ArrayType(IntegerType()))]))


def blocks(aligned: DataFrame, key: str, fold: tuple[str, str] = ("", ""), length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """key, id (from 1), sentence1, sentence2, has_diff and parts of the blocks of each row of aligned (key, segments). Short blocks join the one before; the text of a block is in the order of the alignment."""
    cut = numbered(aligned.select(F.col(key).alias("owner"), chunks(F.col("segments"), length).alias("chunks")), length)
    rows = cut.select("owner", F.posexplode(F.arrays_zip("chunks", "block")).alias("k", "x")).select("owner", "k", "x.block", "x.chunks.*").drop("cut")
    fine = refined(rows, fold)
    text = lambda side: F.array_join(F.col(f"x.{side}"), "")
    own = fine.groupBy("owner", "block").agg(F.array_sort(F.collect_list(F.struct("k", "text1", "text2", "type", "parts"))).alias("x"))
    own = own.select("owner", "block", text("text1").alias("sentence1"), text("text2").alias("sentence2"), F.exists("x.type", lambda t: t != "equal").alias("has_diff"), F.flatten("x.parts").alias("parts"))
    w = Window.partitionBy("owner").orderBy("block")
    alone = (F.greatest(F.length("sentence1"), F.length("sentence2")) >= least) | (F.row_number().over(w) == 1)
    island = own.withColumn("alone", alone).withColumn("id", F.sum(F.col("alone").cast("int")).over(w))
    merged = island.groupBy("owner", "id").agg(F.array_sort(F.collect_list(F.struct("block", "sentence1", "sentence2", "parts"))).alias("x"), F.max("has_diff").alias("has_diff"))
    return merged.select(F.col("owner").alias(key), F.col("id").cast("int").alias("id"), text("sentence1").alias("sentence1"), text("sentence2").alias("sentence2"), "has_diff", F.flatten("x.parts").alias("parts"))
