"""Punctuation by runs: a row a run of marks, with the number of characters before it, so work follows the marks and not the characters. Two texts are compared inside their row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.marks import J_MARK, J_NOT_MARK, MARKS, SPACES
from ..functions.text import mark_difference
from .align import together


def mark_runs(rows: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """key (and more columns), k, before (characters that are no marks and no white space before the run), marks, and attached: whether it follows such a character directly, or stands before the first one. Rows of one key stay together: what a caller groups by key costs no further shuffle."""
    # the end of the text closes the last piece, else a tail without marks would be searched from each of its characters
    piece = F.regexp_extract_all(text, F.lit(rf"{J_NOT_MARK}*+(?:{J_MARK}++|\z)"), F.lit(0))
    cut = rows.select(key, *more, F.posexplode(piece).alias("k", "piece"))
    run = F.rtrim(F.col("piece"), F.lit(MARKS))
    marks = F.substring("piece", F.length(run) + 1, F.length("piece"))
    own = cut.select(key, *more, "k", marks.alias("marks"), F.length(F.translate("piece", MARKS + SPACES, "")).alias("n"), F.contains(F.lit(SPACES), F.right(run, F.lit(1))).alias("spaced")).where("marks <> ''")
    w = Window.partitionBy(key, *more).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    told = own.repartition(key).withColumn("before", F.sum("n").over(w))
    return told.select(key, *more, "k", "before", "marks", (~F.col("spaced") | (F.col("before") == 0)).alias("attached"))


def mark_map(rows: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """Key, pos and marks: those directly after each character that is neither mark nor white space, by its number from 0; -1: before the first one, white space between them or not."""
    own = mark_runs(rows, key, text, *more).where("attached")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "marks"))), lambda x: x["marks"]), "")
    return own.groupBy(key, *more, (F.col("before") - 1).alias("pos")).agg(joined.alias("marks"))


#: What a code point is to a text: a character, a mark, or white space.
CHARACTER, MARKED, SPACED = 0, 1, 2
_KINDS = np.zeros(0x110000, np.uint8)
_KINDS[[ord(c) for c in MARKS]] = MARKED
_KINDS[[ord(c) for c in SPACES]] = SPACED


class _Placed:
    """Runs of marks of many texts, laid end to end: key (number of the text above the number of the character before the run, from 1; 0: none) in order, and marks. solid: white space counts as a character."""

    def __init__(self, texts: list[str], solid: bool):
        self.edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        self.text = "".join(texts)
        self.code = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        kind = _KINDS[self.code]
        mark = kind == MARKED
        self.character = ~mark if solid else kind == CHARACTER
        self.total = np.concatenate([[0], np.cumsum(self.character)])
        cut = np.zeros(len(mark) + 1, bool)
        cut[self.edge] = True
        begin = np.flatnonzero(mark & (cut[:-1] | np.concatenate([[True], ~mark[:-1]])))
        end = np.flatnonzero(mark & (cut[1:] | np.concatenate([~mark[1:], [True]]))) + 1
        of = np.searchsorted(self.edge, begin, side="right") - 1
        place = self.total[begin] - self.total[self.edge[of]]
        near = place == 0
        near[~near] = self.character[begin[~near] - 1]  # white space between a character and its marks parts them
        of, place, begin, end = of[near], place[near], begin[near], end[near]
        marks = [self.text[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
        key = of << 40 | place
        again = np.flatnonzero(key[1:] == key[:-1]) + 1  # white space between runs before the first character
        for k in again[::-1].tolist():
            marks[k - 1] += marks[k]
        self.key = np.delete(key, again)
        self.marks = np.delete(np.array(marks, object), again)

    def sizes(self) -> np.ndarray:
        """How many characters each text has."""
        return self.total[self.edge[1:]] - self.total[self.edge[:-1]]

    def contexts(self, of: np.ndarray, place: np.ndarray, width: int) -> list[str]:
        """The characters from width before to width behind the number `place` of each text `of`, from 0."""
        clean = self.code[self.character].tobytes().decode("utf-32-le")
        low, high = self.total[self.edge[of]], self.total[self.edge[of + 1]]
        begin, end = np.maximum(place - width, 0), np.maximum(place + width, 0)
        return [clean[i:j] for i, j in zip((low + begin).tolist(), np.minimum(low + end, high).tolist(), strict=True)]


def _met(one: _Placed, two: _Placed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all places with marks in either: the text's number, the character's (-1: before the first), and the marks of both."""
    key = np.union1d(one.key, two.key)
    x, y = np.full(len(key), "", object), np.full(len(key), "", object)
    x[np.searchsorted(key, one.key)] = one.marks
    y[np.searchsorted(key, two.key)] = two.marks
    return key >> 40, (key & ((1 << 40) - 1)) - 1, x, y


def mark_differences(rows: DataFrame, key: str, one: Column, two: Column, context: int | None = None) -> DataFrame:
    """key, pos, marks of either text (x, y) and the type of their difference, for texts of the same characters; with a width also context, the characters of the first text from so many before pos to so many behind it. Both texts are walked through in their own row, a batch at a time, so nothing is shuffled and work grows with the texts. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in together(batches, [1, 2]):
            p, q = (_Placed([t or "" for t in b.column(i).to_pylist()], False) for i in (1, 2))
            of, pos, x, y = _met(p, q)
            differ = (x != y).astype(bool)
            of, pos, x, y = of[differ], pos[differ], x[differ], y[differ]
            columns = [b.column(0).take(pa.array(of)), pa.array(pos, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())]
            if context is not None:
                columns.append(pa.array(p.contexts(of, pos, context), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    pairs = rows.select(key, one.alias("one"), two.alias("two"))
    schema = StructType([pairs.schema[key], *StructType().add("pos", "long").add("x", "string").add("y", "string").fields])
    if context is not None:
        schema = schema.add("context", "string")
    return pairs.mapInArrow(run, schema).withColumn("kind", mark_difference(F.col("x"), F.col("y")))


def basic_gaps(rows: DataFrame, key: str, one: Column, two: Column) -> DataFrame:
    """The marks after each character of two texts, where white space counts as a character and marks before the first do not count: key, n_base and n_other (characters with marks), n_different, and first_pos of these (from 0; -1: none). Characters beyond the end of the other text are not compared; texts without characters give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in together(batches, [1, 2]):
            p, q = (_Placed([t or "" for t in b.column(i).to_pylist()], True) for i in (1, 2))
            of, pos, x, y = _met(p, q)
            differ = (x != y).astype(bool) & (pos >= 0) & (pos < np.minimum(p.sizes(), q.sizes())[of])
            count = lambda which: np.bincount(of[which], minlength=b.num_rows)
            n = [count(which.astype(bool)) for which in ((x != "") & (pos >= 0), (y != "") & (pos >= 0), differ)]
            first = np.full(b.num_rows, -1)
            first[of[differ][::-1]] = pos[differ][::-1]  # places are in order, so the first one is written last
            own = np.flatnonzero(p.sizes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), *(pa.array(v[own], pa.int64()) for v in (*n, first))], schema.names)

    pairs = rows.select(key, one.alias("one"), two.alias("two"))
    schema = StructType([pairs.schema[key], *(StructField(c, LongType()) for c in ("n_base", "n_other", "n_different", "first_pos"))])
    return pairs.mapInArrow(run, schema)
