"""Substring dedup by windows of words, behind a count-min prefilter.

A window is 35 consecutive words of one document; every word that a repeated window covers is removed. A window has an
anchor: the smallest hash among the 16-word grams in it. Equal windows have equal anchors, so a window cannot occur
more often than its anchor, and only a tenth as many anchors as windows have to be counted.

1. Each task counts its anchors in a count-min sketch (two cells an anchor, counts kept up to 2); the partition sketches
   are merged chunk by chunk. The merged sketch has a fixed size (CELLS bits, 16 MB) and is broadcast. It can only
   overestimate: a window estimated once is not repeated.
2. A second pass groups exactly, by 96 bits of hash, the windows whose anchors are estimated repeated. Windows that
   occur twice or more give their positions back to their documents. No window is lost, and none is wrongly kept
   apart; beyond a few 10^8 anchors the sketch fills up and lets more windows through to the exact grouping.

A window that a task meets twice is known to repeat: it sends one row for the whole task to the grouping, and its other
places go straight back to their documents, as runs. So a passage that a third of all documents share sends a row a task
to its group.

Nulls and edge cases: a null text has no words; texts shorter than a window lose nothing; rows are told apart by doc_id
and text (null ids by text, beside a mark that no doc_id has), so rows of one doc_id with different texts are different
documents, and a repeated row counts as a copy; long texts are handled whole; extra columns are passed over, or carried
in a struct, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, INVERSE, WordHashes, byte_texts, frugal, marked, mix, powers, slices, table

WINDOW, GRAM = 35, 16
CELLS = 1 << 27
CHUNK = 1 << 17  # bytes of a plane in a chunk


class Rolling:
    """Hashes of all runs of n numbers of a flat array."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, x: np.ndarray, n: int) -> np.ndarray:
        if len(self.up) <= len(x):
            self.up, self.down = powers(BASE, 2 * len(x)), powers(INVERSE, 2 * len(x))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * self.up[: len(x)], dtype=np.uint64)])
        return mix((total[n:] - total[:-n]) * self.down[: len(x) - n + 1])


def sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) of each n neighbours."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x = f(x[:-step], x[step:]) if step else x
        size += step
    return x


class Windows:
    """Window and anchor hashes of a block of documents, in one flat array of words."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.hashes, self.roll = window, gram, WordHashes(), Rolling()

    def load(self, texts: pa.Array) -> bool:
        """False if no document has a window."""
        self.flat, self.offsets = self.hashes(texts)
        self.counts = np.diff(self.offsets)
        w, g = self.window, self.gram
        if self.counts.max(initial=0) < w:
            return False
        n = len(self.flat)
        last = np.repeat(self.offsets[1:], self.counts)  # the end of each word's document
        at = np.arange(n)
        self.valid = (at + w <= last)[: n - w + 1]
        grams = self.roll(self.flat, g)
        grams = np.where((at + g <= last)[: n - g + 1], grams, np.uint64(2**64 - 1))
        self.anchor = sliding(grams, w - g + 1, np.minimum)  # of each window
        reach = w - g
        v = np.concatenate([np.zeros(reach, np.uint64), np.where(self.valid, self.anchor, np.uint64(0)), np.zeros(reach, np.uint64)])
        self.anchors = grams[sliding(v, reach + 1, np.maximum) == grams]  # of all places that are the anchor of some window
        return True

    def hashes96(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h1 = self.roll(self.flat, self.window)[keep]
        h2 = self.roll(mix(self.flat ^ np.uint64(0xD6E8FEB86659FD93)), self.window)[keep]
        return h1, (h2 >> np.uint64(32)).astype(np.uint32)


def cells_of(anchors: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each anchor."""
    half = np.uint64(cells // 2)
    return anchors % half, half + (mix(anchors ^ np.uint64(0x5851F42D4C957F2D)) % half)


class Sketch:
    """Counts up to 2, in two planes of bits: seen at least once, at least twice."""

    def __init__(self, cells: int = CELLS):
        self.once, self.twice = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
        self.cells = cells

    def add(self, anchors: np.ndarray) -> None:
        for cells in cells_of(anchors, self.cells):
            u, n = np.unique(cells, return_counts=True)
            byte, bit = (u >> np.uint64(3)).astype(np.int64), np.left_shift(1, (u & np.uint64(7)).astype(np.uint8)).astype(np.uint8)
            two = (n > 1) | (self.once[byte] & bit != 0)
            np.bitwise_or.at(self.twice, byte[two], bit[two])
            np.bitwise_or.at(self.once, byte, bit)


def repeated(anchors: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Whether each anchor is estimated to occur twice or more."""
    ok = np.ones(len(anchors), bool)
    for cells in cells_of(anchors, len(twice) * 8):
        ok &= (twice[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 != 0
    return ok


def sketch(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int = CELLS) -> np.ndarray:
    """The plane of cells counted twice or more, over all texts (one column)."""
    chunk = min(CHUNK, cells // 8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, w = Sketch(cells), Windows(window, gram)
        for b in slices(batches, 1000, 1 << 20):
            if w.load(b.column(0)):
                s.add(w.anchors)
        for k in range(0, len(s.once), chunk):
            once, twice = s.once[k : k + chunk], s.twice[k : k + chunk]
            if once.any():
                packed = [pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([k // chunk], pa.int32()), *packed], ["chunk", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for i in range(b.num_rows):  # one sketch chunk at a time
                k = b.column(0)[i].as_py()
                once, twice = (np.frombuffer(zlib.decompress(b.column(j)[i].as_py()), np.uint8) for j in (1, 2))
                if k in planes:
                    p = planes[k]
                    p[1] |= twice | (p[0] & once)
                    p[0] |= once
                else:
                    planes[k] = [once.copy(), twice.copy()]
        for k, p in planes.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(p[1].tobytes(), 1)], pa.binary())], ["chunk", "twice"])

    merged = texts.mapInArrow(frugal(count), "chunk int, once binary, twice binary").repartition("chunk").mapInArrow(frugal(merge), "chunk int, twice binary")
    plane = np.zeros(cells // 8, np.uint8)
    for row in merged.toLocalIterator():
        plane[row.chunk * chunk : (row.chunk + 1) * chunk] = np.frombuffer(zlib.decompress(bytes(row.twice)), np.uint8)
    return plane


def runs_of_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h1, h2, key, tag, pos, n, known) sorted by h1 and h2: key, tag, pos and n of those that are known to repeat or not alone with their hashes. Holds one batch and one row."""
    names = ["key", "tag", "pos", "n"]
    held: pa.RecordBatch | None = None  # the last row so far, if it is not given out
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, known = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 6))
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        keep = known > 0
        keep[1:] |= same
        keep[:-1] |= same
        rows = pa.RecordBatch.from_arrays([b.column(i) for i in range(2, 6)], names)
        if last == (h1[0], h2[0]):
            keep[0] = True
            if held is not None:
                yield held
        yield rows.filter(pa.array(keep))
        last = (h1[-1], h2[-1])
        held = None if keep[-1] else rows.slice(rows.num_rows - 1, 1)


class Known:
    """What a task has met twice repeats wherever it stands, and one row of a task is enough to tell other tasks. At most `size` are remembered; what is not sends more rows."""

    def __init__(self, size: int = 1 << 20):
        self.size, self.h1, self.h2 = size, np.zeros(0, np.uint64), np.zeros(0, np.uint32)

    def __call__(self, h1: np.ndarray, h2: np.ndarray | None = None) -> np.ndarray:
        """Of hashes of two parts, or one: 0: not known to repeat, 1: known, 2: known, and the row that tells other tasks."""
        out = np.zeros(len(h1), np.int8)
        order = np.argsort(h1) if h2 is None else np.lexsort((h2, h1))
        h1 = h1[order]
        h2 = np.zeros(len(h1), np.uint32) if h2 is None else h2[order]
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        first = np.concatenate([[True], ~same])[: len(h1)]
        heads = np.flatnonzero(first)
        state = np.where(np.concatenate([same, [False]])[: len(h1)][heads], 2, 0)  # of each number: alone, or met twice now
        if len(self.h1):
            at = np.minimum(np.searchsorted(self.h1, h1[heads]), len(self.h1) - 1)
            state[(self.h1[at] == h1[heads]) & (self.h2[at] == h2[heads])] = 1
        run = np.cumsum(first) - 1
        out[order] = np.where(first, state[run], np.minimum(state[run], 1))
        told = heads[state == 2]
        if len(self.h1) + len(told) <= self.size:
            h1, h2 = np.concatenate([self.h1, h1[told]]), np.concatenate([self.h2, h2[told]])
            order = np.argsort(h1, kind="stable")
            self.h1, self.h2 = h1[order], h2[order]
        return out


WINDOWS = "h1 long, h2 int, key long, tag int, pos int, n int, known byte"


def repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """key, tag, pos (word number) and n of each run of n windows whose words also start anywhere else. documents: key, tag, text."""
    plane = documents.sparkSession.sparkContext.broadcast(sketch(documents.select("text"), window, gram, cells))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, twice, again = Windows(window, gram), plane.value, Known()
        for b in slices(batches, 1000, 1 << 20):
            if not w.load(b.column(2)):
                continue
            keep = np.flatnonzero(w.valid)
            keep = keep[repeated(w.anchor[keep], twice)]
            if not len(keep):
                continue
            h1, h2 = w.hashes96(keep)
            known = again(h1, h2)
            doc = np.searchsorted(w.offsets, keep, side="right") - 1
            # known windows that follow each other go as one row, and to any task
            begins = np.ones(len(keep), bool)
            begins[1:] = (known[1:] != 1) | (known[:-1] != 1) | (keep[1:] != keep[:-1] + 1) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(begins)
            n = np.diff(at, append=len(keep)).astype(np.int32)
            h1, h2, known, keep, doc = h1[at], h2[at], known[at], keep[at], doc[at]
            key, tag = (b.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1))
            pos = (keep - w.offsets[doc]).astype(np.int32)
            alone = known == 1
            h1[alone] = mix(key[alone].view(np.uint64) + mix(pos[alone].astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1.view(np.int64), h2.view(np.int32), key, tag, pos, n, known)], ["h1", "h2", "key", "tag", "pos", "n", "known"])

    rows = documents.select("key", "tag", "text").mapInArrow(frugal(emit), WINDOWS)
    return rows.repartition("h1").sortWithinPartitions("h1", "h2").mapInArrow(frugal(runs_of_two), "key long, tag int, pos int, n int")


def dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int = CELLS, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row; with carry, text and a struct `rest` of those columns too."""
    rest = F.struct(*(documents[c] for c in carry)) if carry else F.lit(None).cast("int")
    rows = marked(documents.select("doc_id", "text", rest.alias("rest")))
    marks = repeats(rows, window, gram, cells).groupBy("key", "tag").agg(F.collect_list(F.struct("pos", "n")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000, 1 << 20):
            n, removed, kept = [], [], []
            marks = b.column(2)
            for i, text in enumerate(byte_texts(b.column(1))):
                words = text.split()
                n.append(len(words))
                if marks[i].is_valid:
                    at, size = (marks[i].values.field(k).to_numpy() for k in (0, 1))
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, np.minimum(at, len(words)), 1)
                    np.add.at(edge, np.minimum(at + size - 1 + window, len(words)), -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    words = [words[j] for j in np.flatnonzero(stay)]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), b.column(1), b.column(3)], ["doc_id", "n_words", "n_removed", "kept", "text", "rest"])

    joined = rows.join(marks, ["key", "tag"], "left").select("doc_id", "text", "marks", "rest")
    fields = [("doc_id", documents.schema["doc_id"].dataType), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()), ("text", T.StringType()), ("rest", rows.schema["rest"].dataType)]
    out = joined.mapInArrow(frugal(cut), T.StructType([T.StructField(*f) for f in fields]))
    return out.drop("text", "rest") if carry is None else out


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
