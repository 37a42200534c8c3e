"""Suffix-array dedup: every byte that a repeated 400-byte string covers is removed.

A suffix array of the corpus is built in shards that hold whole groups of possible matches:

1. Each 400-byte string has an anchor, its leftmost smallest 64-byte gram by hash; equal strings have equal anchors. Of
   each anchor only a hash, its place, and a hash of its context (all strings that have this anchor) leave the task.
2. Contexts that occur twice as wholes are repeated from end to end. An anchor with several different contexts, one of
   them without a copy, sends one of each to the anchor's shard.
3. A shard (groups of about SHARD bytes together) is sorted by induced sorting; permuted common prefixes then tell which
   strings stand in two contexts. A group of more than a shard is cut into several, each sorted alike. Between these
   shards, strings that stand once in theirs, and one of each that stands more often, are compared by hashes: of what
   16 neighbouring strings have in common first, of the strings themselves where that occurs twice.
4. The repeated ranges go back to the documents.

Nulls and edge cases: a null text is empty; texts under 400 bytes lose nothing; matches never cross documents; rows are
told apart by doc_id and text (null ids by text, beside a mark that no doc_id has), and a repeated row is a copy; what
remains of a text after a cut need not be valid UTF-8 and is therefore binary; an empty table gives no rows; extra
columns are passed over, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BASE, INVERSE, byte_texts, frugal, marked, mix, powers, slices, table, written
from .substring_dedup import sliding
from .suffix_array import repeats

LENGTH, GRAM = 400, 64
SHARD = 4 << 20
#: Neighbouring strings whose common part is compared first, between shards of one group.
BLOCK = 16


class Bytes:
    """Hashes over the bytes of a block of texts."""

    def __init__(self):
        self.value = np.random.default_rng(11).integers(1, 2**64, 256, np.uint64, endpoint=False)
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, text: np.ndarray) -> None:
        n = len(text)
        if len(self.up) <= n:
            self.up, self.down = powers(BASE, n + (n >> 2)), powers(INVERSE, n + (n >> 2))
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[text] * self.up[:n], dtype=np.uint64, out=self.total[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        return mix((self.total[n:] - self.total[:-n]) * self.down[: len(self.total) - n])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return text, off - off[0]


def nearest(value: np.ndarray, pos: np.ndarray, doc: np.ndarray, reach: int, step: int) -> np.ndarray:
    """For each of some places in order the next one (step 1) or the one before (step -1) in its document whose value is smaller, or, before, no greater; out of reach: reach + 1 places away."""
    out = pos + step * (reach + 1)
    left = np.arange(len(pos))
    other = left + step
    while len(left):
        ok = (other >= 0) & (other < len(pos))
        left, other = left[ok], other[ok]
        ok = (doc[other] == doc[left]) & (np.abs(pos[other] - pos[left]) <= reach)
        left, other = left[ok], other[ok]
        stop = value[other] < value[left] if step > 0 else value[other] <= value[left]
        out[left[stop]] = pos[other[stop]]
        left, other = left[~stop], other[~stop] + step
    return out


ANCHORS = "a long, ctx long, key long, tag int, lo int, before int, n int"


def anchors(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every anchor: a (hash), ctx (hash of its context), key and tag of its document, lo (where the context begins), before (its bytes before the anchor) and n (its strings)."""
    back = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Bytes()
        for b in slices(batches, 1000, 1 << 20):
            text, off = flat(b.column(2))
            sizes = np.diff(off)
            if sizes.max(initial=0) < length:
                continue
            hashes.load(text)
            n = len(text)
            last = np.repeat(off[1:], sizes)
            at = np.arange(n)
            grams = np.where((at + gram <= last)[: n - gram + 1], hashes.grams(gram), np.uint64(2**64 - 1))
            least = np.where((at + length <= last)[: n - length + 1], sliding(grams, back + 1, np.minimum), np.uint64(0))
            edge = np.zeros(back, np.uint64)
            pos = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), back + 1, np.maximum) == grams)
            if not len(pos):
                continue
            doc = np.searchsorted(off, pos, side="right") - 1
            value = grams[pos]
            lo = np.maximum(np.maximum(off[doc], pos - back), nearest(value, pos, doc, back, -1) + 1)
            hi = np.minimum(np.minimum(pos, off[doc + 1] - length), nearest(value, pos, doc, back, 1) - 1 - back)
            ok = lo <= hi
            pos, doc, lo, hi = pos[ok], doc[ok], lo[ok], hi[ok]
            ctx = mix(hashes.runs(lo, hi + length) ^ (pos - lo).astype(np.uint64))
            key, tag = (b.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[ok].view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(key), pa.array(tag), *(pa.array(x.astype(np.int32)) for x in (lo - off[doc], pos - lo, hi - lo + 1))],
                ["a", "ctx", "key", "tag", "lo", "before", "n"],
            )

    return rows.select("key", "tag", "text").mapInArrow(frugal(run), ANCHORS)


CONTEXTS = "a long, salt int, key long, tag int, lo int, before int, single boolean, split boolean, bytes binary"


def contexts(rows: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The bytes of chosen contexts (a, salt, key, tag, lo, before, n, single, split)."""
    wanted = chosen.groupBy("key", "tag").agg(F.collect_list(F.struct("a", "salt", "lo", "before", "n", "single", "split")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200, 2 << 20):
            w = b.column(3)
            own = np.repeat(np.arange(b.num_rows), np.diff(w.offsets.to_numpy()))
            f = {name: w.flatten().field(name) for name in ("a", "salt", "lo", "before", "n", "single", "split")}
            texts = byte_texts(b.column(2))
            cut = [texts[k][i : i + n - 1 + length] for k, i, n in zip(own.tolist(), f["lo"].to_pylist(), f["n"].to_pylist(), strict=True)]
            for i in range(0, len(own), 10_000):
                part = slice(i, i + 10_000)
                own_rows = pa.array(own[part])
                columns = [f["a"], f["salt"], None, None, f["lo"], f["before"], f["single"], f["split"]]
                columns = [x.slice(i, 10_000) if x is not None else b.column(j - 2).take(own_rows) for j, x in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cut[part], pa.binary())], ["a", "salt", "key", "tag", "lo", "before", "single", "split", "bytes"])

    return rows.join(wanted, ["key", "tag"]).select("key", "tag", "text", "w").mapInArrow(frugal(run), CONTEXTS)


FOUND = "key long, tag int, lo int, before int, single boolean, s int, e int, a long, block int, core long, strings array<long>"


def shard_rows(b: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """The repeated range (s, e, in its document) of each single context of a shard; of contexts of split groups also the hashes of their strings by blocks of BLOCK distances, but of equal strings only one."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    text, off = flat(b.column(8))
    a, salt, key, tag, lo, before, single, split = (b.column(i).to_numpy(zero_copy_only=False) for i in range(8))
    group = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (salt[1:] != salt[:-1])]))
    size, left = np.diff(off), before.astype(np.int64)
    needed = None
    if split.any():
        i = np.arange(-(-(int(left.max()) + 1) // BLOCK) * BLOCK)
        needed = split[:, None] & (i <= left[:, None]) & (i >= length - (size - left)[:, None])
    least, most = repeats(text, off[:-1], size, left, group, length, needed)
    hit = np.flatnonzero((most >= 0) & single)
    if len(hit):
        s, e = (lo[hit] + left[hit] - most[hit]).astype(np.int32), (lo[hit] + left[hit] - least[hit] + length).astype(np.int32)
        none = [pa.nulls(len(hit), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[hit]) for x in (key, tag, lo, before, single)), pa.array(s), pa.array(e), *none], names)
    if needed is None:
        return
    hashes = Bytes()
    hashes.load(text)
    anchor = off[:-1] + left
    for first in range(0, len(anchor), 2000):
        own = needed[first : first + 2000].reshape(-1, needed.shape[1] // BLOCK, BLOCK)
        k, block = np.nonzero(own.any(2))
        if not len(k):
            continue
        mask = own[k, block]
        k += first
        begin = anchor[k, None] - (block[:, None] * BLOCK + np.arange(BLOCK))
        begin = np.where(mask, begin, 0)
        strings = np.where(mask, hashes.runs(begin, np.minimum(begin + length, len(text))), np.uint64(0))
        core = hashes.runs(anchor[k] - block * BLOCK, anchor[k] + length - block * BLOCK - BLOCK + 1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * BLOCK), pa.array(strings.ravel().view(np.int64), mask=~mask.ravel()))
        none = [pa.nulls(len(k), pa.int32())] * 2
        yield pa.RecordBatch.from_arrays([*(pa.array(x[k]) for x in (key, tag, lo, before, single)), *none, pa.array(a[k]), pa.array(block.astype(np.int32)), pa.array(core.view(np.int64)), lists], names)


def in_shards(parts: DataFrame, length: int, shard: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.nbytes for x in held) < shard:
                continue
            # whole groups are sorted, the last one waits for the next batch
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            a, salt = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            last = int(np.flatnonzero((a == a[-1]) & (salt == salt[-1]))[0])
            held = [rows.slice(last)]
            if last:
                yield from shard_rows(rows.slice(0, last), length)
        if held:
            yield from shard_rows(pa.Table.from_batches(held).combine_chunks().to_batches()[0], length)

    return parts.repartition("a", "salt").sortWithinPartitions("a", "salt").mapInArrow(frugal(run), FOUND)


def between_shards(blocks: DataFrame, length: int) -> DataFrame:
    """Repeated ranges (key, tag, s, e) of single contexts whose strings stand in other shards of their group."""
    place = ["a", "block", "core"]
    met = blocks.groupBy(*place).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*place)
    rows = blocks.join(met, place).select("key", "tag", "lo", "before", "single", "a", "block", F.posexplode("strings").alias("i", "h")).where("h IS NOT NULL")
    rows = rows.withColumn("i", F.col("block") * BLOCK + F.col("i"))
    again = rows.groupBy("a", "i", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a", "i", "h")
    start = F.col("lo") + F.col("before") - F.col("i")
    found = rows.join(again, ["a", "i", "h"]).where("single")
    return found.groupBy("key", "tag", "lo").agg(F.min(start).cast("int").alias("s"), (F.max(start) + length).cast("int").alias("e")).select("key", "tag", "s", "e")


def ranges(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def dedup(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every row."""
    rows = marked(documents.select("doc_id", "text"))
    found = written(anchors(rows, length, gram), "anchors")
    whole = found.groupBy("a", "ctx").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "tag", "lo", "before", "n")).alias("one"))
    several = whole.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.max("c").alias("most"), F.min("c").alias("fewest")).where("m > 1 OR most > 1")
    told = written(whole.join(several, "a").select("a", "ctx", "c", "one", "m", "fewest"), "contexts")
    size = F.greatest(F.lit(1), F.ceil(F.col("m") * (length + (length - gram) // 2) / shard)).cast("int")
    chosen = told.where("m > 1 AND fewest = 1").select("a", F.pmod("ctx", size).cast("int").alias("salt"), "one.*", (F.col("c") == 1).alias("single"), (size > 1).alias("split"))
    sorted_ = written(in_shards(contexts(rows, chosen, length), length, shard), "ranges")
    copied = found.join(told.where("c > 1").select("a", "ctx"), ["a", "ctx"]).select("key", "tag", F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + length).alias("e"))
    marks = copied.union(sorted_.where("core IS NULL").select("key", "tag", "s", "e")).union(between_shards(sorted_.where("core IS NOT NULL"), length))
    marks = marks.groupBy("key", "tag").agg(F.collect_list(F.struct("s", "e")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500, 4 << 20):
            out: list[list] = [[] for _ in range(4)]
            marks = b.column(2)
            for i, text in enumerate(byte_texts(b.column(1))):
                n, removed, spans, kept = len(text), 0, 0, text
                if marks[i].is_valid:
                    s, e = (marks[i].values.field(k).to_numpy() for k in (0, 1))
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, np.minimum(s, n), 1)
                    np.add.at(edge, np.minimum(e, n), -1)
                    s, e = ranges(np.cumsum(edge)[:n] > 0)
                    removed, spans = int((e - s).sum()), len(s)
                    kept = b"".join(text[p:q] for p, q in zip([0, *e.tolist()], [*s.tolist(), n], strict=True))
                for column, v in zip(out, (n, removed, spans, kept), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = StructType([documents.schema["doc_id"], *StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary").fields])
    return rows.join(marks, ["key", "tag"], "left").select("doc_id", "text", "marks").mapInArrow(frugal(cut), schema)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
