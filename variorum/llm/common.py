"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of bytes that are no ASCII white space. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: of the session, else of its context. One is made only where neither names one and there is one machine."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and context._jsc.sc().getCheckpointDir().isDefined():
        path = context._jsc.sc().getCheckpointDir().get()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: lineage is cut, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch on its way to Python. Spark's own limit lets 10,000 texts through at once: 33 MB on either side, and twice that while its buffer grows.
BATCH = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df; from now on its session cuts Arrow batches at BATCH bytes, unless it has a smaller limit. The limit counts when a plan runs, so it stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"(-?\d+)([kmgt]?)b?", conf.get(name).lower())
    size = int(found[1]) << 10 * " kmgt".index(found[2] or " ") if found else 0
    if not 0 < size <= BATCH:
        conf.set(name, str(BATCH))
    return df


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted); beyond that Spark shuffles it as usual. df should be written."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def marked(documents: DataFrame) -> DataFrame:
    """documents with what names a row for its own marks: key (doc_id, or where there is none a hash of the text) and tag (another hash of the text, and whether there is a doc_id), so that no two texts share marks."""
    return documents.withColumns({"key": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), "tag": F.hash("text", F.col("doc_id").isNull())})


def row_key() -> Column:
    """struct(stand_in, key): what names a document, its doc_id or, flagged by stand_in, a hash of its text where it has none."""
    return F.struct(F.col("doc_id").isNull().alias("stand_in"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"))


BASE = 0x9E3779B97F4A7C15
LONG = 512
INVERSE = pow(BASE, -1, 1 << 64)
WHITE = bytes([0x20, *range(0x09, 0x0E)])


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHashes:
    """64-bit hashes of the words of whole blocks of texts: sums over the bytes of an Arrow buffer, without a Python object a word."""

    def __init__(self, gaps: bytes = WHITE, lower: bool = False):
        self.gap = np.zeros(256, bool)
        self.gap[list(gaps)] = True
        self.value = np.random.default_rng(7).integers(1, 2**64, 256, np.uint64, endpoint=False)
        self.lower = lower
        if lower:
            self.value[65:91] = self.value[97:123]
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, text after text, and where each text's begin (one more offset than texts). Null: no words."""
        column = column.cast(pa.binary()).fill_null(b"")
        if not len(column):
            return np.zeros(0, np.uint64), np.zeros(1, np.int64)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        text = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
        off -= off[0]
        n = len(text)
        if len(self.up) <= n:
            self.up, self.down = powers(BASE, n + (n >> 2)), powers(INVERSE, n + (n >> 2))
        inside = ~self.gap[text]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        after = np.zeros(n + 1, bool)
        after[:-1] = inside
        starts = np.flatnonzero(after & (~before | edge))
        ends = np.flatnonzero(before & (~after | edge))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[text] * self.up[:n], dtype=np.uint64, out=total[1:])
        found = mix((total[ends] - total[starts]) * self.down[starts])
        for i in np.flatnonzero(ends - starts >= LONG).tolist():  # such sums can be made to agree for words of 1,024 bytes
            word = text[starts[i] : ends[i]].tobytes()
            found[i] = int.from_bytes(hashlib.blake2b(word.lower() if self.lower else word, digest_size=8).digest())
        return found, np.searchsorted(starts, off)


def frugal(run: Callable) -> Callable:
    """A function for mapInArrow that hands a task's memory back when the task ends: workers are used again, and what they keep adds up."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()  # what is there already, modules for the most part, need not be looked through below
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # a C library without it
            pass

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one holds at most so many rows, and few more bytes than size unless one row does."""
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(rows, size // per_row))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
