"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words, over all documents.
2. A randomised SVD of the TF-IDF passages of the benchmark and of all documents: two products with a thin matrix, each
   computed by the tasks that hold the passages and added up chunk by chunk.
3. Every document is cut into overlapping passages at three scales (16, 32 and 64 words); their latent vectors are
   sums of word vectors. Passages whose cosine with a benchmark part of that scale reaches COSINE are candidates, and so
   are those that have a run of SHORT words of an item.
4. Candidates are checked on the words themselves: first the number of words shared with the item, which bounds the
   longest common subsequence from above, then the subsequence itself, then that of the item's answer (its last
   quarter). A document leaks an item if the subsequence covers STRICT of the item, or LOOSE of it and ANSWER of the
   answer: a paraphrase that keeps the answer.

Words are lower-cased runs without white space and ASCII punctuation. One pass over the corpus takes BLOCKS blocks of at
most BLOCK items. Leading directions of the decomposition, which tell languages rather than passages, weigh less.

Nulls and edge cases: null and empty texts match nothing; an item without an item_id is searched as any other, its rows
have a null item_id; items of 1 to 11 words, too short for latent vectors, are also found word for word by the hashes of
their runs (so an item of one word is in every text with that word); texts and items of any length count whole (long
items in parts of 48 words); of ties between passages the best share counts; rows repeat in the result only if their (doc_id, item_id) pairs do not (repeated rows of a
document give one row a pair); an empty benchmark or corpus gives no rows; extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WHITE, WordHashes, frugal, slices, table
from .substring_dedup import Rolling

FEATURES = 1 << 15
RANK = 64
#: Leading directions tell languages and frequent words more than passages; in a cosine they count for a part of their length.
COMMON, WEIGHT = 16, 0.2
#: What all items together weigh in the decomposition against all documents: so do its directions tell their words, too.
BENCHMARK = 0.03
#: Passages that are multiplied at once, and features of a chunk of sums.
GROUP, CHUNK = 16, 2048
#: Tasks of a product, at least and for each core: each hands over a matrix, so their number is not that of the files.
TASKS, PER_CORE = 32, 4
#: Items that are compared at once, and how many such blocks go through the corpus in one pass.
BLOCK, BLOCKS = 500, 20
#: Items of fewer than SHORT words are found word for word too.
SHORT = 12
COSINE, STRICT, LOOSE, ANSWER = 0.6, 0.75, 0.5, 0.8
STEP = 8
SCALES = (16, 32, 64)
PART = 48
GAPS = WHITE + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def hasher() -> WordHashes:
    return WordHashes(GAPS, lower=True)


def feature(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(FEATURES - 1)).astype(np.int64)


def document_frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """idf of each feature, over all documents, and the number of their passages; at most FEATURES numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, n, docs, parts = hasher(), np.zeros(FEATURES, np.int64), 0, 0
        for b in slices(batches, 1000, 1 << 20):
            h, at = hashes(b.column(0))
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            pairs = np.unique(doc * FEATURES + feature(h))
            n += np.bincount(pairs % FEATURES, minlength=FEATURES)
            docs += b.num_rows
            parts += int((-(-np.diff(at) // PART)).sum())
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(n[some], [docs, parts]))], ["f", "n"])

    rows = documents.select("text").mapInArrow(frugal(count), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    total = int(rows.n[rows.f == -1].sum())
    df = np.zeros(FEATURES)
    some = rows[rows.f >= 0]
    df[some.f.to_numpy(np.int64)] = some.n
    return (np.log((1 + total) / (1 + df)) ** 2).astype(np.float32), int(rows.n[rows.f == -2].sum())


def add_product(h: np.ndarray, at: np.ndarray, weight: np.ndarray, idf: np.ndarray, right: np.ndarray, out: np.ndarray) -> None:
    """Adds A'A right to out, with A the TF-IDF passages of PART words at most of a block of texts, rows whose squared length is their text's weight. GROUP passages at a time are a matrix over the features that stand in them."""
    n = np.diff(at)
    per = -(-n // PART)
    first = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(n)), n)
    which = first[doc] + (np.arange(len(h)) - at[doc]) // PART
    key = (which // GROUP * FEATURES + feature(h)) * GROUP + which % GROUP
    key = np.sort(key.astype(np.uint32) if first[-1] + GROUP < (1 << 32) // FEATURES else key)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    cell = key[begin].astype(np.int64)
    column, row = cell // GROUP, cell % GROUP
    group, f = column // FEATURES, column % FEATURES
    w = np.diff(begin, append=len(key)) * idf[f]
    norm = np.sqrt(np.bincount(group * GROUP + row, w * w, first[-1]))
    length = np.sqrt(np.repeat(weight, per)) / np.maximum(norm, 1e-9)
    w = (w * length[group * GROUP + row]).astype(np.float32)
    new = np.concatenate([[True], column[1:] != column[:-1]])
    nth, own = np.cumsum(new) - 1, f[new]
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        x, y = nth[i], nth[j - 1] + 1
        a = np.zeros((GROUP, y - x), np.float32)
        a[row[i:j], nth[i:j] - x] = w[i:j]
        out[own[x:y]] += a.T @ (a @ right[own[x:y]])


def product(texts: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'A right, with A the TF-IDF passages of all texts (text, weight). A task adds up what its texts give; the sums of the tasks are added by chunks of features."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((idf, right.astype(np.float32)))
    k = right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, right = shared.value
        hashes, out = hasher(), np.zeros((FEATURES, k), np.float32)
        for b in slices(batches, 200, 1 << 20):
            h, at = hashes(b.column(0))
            if len(h):
                add_product(h, at, b.column(1).to_numpy(), idf, right, out)
        for i in range(0, FEATURES, CHUNK):
            some = np.flatnonzero(out[i : i + CHUNK].any(1))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([some.astype(np.uint16).tobytes()], pa.binary()), pa.array([out[i + some].tobytes()], pa.binary())], ["i", "at", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, at, m in zip(*b.columns, strict=True):
                own = total.setdefault(i.as_py(), np.zeros((CHUNK, k), np.float32))
                own[np.frombuffer(at.as_py(), np.uint16)] += np.frombuffer(m.as_py(), np.float32).reshape(-1, k)
        for i, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["i", "m"])

    out = np.zeros((FEATURES, k), np.float32)
    for r in texts.mapInArrow(frugal(run), "i int, at binary, m binary").repartition("i").mapInArrow(add, "i int, m binary").toLocalIterator():
        out[r.i : r.i + CHUNK] = np.frombuffer(bytes(r.m), np.float32).reshape(-1, k)
    shared.destroy()  # each worker has it as a file
    return out


def word_vectors(texts: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """A latent vector for each feature, idf included, from the leading right singular vectors of the passages of all texts; after them, zero. Two products: the second one's directions and values come from q and A'A q (Nystroem)."""
    q = np.random.default_rng(seed).standard_normal((FEATURES, rank)).astype(np.float32)
    q = np.linalg.qr(product(texts, idf, q).astype(np.float64))[0]
    both = product(texts, idf, q).astype(np.float64)
    value, turn = np.linalg.eigh((q.T @ both + both.T @ q) / 2)
    some = value > 1e-6 * max(value[-1], 1e-9)
    vectors = np.zeros((FEATURES + 1, rank), np.float32)
    if some.any():
        own = np.linalg.svd(both @ (turn[:, some] / np.sqrt(value[some])), full_matrices=False)[0]
        vectors[:-1, : own.shape[1]] = own * idf[:, None]
    vectors[:, :COMMON] *= WEIGHT
    return vectors


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one machine word operation a row of bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Items:
    """A block of the benchmark: words, parts by scale and their latent vectors."""

    def __init__(self, ids: list[int], texts: list[str], vectors: np.ndarray):
        h, at = hasher()(pa.array(texts, pa.string()))
        self.ids, self.words = ids, [h[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        parts: dict[int, list] = {s: [] for s in SCALES}
        for k, w in enumerate(self.words):
            n = max(1, round(len(w) / PART)) if len(w) > 64 else 1
            for piece in np.array_split(w, n):
                if len(piece):
                    v = vectors[feature(piece)].sum(0)
                    scale = min(SCALES, key=lambda s: abs(np.log(s / len(piece))))
                    parts[scale].append((k, v / max(1e-9, float(np.linalg.norm(v)))))
        self.parts = {s: (np.array([k for k, _ in x]), np.array([v for _, v in x], np.float32)) for s, x in parts.items() if x}
        self.short = {}
        for n in range(1, SHORT):
            which = np.array([k for k, w in enumerate(self.words) if len(w) == n], np.int64)
            if len(which):
                self.short[n] = which, np.concatenate([Rolling()(self.words[k], n) for k in which.tolist()])
        rows = [(Rolling()(w, SHORT)[::SHORT], k) for k, w in enumerate(self.words) if len(w) >= SHORT]
        run = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in rows)])
        order = np.argsort(run, kind="stable")
        self.run, self.run_of = run[order], np.repeat([k for _, k in rows], [len(x) for x, _ in rows]).astype(np.int64)[order]
        self.sets = [np.unique(w) for w in self.words]
        self.lists = [w.tolist() for w in self.words]
        self.sizes, self.distinct = (np.array([len(w) for w in x], np.int64) for x in (self.words, self.sets))
        self.vocabulary = np.unique(np.concatenate([np.zeros(1, np.uint64), *self.sets]))
        self.has = np.zeros((len(ids), len(self.vocabulary)), bool)
        for k, w in enumerate(self.sets):
            self.has[k, np.searchsorted(self.vocabulary, w)] = True


class Totals:
    """Sums of word vectors over a block of documents, at each STEP words of each document."""

    def __init__(self, h: np.ndarray, at: np.ndarray, vectors: np.ndarray):
        self.at = at
        self.blocks = blocks = -(-np.diff(at) // STEP)
        self.first = first = np.concatenate([[0], np.cumsum(blocks)])
        self.doc = doc = np.repeat(np.arange(len(blocks)), blocks)
        self.start = start = at[doc] + (np.arange(len(doc)) - first[doc]) * STEP
        words = np.append(feature(h), FEATURES)  # the last vector is zero
        end = at[doc + 1]
        sums = vectors[words[start]]
        for k in range(1, STEP):
            sums += vectors[words[np.where(start + k < end, start + k, len(h))]]
        self.total = np.zeros((len(doc) + 1, vectors.shape[1]), np.float32)
        np.cumsum(sums, 0, out=self.total[1:])


def passages_like(t: Totals, items: Items, cosine: float) -> np.ndarray:
    """Rows (document, item, first word, words) of passages near a part of an item."""
    at, blocks, first, doc, start, total = t.at, t.blocks, t.first, t.doc, t.start, t.total
    found = []
    for scale, (which, v) in items.parts.items():
        k = scale // STEP
        stride = max(1, k // 2)
        i = np.flatnonzero(((np.arange(len(doc)) - first[doc]) % stride == 0) & ((np.arange(len(doc)) + k <= first[doc + 1]) | (np.arange(len(doc)) == first[doc])))
        j = np.minimum(i + k, first[doc[i] + 1])
        # the last passage of a document ends with it
        tail = np.flatnonzero(blocks > k)
        i, j = np.concatenate([i, first[tail + 1] - k]), np.concatenate([j, first[tail + 1]])
        w = total[j] - total[i]
        least = cosine * np.maximum(np.sqrt(np.einsum("ij,ij->i", w, w)), 1e-9)
        for part in range(0, len(v), 128):
            p, q = np.nonzero(w @ v[part : part + 128].T >= least[:, None])
            if len(p):
                a, b = start[i[p]], np.minimum(start[i[p]] + scale, at[doc[i[p]] + 1])
                found.append(np.stack([doc[i[p]], which[q + part], a, b - a], 1))
    return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def verbatim(h: np.ndarray, at: np.ndarray, items: Items, roll: Rolling) -> list[tuple[int, int]]:
    """(document, item) of the short items that stand in a document word for word."""
    out: set[tuple[int, int]] = set()
    for n, (which, runs) in items.short.items():
        if len(h) < n:
            continue
        own = roll(h, n)
        start = np.flatnonzero(np.isin(own, runs))
        doc = np.searchsorted(at, start, side="right") - 1
        ok = start + n <= at[doc + 1]
        name, code = np.unique(runs, return_inverse=True)
        each = np.unique(doc[ok] * len(name) + np.searchsorted(name, own[start[ok]]))  # a run counts once a document
        for d, run in zip((each // len(name)).tolist(), (each % len(name)).tolist(), strict=True):
            out.update((d, int(i)) for i in which[code == run])
    return sorted(out)


def sharing_runs(h: np.ndarray, at: np.ndarray, items: Items, roll: Rolling) -> np.ndarray:
    """Rows (document, item, first word, words) of the runs of SHORT words that stand in a longer item, at every SHORT words of it."""
    if len(h) < SHORT or not len(items.run):
        return np.zeros((0, 4), np.int64)
    own = roll(h, SHORT)
    start = np.flatnonzero(items.run[np.minimum(np.searchsorted(items.run, own), len(items.run) - 1)] == own)
    doc = np.searchsorted(at, start, side="right") - 1
    ok = start + SHORT <= at[doc + 1]
    start, doc = start[ok], doc[ok]
    lo, hi = (np.searchsorted(items.run, own[start], side=side) for side in ("left", "right"))
    which = np.repeat(np.arange(len(start)), hi - lo)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    return np.stack([doc[which], items.run_of[lo[which] + nth], start[which], np.full(len(which), SHORT)], 1)


def shared_words(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """How many distinct words of an item stand in h[lo:hi]."""
    at = np.minimum(np.searchsorted(items.vocabulary, h), len(items.vocabulary) - 1)
    place = np.flatnonzero(items.vocabulary[at] == h)
    word = at[place]
    lo, hi = np.searchsorted(place, lo), np.searchsorted(place, hi)
    out = np.zeros(len(lo), np.int64)
    for i in range(0, len(lo), 4096):
        n = hi[i : i + 4096] - lo[i : i + 4096]
        which = np.repeat(np.arange(len(n)), n)
        w = word[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[i : i + 4096], n)]
        own = items.has[np.repeat(item[i : i + 4096], n), w]
        pairs = np.unique(which[own] * len(items.vocabulary) + w[own])
        out[i : i + 4096] = np.bincount(pairs // len(items.vocabulary), minlength=len(n))
    return out


def judge(h: np.ndarray, at: np.ndarray, near: np.ndarray, items: Items) -> dict:
    """(document, item) to the best (share of the item, share of its answer) among its passages, where they leak."""
    out: dict = {}
    if not len(near):
        return out
    d, k, a, n = near.T
    m = items.sizes[k]
    spans = np.unique(np.stack([d, k, np.maximum(at[d], a - m), np.minimum(at[d + 1], a + n + m)], 1), axis=0)
    d, k, lo, hi = spans.T
    spans = spans[shared_words(h, lo, hi, k, items) >= LOOSE * 0.8 * items.distinct[k]]
    for d, k, lo, hi in spans.tolist():
        whole = items.lists[k]
        words = h[lo:hi][np.isin(h[lo:hi], items.sets[k])].tolist()
        share = lcs(whole, words) / len(whole)
        if share >= LOOSE:
            answer = whole[-max(1, len(whole) // 4) :]
            ok = lcs(answer, words) / len(answer)
            if share >= STRICT or ok >= ANSWER:
                out[d, k] = max(out.get((d, k), (0.0, 0.0)), (share, ok))
    return out


def find_leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, item_id (null for items without one), share and answer_share of each document that holds a benchmark item, or a paraphrase of it; with another key, that column in the place of doc_id."""
    spark = documents.sparkSession
    schema = StructType([documents.schema[key], *StructType().add("item_id", "long").add("share", "double").add("answer_share", "double").fields])
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    idf, parts = document_frequencies(documents)
    n = items.count()
    weight = max(1.0, BENCHMARK * parts / max(1, n))
    tasks = max(TASKS, PER_CORE * spark.sparkContext.defaultParallelism)
    weighed = documents.select("text", F.lit(1.0).alias("weight")).union(items.select("text", F.lit(weight).alias("weight")))
    vectors = word_vectors(weighed.coalesce(tasks), idf)
    passes = max(1, -(-n // (BLOCK * BLOCKS)))
    out = None
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        if not own:
            continue
        blocks = [Items([r.item_id for r in part], [r.text for r in part], vectors) for part in (own[i : i + BLOCK] for i in range(0, len(own), BLOCK))]
        shared = spark.sparkContext.broadcast((blocks, vectors))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks, vectors = shared.value
            hashes, roll = hasher(), Rolling()
            for b in slices(batches, 200, 1 << 20):
                h, at = hashes(b.column(1))
                if not len(h):
                    continue
                totals = Totals(h, at, vectors)
                for items in blocks:
                    got = judge(h, at, np.concatenate([passages_like(totals, items, COSINE), sharing_runs(h, at, items, roll)]), items)
                    for d, i in verbatim(h, at, items, roll):
                        got[d, i] = (1.0, 1.0)
                    if got:
                        doc = pa.array([d for d, _ in got])
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(doc), pa.array([items.ids[i] for _, i in got], pa.int64()), pa.array([s for s, _ in got.values()]), pa.array([a for _, a in got.values()])],
                            schema.names,
                        )

        part = documents.select(key, "text").mapInArrow(frugal(search), schema)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy(key, "item_id").agg(F.max("share").alias("share"), F.max("answer_share").alias("answer_share"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
