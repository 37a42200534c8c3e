"""Quality classifier: supervised subword embeddings.

Each word and each of its character 3- and 4-grams (with word marks) has a learned vector, found by hashing; a text is
the average of them, and a softmax layer turns the average into a probability. Training is stochastic gradient descent
in numpy inside one Spark task, over a bounded sample of labelled rows. Since the layer is linear, a trained vector
enters a score only through one number; scoring therefore adds up two numbers a word, in one pass and without shuffles.

Nulls and edge cases: a null or empty text has no features and gets the score of the bias; words of any length count
whole; labels that are null or whose document is missing are left out; without any labelled row the score is 0.5;
repeated rows are scored each; extra columns are passed over.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, frugal, slices

BUCKETS = 1 << 18
DIM = 8
EPOCHS = 4
RATE = 2.0
#: Labelled rows that are used for training at most.
SAMPLE = 4000


def held_out(doc_id) -> F.Column:
    """The third of rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features(word: bytes) -> list[int]:
    w = b"<" + word + b">"
    crc = zlib.crc32
    found = [crc(w, 7) % BUCKETS]
    found += [crc(w[i : i + 3]) % BUCKETS for i in range(len(w) - 2)]
    found += [crc(w[i : i + 4]) % BUCKETS for i in range(len(w) - 3)]
    return found


def train(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """A weight for each feature (the difference of the two classes' logits) and the bias."""
    docs = []
    for text in texts:
        count: Counter[int] = Counter()
        for word, n in Counter(text.split()).items():
            for f in features(word):
                count[f] += n
        ids = np.fromiter(count.keys(), np.int64, len(count))
        n = np.fromiter(count.values(), np.float32, len(count))
        docs.append((ids, n / max(1.0, n.sum())))
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(docs)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, share = docs[i]
            hidden = share @ vectors[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= 0.1 * rate * p
            vectors[ids] -= (rate * share)[:, None] * back
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled rows of which held_out() is false, taken in the order of a hash of doc_id."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, ys = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            texts += byte_texts(b.column(1))
            ys += b.column(2).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        if ids:
            w, bias = train([texts[i] for i in order], np.array([ys[i] for i in order], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])

    got = rows.repartition(1).mapInArrow(frugal(run), "weights binary, bias double").collect()
    return Model(np.frombuffer(bytes(got[0].weights), np.float32), got[0].bias) if got else Model(np.zeros(BUCKETS), 0.0)


class Scores(dict):
    """Of a word: the sum of its features' weights (real) and their number (imaginary)."""

    LIMIT = 400_000

    def __init__(self, weights: list[float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> complex:
        if len(self) >= self.LIMIT:
            self.clear()
        weights, found = self.weights, features(word)
        z = self[word] = complex(sum([weights[f] for f in found]), len(found))
        return z


def scores(texts: list[bytes], words: Scores, bias: float) -> np.ndarray:
    z = np.array([sum(map(words.__getitem__, t.split()), 0j) for t in texts], np.complex128)
    return 1 / (1 + np.exp(-np.clip(z.real / np.maximum(z.imag, 1) + bias, -500, 500)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; one pass, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = Scores(m.weights.tolist())
        for b in slices(batches, 2000):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(byte_texts(b.column(1)), words, m.bias))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, score double")


def filter_rows(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows with a score of at least `least`, all columns as they are; one pass, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = Scores(m.weights.tolist())
        for b in slices(batches, 2000):
            yield b.filter(pa.array(scores(byte_texts(b.column(at)), words, m.bias) >= least))

    return documents.mapInArrow(frugal(run), documents.schema)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    from .common import table

    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
