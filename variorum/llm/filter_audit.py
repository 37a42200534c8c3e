"""What each of five filters removes, in every order in which they may be applied.

A text's failures are five bits. A table of 32 by 120 says at which step each set of failures is first met in each order;
tasks count documents by part, label and failures, look the counts up in the table, add them by order and step with
bincount, and Spark sums these partial arrays. All other figures follow from the sums: what a filter removes as the first
of an order is all that fail it, as the last only those that fail nothing else.

The fifth filter looks for the same text under a smaller doc_id. Texts are compared by 128 bits of a hash; the smallest
doc_id of each text that stands more than once is found by a grouped minimum, which tasks reduce before they send.

Nulls and edge cases: a null text is an empty text (fails the first filter only, and the fifth, as empty texts are alike);
a null source is the part ''; a row without a doc_id is nobody's copy and makes no copies; rows that share a doc_id are
counted each and are not each other's copies; where a doc_id has several labels, one that says 1 counts; texts of any
length are read whole; an empty table gives no rows; extra columns may have any names and are passed over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, slices, table, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: The filters' limits: words at least; distinct words, capital letters and characters that count against a text.
LIMITS = {"words": 200, "distinct": 50, "capitals": 2, "symbols": "#$%&*|"}
#: Parts of which a task gathers counts before it sends them.
PARTS = 256


def first_failures(orders: list[str] = ORDERS) -> np.ndarray:
    """[failures, order]: the step (from 0) at which a document with these failures goes; the number of filters where it stays. Bit k stands for the k-th filter."""
    fails = (np.arange(1 << STEPS)[:, None, None] >> np.array([[FILTERS.index(f) for f in o] for o in orders])) & 1
    return np.where(fails.any(2), fails.argmax(2), STEPS)


def failures(text: bytes, limits: dict = LIMITS) -> int:
    """Bits of the filters that look at the text alone."""
    words = text.split()
    chars = len(text.translate(None, _CONTINUED))
    few = len(words) < limits["words"]
    poor = 100 * len(set(words)) < limits["distinct"] * len(words)
    loud = 100 * len(text.translate(None, _NOT_CAPITAL)) > limits["capitals"] * chars
    odd = re.search(b"[" + re.escape(limits["symbols"].encode()) + b"]", text) is not None
    return few | poor << 1 | loud << 2 | odd << 3


#: Bytes that continue a character, and those that are no capital letter.
_CONTINUED = bytes(range(0x80, 0xC0))
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)


def judged(documents: DataFrame, text: str = "text", part: str = "source", limits: dict = LIMITS) -> DataFrame:
    """doc_id, part, fails (bits of the first four filters) and h1, h2, a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            texts = [x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()]
            fails = pa.array([failures(t, limits) for t in texts], pa.int32())
            hashes = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fails, *(pa.array(np.ascontiguousarray(h)) for h in hashes.T)], ["doc_id", "part", "fails", "h1", "h2"])

    own = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")), F.col(text).cast("string"))
    return own.mapInArrow(frugal(run), "doc_id long, part string, fails int, h1 long, h2 long")


def failing(documents: DataFrame, labels: DataFrame, text: str = "text", part: str = "source", limits: dict = LIMITS) -> DataFrame:
    """part, fails (bits of all five filters) and label (bit 0: of quality, bit 1: toxic) of every row."""
    rows = written(judged(documents, text, part, limits), "judged")
    again = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.col("quality").cast("int").eqNullSafe(1)).cast("int") + 2 * F.max(F.col("toxic").cast("int").eqNullSafe(1)).cast("int")).alias("label"))
    told = rows.join(written(again, "repeated"), ["h1", "h2"], "left").join(written(said, "labels"), "doc_id", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return told.select("part", F.col("fails").bitwiseOR(copy * (1 << (STEPS - 1))).alias("fails"), F.coalesce("label", F.lit(0)).alias("label"))


def removals(rows: DataFrame, orders: list[str] = ORDERS) -> DataFrame:
    """part, filter_order, and for each step removed_k, good_k, toxic_k (k from 0; removed_5 are those that stay), summed over rows of `failing`."""
    first, n = first_failures(orders), len(orders)
    place = (np.arange(n)[None, :] * (STEPS + 1) + first).ravel()  # of each set of failures and order
    names = [f"{what}_{k}" for what in ("removed", "good", "toxic") for k in range(STEPS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for part, count in held.items():
                by_label = count.reshape(4, -1)
                wanted = (by_label.sum(0), by_label[1] + by_label[3], by_label[2] + by_label[3])
                # exact in float64 up to 2 ** 53 documents
                got = [np.bincount(place, np.repeat(w, n), n * (STEPS + 1)).astype(np.int64).reshape(n, -1) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([part] * n), pa.array(orders), *(pa.array(np.ascontiguousarray(x[:, k])) for x in got for k in range(STEPS + 1))], ["part", "filter_order", *names])
            held.clear()

        for b in batches:
            coded = b.column(0).dictionary_encode()
            fails, label = (b.column(i).to_numpy().astype(np.int64) for i in (1, 2))
            count = np.bincount(coded.indices.to_numpy().astype(np.int64) << 7 | label << 5 | fails, minlength=len(coded.dictionary) << 7).reshape(-1, 128)
            for part, own in zip(coded.dictionary.to_pylist(), count, strict=True):
                held[part] = held.get(part, 0) + own
            if len(held) > PARTS:
                yield from sums()
        yield from sums()

    schema = "part string, filter_order string, " + ", ".join(f"{c} long" for c in names)
    partial = rows.select("part", "fails", "label").mapInArrow(frugal(run), schema)
    return partial.groupBy("part", "filter_order").agg(*(F.sum(c).alias(c) for c in names))


def audit(documents: DataFrame, labels: DataFrame, text: str = "text", part: str = "source", limits: dict = LIMITS) -> DataFrame:
    """part, filter_order, step (from 1) and its figures, as the contract of the query names them."""
    sums = removals(failing(documents, labels, text, part, limits))
    total = sum(F.col(f"removed_{k}") for k in range(STEPS + 1))
    gone = [sum((F.col(f"removed_{j}") for j in range(k + 1)), F.lit(0)) for k in range(STEPS)]
    steps = F.array(*(
        F.struct(F.lit(k + 1).alias("step"), F.substring("filter_order", k + 1, 1).alias("filter"), (total - gone[k]).alias("kept"), F.col(f"removed_{k}").alias("removed"), F.col(f"good_{k}").alias("good_lost"), F.col(f"toxic_{k}").alias("toxic_lost"))
        for k in range(STEPS)
    ))
    each = sums.select("part", "filter_order", F.inline(steps))
    # a part has 120 rows a filter; a filter's first and last places give all that fail it, and those that fail it alone
    own = Window.partitionBy("part", "filter")
    at = lambda k: F.max(F.when(F.col("step") == k, F.col("removed"))).over(own)
    return each.select(
        "part", "filter_order", "step", "kept", "removed", (at(1) - F.col("removed")).alias("redundant"), at(STEPS).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(own).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SQL_ORDERS = " CROSS JOIN ".join(f"(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f{k}) AS t{k}" for k in range(1, 6))
OP12_SQL = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT t AS text, min(doc_id) AS first FROM d GROUP BY t),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM d JOIN least ON d.t = least.text LEFT JOIN lab ON d.doc_id = lab.id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good = 1) AS n_good, count(*) FILTER (WHERE toxic = 1) AS n_toxic FROM f GROUP BY part, fails),
o AS (SELECT f1 || f2 || f3 || f4 || f5 AS filter_order FROM {_SQL_ORDERS} WHERE len(list_distinct([f1, f2, f3, f4, f5])) = 5),
x AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before, fails, n, n_good, n_toxic
  FROM c CROSS JOIN o CROSS JOIN (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step) s),
y AS (SELECT part, filter_order, step, letter, n, n_good, n_toxic, fails, contains(fails, letter) AS hit, length(translate(fails, before, '')) < length(fails) AS earlier FROM x),
z AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT earlier), 0) AS removed, coalesce(sum(n) FILTER (WHERE hit AND earlier), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE fails = letter), 0) AS unique_fails, coalesce(sum(n_good) FILTER (WHERE hit AND NOT earlier), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (WHERE hit AND NOT earlier), 0) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM z"""
