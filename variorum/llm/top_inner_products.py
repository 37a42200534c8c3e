"""Exact search for the greatest inner products of integer vectors.

All vectors are turned by the eigenvectors of their sum of squares (the right singular vectors of the table), so that few
leading coordinates carry most of a product; lengths and products stay. They are sorted by descending length and packed
in blocks of bounded size, as are the queries. Every block of queries first meets the block of the longest vectors, which
gives each query a score that its twentieth best reaches at least. Then it meets all other blocks whose greatest length
can still reach that score; within a pair of blocks, vectors go by in descending length: partial products of the leading
coordinates plus the product of the lengths of what is left (Cauchy-Schwarz) bound a score, and only what can reach the
running threshold is computed further and, in the end, exactly on the integers.

Pairs of blocks are rows of a shuffle, so a task holds one block of either side, and no side is sent whole to a task or
the driver; the driver sees one matrix of dimension by dimension.

Nulls and edge cases: vectors that are null or hold null or non-finite components take no part; a row never meets itself,
but its copies (rows with the same id too) are candidates as any others; repeated rows are kept once with their number;
a query row that stands twice has its results twice; a row without an id is no query and comes last among ties; only
vectors of one dimension are compared; a score beyond 64 bits is an error, as no long can hold it; an empty table gives no
rows; extra columns may have any names and are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, slices, table, written

SCALE, EVERY, K = 64, 20, 20
#: Vectors in a block of candidates and of queries; candidates that are compared at a time; bytes of a block at most.
BLOCK, QUERIES, STEP, BYTES = 8192, 2048, 2048, 64 << 20
#: Query blocks that a block of candidates meets in one task, about.
SHARE = 16
LOWEST = np.iinfo(np.int64).min
#: Dimension up to which vectors are turned, and the parts of the coordinates after which products are bounded.
TURNED, PARTS = 1024, (0.25, 0.5)
#: Share of a step's pairs up to which survivors are computed one by one.
SPARSE = 0.05


def integers(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """key, dim, norm, v (the integer components, as little-endian doubles) and copies: how many rows are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 10_000):
            lists = b.column(1)
            flat = lists.flatten()
            x = np.floor(scale * flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(size)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = (bad[edge[1:]] == bad[edge[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
            x = x + 0.0  # no negative zero
            for d in np.unique(size[good]).tolist():
                rows = np.flatnonzero(good & (size == d))
                own = x[edge[rows][:, None] + np.arange(d)]
                norm = np.linalg.norm(own, axis=1)
                if not np.isfinite(norm).all():
                    raise OverflowError("a vector whose scores no long can hold")
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32)), pa.array(norm), pa.array([v.tobytes() for v in own], pa.binary())], ["key", "dim", "norm", "v"])

    own = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("x"))
    rows = own.mapInArrow(frugal(run), "key long, dim int, norm double, v binary")
    return rows.groupBy("key", "dim", "v").agg(F.min("norm").alias("norm"), F.count(F.lit(1)).alias("copies"))


def turns(rows: DataFrame) -> dict[int, np.ndarray]:
    """For every dimension up to TURNED the matrix whose columns are the eigenvectors of the vectors' sum of squares, greatest first. Tasks sum, then few tasks sum what these sent."""

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                v = np.frombuffer(b"".join(b.column(1).filter(pa.array(dims == d)).to_pylist()), "<f8").reshape(-1, d)
                held[d] = held.get(d, 0.0) + v.T @ v
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([m.tobytes() for m in held.values()], pa.binary())], ["dim", "m"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[d] = held.get(d, 0.0) + np.frombuffer(m, "<f8").reshape(d, d)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([m.tobytes() for m in held.values()], pa.binary())], ["dim", "m"])

    part = written(rows.where(F.col("dim").between(1, TURNED)).select("dim", "v").mapInArrow(squares, "dim int, m binary"), "squares")
    total: dict[int, np.ndarray] = {}
    for r in part.repartition(8).mapInArrow(added, "dim int, m binary").toLocalIterator():
        total[r.dim] = total.get(r.dim, 0.0) + np.frombuffer(bytes(r.m), "<f8").reshape(r.dim, r.dim)
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in total.items() if np.isfinite(m).all()}


class Block:
    """Vectors of one dimension in descending length, unpacked: exact integers, turned coordinates, and for each part of the coordinates the length of what is left."""

    def __init__(self, dim: int, keys: bytes, known: bytes, copies: bytes, kind: str, v: bytes, turn: np.ndarray | None):
        self.keys, self.known, self.copies = np.frombuffer(keys, np.int64), np.frombuffer(known, bool), np.frombuffer(copies, np.int64)
        self.exact = np.frombuffer(v, kind).reshape(len(self.keys), dim).astype(np.float64)
        self.turned = self.exact @ turn if turn is not None else self.exact
        self.norm = np.linalg.norm(self.exact, axis=1)
        self.parts = sorted({max(1, round(p * dim)) for p in PARTS}) if dim > 1 else []
        self.left = [np.linalg.norm(self.turned[:, p:], axis=1) for p in self.parts]


def exact_scores(q: np.ndarray, c: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of integers that stand in doubles; most: of a product of lengths."""
    if most < 2.0**53:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    got = [sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for a, b in zip(q.tolist(), c.tolist(), strict=True)]
    return np.array(got, np.int64)  # beyond 64 bits: OverflowError


def best(q: Block, c: Block, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query (its place), candidate (its place) and score of the k best candidates of each query that reach floor, and for each query the score that its k-th best reaches at least. More come where copies of one vector count more than once."""
    need = floor.copy()
    rows = [np.zeros(0, np.int64)] * 3
    for i in range(0, len(c.keys), STEP):
        j = min(i + STEP, len(c.keys))
        length = c.norm[i:j]
        # rounding of a product of these lengths, generously
        slack = 1e-12 * q.exact.shape[1] * (q.norm * length[0] + 1)
        open_ = np.flatnonzero(q.norm * length[0] + slack >= need)
        if not len(open_):
            break  # lengths only fall from here
        first = c.parts[0] if c.parts else q.exact.shape[1]
        bound = q.turned[open_, :first] @ c.turned[i:j, :first].T
        if c.parts:
            bound += q.left[0][open_, None] * c.left[0][i:j]
        at, to = np.nonzero(bound + slack[open_, None] >= need[open_, None])
        del bound
        most = float(q.norm.max() * length[0])
        if len(at) > SPARSE * len(open_) * (j - i) and most < 2.0**53:
            full = (q.exact[open_] @ c.exact[i:j].T).astype(np.int64)
            if j - i >= k:
                need[open_] = np.maximum(need[open_], np.partition(full, j - i - k, axis=1)[:, j - i - k])
            at, to = np.nonzero(full >= need[open_, None])
            score = full[at, to]
            at, to = open_[at], to + i
        else:
            at, to = open_[at], to + i
            done = first
            total = np.einsum("ij,ij->i", q.turned[at, :done], c.turned[to, :done])
            for p, ql, cl in zip(c.parts[1:], q.left[1:], c.left[1:], strict=True):
                total += np.einsum("ij,ij->i", q.turned[at, done:p], c.turned[to, done:p])
                stay = total + ql[at] * cl[to] + slack[at] >= need[at]
                at, to, total, done = at[stay], to[stay], total[stay], p
            score = exact_scores(q.exact[at], c.exact[to], most)
            stay = score >= need[at]
            at, to, score = at[stay], to[stay], score[stay]
        rows = [np.concatenate(x) for x in zip(rows, (at, to, score), strict=True)]
        order = np.lexsort((c.keys[rows[1]], ~c.known[rows[1]], -rows[2], rows[0]))
        rows = [x[order] for x in rows]
        begin = np.searchsorted(rows[0], np.arange(len(q.keys)))
        place = np.arange(len(rows[0])) - begin[rows[0]]
        stay = place < k
        rows, place = [x[stay] for x in rows], place[stay]
        last = place == k - 1
        need[rows[0][last]] = np.maximum(need[rows[0][last]], rows[2][last])
    return *rows, need


_PACKED = "block long, dim int, longest double, keys binary, known binary, copies binary, kind string, v binary"


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of at most so many vectors of one dimension, in descending length within each dimension; block: numbers them, smaller for longer vectors as far as tasks go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        weight = 0

        def block() -> pa.RecordBatch:
            key, dim, norm, copies, v = zip(*held, strict=True)
            ints = np.array([0 if x is None else x for x in key], np.int64)
            all_ = np.frombuffer(b"".join(v), "<f8")
            kind = "<i2" if not len(all_) or np.abs(all_).max() < 1 << 15 else "<f8"
            values = [number, dim[0], max(norm), ints.tobytes(), np.array([x is not None for x in key], bool).tobytes(), np.array(copies, np.int64).tobytes(), kind, all_.astype(kind).tobytes()]
            types = [pa.int64(), pa.int32(), pa.float64(), *[pa.binary()] * 3, pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], ["block", "dim", "longest", "keys", "known", "copies", "kind", "v"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) >= size or held[0][1] != r[1] or weight + len(r[4]) > BYTES):
                    yield block()
                    number, held, weight = number + 1, [], 0
                held.append(r)
                weight += len(r[4])
        if held:
            yield block()

    spark = rows.sparkSession
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // size)))
    order = [F.col("dim"), F.desc("norm"), F.xxhash64("key", "v")]
    dealt = rows.select("key", "dim", "norm", "copies", "v").repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(frugal(run), _PACKED), name)


def met(meet: DataFrame, asked: DataFrame, given: DataFrame, parts: int) -> DataFrame:
    """Rows of asked beside rows of given for all (q_block, block) of meet. A block of candidates goes to `parts` tasks, each with its share of the query blocks, so none meets all of them in one task."""
    part = F.pmod(F.hash("q_block"), F.lit(parts)).alias("part")
    left = meet.join(asked, "q_block").withColumn("part", part)
    right = given.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, ["block", "part"]).drop("part")


def search(queries: DataFrame, candidates: DataFrame, k: int = K, sizes: tuple[int, int] = (QUERIES, BLOCK)) -> DataFrame:
    """query_id, rank, vec_id, score of rows of `integers`; queries are rows among the candidates."""
    shared = candidates.sparkSession.sparkContext.broadcast(turns(candidates))
    asked, given = packed(queries, sizes[0], "query-blocks"), packed(candidates, sizes[1], "vector-blocks")
    q = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns))
    parts = -(-max(1, asked.count()) // SHARE)
    schema = "q_block long, nth long, q_copies long, query_id long, own long, vec_id long, copies long, score long, need long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            r = b.to_pylist()[0]
            turn = shared.value.get(r["dim"])
            left, right = (Block(r["dim"], *(r[f"{side}{c}"] for c in ("keys", "known", "copies", "kind", "v")), turn) for side in ("q_", ""))
            floor = np.frombuffer(r["need"], np.int64) if r["need"] else np.full(len(left.keys), LOWEST)
            at, to, score, need = best(left, right, k + 1, floor)
            own = exact_scores(left.exact, left.exact, float(left.norm.max()) ** 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), r["q_block"])), *(pa.array(x) for x in (at, left.copies[at], left.keys[at], own[at])),
                    pa.array(right.keys[to], mask=~right.known[to]), pa.array(right.copies[to]), pa.array(score), pa.array(need[at]),
                ],
                ["q_block", "nth", "q_copies", "query_id", "own", "vec_id", "copies", "score", "need"],
            )

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            r = b.to_pylist()[0]
            turn = None
            left = Block(r["q_dim"], r["q_keys"], r["q_known"], r["q_copies"], r["q_kind"], r["q_v"], turn)
            need = np.full(len(left.keys), LOWEST)
            for x in r["got"] or []:
                need[x["nth"]] = x["need"]
            # the least length of a vector that some query can still use
            reach = 0.0 if (need <= 0).any() else float(np.min(need / left.norm) * (1 - 1e-9))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((r["q_block"], pa.int64()), (need.tobytes(), pa.binary()), (reach, pa.float64()))], ["q_block", "need", "reach"])

    # the longest vectors of each dimension first: a threshold for every query
    head = given.groupBy("dim").agg(F.min("block").alias("block"))
    start = q.join(F.broadcast(head), q.q_dim == head.dim).select("q_block", "block")
    first = met(start, q.withColumn("need", F.lit(None).cast("binary")), given.join(F.broadcast(head), ["dim", "block"], "left_semi"), parts)
    first = written(first.mapInArrow(frugal(run), schema), "first-scores")
    got = first.groupBy("q_block", "nth").agg(F.max("need").alias("need")).groupBy("q_block").agg(F.collect_list(F.struct("nth", "need")).alias("got"))  # QUERIES in a block at most
    reach = q.join(got, "q_block", "left").select(*q.columns, "got").mapInArrow(frugal(reaches), "q_block long, need binary, reach double")
    told = written(q.join(reach, "q_block"), "thresholds")
    # which blocks meet is said by rows without vectors
    others = given.join(F.broadcast(head), ["dim", "block"], "left_anti")
    sides = told.select("q_block", "q_dim", "reach"), others.select("block", "dim", "longest")
    meet = written(sides[0].join(sides[1], (F.col("q_dim") == F.col("dim")) & (F.col("longest") >= F.col("reach"))).select("q_block", "block"), "meetings")
    rest = written(met(meet, told.drop("reach"), others, parts).mapInArrow(frugal(run), schema), "scores")

    # copies of a vector count each; the query's own row goes once
    every = first.union(rest)
    w = Window.partitionBy("q_block", "nth").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    own = F.col("vec_id").eqNullSafe(F.col("query_id")) & (F.col("score") == F.col("own"))
    near = every.groupBy("q_block", "nth", "q_copies", "query_id", "own", "vec_id", "score").agg(F.sum("copies").alias("copies"))
    near = near.withColumn("copies", F.col("copies") - own.cast("int")).where("copies > 0")
    before = F.coalesce(F.sum("copies").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = near.withColumn("before", before).where(F.col("before") < k)
    ranks = F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k))))
    once = near.select("query_id", ranks.alias("rank"), "vec_id", "score", "q_copies").withColumn("rank", F.col("rank").cast("int"))
    return once.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "q_copies"))).select("query_id", "rank", "vec_id", "score")


def top(vectors: DataFrame, k: int = K, every: int = EVERY, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE, sizes: tuple[int, int] = (QUERIES, BLOCK)) -> DataFrame:
    """The k greatest inner products of each row whose key is divisible by `every` with all other rows."""
    rows = written(integers(vectors, vector, key, scale), "integer-vectors")
    return search(rows.where(F.col("key") % every == 0), rows, k, sizes)


def op13_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(table(spark, sf_dir, "embeddings"))


OP13_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
