"""Sentences of two editions in blocks of several to several.

A block takes up to eight sentences of either side: those whose likeness, less what unequal numbers cost and with what a
like pair behind the block is worth, is greatest. Texts are cut and cleaned by expressions; a task chooses the
numbers and gives each block its sentences. It steps through many pairs at once, so that one call of the alignment kernel serves them all, and
leaves out what the longest common subsequences of its texts keep from the best score; what may score most is compared first.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import text as T
from .align import matching_blocks, popular

#: The sentences of a block's side, what equal numbers are worth and unequal ones cost, what a block of like
#: sentences gains by its size, from which likeness on, what the pair behind it adds, from which likeness on, and the
#: likeness below which texts differ.
MOST, EVEN, UNEVEN, LARGER, LIKE, BEHIND, LIKE_BEHIND, SAME = 8, 0.05, 0.03, 0.01, 0.9, 0.1, 0.8, 0.95
#: Pairs of texts that step together, and characters that are compared in one call.
TOGETHER, CALL = 256, 1 << 20
#: Characters of two texts up to which the standard library's matcher, which the kernel follows, takes less time than a call of the kernel.
SHORT = 4096

STEP = StructType(
    [StructField(n, IntegerType()) for n in ("begin1", "count1", "begin2", "count2", "start1", "end1", "start2", "end2")]
    + [StructField("similarity", DoubleType()), StructField("text_differs", BooleanType())]
)
TOLD = StructType([*STEP.fields, StructField("sentence1", StringType()), StructField("sentence2", StringType())])
_TOLD = pa.list_(pa.struct([(f.name, pa.int32()) for f in STEP.fields[:8]] + [("similarity", pa.float64()), ("text_differs", pa.bool_()), ("sentence1", pa.string()), ("sentence2", pa.string())]))


def ratios(left: list[str], right: list[str]) -> list[float]:
    """Twice the matched over all characters of each pair, by the matcher's heuristic; two empty texts are alike."""
    out = [1.0] * len(left)
    some = []
    matcher = SequenceMatcher()
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        # equal texts are matched whole, unless all characters of a long one are popular
        if x == y and (len(y) < 200 or not popular([y]).all()):
            continue
        if len(x) + len(y) > SHORT:
            some.append(k)
            continue
        matcher.set_seq2(y)  # of the same right text it keeps what it knows
        matcher.set_seq1(x)
        out[k] = matcher.ratio()
    left, right = [left[k] for k in some], [right[k] for k in some]
    total = np.fromiter((len(x) + len(y) for x, y in zip(left, right, strict=True)), np.int64, len(left))
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(total) // CALL)) + 1).tolist(), len(left)] if len(left) else [0]
    for i, j in zip(edges, edges[1:], strict=False):
        if j > i:
            pair, _, _, size = matching_blocks(left[i:j], right[i:j], autojunk=True)
            same = np.bincount(pair, size, j - i)
            for k, s, t in zip(some[i:j], same.tolist(), total[i:j].tolist(), strict=True):
                out[k] = 2.0 * s / t
    return out


def score(m: int, n: int, sim: float, behind: float) -> float:
    s = sim + (EVEN if m == n else 0.0)
    if sim > LIKE:
        s += min(m, n) * LARGER
    s -= abs(m - n) * UNEVEN
    return s + behind * BEHIND if behind > LIKE_BEHIND else s


def _reach(a: int, b: int) -> float:
    """The greatest likeness of texts of these lengths."""
    return 2.0 * min(a, b) / (a + b) if a + b else 1.0


class _Pair:
    """Where two lists of cleaned sentences stand, and the blocks found so far."""

    def __init__(self, one: list[str], two: list[str]):
        self.side = one, two
        self.edge = [np.concatenate([[0], np.cumsum([len(s) for s in x], dtype=np.int64)]).tolist() for x in self.side]
        self.at = [0, 0]
        self.out: list[dict] = []
        self.behind: dict[tuple[int, int], float] = {}
        self.most: dict[tuple[int, int], float] = {}  # the same before it is known, at most

    def more(self) -> bool:
        return self.at[0] < len(self.side[0]) and self.at[1] < len(self.side[1])

    def size(self, k: int, n: int) -> int:
        return self.edge[k][self.at[k] + n] - self.edge[k][self.at[k]]

    def texts(self, m: int, n: int) -> tuple[str, str]:
        i, j = self.at
        return "".join(self.side[0][i : i + m]), "".join(self.side[1][j : j + n])

    def next(self, m: int, n: int) -> tuple[int, int] | None:
        """The sentences behind a block, where both sides have one whose length allows a likeness that counts."""
        i, j = self.at[0] + m, self.at[1] + n
        if i >= len(self.side[0]) or j >= len(self.side[1]):
            return None
        return (i, j) if _reach(len(self.side[0][i]), len(self.side[1][j])) > LIKE_BEHIND else None

    def add(self, m: int, n: int, sim: float | None) -> None:
        i, j = self.at
        ends = self.edge[0][i], self.edge[0][i + m], self.edge[1][j], self.edge[1][j + n]
        self.out.append(dict(zip(STEP.names, (i, m, j, n, *ends, None if sim is None else round(sim, 3), sim is None or sim < SAME), strict=True)))
        self.at = [i + m, j + n]


def _tell(asked: list[tuple[_Pair, int, int]]) -> list[tuple[float, float]]:
    """Likeness and score of blocks (pair, sentences of either side); a pair of sentences behind is compared once."""
    behind = list({(id(p), k): (p, k) for p, m, n in asked if (k := p.next(m, n)) and k not in p.behind}.values())
    texts = [p.texts(m, n) for p, m, n in asked] + [(p.side[0][i], p.side[1][j]) for p, (i, j) in behind]
    sims = ratios([x for x, _ in texts], [y for _, y in texts])
    for (p, k), s in zip(behind, sims[len(asked) :], strict=True):
        p.behind[k] = s
    return [(s, score(m, n, s, p.behind.get(p.next(m, n), 0.0))) for (p, m, n), s in zip(asked, sims, strict=False)]


def _common(a: str, cuts: list[int], parts: list[str]) -> list[list[int]]:
    """The longest common subsequences of the first parts together and each beginning a[:cut]: no likeness matches more. A bit of a number is a character of a, zero where the sequence grows."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    v = full = (1 << len(a)) - 1
    low = [(1 << c) - 1 for c in cuts]
    out = []
    for s in parts:
        for c in s:
            m = where.get(c)
            if m is not None:
                u = v & m
                v = ((v + u) | (v - u)) & full
        out.append([c - (v & x).bit_count() for c, x in zip(cuts, low, strict=True)])
    return out


def _behind(p: _Pair, m: int, n: int) -> float:
    """The greatest likeness of the sentences behind a block."""
    k = p.next(m, n)
    if k is None:
        return 0.0
    if k not in p.behind and k not in p.most:
        a, b = p.side[0][k[0]], p.side[1][k[1]]
        p.most[k] = 2.0 * _common(a, [len(a)], [b])[0][0] / (len(a) + len(b)) if a or b else 1.0
    return p.behind[k] if k in p.behind else p.most[k]


def _most(p: _Pair) -> list[tuple[float, int, int, float]]:
    """What each block may score at most (whatever is behind it), its sentences, and its greatest likeness."""
    room = [min(MOST, len(p.side[k]) - p.at[k]) for k in (0, 1)]
    cuts = [p.size(0, m) for m in range(1, room[0] + 1)]
    common = _common("".join(p.side[0][p.at[0] : p.at[0] + room[0]]), cuts, p.side[1][p.at[1] : p.at[1] + room[1]])
    out = []
    for n in range(1, room[1] + 1):
        for m in range(1, room[0] + 1):
            total = cuts[m - 1] + p.size(1, n)
            sim = 2.0 * common[n - 1][m - 1] / total if total else 1.0
            out.append((score(m, n, sim, 1.0 if p.next(m, n) else 0.0), m, n, sim))
    return sorted(out, reverse=True)


def _step(open_: list[_Pair]) -> None:
    """One block more for each pair. Blocks are compared in the order of what they may score, some at a time, until no other can score as much as the best."""
    best = {id(p): (-np.inf, 0, 0, 0.0) for p in open_}
    left = {id(p): _most(p) for p in open_}
    going, some = open_, 1
    while going:
        asked = [(p, m, n) for p in going for _, m, n, _ in sorted(left[id(p)][:some], key=lambda x: x[2])]
        for (p, m, n), (sim, s) in zip(asked, _tell(asked), strict=True):
            best[id(p)] = max(best[id(p)], (s, -m, -n, sim))
        for p in going:
            least = best[id(p)][0] - 1e-9
            left[id(p)] = [x for x in left[id(p)][some:] if x[0] >= least and score(x[1], x[2], x[3], _behind(p, x[1], x[2])) >= least]
        going, some = [p for p in going if left[id(p)]], some * 4
    for p in open_:
        _, m, n, sim = best[id(p)]
        p.add(-m, -n, sim)


def stepped(pairs: Iterator[tuple[list[str], list[str]]]) -> Iterator[list[dict]]:
    """The blocks of each pair of lists of cleaned sentences, in order. Of equal scores the fewest sentences of the left, then of the right win. What one side has left over is a block without likeness. TOGETHER pairs step together; where one is done another takes its place."""
    waiting: deque[_Pair] = deque()
    open_: list[_Pair] = []
    more = True
    while more or waiting:
        while more and len(open_) < TOGETHER:
            p = next(pairs, None)
            more = p is not None
            if more:
                waiting.append(_Pair(*p))
                open_ += [waiting[-1]] if waiting[-1].more() else []
        if open_:
            _step(open_)
            open_ = [p for p in open_ if p.more()]
        while waiting and not waiting[0].more():
            p = waiting.popleft()
            left = [len(p.side[k]) - p.at[k] for k in (0, 1)]
            if any(left):
                p.add(*left, None)
            yield p.out


def steps(pairs: list[tuple[list[str], list[str]]]) -> list[list[dict]]:
    return list(stepped(iter(pairs)))


def chosen(rows: DataFrame) -> DataFrame:
    """owner and steps of rows (owner, s1, s2, p1, p2): the blocks of two lists of cleaned sentences (p), with their sentences (s) as they were. A block takes its own sentences along, not those of its whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = stepped(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True))
            for k in range(0, b.num_rows, TOGETHER):
                part = b.slice(k, TOGETHER)
                steps_ = list(islice(found, part.num_rows))
                for own, one, two in zip(steps_, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for x in own:
                        x["sentence1"] = "".join(one[x["begin1"] : x["begin1"] + x["count1"]])
                        x["sentence2"] = "".join(two[x["begin2"] : x["begin2"] + x["count2"]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(steps_, _TOLD)], ["owner", "steps"])

    return rows.select("owner", "s1", "s2", "p1", "p2").mapInArrow(run, StructType([rows.schema["owner"], StructField("steps", ArrayType(TOLD))]))


def blocks(pairs: DataFrame, keys: list[str], one: str, two: str, fold: tuple[str, str] = ("", "")) -> DataFrame:
    """keys, id (from 1), type ("2-to-1", insert or delete), sentence1, sentence2, start1, end1, start2, end2 (characters without marks and white space), similarity (null for insert and delete) and text_differs. Marks stay in the sentences; likenesses see neither them nor variants (fold). A null text has no sentences, two texts without sentences no blocks."""
    cut: dict[str, Column] = {f"s{k}": T.sentences(F.coalesce(F.col(c), F.lit(""))) for k, c in ((1, one), (2, two))}
    plain = {f"p{k}": F.transform(f"s{k}", lambda s: F.translate(T.strip_marks(s), *fold) if fold[0] else T.strip_marks(s)) for k in (1, 2)}
    rows = pairs.select(F.struct(*keys).alias("owner"), *(c.alias(n) for n, c in cut.items())).withColumns(plain)
    x = chosen(rows).select("owner", F.posexplode("steps").alias("k", "x"))
    kind = F.when(F.col("x.similarity").isNotNull(), F.concat_ws("-to-", F.col("x.count1").cast("string"), F.col("x.count2").cast("string"))).when(F.col("x.count1") == 0, "insert").otherwise("delete")
    return x.select("owner.*", (F.col("k") + 1).alias("id"), kind.alias("type"), "x.sentence1", "x.sentence2", *(f"x.{c}" for c in STEP.names[4:]))


def with_differences(found: DataFrame, differences: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with n_differences (of keys, pos: those within the block's characters of the left text) and has_diff. Blocks and differences are one ordered union, in which a difference carries the last block that began; left-over sentences have none."""
    begun = found.select(*keys, F.col("start1").alias("pos"), F.lit(0).alias("order"), "id", F.col("similarity").isNotNull().alias("counts"))
    both = begun.unionByName(differences.select(*keys, F.col("pos").cast("int").alias("pos"), F.lit(1).alias("order")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("pos", "order", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w).alias(c)
    held = both.select(*keys, "order", last("id"), last("counts")).where("order = 1 AND counts")
    n = held.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n_differences"))
    own = found.join(n, [*keys, "id"], "left").withColumn("n_differences", F.coalesce("n_differences", F.lit(0)))
    return own.withColumn("has_diff", (F.col("n_differences") > 0) | F.col("text_differs"))
