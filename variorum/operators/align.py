"""Alignment of text pairs by longest matching blocks.

The longest run of characters that both texts share is taken, of several the one that begins first in the left text, then
first in the right; the same is done left and right of it, until nothing is shared. A task does this for a whole Arrow
batch at once: all gaps of all its pairs are searched together, by hashes of runs whose length is halved towards the
longest, round after round, so the work of a round is a few sorts of what is still unaligned, and texts of any length are
aligned by the same rule. Matches are verified character by character. What follows the kernel is relational.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import is_transposition

SEGMENT = StructType([StructField(n, t) for n, t in (("type", StringType()), ("text1", StringType()), ("text2", StringType()), ("i1", IntegerType()), ("i2", IntegerType()), ("j1", IntegerType()), ("j2", IntegerType()))])
_ARROW = pa.list_(pa.struct([("type", pa.string()), ("text1", pa.string()), ("text2", pa.string()), ("i1", pa.int32()), ("i2", pa.int32()), ("j1", pa.int32()), ("j2", pa.int32())]))


#: Characters of the pairs that are aligned together, unless one pair has more.
TOGETHER = 1 << 20
#: Distances of the groups that are clustered together, unless one group has more.
BATCH = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers begin to begin + size - 1 of every run, one after the other, and which run each is of."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + np.repeat(begin - (np.cumsum(size) - size), size), of


class _Side:
    """Code points of many texts laid end to end, and hashes of their runs. alone: places that match nothing."""

    def __init__(self, texts: list[str], alone: np.ndarray | None = None):
        self.edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        self.code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        value = _mix(self.code.astype(np.uint64) + np.uint64(1))
        if alone is not None:
            value[alone] = _mix(np.flatnonzero(alone).astype(np.uint64) + np.uint64(1 << 40))
        n, self.value = len(value), value
        up, self.down = (np.concatenate([np.ones(1, np.uint64), np.full(n, x)]) for x in (_STEP, _BACK))
        up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(self.down)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[:n], dtype=np.uint64)])

    def keys(self, begin: np.ndarray, gap: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
        """The gap's number above a hash of the run that begins at each place."""
        run = _mix((self.total[begin + size] - self.total[begin]) * self.down[begin])
        return gap.astype(np.uint64) << np.uint64(64 - bits) | run >> np.uint64(bits)


def popular(texts: list[str]) -> np.ndarray:
    """Places of characters that make up more than a hundredth of a text of 200 characters or more: fixed values of the matcher's heuristic."""
    marks = []
    for t in texts:
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        _, of, n = np.unique(code, return_inverse=True, return_counts=True)
        marks.append(n[of] > len(t) // 100 + 1 if len(t) >= 200 else np.zeros(len(t), bool))
    return np.concatenate([np.zeros(0, bool), *marks])


def _along(a: _Side, b: _Side, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The longest run that the n characters from x on and those from y on share place by place."""
    at, of = _spread(x, n)
    k = np.arange(len(at))
    begin = np.cumsum(n) - n
    other = np.where(a.value[at] == b.value[at + (y - x)[of]], -1, k)
    return np.maximum.reduceat(k - np.maximum(np.maximum.accumulate(other), begin[of] - 1), begin)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The places of keys that are among the sorted known ones."""
    if not len(known):
        return np.zeros(0, np.int64)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys)


def _kept(of: np.ndarray, both: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The places that stay: of gaps in which a run was found those where one begins, of others all."""
    stay = ~both[of]
    stay[some] = True
    return stay


def matching_blocks(left: list[str], right: list[str], autojunk: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pair, begin in the left text, begin in the right text and length of every matching block, in order. autojunk: popular characters of the right text begin no match, they only lengthen one."""
    a, b = _Side(left), _Side(right, popular(right) if autojunk else None)
    gaps = np.stack([np.arange(len(left)), a.edge[:-1], a.edge[1:], b.edge[:-1], b.edge[1:]])
    found: list[np.ndarray] = []
    while True:
        gaps = gaps[:, (gaps[2] > gaps[1]) & (gaps[4] > gaps[3])]
        pair, a0, a1, b0, b1 = gaps
        if not len(pair):
            break
        bits = max(1, len(pair).bit_length())
        most = np.minimum(a1 - a0, b1 - b0)
        low = np.maximum(_along(a, b, a0, b0, most), _along(a, b, a1 - most, b1 - most, most))
        i, j, size = a0.copy(), b0.copy(), low
        # gaps whose sides are one run are done; of the others the places where a run of at least that length begins are kept
        whole = low == np.maximum(a1 - a0, b1 - b0)
        try_, high, first = np.maximum(low, 1), np.where(whole, low, most), True
        places = [_spread(x[~whole], y[~whole] - x[~whole] - try_[~whole] + 1) for x, y in ((a0, a1), (b0, b1))]
        (at_a, of_a), (at_b, of_b) = ((at, np.flatnonzero(~whole)[of]) for at, of in places)
        open_ = ~whole
        while open_.any():
            some_a, some_b = (np.flatnonzero(open_[of] & (at + try_[of] <= end[of])) for at, of, end in ((at_a, of_a, a1), (at_b, of_b, b1)))
            key_a, key_b = (side.keys(at[k], of[k], try_[of[k]], bits) for side, at, of, k in ((a, at_a, of_a, some_a), (b, at_b, of_b, some_b)))
            some_a = some_a[hit := _among(key_a, np.sort(key_b))]
            some_b = some_b[_among(key_b, np.sort(key_a[hit]))]
            both = np.zeros(len(pair), bool)
            both[of_a[some_a]] = True
            low[open_ & both] = try_[open_ & both]
            high[open_ & ~both] = try_[open_ & ~both] - 1
            (at_a, of_a), (at_b, of_b) = ((at[k], of[k]) for at, of, k in ((at_a, of_a, _kept(of_a, both, some_a)), (at_b, of_b, _kept(of_b, both, some_b))))
            open_ = low < high
            # mostly the run that is known is the longest
            try_, first = np.where(open_, low + 1 if first else (low + high + 1) // 2, low), False
        some = np.flatnonzero(size > 0)
        if len(some):
            held, begin = np.unique(of_a, return_index=True)  # in order, so the first place of a gap is its leftmost
            i[held[size[held] > 0]] = at_a[begin][size[held] > 0]
            own = np.flatnonzero(size[of_b] > 0)
            same = own[a.keys(i[of_b[own]], of_b[own], size[of_b[own]], bits) == b.keys(at_b[own], of_b[own], size[of_b[own]], bits)]
            held, begin = np.unique(of_b[same], return_index=True)
            j[held] = at_b[same][begin]
            # a run that only its hash makes equal is searched again, character by character
            at, of = _spread(np.zeros(len(some), np.int64), size[some])
            wrong = np.unique(of[a.code[i[some][of] + at] != b.code[j[some][of] + at]])
            for k in some[wrong].tolist():
                x, y = (side.code[lo:hi].tolist() for side, lo, hi in ((a, a0[k], a1[k]), (b, b0[k], b1[k])))
                m = SequenceMatcher(None, x, y, False).find_longest_match()
                i[k], j[k], size[k] = a0[k] + m.a, b0[k] + m.b, m.size
        if autojunk:
            while len(k := np.flatnonzero((i > a0) & (j > b0))) and len(k := k[a.code[i[k] - 1] == b.code[j[k] - 1]]):
                i[k], j[k], size[k] = i[k] - 1, j[k] - 1, size[k] + 1
            while len(k := np.flatnonzero((i + size < a1) & (j + size < b1))) and len(k := k[a.code[i[k] + size[k]] == b.code[j[k] + size[k]]]):
                size[k] += 1
        k = np.flatnonzero(size > 0)
        found.append(np.stack([pair[k], i[k], j[k], size[k]]))
        before, after = np.stack([pair[k], a0[k], i[k], b0[k], j[k]]), np.stack([pair[k], i[k] + size[k], a1[k], j[k] + size[k], b1[k]])
        gaps = np.concatenate([before, after], axis=1)
    pair, i, j, size = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    order = np.lexsort((i, pair))
    pair, i, j, size = pair[order], i[order], j[order], size[order]
    # blocks that touch on both sides are one
    if len(pair):
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (i[1:] != (i + size)[:-1]) | (j[1:] != (j + size)[:-1])])
        first = np.flatnonzero(new)
        pair, i, j, size = pair[first], i[first], j[first], np.add.reduceat(size, first)
    return pair, i - a.edge[pair], j - b.edge[pair], size


def opcodes(left: list[str], right: list[str], autojunk: bool = False) -> list[list[tuple[str, int, int, int, int]]]:
    """The segments (kind, i1, i2, j1, j2) of every pair."""
    pair, i, j, size = matching_blocks(left, right, autojunk)
    out: list[list[tuple[str, int, int, int, int]]] = [[] for _ in left]
    at = [(0, 0)] * len(left)

    def between(k: int, x: int, y: int) -> None:
        x0, y0 = at[k]
        if x > x0 or y > y0:
            out[k].append(("replace" if x > x0 and y > y0 else "delete" if x > x0 else "insert", x0, x, y0, y))

    for k, x, y, n in zip(pair.tolist(), i.tolist(), j.tolist(), size.tolist(), strict=True):
        between(k, x, y)
        out[k].append(("equal", x, x + n, y, y + n))
        at[k] = (x + n, y + n)
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        between(k, len(x), len(y))
    return out


def together(batches: Iterator[pa.RecordBatch], columns: list[int]) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts have about TOGETHER bytes."""
    for b in batches:
        size = sum(np.array([len(x or "") for x in b.column(c).to_pylist()], np.int64) for c in columns)
        part = np.cumsum(size) // TOGETHER if b.num_rows else np.zeros(0, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i)


def segments_of(left: list[str], right: list[str], fold: dict[int, str], autojunk: bool) -> list[list[dict]]:
    """Equal, replace, insert and delete segments; texts are folded for the comparison only, and what is equal only when folded is a replace."""
    out = []
    for a, b, codes in zip(left, right, opcodes([x.translate(fold) for x in left], [x.translate(fold) for x in right], autojunk), strict=True):
        own = []
        for tag, i1, i2, j1, j2 in codes:
            kind = "replace" if tag == "equal" and a[i1:i2] != b[j1:j2] else tag
            own.append({"type": kind, "text1": a[i1:i2], "text2": b[j1:j2], "i1": i1, "i2": i2, "j1": j1, "j2": j2})
        out.append(own)
    return out


def align(pairs: DataFrame, left: str, right: str, fold: tuple[str, str] = ("", ""), autojunk: bool = False) -> DataFrame:
    """The rows with segments (array) and similarity (2 x matching / total length; two empty texts: 1). Null texts are empty."""
    at = [pairs.columns.index(c) for c in (left, right)]
    table = str.maketrans(*fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in together(batches, at):
            left, right = ([x or "" for x in b.column(i).to_pylist()] for i in at)
            found, ratio = segments_of(left, right, table, autojunk), []
            for x, y, s in zip(left, right, found, strict=True):
                same = sum(v["i2"] - v["i1"] for v in s if v["type"] == "equal")
                ratio.append(2 * same / (len(x) + len(y)) if x or y else 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _ARROW), pa.array(ratio, pa.float64())], [*b.schema.names, "segments", "similarity"])

    schema = StructType([*pairs.schema.fields, StructField("segments", ArrayType(SEGMENT)), *StructType().add("similarity", "double").fields])
    return pairs.mapInArrow(run, schema)


#: The segments that one transposition may span, and its characters.
SPAN, SIZE = (2, 7), (2, 6)


def merge_transpositions(s: Column) -> Column:
    """runs of 2 to 7 segments, the first an insertion or a deletion, whose two sides are the same 2 to 6 characters in another order. The shortest run from a segment counts, and none begins inside the one before. Replaced text breaks a run."""

    def window(i: Column, n: Column) -> Column:
        part = F.slice(s, i + 1, n)
        one, two = (F.array_join(F.transform(part, lambda x: x[side]), "") for side in ("text1", "text2"))
        kinds = F.transform(part, lambda x: x["type"])
        fits = F.array_contains(kinds, "insert") & F.array_contains(kinds, "delete") & ~F.array_contains(kinds, "replace")
        first, last = F.get(s, i), F.get(s, i + n - 1)
        found = F.struct(
            F.lit("transpose").alias("type"), one.alias("text1"), two.alias("text2"),
            first["i1"].alias("i1"), last["i2"].alias("i2"), first["j1"].alias("j1"), last["j2"].alias("j2"), i.alias("at"), (i + n).alias("next"),
        )
        return F.when(fits & F.length(one).between(*SIZE) & is_transposition(one, two), found)

    def shortest(x: Column, i: Column) -> Column:
        widths = F.filter(F.sequence(F.lit(SPAN[0]), F.lit(SPAN[1])), lambda n: i + n <= F.size(s))
        return F.when(x["type"].isin("insert", "delete"), F.get(F.filter(F.transform(widths, lambda n: window(i, n)), lambda w: w.isNotNull()), F.lit(0)))

    runs = F.filter(F.transform(s, shortest), lambda w: w.isNotNull())
    kept = F.array().cast("array<struct<type:string,text1:string,text2:string,i1:int,i2:int,j1:int,j2:int,at:int,next:int>>")
    apart = F.aggregate(runs, kept, lambda acc, w: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["next"] > w["at"]), acc).otherwise(F.concat(acc, F.array(w))))
    return F.transform(apart, lambda w: F.struct(*(w[c].alias(c) for c in SEGMENT.names)))


def statistics(aligned: DataFrame, key: str) -> DataFrame:
    """Counts and characters of a pair's segments by type."""
    s = aligned.select(key, F.inline("segments"))
    return s.groupBy(key, "type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text1")).alias("chars1"), F.sum(F.length("text2")).alias("chars2"))


def differences(aligned: DataFrame, key: str, left: str, width: int = 20) -> DataFrame:
    """a row a difference with the base's characters around it."""
    s = aligned.select(key, left, F.inline("segments")).where("type <> 'equal'")
    before = F.substring(left, F.greatest(F.col("i1") - width, F.lit(0)) + 1, F.least(F.col("i1"), F.lit(width)))
    return s.select(key, "type", "i1", "text1", "text2", before.alias("before"), F.substring(F.col(left), F.col("i2") + 1, F.lit(width)).alias("after"))


def transfer_marks(pairs: DataFrame, source: str, target: str, marks: str) -> DataFrame:
    """the rows with transferred: the target with the source's marks, set before the characters that the marked ones are aligned with. Marks after the last character of source close the target."""
    at = [pairs.columns.index(c) for c in (source, target)]
    known = set(marks)

    def stripped(t: str) -> str:
        return "".join(c for c in t if c not in known and not c.isspace())

    def move(a: str, b: str, codes: list[tuple[str, int, int, int, int]]) -> str:
        count = 0
        runs: dict[int, str] = {}
        for c in a:
            if c in known:
                runs[count] = runs.get(count, "") + c
            elif not c.isspace():
                count += 1
        bare = [c for c in b if c not in known]
        solid = [i for i, c in enumerate(bare) if not c.isspace()]
        to: dict[int, int] = {count: len(solid)}
        for tag, i1, i2, j1, j2 in codes:
            for i in range(i1, i2):
                to[i] = j1 + (i - i1) if tag == "equal" else j1 + (i - i1) * (j2 - j1) // max(1, i2 - i1)
        put: dict[int, str] = {}
        for i, m in sorted(runs.items()):
            j = to[i]
            # a closing mark stays with the character before it
            put[j] = put.get(j, "") + m
        out, k = [], 0
        for i, c in enumerate(bare):
            if k < len(solid) and solid[k] == i:
                out.append(put.get(k, ""))
                k += 1
            out.append(c)
        return "".join(out) + put.get(len(solid), "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in together(batches, at):
            left, right = ([x or "" for x in b.column(i).to_pylist()] for i in at)
            codes = opcodes([stripped(x) for x in left], [stripped(x) for x in right])
            got = [move(*x) for x in zip(left, right, codes, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, "transferred"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("transferred", StringType())]))


def _merges(of: np.ndarray, i: np.ndarray, j: np.ndarray, sim: np.ndarray, base: int | None) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Merges of many groups (of: the group's number of each pair), those with the same number of nodes together, a step at a time: groups, step, a, b, height."""
    name, code = np.unique(np.concatenate([i, j]), return_inverse=True)
    node = np.unique(np.concatenate([of, of]) * len(name) + code)
    one, two = (of * len(name) + c for c in (code[: len(of)], code[len(of) :]))
    if base is not None:
        node = node[name[node % len(name)] != base]
        own = (i != base) & (j != base)
        of, one, two, sim = of[own], one[own], two[own], sim[own]
    count = np.bincount(node // len(name))
    first = np.cumsum(count) - count
    x, y = (np.searchsorted(node, v) - first[of] for v in (one, two))
    for n in np.unique(count[count > 1]).tolist():
        alike = np.flatnonzero(count == n)
        part = max(1, BATCH // (n * n))
        for k in range(0, len(alike), part):
            groups = alike[k : k + part]
            row = np.full(len(count), -1)
            row[groups] = at = np.arange(len(groups))
            own = row[of] >= 0
            g, p, q = row[of[own]], x[own], y[own]
            far = np.zeros((len(groups), n, n))  # sums of distances between the members of two clusters
            far[g, p, q] = far[g, q, p] = 1 - sim[own]
            size, names = np.ones((len(groups), n)), name[node[first[groups][:, None] + np.arange(n)] % len(name)]
            for step in range(1, n):
                m = n + 1 - step
                gap = np.where(np.triu(np.ones((m, m), bool), 1), far / (size[:, :, None] * size[:, None, :]), np.inf)
                c, d = np.divmod(np.round(gap, 12).reshape(len(groups), -1).argmin(1), m)
                a, b = np.minimum(names[at, c], names[at, d]), np.maximum(names[at, c], names[at, d])
                yield groups, step, a, b, gap[at, c, d]
                stay = np.ones((len(groups), m), bool)
                stay[at, c] = stay[at, d] = False
                rest = np.nonzero(stay)[1].reshape(len(groups), m - 2)
                both = np.take_along_axis(far[at, c] + far[at, d], rest, 1)
                far = np.pad(far[at[:, None, None], rest[:, :, None], rest[:, None, :]], ((0, 0), (0, 1), (0, 1)))
                far[:, -1, :-1] = far[:, :-1, -1] = both
                size = np.concatenate([np.take_along_axis(size, rest, 1), (size[at, c] + size[at, d])[:, None]], 1)
                names = np.concatenate([np.take_along_axis(names, rest, 1), a[:, None]], 1)


def cluster(similarities: DataFrame, base: int | None = None) -> DataFrame:
    """H1: average-linkage merges (step, a, b, height) of the nodes of (grp, i, j, sim), each group a project of a few dozen witnesses. A base is the root and merges with none, so that it and one cluster are left; without one all merge. A new cluster has the smaller name of its two and comes last, and of equal distances the first pair counts. All groups of a batch are merged at once."""
    names = ["grp", "step", "a", "b", "height"]

    def merged(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of = rows.column(0).dictionary_encode("encode").indices.to_numpy()
        first = np.unique(of, return_index=True)[1]
        for groups, step, a, b, height in _merges(of.astype(np.int64), *(rows.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3)), base):
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(first[groups])), pa.array(np.full(len(groups), step, np.int32)), pa.array(a), pa.array(b), pa.array(height)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            last = b.column(0)[-1].as_py()
            if held[0].column(0)[0].as_py() == last:
                continue
            # the last group waits for the next batch
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            code = rows.column(0).dictionary_encode("encode").indices.to_numpy()
            begin = int(np.flatnonzero(code == code[-1])[0])
            held = [rows.slice(begin)]
            yield from merged(rows.slice(0, begin))
        if held:
            yield from merged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    pairs = similarities.select(F.col("grp").cast("long").alias("grp"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("sim").cast("double").alias("sim"))
    return pairs.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "grp long, step int, a long, b long, height double")
