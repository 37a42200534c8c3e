"""N-gram Jaccard join by partitions of the universe.

A text's set holds the 64-bit hashes of its distinct five-word shingles (a shorter text: of its whole sequence). Two
sets of sizes a and b with similarity of at least 0.8 differ in at most H = (a + b) / 9 elements. Sizes fall into bands;
the partition of a band cuts the universe of hashes into H + 2 segments, and a set takes part in that of its own band
and, while it can be the smaller one, of the next. Equal sets count once.

1. Subsets: the hashes of all segment subsets are grouped over all sets. A set with m segments that are not empty shares
   at least m - H of its subsets with a partner, so one that shares fewer with others has none and is done.
2. Neighbourhoods: the sets that are left index their subsets and, of each, the one-deletion neighbourhood. Lists are
   measured, and each set allocates thresholds to its segments: none (skipped), 0 (equal subsets) or 1 (subsets that
   differ by one element, the same or a deletion on either side), cheapest lists first, until they add up to H + 1: then
   one segment at least lies within its threshold. Segments without any list count two and cost nothing; a set for which
   these suffice has no partner. Sets whose segments are too small for H + 1 add the hashes of their H + 1 first elements.
3. Sets that share an allocated list are verified exactly. First each with one neighbour; then, where a list still holds
   several components, lists are cut into blocks, and the pairs of a block that lie in different components and whose
   sizes and parities (2,048 bits of each set, which can only underestimate a difference) allow a link are sought: a
   spanning forest of them first (in one list of each set, then in all), in the end all. Only pairs that may link leave a
   block.

A subset that a task meets in two sets is known to be shared: it sends one row for the whole task to its group, and its
other rows go to any task. No list is capped.

Nulls and edge cases: a null or empty text has no shingles and is linked with nothing; rows sharing a doc_id must be
repeats of one row; a doc_id may be any number; null doc_ids are named by their texts, beside a flag that tells these names
from doc_ids, and their component_id is null if none of it has a doc_id;
texts of any length count whole; an empty table gives no rows; extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, frugal, mix, row_key, slices, small, table, written
from .components import components
from .substring_dedup import Known

N = 5
#: Similarity at least NUM / DEN.
NUM, DEN = 80, 100
#: Rows of a table that may be broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000
#: Sets of a list that are compared with each other, or with as many others, in one go.
BLOCK = 1500
BITS = 2048
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted set of shingle hashes of a sequence of word hashes."""
    n = len(words)
    if n < N:
        if not n:
            return words
        x = np.array([n], np.uint64)
        for k in range(n):
            x = mix(x * _ODD[0] + words[k : k + 1])
        return x
    s = words[: n - N + 1] * _ODD[0]
    for k in range(1, N):
        s = s + words[k : n - N + 1 + k] * _ODD[k]
    s = np.sort(mix(s))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def class_of(u: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets."""
    total = mix(u ^ _ODD[3]).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.array([len(u)], np.uint64) * _ODD[1])[0])


def differences(a: int, b: int) -> int:
    """The most elements in which sets of these sizes may differ: (1 - s) / (1 + s) of a + b."""
    return (DEN - NUM) * (a + b) // (DEN + NUM)


class Bands:
    """Bands of sizes; a partner of a size in one band is in the same or in an adjacent one."""

    def __init__(self):
        self.low, self.high = [1], [1]

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * DEN // NUM)
        return int(np.searchsorted(self.high, size))

    def partitions(self, size: int) -> list[tuple[int, int, int]]:
        """Of the partitions that a set of this size takes part in: band, number of segments, and in how many elements partners may differ."""
        most = size * DEN // NUM
        if not differences(size, most):
            return []  # only equal sets are similar
        band = self.of(size)
        self.of(most)
        segments = lambda b: differences(self.high[b], self.high[b]) + 2
        found = [(band, segments(band), differences(size, min(most, self.high[band])))]
        if most > self.high[band]:
            found.append((band + 1, segments(band + 1), differences(size, most)))
        return found


class Segments:
    """A set under the partition of a band: numbers, sizes and hashes of its segment subsets that are not empty."""

    def __init__(self, u: np.ndarray, band: int, segments: int):
        seg = ((u >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        starts = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1])
        self.number, self.sizes = seg[starts].astype(np.int64), np.diff(starts, append=len(u))
        self.mixed = mix(u ^ _ODD[4])
        self.sums = np.add.reduceat(self.mixed, starts)
        self.place = mix((np.uint64(band + 1) << np.uint64(32)) + seg[starts])
        self.band = band

    def subsets(self) -> np.ndarray:
        return mix(self.sums ^ self.place)

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """Which segment, and the hash of its subset without one element, for each element of segments of two or more."""
        which = np.repeat(np.arange(len(self.sizes)), self.sizes)
        many = self.sizes[which] > 1
        which = which[many]
        return which, mix((self.sums[which] - self.mixed[many]) ^ self.place[which])

    def elements(self, n: int) -> np.ndarray:
        return mix(np.sort(self.mixed)[:n] ^ mix(np.array([self.band + 1], np.uint64)) ^ _ODD[1])


class Sets:
    def __init__(self):
        self.hashes = WordHashes(lower=True)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        flat, at = self.hashes(texts)
        return [shingles(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


def even(sig: np.ndarray, band: int) -> np.ndarray:
    """Hashes that tell the parity of their band by their last bit."""
    return sig & ~np.uint64(1) | np.uint64(band & 1)


def keyed(documents: DataFrame) -> DataFrame:
    return documents.select(row_key().alias("k"), "doc_id", "text").select("k.key", "doc_id", "text", "k.stand_in")


def classes(rows: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles and cls (null for empty sets) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for b in slices(batches, 1000, 1 << 20):
            found = sets(b.column(2))
            n = np.array([len(u) for u in found], np.int64)
            cls = np.array([class_of(u) if len(u) else 0 for u in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(n), pa.array(cls, mask=n == 0)], ["doc_id", "key", "n_shingles", "cls"])

    return rows.mapInArrow(frugal(run), "doc_id long, key long, n_shingles long, cls long")


SUBSETS = "sig long, cls long, need int"
#: Marks above need in a row of subsets: its sig is known to be shared; its sig is disguised, as the row tells nobody anything.
SHARED, DEALT = 1 << 16, 1 << 17


def subsets(rows: DataFrame) -> DataFrame:
    """sig, cls and need (how many subsets the set shares with a partner at least) of all segment subsets, copies of a set in one task once. need is one more than that, and marked where sig is known to be shared; sig is then any number unless the row tells other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, bands, seen, shared = Sets(), Bands(), set(), Known(1 << 18)
        for b in slices(batches, 1000, 1 << 20):
            found: list[tuple] = []
            for u in sets(b.column(0)):
                if len(u) and (name := class_of(u)) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(name)
                    for band, segments, h in bands.partitions(len(u)):
                        sig = even(Segments(u, band, segments).subsets(), band)
                        found.append((sig, name, len(sig) - h))
            if not found:
                continue
            n = [len(x) for x, _, _ in found]
            sig = np.concatenate([x for x, _, _ in found])
            cls = np.repeat(np.array([x for _, x, _ in found], np.uint64), n)
            need = np.repeat(np.clip([x for _, _, x in found], -1, 30000).astype(np.int32) + 1, n)
            known = shared(sig)
            need += (known != 0) * np.int32(SHARED) + (known == 1) * np.int32(DEALT)
            dealt = np.where(known == 1, sig ^ mix(cls), sig)
            yield pa.RecordBatch.from_arrays([pa.array(dealt.view(np.int64)), pa.array(cls.view(np.int64)), pa.array(need)], ["sig", "cls", "need"])

    return rows.select("text").mapInArrow(frugal(run), SUBSETS)


def not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of subsets() sorted by sig: sig, cls and need of those that another class has too, or that may have no subset in common with a partner. Holds one batch and one row."""
    names = ["sig", "cls", "need"]
    held: pa.RecordBatch | None = None  # the first row of the last sig, if it is not given out
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        sig, cls, need = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        shared, disguised = need & SHARED != 0, need & DEALT != 0
        need = ((need & (SHARED - 1)) - 1).astype(np.int16)
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        if last is not None and last[0] == sig[0]:
            new[0] = False
        run = np.cumsum(new) - new[0]
        first = np.zeros(run[-1] + 1, np.int64)
        at = np.flatnonzero(new)
        first[run[at]] = at
        leader = cls[first][run]  # the class of each sig's first row
        if not new[0]:
            leader[run == 0] = last[1]
        several = np.zeros(run[-1] + 1, bool)
        several[run[cls != leader]] = True
        if not new[0]:
            if held is not None and several[0]:
                yield held
                held = None
            several[0] |= last[2]
        keep = several[run] | (need <= 0) | shared
        true = sig.copy()
        true[disguised] ^= mix(cls[disguised].view(np.uint64)).view(np.int64)
        rows = pa.RecordBatch.from_arrays([pa.array(true), b.column(1), pa.array(need)], names)
        yield rows.filter(pa.array(keep))
        end = int(run[-1])
        if end or new[0]:
            k = int(first[end])
            held = None if keep[k] else rows.slice(k, 1)
        last = (sig[-1], leader[-1], bool(several[end]))


def sets_of(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """cls, n, u (the set) and bits (parities of it) of the chosen classes (cls, stand_in, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for b in slices(batches, 500, 1 << 20):
            found = sets(b.column(1))
            bits = [np.packbits(np.bincount((u & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).tobytes() for u in found]
            at = np.concatenate([[0], np.cumsum([len(u) for u in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at).astype(np.int64)), lists, pa.array(bits, pa.binary())], ["cls", "n", "u", "bits"])

    own = chosen.select("cls", "stand_in", "key").join(rows.select("stand_in", "key", "text"), ["stand_in", "key"])
    return own.select("cls", "text").dropDuplicates(["cls"]).mapInArrow(frugal(run), "cls long, n long, u array<long>, bits binary")


ENTRIES = "sig long, cls long, slot long"
#: Where a slot holds how far H + 1 exceeds what all segments add, and what is added to that so that it is no negative number.
OVER, LEVEL = 36, 1 << 26


def slot(seg, kind, gain, part, over):
    """A segment, what an entry is of it, and by how much H + 1 exceeds what all segments add, in one number."""
    return (over + LEVEL << OVER) + seg * 64 + kind * 16 + gain * 4 + part


def entries(sets: DataFrame) -> DataFrame:
    """What each set (cls, u, parts: parities of bands) indexes, by sig (its last bit is kind 1, so that a list begins with its subsets): kind 0 for a subset, 1 for one without an element, 2 for an element of a set whose segments are too small; slot: its segment, kind, the most that the segment adds to the thresholds, the part, and what H + 1 is beyond all that segments add."""
    names = [x.split()[0] for x in ENTRIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for b in slices(batches, 200):
            out: list[list[np.ndarray]] = []
            for cls, u, parts in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                u = u.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for band, segments, h in bands.partitions(len(u)):
                    if (band & 1) not in parts:
                        continue
                    s = Segments(u, band, segments)
                    which, deleted = s.deletions()
                    gain = np.minimum(s.sizes, 2)
                    due = h + 1
                    first = s.elements(due) if gain.sum() < due else deleted[:0]
                    kind = np.repeat(np.array([0, 1, 2], np.int8), [len(gain), len(which), len(first)])
                    n = len(kind)
                    number = np.concatenate([s.number, s.number[which], np.zeros(len(first), np.int64)])
                    gains = np.concatenate([gain, gain[which], np.zeros(len(first), np.int64)])
                    out.append([
                        (np.concatenate([s.subsets(), deleted, first]) & ~np.uint64(1) | (kind == 1).astype(np.uint64)).view(np.int64), np.full(n, cls, np.int64),
                        slot(number, kind.astype(np.int64), gains, band & 1, due - int(gain.sum())),
                    ])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)

    return sets.select("cls", "u", "parts").mapInArrow(frugal(run), ENTRIES)


def lists_of_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by sig: those of lists with two entries or more, of which one at least is no deletion; sig without its last bit. Holds one batch and one row."""
    held: pa.RecordBatch | None = None
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        sig, kind = b.column(0).to_numpy() >> 1, b.column(2).to_numpy() >> 4 & 3
        b = b.set_column(0, "sig", pa.array(sig))
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        going = last is not None and last[0] == sig[0]
        new[0] = not going
        run = np.cumsum(new) - new[0]
        at = np.flatnonzero(new)
        good, size = np.zeros(run[-1] + 1, bool), np.bincount(run)
        good[run[at]] = kind[at] != 1
        if going:
            good[0], size[0] = last[1], size[0] + 1
            if held is not None and good[0]:
                yield held
        keep = (good & (size > 1))[run]
        yield b.filter(pa.array(keep))
        held = b.slice(b.num_rows - 1, 1) if good[run[-1]] and not keep[-1] else None
        last = (sig[-1], bool(good[run[-1]]))


def allocated(lists: DataFrame) -> DataFrame:
    """The sigs of the lists that some set has to look through (lists: entries that are not alone)."""
    counts = lists.groupBy("sig").agg(F.count_if(F.col("slot").bitwiseAND(F.lit(48)) == 0).alias("equal"), F.count(F.lit(1)).alias("all"))
    priced = lists.join(counts, "sig").groupBy("cls", F.col("slot").bitwiseAND(F.lit(1)).alias("part")).agg(F.max(F.shiftright("slot", OVER)).alias("over"), F.collect_list(F.struct("slot", "sig", "equal", "all")).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            chosen: list[np.ndarray] = []
            for over, e in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                slots, sig, equal, every = (e.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                seg, kind, gain = (slots & (1 << OVER) - 1) >> 6, slots >> 4 & 3, slots >> 2 & 3
                # by segment: the list of a threshold of 0, and what 1 adds to it
                number, own = np.unique(seg[kind < 2], return_inverse=True)
                k, q, a = kind[kind < 2], equal[kind < 2], every[kind < 2]
                zero = np.bincount(own, (k == 0) * (q - 1), len(number))
                one = np.bincount(own, np.where(k == 0, a - q, q), len(number))
                adds = np.zeros(len(number), np.int64)
                adds[own] = gain[kind < 2]
                left = over - LEVEL + int(adds.sum())
                if left <= 0:
                    continue
                both = (adds == 2) & (one < zero)  # 1 is cheaper by what it adds than 0
                first = np.where(both, (zero + one) / 2, zero)
                second = np.where(adds == 2, np.where(both, first, one), np.inf)
                cost, step = np.concatenate([first, second]), np.repeat([0, 1], len(number))
                order = np.lexsort((np.tile(np.arange(len(number)), 2), step, cost))
                order = order[: min(left, int(adds.sum()))]
                threshold = np.full(len(number), -1)
                np.maximum.at(threshold, order % max(1, len(number)), step[order])
                threshold[both & (threshold == 0)] = 1
                ok = np.ones(len(seg), bool)
                ok[kind < 2] = threshold[own] >= k
                chosen.append(sig[ok])
            if chosen:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen))], ["sig"])

    return priced.select("over", "e").mapInArrow(frugal(run), "sig long").distinct()


def forest(p: np.ndarray, q: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the pairs (p, q) are enough to connect what all of them connect; label: the component of each node."""
    label = np.unique(label, return_inverse=True)[1]
    taken = np.zeros(len(p), bool)
    while True:
        x, y = label[p], label[q]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            return taken
        lo, hi = np.minimum(x, y)[open_], np.maximum(x, y)[open_]
        # each component joins the least one next to it
        order = np.lexsort((lo, hi))
        top = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]
        taken[open_[top]] = True
        to = np.arange(label.max() + 1)
        to[hi[top]] = lo[top]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def candidates(members: DataFrame, whole: bool) -> DataFrame:
    """Pairs (x, y) of the classes of a list (sig, cls, comp, n, bits) in different components that may link by sizes and parities: all, or a forest of them a block."""
    counts = members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = members.join(counts, "sig").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "comp", "n", "bits")

    def pairs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of whole blocks."""
        sig, i, j, own, cls, comp, n = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(7))
        bits = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint64).reshape(len(cls), -1)
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        begins = np.flatnonzero(new)
        after = np.append(begins[1:], len(sig))[np.cumsum(new) - 1] - np.arange(len(sig)) - 1  # members of its block after each
        total = np.concatenate([[0], np.cumsum(after)])
        found = []
        k = 0
        while k < len(sig):
            end = max(k + 1, int(np.searchsorted(total, total[k] + 500_000, side="right")) - 1)
            p = np.repeat(np.arange(k, end), after[k:end])
            q = p + 1 + np.arange(len(p)) - (total[p] - total[k])
            k = end
            ok = (comp[p] != comp[q]) & (np.minimum(n[p], n[q]) * DEN >= np.maximum(n[p], n[q]) * NUM) & ((i[p] == j[p]) | (own[p] != own[q]))
            p, q = p[ok], q[ok]
            differ = np.zeros(len(p), np.int64)
            for w in (slice(0, 4), slice(4, None)):
                differ = differ + np.bitwise_count(bits[p, w] ^ bits[q, w]).sum(1, dtype=np.int64)
                stay = differ * (DEN + NUM) <= (n[p] + n[q]) * (DEN - NUM)
                p, q, differ = p[stay], q[stay], differ[stay]
            if len(p):
                found.append((p, q))
        if found:
            p, q = (np.concatenate(x) for x in zip(*found, strict=True))
            if not whole:
                take = forest(p, q, comp)
                p, q = p[take], q[take]
            x, y = np.minimum(cls[p], cls[q]), np.maximum(cls[p], cls[q])
            once = np.unique(np.stack([x, y], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(once[:, 0].copy()), pa.array(once[:, 1].copy())], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < 4 * BLOCK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sig, i, j = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            last = int(np.flatnonzero((sig == sig[-1]) & (i == i[-1]) & (j == j[-1]))[0])  # its block may go on
            held = [rows.slice(last)]
            if last:
                yield from pairs(rows.slice(0, last))
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(frugal(run), "x long, y long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) among pairs of classes (x, y)."""
    light, heavy = sets.select("cls", "n"), sets.select("cls", "u")
    p = pairs.join(light.toDF("x", "nx"), "x").join(light.toDF("y", "ny"), "y").where(F.least("nx", "ny") * DEN >= F.greatest("nx", "ny") * NUM)
    both = p.join(heavy.toDF("x", "ux"), "x").join(heavy.toDF("y", "uy"), "y")
    common = both.select(F.col("x").alias("a"), F.col("y").alias("b"), "nx", "ny", F.size(F.array_intersect("ux", "uy")).alias("c"))
    return common.where(F.col("c") * DEN >= (F.col("nx") + F.col("ny") - F.col("c")) * NUM).select("a", "b")


def grouped(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, key, n_shingles, cls), classes (cls, doc_id, stand_in, key: their smallest names, doc_ids first) and the heads of components of several classes (cls, doc_id, stand_in, key: the smallest names of the component)."""
    rows = keyed(documents)
    told = written(classes(rows), "classes")
    names = smallest(told.where("cls IS NOT NULL").withColumn("stand_in", F.col("doc_id").isNull()), "cls")
    met = written(subsets(rows).repartition("sig").sortWithinPartitions("sig").mapInArrow(frugal(not_alone), "sig long, cls long, need short"), "met")
    part = F.col("sig").bitwiseAND(F.lit(1)).cast("byte").alias("part")
    left = met.groupBy("cls", part).agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need")).where("c >= need")
    left = left.groupBy("cls").agg(F.collect_set("part").alias("parts"))
    met = written(names.join(left, "cls"), "left")
    sets = written(sets_of(rows, small(met, BROADCAST_ROWS)).join(small(met.select("cls", "parts"), BROADCAST_ROWS), "cls"), "sets")
    lists = written(entries(sets).repartition(F.shiftright("sig", 1)).sortWithinPartitions("sig").mapInArrow(frugal(lists_of_two), ENTRIES), "lists")
    lists = lists.join(allocated(lists), "sig").select("sig", "cls")
    members = lists.groupBy("sig").agg(F.bit_xor(F.xxhash64("cls")).alias("one"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("two"), F.count(F.lit(1)).alias("n"))
    once = members.groupBy("one", "two", "n").agg(F.min("sig").alias("sig")).select("sig")  # lists of the same sets say the same
    lists = written(lists.join(once, "sig"), "allocated")

    def components_of(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The component of each class, and the lists that hold several."""
        comp = sets.select("cls", "n", "bits").join(components(links).toDF("cls", "component"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
        own = lists.join(comp.select("cls", "comp"), "cls")
        apart = own.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
        return comp, written(own.join(apart, "sig").select("sig", "cls", "comp"), "apart")

    hubs = lists.groupBy("sig").agg(F.min("cls").alias("hub"))
    tested = written(lists.join(hubs, "sig").where("hub <> cls").groupBy(F.col("cls").alias("y")).agg(F.min("hub").alias("x")).select("x", "y"), "pairs")
    links = written(verified(tested, sets), "links")
    for few, whole in ((True, False), (False, False), (False, True)):
        comp, apart = components_of(links)
        if apart.isEmpty():
            break
        if few:  # a list for each class, which most sets of a group have in common
            apart = apart.join(apart.groupBy("cls").agg(F.min("sig").alias("sig")).select("sig").distinct(), "sig")
        members = apart.join(comp.select("cls", "n", "bits"), "cls").select("sig", "cls", "comp", "n", "bits")
        pairs = written(candidates(members, whole).distinct().join(tested, ["x", "y"], "left_anti"), "pairs")
        tested = tested.union(pairs)
        links = written(links.union(verified(pairs, sets)), "links")
    c = components(links).toDF("cls", "component")
    heads = small(written(smallest(names.join(c, "cls"), "component"), "heads"), BROADCAST_ROWS)
    return told, names, c.join(heads, "component").drop("component")


def smallest(named: DataFrame, by: str) -> DataFrame:
    """doc_id, stand_in and key of the smallest name in each group: the smallest doc_id, or where there is none the smallest stand-in."""
    g = named.groupBy(by).agg(F.min("doc_id").alias("doc_id"), F.min(F.when(F.col("stand_in"), F.col("key"))).alias("other"))
    return g.select(by, "doc_id", F.col("doc_id").isNull().alias("stand_in"), F.coalesce("doc_id", "other").alias("key"))


def join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    told, names, heads = grouped(documents)
    found = names.select("cls", F.col("doc_id").alias("own")).join(heads.select("cls", F.col("doc_id").alias("head"), F.lit(True).alias("linked")), "cls", "left")
    found = found.select("cls", F.when(F.col("linked"), F.col("head")).otherwise(F.col("own")).alias("component_id"))
    out = told.join(found, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(documents: DataFrame) -> DataFrame:
    """One row of each group, all columns as they are: that of the smallest doc_id, or of the smallest stand-in where no row of the group has one. Texts without shingles are linked with nothing: each such row without a doc_id stays, and one of those that share a doc_id."""
    told, names, heads = grouped(documents)
    chosen = names.join(heads, "cls", "left_anti").unionByName(heads).select("stand_in", "key").distinct()
    own = told.select(F.col("doc_id").isNull().alias("stand_in"), "key", "cls")
    n = own.groupBy("stand_in", "key").agg(F.count(F.lit(1)).alias("n"), F.count("cls").alias("full"))
    alone = n.where("full = 0").select("stand_in", "key", ((F.col("n") > 1) & ~F.col("stand_in")).alias("again"))
    rest = n.where("full > 0").join(chosen, ["stand_in", "key"], "left_semi").select("stand_in", "key", (F.col("n") > 1).alias("again"))
    kept = small(written(alone.unionByName(rest), "kept"), BROADCAST_ROWS)
    rows = documents.select(F.struct(*documents.columns).alias("row"), row_key().alias("k")).select("row", "k.stand_in", "k.key").join(kept, ["stand_in", "key"])
    once = rows.where(~F.col("again")).select("row.*")
    if kept.where("again").isEmpty():
        return once
    return once.unionByName(rows.where("again").dropDuplicates(["stand_in", "key"]).select("row.*"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
