"""Alignment of two tokenizers' tokens over a corpus.

A block of texts is encoded by both, its tokens' bytes are laid end to end, and the ends of either tokenizer's tokens are
counted by byte with bincount; a byte where both count is a cut. Cuts part the tokens into groups, and all tokens of a
group are linked with each other. What belongs to one text is recovered by prefix sums that are read at the texts' edges.
How many texts hold an id pair is counted over the corpus; the frequent pairs, a bounded number of them, are looked up in
the tasks, the others by a shuffled join.

Tokenizer A cuts a text by a pattern and merges by rank, B is a sentencepiece model. B's pieces never hold the mark of a
space behind another character (else texts are encoded whole), so its words are encoded once a block.

Nulls and edge cases: texts that are null, empty, or that a tokenizer does not give back byte by byte (after one space)
have no tokens, no links and an empty digest; texts of any length are encoded whole; a group whose links would be many is
counted by distinct ids, not expanded; repeated rows, and rows that share a doc_id or have none, are texts of their own,
each with a row and each counted; ties for an id's best partner all count; an empty table gives no rows; extra columns
may have any names and are passed over. Results do not depend on blocks or on the number of frequent pairs.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, slices, table, written

#: Bytes of text that are encoded at a time, unless one text has more.
BLOCK = 2 << 20
#: Links of one group up to which they are expanded, and id pairs up to which a task gathers counts.
EXPANDED, GATHERED = 1 << 12, 1 << 21
#: Pairs at most that tasks look up in place; all others are joined.
FREQUENT = 1 << 20
#: Bits of an id in a pair; what is above both in 63 bits numbers the texts of a block.
BITS, ROWS = 24, 2000


def byte_of(mark: str, made: dict = {}) -> int:  # noqa: B006  one table
    """The byte that a character of a byte-level vocabulary stands for: printable bytes stand for themselves, the others in order for what follows U+0100."""
    if not made:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        made.update({chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)})
    return made[mark]


class Tokenizers:
    """Both tokenizers of a task, and the bytes of their tokens."""

    def __init__(self, bpe: str, model: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        entries = json.loads(bpe)["model"]["vocab"]
        self.rank = {bytes(map(byte_of, t)): i for t, i in entries.items()}
        self.pattern = pattern
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=self.rank, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.bytes_a = self.tokens({i: t for t, i in self.rank.items()})
        self.bytes_b = self.tokens({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)})
        self.size_a, self.size_b = (np.diff(x.offsets_np) for x in (self.bytes_a, self.bytes_b))
        most = max(len(self.size_a), len(self.size_b))
        #: Every id in decimal, followed by a comma, then by a bar, then by a semicolon.
        self.numerals = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(most)], pa.large_string())
        self.slow = None

    @staticmethod
    def tokens(by_id: dict[int, bytes]):
        class Table:
            array = pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.large_binary())
            offsets_np = np.frombuffer(array.buffers()[1], np.int64)[: len(array) + 1]

        return Table

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            try:
                out.append(np.asarray(self.a.encode_to_numpy(" " + t)).astype(np.int64))
            except ValueError:  # runs of white space that the library's pattern engine gives up on
                from .byte_bpe import Encoder, Ranks

                if self.slow is None:
                    self.slow = Encoder(Ranks(b"\n".join(base64.b64encode(k) + b" %d" % v for k, v in self.rank.items())), self.pattern)
                out.append(self.slow.encode(pa.array([" " + t]))[0].astype(np.int64))
        return out

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        """Texts of single spaces are cut at them, and each distinct word of the block is encoded once."""
        spaced = [self.apart and t != "" and t[0] != " " and t[-1] != " " and "  " not in t for t in texts]
        whole = iter(self.b.encode([t for t, s in zip(texts, spaced, strict=True) if not s], num_threads=1))
        cut = pc.split_pattern(pa.array([t for t, s in zip(texts, spaced, strict=True) if s], pa.large_string()), " ")
        at = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.dictionary_encode()
        ids = self.b.encode(coded.dictionary.to_pylist(), num_threads=1)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(size.sum()))
        which = coded.indices.to_numpy().astype(np.int64)
        n = size[which]
        end = np.concatenate([[0], np.cumsum(n)])
        got = flat[np.repeat((np.cumsum(size) - size)[which] - end[:-1], n) + np.arange(end[-1])] if len(n) else flat
        edge = end[at]
        k, out = 0, []
        for s in spaced:
            if s:
                out.append(got[edge[k] : edge[k + 1]])
                k += 1
            else:
                out.append(np.array(next(whole), np.int64))
        return out


def _tokenizers(bpe: str, model: bytes, pattern: str, made: dict = {}) -> Tokenizers:  # noqa: B006  one for each worker process
    key = hashlib.sha256(b"\0".join((bpe.encode(), model, pattern.encode()))).digest()
    if key not in made:
        made.clear()
        made[key] = Tokenizers(bpe, model, pattern)
    return made[key]


def vocabularies(bpe: str = "byte_bpe_50k.json", model: str = "piece_bpe_32k.model") -> tuple[str, bytes, str]:
    """Both vocabulary files (a few MB, read by the driver) and the pattern that cuts texts for the first."""
    import public_tokenizers

    with open(public_tokenizers.path(bpe), encoding="utf-8") as f, open(public_tokenizers.path(model), "rb") as g:
        return f.read(), g.read(), public_tokenizers.PATTERN


def joined(ids: np.ndarray, tokens) -> np.ndarray:
    """The bytes of all tokens, one after the other."""
    got = tokens.array.take(pa.array(ids))
    if not len(got):
        return np.zeros(0, np.uint8)
    _, offsets, data = got.buffers()
    edge = np.frombuffer(offsets, np.int64)[got.offset : got.offset + len(got) + 1]
    return np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None else np.zeros(0, np.uint8)


class Aligned:
    """A block of texts: tokens of both sides, the group of each token, and prefix sums over them."""

    def __init__(self, texts: list[str | None], with_: Tokenizers):
        texts = [t or "" for t in texts]
        raw = [b" " + t.encode() if t else b"" for t in texts]
        a, b = with_.encode_a(texts), with_.encode_b(texts)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        # texts that either side does not give back have no tokens
        held = []
        for k, t in enumerate(raw):
            fits = size[k] > 0 and with_.size_a[a[k]].sum() == size[k] == with_.size_b[b[k]].sum()
            if fits:
                own = np.frombuffer(t, np.uint8)
                fits = np.array_equal(joined(a[k], with_.bytes_a), own) and np.array_equal(joined(b[k], with_.bytes_b), own)
            held.append(bool(fits))
        none = np.zeros(0, np.int64)
        a, b = ([x if h else none for x, h in zip(side, held, strict=True)] for side in (a, b))
        size = size * np.array(held, bool)
        self.edge_a, self.edge_b = (np.concatenate([[0], np.cumsum(np.fromiter(map(len, x), np.int64, len(x)))]) for x in (a, b))
        self.a, self.b = (np.concatenate([none, *x]) for x in (a, b))
        total = int(size.sum())
        end_a, end_b = np.cumsum(with_.size_a[self.a]), np.cumsum(with_.size_b[self.b])
        cut = (np.bincount(end_a, minlength=total + 1) > 0) & (np.bincount(end_b, minlength=total + 1) > 0)
        before = np.cumsum(cut) - cut  # cuts before a byte
        self.group_a, self.group_b = before[end_a], before[end_b]
        n = int(cut.sum())
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.groups = np.concatenate([[0], np.cumsum(cut)])[np.concatenate([[0], np.cumsum(size)]) + 1]  # groups before each text
        self.links = np.concatenate([[0], np.cumsum(self.in_a * self.in_b)])

    def written(self, with_: Tokenizers) -> tuple[np.ndarray, np.ndarray]:
        """The groups as text, and where each text's begin (and end): all tokens in order, A's before B's in a group, each with the mark that follows it."""
        n = max(len(with_.size_a), len(with_.size_b))
        before_a, before_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        place_a = np.arange(len(self.a)) + before_b[self.group_a]
        place_b = np.arange(len(self.b)) + (before_a + self.in_a)[self.group_b]
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[place_a], order[place_b] = self.a, self.b
        order[place_a[np.cumsum(self.in_a) - 1]] += n
        order[place_b[np.cumsum(self.in_b) - 1]] += 2 * n
        got = with_.numerals.take(pa.array(order))
        if not len(got):
            return np.zeros(0, np.uint8), np.zeros(len(self.edge_a), np.int64)
        _, offsets, data = got.buffers()
        edge = np.frombuffer(offsets, np.int64)[got.offset : got.offset + len(got) + 1]
        return np.frombuffer(data, np.uint8), edge[self.edge_a + self.edge_b]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair (A's id above the 24 bits of B's) and number of links of every pair that a text holds linked; ascending."""
        text_of = np.repeat(np.arange(len(self.groups) - 1), np.diff(self.groups)) << 2 * BITS
        links = self.in_a * self.in_b
        at_a, at_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        some, many = np.flatnonzero(links <= EXPANDED), np.flatnonzero(links > EXPANDED)
        n = links[some]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        of, wide = np.repeat(some, n), np.repeat(self.in_b[some], n)
        keys = [text_of[of] | self.a[at_a[of] + nth // wide] << BITS | self.b[at_b[of] + nth % wide]]
        times = [np.ones(len(of) if len(many) else 0, np.int64)]
        for g in many.tolist():
            x, many_x = np.unique(self.a[at_a[g] : at_a[g] + self.in_a[g]], return_counts=True)
            y, many_y = np.unique(self.b[at_b[g] : at_b[g] + self.in_b[g]], return_counts=True)
            keys.append((text_of[g] | x[:, None] << BITS | y[None, :]).ravel())
            times.append((many_x[:, None] * many_y[None, :]).ravel())
        key = np.concatenate(keys)
        if len(many):
            order = np.argsort(key)
            key, weight = key[order], np.concatenate(times)[order]
        else:
            key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.add.reduceat(weight, first) if len(many) else np.diff(np.append(first, len(key)))
        key = key[first]
        return key >> 2 * BITS, key & ((1 << 2 * BITS) - 1), count


MEASURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def linked(documents: DataFrame, files: tuple[str, bytes, str], text: str = "text") -> DataFrame:
    """row (names a row of this result), the measures of a text, and its distinct linked id pairs (array of long, ascending) with the number of links of each. To be written before row is used: it numbers the rows of a task."""
    shared = documents.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = _tokenizers(*shared.value), TaskContext.get().partitionId() << 40
        for b in slices(batches, ROWS, BLOCK):
            found = Aligned(b.column(1).to_pylist(), coder)
            chars, edge = found.written(coder)
            digest = [hashlib.sha256(chars[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            who, key, many = found.pairs()
            at = pa.array(np.searchsorted(who, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + b.num_rows)), b.column(0), *(pa.array(np.diff(x)) for x in (found.edge_a, found.edge_b, found.groups, found.links[found.groups])),
                    pa.array(digest, pa.string()), pa.ListArray.from_arrays(at, pa.array(key)), pa.ListArray.from_arrays(at, pa.array(many)),
                ],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )
            row += b.num_rows

    own = documents.select(F.col("doc_id").cast("long"), F.col(text).cast("string"))
    return own.mapInArrow(frugal(run), f"row long, {MEASURES}, pairs array<long>, times array<long>")


def groups(documents: DataFrame, files: tuple[str, bytes, str], text: str = "text") -> DataFrame:
    """doc_id and groups: an array of (a, b), the ids of both sides that share a byte range, in order."""
    shared = documents.sparkSession.sparkContext.broadcast(files)
    kind = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizers(*shared.value)
        for b in slices(batches, ROWS, BLOCK):
            found = Aligned(b.column(1).to_pylist(), coder)
            sides = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(x.astype(np.int32))) for n, x in ((found.in_a, found.a), (found.in_b, found.b))]
            lists = pa.ListArray.from_arrays(pa.array(found.groups.astype(np.int32)), pa.StructArray.from_arrays(sides, fields=list(kind)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "groups"])

    own = documents.select(F.col("doc_id").cast("long"), F.col(text).cast("string"))
    return own.mapInArrow(frugal(run), "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair, n (how many rows hold it), best (whether no other pair of its A id has more), of rows of `linked`. Tasks count before they send; the greatest number of an A id is joined by broadcast, as there is one row an id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, held = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            every, many = np.concatenate(key), np.concatenate(n)
            order = np.argsort(every, kind="stable")
            every, many = every[order], many[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            return every[first], np.add.reduceat(many, first)

        for b in slices(batches, 2000, 16 << 20):
            own, many = np.unique(b.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            key, n, held = [*key, own], [*n, many], held + len(own)
            if held > GATHERED:
                every, many = summed()
                if len(every) > GATHERED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(many)], ["pair", "n"])
                    key, n, held = [], [], 0
                else:
                    key, n, held = [every], [many], len(every)
        if held:
            every, many = summed()
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(many)], ["pair", "n"])

    part = texts.select("pairs").mapInArrow(frugal(run), "pair long, n long")
    total = written(part.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.shiftright("pair", BITS)
    most = total.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return total.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, most: int) -> tuple[int, bool]:
    """The least power of two so that at most `most` pairs have that count or more; and whether there are others."""
    power = F.floor(F.log2("n")).cast("int").alias("power")
    sizes = dict(counts.groupBy(power).agg(F.count(F.lit(1)).alias("k")).collect())  # 63 rows at most
    held, least = 0, 62
    for p in sorted(sizes, reverse=True):
        if held + sizes[p] > most:
            break
        held, least = held + sizes[p], p
    return 1 << least, held < sum(sizes.values())


def collected(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in ascending order, their counts and whether they are best: of as many as tasks may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.cast(pa.int64()).to_numpy().tobytes()]) for x in b.columns], ["pair", "n", "best"])

    parts = counts.mapInArrow(run, "pair binary, n binary, best binary").collect()
    pair, n, best = (np.frombuffer(b"".join(bytes(p[i]) for p in parts), np.int64) for i in range(3))
    order = np.argsort(pair)
    return pair[order], n[order], best[order].astype(bool)


def scored(texts: DataFrame, counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """Rows of `linked` with n_best and count_sum instead of their pairs, by written counts: frequent pairs are looked up in place, what is not found there goes to a join by pair, where no pair is frequent."""
    least, others = frequent(counts, most)
    shared = texts.sparkSession.sparkContext.broadcast(collected(counts.where(F.col("n") >= least)))
    kept = [c for c in texts.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for b in slices(batches, ROWS, 16 << 20):
            lists, times = b.column(len(kept)), b.column(len(kept) + 1).flatten().to_numpy(zero_copy_only=False)
            pair = lists.flatten().to_numpy(zero_copy_only=False)
            edge = lists.offsets.to_numpy().astype(np.int64)
            edge = edge - edge[0]
            here, sums = np.zeros(len(pair), bool), [np.zeros(b.num_rows, np.int64)] * 2
            if len(known):
                at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                here = known[at] == pair
                sums = [np.diff(np.concatenate([[0], np.cumsum(times * here * x[at])])[edge]) for x in (best, n)]
            cut = pa.array(np.concatenate([[0], np.cumsum(~here)])[edge].astype(np.int32))
            rest = [pa.ListArray.from_arrays(cut, pa.array(x[~here])) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *map(pa.array, sums), *rest], [*kept, "n_best", "count_sum", "pairs", "times"])

    schema = f"row long, {MEASURES}, n_best long, count_sum long, pairs array<long>, times array<long>"
    part = texts.select(*kept, "pairs", "times").mapInArrow(frugal(run), schema)
    if not others:
        return part.drop("pairs", "times")
    part = written(part, "pair-scores")
    loose = part.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    got = loose.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    both = part.drop("pairs", "times").join(got, "row", "left")
    more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return both.select(*kept, more("n_best", "more_best"), more("count_sum", "more"))


def align(documents: DataFrame, files: tuple[str, bytes, str], text: str = "text", most: int = FREQUENT) -> DataFrame:
    """A row a text: the measures, n_best and count_sum."""
    texts = written(linked(documents, files, text), "linked-texts")
    counts = written(pair_counts(texts), "pair-table")
    return scored(texts, counts, most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), vocabularies())
