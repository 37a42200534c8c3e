"""Byte-level BPE by merge replay.

Every task takes its share of the corpus in blocks, cuts the texts into words and gathers those it has not met before. The
merges are then replayed over the pieces of all of these words at once: an inverted index leads from the rank of a token
pair to the positions where the pair stands, ranks are applied in ascending order, and a merge touches only its two
neighbours. A word is encoded once a task, whatever its number of uses (again only after KEPT bytes of others), and
words are independent of each other, so shares give what one replay over the whole corpus would give, without a shuffle.
What uses a word are gathers of whole blocks in Arrow and numpy.

Nulls and edge cases: a null text is an empty text (no tokens); special tokens do not exist, their strings are text;
texts and pieces of any length are encoded whole; repeated rows are encoded each; an empty table gives no rows; extra
columns pass through, but a column ids is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import frugal, slices, table

NEVER = np.iinfo(np.int32).max
#: Bytes of words that a task remembers, about; bytes of text that it encodes at a time, unless one text has more.
KEPT, BLOCK = 48 << 20, 4 << 20


class Ranks:
    """A vocabulary in the rank format: a line for each token, base64 bytes and rank."""

    def __init__(self, lines: bytes):
        self.rank = rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        self.token = {r: t for t, r in rank.items()}
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {}  # of two adjacent tokens to the rank of the token that they make
        for t, r in rank.items():
            for i in range(1, len(t)):
                x, y = rank.get(t[:i]), rank.get(t[i:])
                if x is not None and y is not None:
                    pairs[x << 32 | y] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        x, y = np.repeat(self.single, 256), np.tile(self.single, 256)
        self.first = self.of(x, y)  # of two bytes

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the token that two adjacent tokens make, NEVER if there is none (or where one of them is none)."""
        key = x.astype(np.int64) << 32 | y
        if not len(self.keys):
            return np.full(len(key), NEVER, np.int32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (y >= 0), self.values[at], NEVER)


def replay(pieces: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all pieces, one after the other, and the number of each piece's: all merges of all pieces, in rank order, through an inverted index from the rank of a pair to its positions."""
    whole = np.array([ranks.rank.get(p, -1) for p in pieces], np.int32)
    rest = np.flatnonzero(whole < 0)
    own = [pieces[i] for i in rest.tolist()]
    size = np.array([len(p) for p in own], np.int64)
    data = np.frombuffer(b"".join(own), np.uint8)
    n = len(data) + len(own) + 1  # a mark before the first piece and after each
    piece = np.repeat(np.arange(len(own) + 1), np.concatenate([[1], size + 1])) - 1
    where = np.arange(len(data)) + np.repeat(np.arange(len(own)), size) + 1
    sym = np.full(n, -1, np.int32)
    sym[where] = ranks.single[data]
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    made = np.full(n, NEVER, np.int32)  # the rank of the pair that begins at a position
    inner = np.flatnonzero(np.diff(where) == 1)
    made[where[inner]] = ranks.first[data[inner].astype(np.int64) << 8 | data[inner + 1]]
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        r = made[at]
        at, r = at[r < NEVER], r[r < NEVER]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        edges = [0, *cuts.tolist(), len(r)]
        for k, i, j in zip(r[edges[:-1]].tolist() if len(r) else [], edges, edges[1:], strict=False):
            if k in index:
                index[k].append(at[i:j])
            else:
                index[k] = [at[i:j]]
                heappush(heap, k)

    enter(where)
    while heap:
        r = heappop(heap)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[made[at] == r]
        if not len(at):
            continue
        new = np.full(len(at), r, np.int32)
        after = nxt[at]
        if len(at) > 1 and (again := at[1:] == after[:-1]).any():  # pairs that share a token: every other one of a chain
            place = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(np.concatenate([[False], again]), 0, place))
            stay = (place - begin) & 1 == 0
            at, after, new = at[stay], after[stay], new[stay]
        left, right = ranks.of(sym[prv[at]], new), ranks.of(new, sym[nxt[after]])
        lower = np.minimum(left, right) < r
        side = nxt[after][:-1] == at[1:]  # merges next to each other
        if side.any() and ranks.of(new[:1], new[:1])[0] < r:
            lower[1:] |= side
        if lower.any():  # a pair of lower rank comes up in these pieces and goes first: one merge at a time
            held = np.isin(piece[at], piece[at[lower]])
            held[np.unique(piece[at], return_index=True)[1]] = False
            if held.any():
                index[r] = [at[held]]
                heappush(heap, r)
                at, after, new, left, right = (x[~held] for x in (at, after, new, left, right))
                side = nxt[after][:-1] == at[1:]
        far = nxt[after]
        sym[at], sym[after], made[after] = r, -2, NEVER
        nxt[at], prv[far] = far, at
        near = prv[at]
        made[at], made[near] = right, left
        if side.any():
            both = at[:-1][side]
            made[both] = ranks.of(sym[both], sym[nxt[both]])
        enter(np.concatenate([at, near]))
    kept = np.flatnonzero(sym >= 0)
    count = np.ones(len(pieces), np.int64)
    count[rest] = np.bincount(piece[kept], minlength=len(own))[: len(own)]
    end = np.cumsum(count)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint32)
    plain = np.ones(len(out), bool)
    plain[(end - count)[whole >= 0]] = False
    out[plain] = sym[kept]
    out[~plain] = whole[whole >= 0]
    return out, count


def gathered(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of flat that `which` names, one after the other; size: of each run."""
    n = size[which]
    end = np.cumsum(n)
    if not len(n) or not end[-1]:
        return flat[:0]
    return flat[np.repeat((np.cumsum(size) - size)[which] - (end - n), n) + np.arange(end[-1])]


class Encoder:
    """Encodes blocks of texts. A text is cut before each space into words (white space and what follows it up to the next space), which the pattern never joins; each distinct word of a block is looked up once, new ones are cut by the pattern and replayed together."""

    def __init__(self, ranks: Ranks, pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.gap, self.words = regex.compile(r"\s").match, regex.compile(r"\s*\S+|\s+").findall
        most = max(ranks.token)
        self.tokens = pa.array([ranks.token.get(i, b"") for i in range(most + 1)], pa.binary())
        self.lengths = np.array([len(ranks.token.get(i, b"")) for i in range(most + 1)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # word to its number
        self.ids, self.sizes, self.edges, self.held = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], 0

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word; new words are encoded."""
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            # words of a space and no other white space stay apart when they stand in a row
            spaced: list[str] = []
            other: list[str] = []
            for w in new:
                (spaced if w[:1] == " " and len(w.split()) == 1 and len(w.strip()) == len(w) - 1 else other).append(w)
            pieces = self.find("".join(spaced))
            begins = np.searchsorted(np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced))), side="right")
            cut = [self.find(w) for w in other]
            for own in cut:
                pieces += own
            size = np.concatenate([np.diff(begins, prepend=0), np.fromiter(map(len, cut), np.int64, len(cut))])
            # 1: begins (after its space) with white space, or is a space alone; 2: ends with white space
            edge = [(len(w) < 2 or self.gap(w[1]) is not None) + 2 * (w != "" and self.gap(w[-1]) is not None) for w in other]
            self.edges.append(np.concatenate([np.zeros(len(spaced), np.uint8), np.array(edge, np.uint8)]))
            known.update(zip(spaced, range(len(known), len(known) + len(spaced)), strict=True))
            known.update(zip(other, range(len(known), len(known) + len(other)), strict=True))
            self.held += 2 * sum(map(len, new)) + 100 * len(new)
            coded = pa.array(pieces, pa.string()).dictionary_encode()
            which = coded.indices.to_numpy().astype(np.int64)
            ids, count = replay([p.encode() for p in coded.dictionary.to_pylist()], self.ranks)
            self.ids.append(gathered(ids, count, which))
            total = np.concatenate([[0], np.cumsum(count[which])])
            end = np.cumsum(size)
            self.sizes.append(total[end] - total[end - size])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, text after text, and where each text's begin (one more offset than texts). Null: no ids."""
        if self.held > KEPT:
            self.forget()
        texts = texts.cast(pa.string()).fill_null("")
        cut = pc.split_pattern(texts, " ")
        at = cut.offsets.to_numpy().astype(np.int64)
        at, flat = at - at[0], cut.values.slice(cut.offsets[0].as_py(), at[-1] - at[0])
        first = np.zeros(len(flat), bool)
        first[at[:-1]] = True
        number = np.empty(len(flat), np.int64)
        coded = flat.filter(pa.array(~first)).dictionary_encode()
        number[~first] = self.numbers([" " + w for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy()] if len(coded) else 0
        coded = flat.filter(pa.array(first)).dictionary_encode()
        number[first] = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else 0
        edge = np.concatenate(self.edges)[number]
        odd = np.zeros(len(flat), bool)  # a run of white space across two words
        odd[1:] = (edge[1:] & 1 == 1) & (edge[:-1] & 2 == 2) & ~first[1:]
        texts_odd = np.unique(np.searchsorted(at, np.flatnonzero(odd), side="right") - 1)
        own = {k: self.numbers(self.words(texts[k].as_py())) for k in texts_odd.tolist()}
        if own:
            parts, last = [], 0
            for k, n in own.items():
                parts += [number[at[last] : at[k]], n]
                last = k + 1
            sizes = np.diff(at)
            sizes[list(own)] = [len(n) for n in own.values()]
            number = np.concatenate([*parts, number[at[last] :]])
            at = np.concatenate([[0], np.cumsum(sizes)])
        self.ids, self.sizes, self.edges = ([np.concatenate(x)] for x in (self.ids, self.sizes, self.edges))
        end = np.concatenate([[0], np.cumsum(self.sizes[0][number])])
        out = gathered(self.ids[0], self.sizes[0], number)
        return out, end[at]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        got = self.tokens.take(pa.array(ids))
        _, offsets, data = got.buffers()
        lo, hi = np.frombuffer(offsets, np.int32)[[got.offset, got.offset + len(got)]]
        return np.frombuffer(data, np.uint8)[lo:hi]


def _encoder(lines: bytes, pattern: str, made: dict = {}) -> Encoder:  # noqa: B006  one for each worker process
    key = (len(lines), hashlib.sha256(lines).digest(), pattern)
    if key not in made:
        made.clear()
        made[key] = Encoder(Ranks(lines), pattern)
    return made[key]


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """A vocabulary file (under 1 MB, read by the driver) and the pattern that cuts texts for it."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encode(documents: DataFrame, lines: bytes, pattern: str, text: str = "text", digest: bool = False, block: int = BLOCK) -> DataFrame:
    """The rows with a column ids (array of int; a column of that name is replaced); or, with digest, doc_id and hashes of the ids and of what they decode to. Smaller blocks take less memory and more time."""
    shared = documents.sparkSession.sparkContext.broadcast((lines, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(*shared.value)
        for b in slices(batches, 2000, block):
            ids, at = coder.encode(b.column(b.schema.get_field_index(text)))
            if digest:
                back, raw = coder.decode(ids), ids.astype("<u4").tobytes()
                ends = np.concatenate([[0], np.cumsum(coder.lengths[ids])])[at]
                of = lambda data, lo, hi: pa.array([hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index("doc_id")), pa.array(np.diff(at)), of(raw, 4 * at[:-1], 4 * at[1:]), of(back.data, ends[:-1], ends[1:])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "ids"])
        coder.forget()

    if digest:
        return documents.select("doc_id", text).mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    rest = documents.drop("ids")
    return rest.mapInArrow(frugal(run), T.StructType([*rest.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, lines: bytes, pattern: str) -> DataFrame:
    """doc_id and decoded (binary) of rows with a column ids (null: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast((lines, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(*shared.value)
        for b in slices(batches, 2000, BLOCK):
            got = [coder.decode(np.array(x or [], np.uint32)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(frugal(run), "doc_id long, decoded binary")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), *vocabulary(), digest=True)
