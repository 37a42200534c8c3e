"""Where citations stand in a text: fuzzy windows, heads and tails of ranges, and windows around given positions.

A citation is looked for in the text that it belongs to, so rows are texts, each with its citations, and nothing is
compared across texts. All windows of a text are bounded at once: by lengths, then by the longest common subsequence
(bit-parallel over all windows), which no likeness can exceed; what may still reach the threshold is matched by the
alignment kernel. So the result is that of comparing every window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentences import PASSED_OVER, in_steps

#: What a window has beyond the citation, its threshold and how many matches count; the same of ranges; the
#: characters on either side of a position, its threshold, and what makes a match sure.
WIDER, LEAST, BEST = 15, 0.7, 10
RANGE_BEST, RANGE, RANGE_TIMES, SHOWN, SURE = 5, 300, 20, 80, 0.9
AROUND, AROUND_LEAST = 10, 0.75
#: Windows that are bounded together, and windows of patterns where all patterns of a text are.
TOGETHER, CELLS = 20_000, 1 << 16
#: Characters of windows and citations of a batch that are matched together.
MATCHED = 1 << 20


class Text:
    """A text whose windows are compared."""

    def __init__(self, text: str):
        self.text = text
        self.code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kept = np.ones(len(text), bool)
        for m in PASSED_OVER.finditer(text):
            kept[m.start()] = False
        self.kept, self.before = kept, np.concatenate([[0], np.cumsum(kept)])

    def common(self, pattern: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest common subsequence of the pattern and each window: zero bits of a row of words that takes the windows' characters one by one."""
        letters = {c: k for k, c in enumerate(sorted(set(pattern)))}
        words = -(-len(pattern) // 64)
        mask = np.zeros((len(letters) + 1, words), np.uint64)
        for i, c in enumerate(pattern):
            mask[letters[c], i // 64] |= np.uint64(1 << (i % 64))
        known = np.array([ord(c) for c in sorted(set(pattern))], np.uint32)
        at = np.minimum(np.searchsorted(known, self.code), len(known) - 1)
        index = np.append(np.where((known[at] == self.code) & self.kept, at, len(letters)), len(letters))
        out = np.empty(len(begin), np.int64)
        for i in range(0, len(begin), TOGETHER):
            b, e = begin[i : i + TOGETHER], end[i : i + TOGETHER]
            v = np.full((words, len(b)), ~np.uint64(0))
            for s in range(int((e - b).max(initial=0))):
                u = v & mask[index[np.where(b + s < e, b + s, len(self.code))]].T
                carry = np.zeros(len(b), np.uint64)
                for w in range(words):
                    one = v[w] + u[w]
                    over = one < u[w]
                    two = one + carry
                    carry = (over | (two < carry)).astype(np.uint64)
                    v[w] = two | (v[w] - u[w])
            ones = np.bitwise_count(v).astype(np.int64).sum(0)
            out[i : i + TOGETHER] = 64 * words - ones
        return out

    def may_reach(self, patterns: list[str], begin: np.ndarray, end: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (pattern, window) whose longest common subsequence allows a likeness of `least`, for clean patterns of 1 to 64 characters. All pairs take a step together: a row of words is a window, a word of it a pattern."""
        known = np.array(sorted({ord(c) for p in patterns for c in p}), np.uint32)
        word = np.uint32 if max(map(len, patterns)) <= 32 else np.uint64
        mask = np.zeros((len(known) + 1, len(patterns)), word)
        sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
        letter = np.searchsorted(known, np.frombuffer("".join(patterns).encode("utf-32-le", "surrogatepass"), np.uint32))
        of = np.repeat(np.arange(len(patterns)), sizes)
        bit = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        np.bitwise_or.at(mask, (letter, of), word(1) << bit.astype(word))
        at = np.minimum(np.searchsorted(known, self.code), len(known) - 1)
        index = np.append(np.where((known[at] == self.code) & self.kept, at, len(known)), len(known)) if len(self.code) else np.array([len(known)])
        some = max(1, CELLS // len(patterns))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i in range(0, len(begin), some):
            b, e = begin[i : i + some], end[i : i + some]
            v = np.full((len(b), len(patterns)), ~word(0))
            for s in range(int((e - b).max(initial=0))):
                u = mask[index[np.where(b + s < e, b + s, len(self.code))]]
                u &= v
                left = v ^ u
                v += u
                v |= left
            most = v.itemsize * 8 - np.bitwise_count(v).astype(np.int64)
            total = (self.before[e] - self.before[b])[:, None] + sizes
            window, pattern = np.nonzero(reach_of(most, total, least))
            found.append((pattern, window + i))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def likeness(self, pattern: str, begin: np.ndarray, end: np.ndarray, least: float) -> np.ndarray:
        """The likeness of the pattern and each window where it is `least` or more, else -1."""
        pattern = PASSED_OVER.sub("", pattern)
        size = self.before[end] - self.before[begin]
        total = len(pattern) + size
        if not pattern:
            return np.where(size == 0, 1.0, -1.0 if least > 0 else 0.0)
        reach = lambda most: np.round(2 * most / total, 4) >= least
        out = np.full(len(begin), -1.0)
        some = np.flatnonzero(reach(np.minimum(size, len(pattern))))
        some = some[reach_of(self.common(pattern, begin[some], end[some]), total[some], least)] if len(some) else some
        found = in_steps([pattern] * len(some), [PASSED_OVER.sub("", self.text[i:j]) for i, j in zip(begin[some].tolist(), end[some].tolist(), strict=True)])
        out[some] = np.where(found >= least, found, -1.0)
        return out


def reach_of(most: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    return np.round(2 * most / total, 4) >= least


def apart(positions: list[int], width: int) -> list[int]:
    """The indexes of positions that are `width` or more from all that were taken before them, in the given order."""
    cells: dict[int, list[int]] = {}
    out = []
    for k, p in enumerate(positions):
        c = p // width
        if all(abs(p - x) >= width for d in (-1, 0, 1) for x in cells.get(c + d, ())):
            cells.setdefault(c, []).append(p)
            out.append(k)
    return out


def window_matches(t: Text, citation: str, wider: int = WIDER, least: float = LEAST, most: int | None = BEST) -> list[tuple[int, float, str]]:
    """Position (from 1), likeness and text of the windows that are like a citation of 3 characters or more, best first; of windows less than `wider` apart the first."""
    clean = PASSED_OVER.sub("", citation)
    n = len(clean)
    if n < 3 or not len(t.code):
        return []
    begin = np.arange(0, len(t.code) - min(n, len(t.code)) + 1, max(1, wider // 3))
    sim = t.likeness(clean, begin, np.minimum(begin + n + wider, len(t.code)), least)
    hit = np.flatnonzero(sim >= least)
    hit = hit[apart(begin[hit].tolist(), wider)]
    found = [(int(begin[k]) + 1, float(sim[k]), t.text[begin[k] : begin[k] + n]) for k in hit.tolist()]
    return sorted(found, key=lambda m: -m[1])[:most]


def range_matches(t: Text, head: str, tail: str, wider: int = WIDER, least: float = LEAST, most: int | None = RANGE_BEST) -> list[tuple[int, float, str]]:
    """A range that begins as head and ends as tail: heads by their first characters, else by likeness; for each the tail of 0.9 or more that is farthest within the span, else the likest (of equals the farthest)."""
    head, tail = head.strip(), tail.strip()
    h, e, size = len(head), len(tail), len(t.code)
    if h < 2 or e < 2:
        return []
    first = head[: min(5, max(3, h // 2))]
    places, i = [], t.text.find(first)
    while i >= 0:
        places.append(i)
        i = t.text.find(first, i + 1)
    if not places:
        begin = np.arange(0, size - h + 1, max(1, h // 2))
        places = begin[t.likeness(head, begin, begin + h, least) >= least].tolist() if len(begin) else []
    begin = np.array(places, np.int64)
    sims = t.likeness(head, begin, np.minimum(begin + h, size), least)
    found = []
    for p, sim in zip(places, sims.tolist(), strict=True):
        if sim < least:
            continue
        last = min(p + max(RANGE, h * RANGE_TIMES), size)
        ends = np.arange(last - e, p + h, -1)
        like = t.likeness(tail, ends, ends + e, least) if len(ends) else np.zeros(0)
        if not len(like) or like.max() < least:
            continue
        good = np.flatnonzero(like >= SURE)
        k = int(good[0]) if len(good) else int(like.argmax())
        whole = t.text[p : ends[k] + e]
        found.append((p + 1, round((sim + float(like[k])) / 2, 4), whole[:SHOWN] + ("..." if len(whole) > SHOWN else "")))
    found = [found[k] for k in apart([m[0] for m in found], wider)]
    return sorted(found, key=lambda m: -m[1])[:most]


def matches(t: Text, citation: str) -> list[tuple[int, float, str]]:
    parts = citation.split("...")
    if len(parts) == 1:
        return window_matches(t, citation)
    return range_matches(t, *(PASSED_OVER.sub("", p) for p in parts)) if len(parts) == 2 else []


def _mapped(rows: DataFrame, find: Callable[[Text, dict], list[tuple]], fields: str) -> DataFrame:
    """Rows of a text (key, text, asked) to rows of what find returns for each thing asked; key and id go along."""
    names = ["key", "id", *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for key, text, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = Text(text or "")
                for a in asked:
                    for found in find(t, a):
                        for column, v in zip(out, (key, a["id"], *found), strict=True):
                            column.append(v)
            types = [b.schema.field(0).type, b.schema.field(2).type.value_type.field("id").type, *({"int": pa.int32(), "double": pa.float64(), "string": pa.string()}[f.split()[1]] for f in fields.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    kinds = dict(rows.dtypes)
    of = rows.schema["asked"].dataType.elementType["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kinds['key']}, id {of}, {fields}")


def asked(texts: DataFrame, citations: DataFrame, *more: str) -> DataFrame:
    """Texts (key, text) with the array of their citations (key, id, citation, ...): the citations of one text are one row's."""
    own = citations.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "citation", *more))).alias("asked"))
    return texts.join(own, "key").select("key", "text", "asked")


def find_citations(texts: DataFrame, citations: DataFrame) -> DataFrame:
    """Key, id, rank, position, similarity and matched of the best places of each citation (key, id, citation) in its text; "..." in a citation makes it a range."""
    find = lambda t, a: [(k, *m) for k, m in enumerate(matches(t, a["citation"] or ""), 1)]
    return _mapped(asked(texts, citations), find, "rank int, position int, similarity double, matched string")


def citations_at(texts: DataFrame, citations: DataFrame, positions: DataFrame, around: int = AROUND, least: float = AROUND_LEAST) -> DataFrame:
    """Key, id, position (from 0), similarity, confidence and matched: the citations that are like what stands around positions (key, position) of their text."""
    at = positions.groupBy("key").agg(F.array_sort(F.collect_set("position")).alias("at"))
    both = asked(texts, citations).join(at, "key")
    kinds = dict(both.dtypes)
    of = both.schema["asked"].dataType.elementType["id"].dataType.simpleString()
    names = ["key", "id", "position", "similarity", "confidence", "matched"]

    def near(t: Text, citations: list[str], p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Pairs (citation, position) that may be alike, and the windows and clean citations."""
        begin, end = np.maximum(p - around, 0), np.minimum(p + around + 1, len(t.code))
        clean = [PASSED_OVER.sub("", c) for c in citations]
        sizes = np.fromiter(map(len, clean), np.int64, len(clean))
        window = t.before[end] - t.before[begin]
        c, w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        some = np.flatnonzero((sizes > 0) & (sizes <= 64))
        if len(some):
            x, y = t.may_reach([clean[k] for k in some.tolist()], begin, end, least)
            c.append(some[x])
            w.append(y)
        for k in np.flatnonzero((sizes == 0) | (sizes > 64)).tolist():  # by lengths alone; these are few
            y = np.flatnonzero(reach_of(np.minimum(window, sizes[k]), window + sizes[k], least) if sizes[k] else (window == 0) | (least <= 0))
            c.append(np.full(len(y), k))
            w.append(y)
        c, w = np.concatenate(c), np.concatenate(w)
        order = np.lexsort((w, c))
        return c[order], w[order], begin, end, clean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b.schema.field(0).type, b.schema.field(2).type.value_type.field("id").type, pa.int32(), pa.float64(), pa.string(), pa.string()]
            rows: list[tuple] = []
            size = 0

            def matched(rows: list[tuple], types: list = types) -> pa.RecordBatch:
                sims = in_steps([r[4] for r in rows], [PASSED_OVER.sub("", r[3]) for r in rows]).tolist()
                found = [(key, id_, at, s, "high" if s >= SURE else "medium", text) for (key, id_, at, text, _), s in zip(rows, sims, strict=True) if s >= least]
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [[]] * len(types), types, strict=True)], names)

            for key, text, own, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = Text(text or "")
                p = np.array(places, np.int64)
                p = p[(p >= 0) & (p < max(1, len(t.code)))]
                c, w, begin, end, clean = near(t, [a["citation"] or "" for a in own], p)
                for k, i, j, q in zip(c.tolist(), begin[w].tolist(), end[w].tolist(), p[w].tolist(), strict=True):
                    rows.append((key, own[k]["id"], q, t.text[i:j], clean[k]))
                    size += j - i + len(clean[k])
                if size > MATCHED:
                    yield matched(rows)
                    rows, size = [], 0
            yield matched(rows)

    return both.select("key", "text", "asked", "at").mapInArrow(run, f"key {kinds['key']}, id {of}, position int, similarity double, confidence string, matched string")
