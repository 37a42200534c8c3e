"""Blocks of sentences and definitive punctuation against plain scans."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

from variorum.functions import text as T
from variorum.functions.marks import MARKS, SPACES
from variorum.operators import definitive as D
from variorum.operators import sentence_blocks as B

SENTENCE = re.compile(T.SENTENCE.replace(r"\z", r"\Z"))
FOLD = ("éü", "eu")


def likeness(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    return SequenceMatcher(None, a, b).ratio()


def plain_blocks(a, b):
    """Every block of up to eight sentences tried at each step."""
    one, two = SENTENCE.findall(a), SENTENCE.findall(b)
    clean = [["".join(c for c in s if c not in MARKS + SPACES).translate(str.maketrans(*FOLD)) for s in x] for x in (one, two)]
    i = j = 0
    at = [0, 0]
    out = []

    def add(m, n, sim):
        ends = [at[0] + sum(map(len, clean[0][i : i + m])), at[1] + sum(map(len, clean[1][j : j + n]))]
        kind = f"{m}-to-{n}" if sim is not None else "delete" if m else "insert"
        out.append((len(out) + 1, kind, "".join(one[i : i + m]), "".join(two[j : j + n]), at[0], ends[0], at[1], ends[1], None if sim is None else round(sim, 3), sim is None or sim < 0.95))
        at[:] = ends

    while i < len(one) or j < len(two):
        if i == len(one) or j == len(two):
            add(len(one) - i, len(two) - j, None)
            break
        best = (-1, 0, 0, 0)
        for m in range(1, min(8, len(one) - i) + 1):
            for n in range(1, min(8, len(two) - j) + 1):
                sim = likeness("".join(clean[0][i : i + m]), "".join(clean[1][j : j + n]))
                s = sim + 0.05 * (m == n)
                s += min(m, n) * 0.01 if sim > 0.9 else 0
                s -= abs(m - n) * 0.03
                if i + m < len(one) and j + n < len(two):
                    behind = likeness(clean[0][i + m], clean[1][j + n])
                    s += behind * 0.1 if behind > 0.8 else 0
                if s > best[0]:
                    best = (s, m, n, sim)
        add(*best[1:])
        i, j = i + best[1], j + best[2]
    return out


def words(r, n):
    return " ".join("".join(r.choice("abdeéiklmnoprstuü") for _ in range(r.randint(2, 7))) for _ in range(n))


def edition(r, sentences):
    """Another edition: sentences joined, parted, lost, added and changed."""
    out = []
    for s in sentences:
        what = r.random()
        if what < 0.12:
            s = s[:-1] + ","
        elif what < 0.2:
            s = s.replace(" ", ". ", 1)
        elif what < 0.26:
            s = ""
        elif what < 0.34:
            s += words(r, 5) + "!"
        elif what < 0.5:
            s = s.replace("e", "é").replace("a", "o", 2)
        out.append(s)
    return "".join(out)


def test_blocks(spark):
    r = random.Random(5)
    pairs = []
    for k in range(30):
        s = [words(r, r.randint(1, 12)) + r.choice(".?!。") for _ in range(r.choice([1, 3, 9, 25]))]
        pairs.append((k, "".join(s), edition(r, s)))
    long = [words(r, 60) + "." for _ in range(12)]
    pairs += [(90, "".join(long), edition(r, long)), (91, "", ""), (92, None, "One. Two."), (93, "One. Two.", None), (94, "...", "!"), (95, "a. " * 20, "a. " * 13), (96, words(r, 30) + ".", "".join(words(r, 3) + "." for _ in range(30)))]
    rows = spark.createDataFrame(pairs, "k int, a string, b string").repartition(3)
    got = {}
    for x in B.blocks(rows, ["k"], "a", "b", FOLD).orderBy("k", "id").collect():
        got.setdefault(x.k, []).append(tuple(x)[1:])
    for k, a, b in pairs:
        assert got.get(k, []) == plain_blocks(a or "", b or ""), k
        assert "".join(x[2] for x in got.get(k, [])) == "".join(SENTENCE.findall(a or ""))
        assert "".join(x[3] for x in got.get(k, [])) == "".join(SENTENCE.findall(b or ""))
    kinds = {x[1] for v in got.values() for x in v}
    assert {"insert", "delete", "1-to-1"} <= kinds and any(k[0] != k[-1] for k in kinds if "-to-" in k)
    assert B.blocks(rows.limit(0), ["k"], "a", "b").count() == 0


def test_differences_of_blocks(spark):
    found = spark.createDataFrame([(1, 1, 0, 5, 0.99, False), (1, 2, 5, 5, 1.0, False), (1, 3, 5, 9, 0.5, True), (1, 4, 9, 12, None, True), (2, 1, 0, 3, 1.0, False)], "k int, id int, start1 int, end1 int, similarity double, text_differs boolean")
    places = spark.createDataFrame([(1, 0), (1, 4), (1, 5), (1, 8), (1, 8), (1, 10), (7, 1)], "k int, pos long")
    got = {(x.k, x.id): (x.n_differences, x.has_diff) for x in B.with_differences(found, places, ["k"]).collect()}
    assert got == {(1, 1): (2, True), (1, 2): (0, False), (1, 3): (3, True), (1, 4): (0, True), (2, 1): (0, False)}


def plain_definitive(text, edits, marks):
    chars, notes, skipped = list(text), [], 0
    for pos, _, kind, mark, note in sorted(edits, key=lambda e: (-(e[0] or 0), e[1])):
        if kind is None:
            skipped += 1
            continue
        before, actual = 0, len(chars)
        for i, c in enumerate(chars):
            if before == pos:
                actual = i
                break
            before += c not in marks
        if kind == "added":
            if actual + 1 <= len(chars):
                chars[actual + 1 : actual + 1] = list(mark)
                notes.append((pos, D.NONE, mark, kind, note))
            continue
        for k in (0, 1, 2, 3, -1, -2, -3):
            i = actual + k
            if 0 <= i < len(chars) and chars[i] in marks:
                notes.append((pos, chars[i], D.NONE if kind == "deleted" else mark, kind, note))
                chars[i : i + 1] = [] if kind == "deleted" else list(mark)
                break
    return "".join(chars), sorted(notes, key=lambda n: n[0]), skipped


def test_definitive(spark):
    r = random.Random(11)
    texts, differences, decisions, want = [], [], [], {}
    for k in range(150):
        text = "".join(r.choice("abcd 甲乙，。，。!-") for _ in range(r.choice([0, 1, 5, 30, 200])))
        texts.append((k, text or r.choice(["", None])))
        edits, n_first = [], 0
        for id_ in range(r.choice([0, 1, 6, 40])):
            second, lost = r.random() < 0.8, r.random() < 0.1
            kind = r.choice(["added", "deleted", "replaced"])
            d = (k, id_, r.randint(0, len(text) + 2), kind, "" if kind == "deleted" else r.choice(["；", "？！", ".", "”"]))
            note = r.choice(["n", None])
            decisions.append((k, id_, second, note))
            if not lost:
                differences.append(d)
            if second:
                edits.append((None if lost else d[2], id_, None if lost else kind, d[4], note or ""))
            n_first += not second
        out = plain_definitive(text, edits, frozenset(D.DEFINITIVE_MARKS))
        want[k] = (out[0], out[1], n_first, len(edits), len(out[1]), out[2])
    docs = spark.createDataFrame(texts, "k int, text string").repartition(3)
    got = D.definitive(docs, spark.createDataFrame(differences, "k int, id int, pos int, kind string, y string"), spark.createDataFrame(decisions, "k int, id int, second boolean, note string"), "k")
    assert {x.k: (x.text, [tuple(n) for n in x.notes], *tuple(x)[3:]) for x in got.collect()} == want


def test_bounds_of_blocks():
    """What the lengths and common subsequences let a block score at most is no less than what it scores, and long texts and equal ones have the matcher's likeness."""
    r = random.Random(3)
    for _ in range(20):
        s = [words(r, r.randint(1, 9)).replace(" ", "") for _ in range(9)]
        one, two = s, [x.replace("e", "é", r.randint(0, 2)) for x in s if r.random() < 0.8] or [""]
        p = B._Pair(one, two)
        for most, m, n, sim in B._most(p):
            (got, scored), = B._tell([(p, m, n)])
            assert got == likeness("".join(one[:m]), "".join(two[:n])) <= sim and scored <= most + 1e-12
            assert p.next(m, n) is None or B._behind(B._Pair(one, two), 0, 0) >= 0.0
    long = words(r, 900)
    texts = [(long, long[:2000] + "x" + long[2000:]), (long, long), ("ab" * 150, "ab" * 150), ("ab", "ab"), ("", ""), ("", "a")]
    assert B.ratios([a for a, _ in texts], [b for _, b in texts]) == [likeness(a, b) for a, b in texts]
