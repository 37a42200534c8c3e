"""Citations in their texts against comparing every window by the standard matcher."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np

from variorum.operators import citations as C
from variorum.operators.sentences import PASSED_OVER


def like(a, b):
    a, b = PASSED_OVER.sub("", a), PASSED_OVER.sub("", b)
    if not a or not b:
        return 1.0 if a == b else 0.0
    return round(SequenceMatcher(None, a, b).ratio(), 4)


def windows(text, citation, wider=15, least=0.7):
    c = PASSED_OVER.sub("", citation)
    out = []
    if len(c) < 3:
        return out
    for p in range(0, len(text) - min(len(c), len(text)) + 1, 5):
        s = like(c, text[p : p + len(c) + wider])
        if s >= least and all(abs(m[0] - p - 1) >= wider for m in out):
            out.append((p + 1, s, text[p : p + len(c)]))
    return sorted(out, key=lambda m: -m[1])[:10]


def ranges(text, head, tail, wider=15, least=0.7):
    out = []
    if len(head) < 2 or len(tail) < 2:
        return out
    first = head[: min(5, max(3, len(head) // 2))]
    places = [i for i in range(len(text)) if text.startswith(first, i)]
    if not places:
        places = [p for p in range(0, len(text) - len(head) + 1, max(1, len(head) // 2)) if like(head, text[p : p + len(head)]) >= least]
    for p in places:
        s = like(head, text[p : p + len(head)])
        if s < least:
            continue
        best, at = 0, None
        for q in range(min(p + max(300, 20 * len(head)), len(text)) - len(tail), p + len(head), -1):
            e = like(tail, text[q : q + len(tail)])
            if e >= least and e > best:
                best, at = e, q
                if e >= 0.9:
                    break
        if at is not None and all(abs(m[0] - p - 1) >= wider for m in out):
            whole = text[p : at + len(tail)]
            out.append((p + 1, round((s + best) / 2, 4), whole[:80] + ("..." if len(whole) > 80 else "")))
    return sorted(out, key=lambda m: -m[1])[:5]


def spoiled(r, t, share):
    return "".join(c if r.random() > share else r.choice("xyz，") for c in t)


def cases():
    r = random.Random(12)
    out = []
    for k in range(14):
        letters = r.choice(["abcdefghij klm", "ab", "如是我聞一時佛在舍衛國祇樹給孤獨園與大比丘"])
        text = "".join(r.choice(letters + "，。") for _ in range(r.choice([0, 12, 200, 700])))
        asked = ["", "ab", "no such thing at all", text[:40]]
        for _ in range(4):
            i, n = r.randint(0, max(0, len(text) - 1)), r.choice([6, 20, 40, 130])
            part = text[i : i + n]
            asked.append(spoiled(r, part, r.choice([0, 0.1, 0.3])))
            asked.append(part[:8] + "..." + spoiled(r, text[i + 40 : i + 40 + r.choice([3, 9])], 0.1))
        asked.append("a...b...c")
        out.append((k, text, asked))
    return out


def test_places(spark):
    rows = cases()
    texts = spark.createDataFrame([(k, t) for k, t, _ in rows], "key int, text string")
    asked = spark.createDataFrame([(k, i, c) for k, _, cs in rows for i, c in enumerate(cs)], "key int, id int, citation string").repartition(3)
    got = {}
    for x in C.find_citations(texts, asked).orderBy("key", "id", "rank").collect():
        got.setdefault((x.key, x.id), []).append((x.position, x.similarity, x.matched))
    found = 0
    for k, text, cs in rows:
        for i, c in enumerate(cs):
            parts = [PASSED_OVER.sub("", p) for p in c.split("...")]
            want = windows(text, c) if len(parts) == 1 else ranges(text, *parts) if len(parts) == 2 else []
            assert got.get((k, i), []) == want, (text, c)
            found += len(want)
    assert found > 60


def test_positions(spark):
    rows = cases()
    r = random.Random(1)
    texts = spark.createDataFrame([(k, t) for k, t, _ in rows], "key int, text string")
    asked = [(k, i, t[max(0, i * 7 - 10) : i * 7 + 11] if r.random() < 0.7 else "x" * 20) for k, t, _ in rows for i in range(6)]
    places = [(k, p) for k, t, _ in rows if t for p in {r.randrange(len(t)) for _ in range(25)} | {0, len(t) - 1}]
    got = C.citations_at(texts, spark.createDataFrame(asked, "key int, id int, citation string"), spark.createDataFrame(places, "key int, position int"))
    want = []
    text = dict((k, t) for k, t, _ in rows)
    for k, i, c in asked:
        for kk, p in places:
            if kk == k:
                w = text[k][max(0, p - 10) : p + 11]
                s = like(c, w)
                if s >= 0.75:
                    want.append((k, i, p, s, "high" if s >= 0.9 else "medium", w))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 30


def test_common_subsequence():
    r = random.Random(3)
    for n in (1, 63, 64, 65, 130):
        text = "".join(r.choice("abcd") for _ in range(300))
        pattern = "".join(r.choice("abcde") for _ in range(n))
        begin = np.arange(0, 250, 7)
        end = np.minimum(begin + n + 15, len(text))
        got = C.Text(text).common(pattern, begin, end)
        for i, j, g in zip(begin, end, got):
            row = [0] * (j - i + 1)
            for c in pattern:
                last = row[:]
                for k in range(1, len(row)):
                    row[k] = last[k - 1] + 1 if text[i + k - 1] == c else max(last[k], row[k - 1])
            assert row[-1] == g


def test_pairs_that_may_reach():
    """All citations and windows of a text at once give what one citation after the other gives, for words of 32 and 64 bits."""
    r = random.Random(7)
    for letters, longest in (("abcdef, gh", 24), ("ab，c", 64), ("甲乙丙丁戊。", 40)):
        text = "".join(r.choice(letters) for _ in range(900))
        t = C.Text(text)
        at = np.array(sorted({r.randrange(len(text)) for _ in range(200)} | {0, len(text) - 1}))
        begin, end = np.maximum(at - 10, 0), np.minimum(at + 11, len(text))
        asked = [PASSED_OVER.sub("", spoiled(r, text[k : k + r.randint(3, longest)], 0.1)) for k in (r.randrange(850) for _ in range(120))]
        asked = [a for a in asked if a]
        pattern, window = t.may_reach(asked, begin, end, 0.75)
        want = {(k, w) for k, a in enumerate(asked) for w in np.flatnonzero(C.reach_of(t.common(a, begin, end), len(a) + t.before[end] - t.before[begin], 0.75)).tolist()}
        assert set(zip(pattern.tolist(), window.tolist(), strict=True)) == want and len(want) == len(pattern) > 50
