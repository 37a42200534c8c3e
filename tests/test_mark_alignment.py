"""Marks across differing texts against a plain walk over the standard matcher's segments."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from variorum.functions.marks import MARKS
from variorum.operators import mark_alignment

FOLD = ("éü", "eu")


def clean(t):
    return "".join(c for c in t if c not in MARKS and not c.isspace())


def marks_of(t):
    out, n, at = {}, 0, None
    for c in t:
        if c in MARKS:
            if n == 0:
                out[-1] = out.get(-1, "") + c
            elif at is not None:
                out[at] = out.get(at, "") + c
        elif c.isspace():
            at = None
        else:
            at, n = n, n + 1
    return out


def plain(one, two):
    a, b, x, y = clean(one), clean(two), marks_of(one), marks_of(two)
    fold = str.maketrans(*FOLD)
    found = []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, a.translate(fold), b.translate(fold)).get_opcodes():
        n = min(i2 - i1, j2 - j1)
        for k in range(n):
            p, q = x.get(i1 + k, ""), y.get(j1 + k, "")
            if p != q:
                found.append((i1 + k, j1 + k, a[i1 + k], b[j1 + k], p, q))
        for i in range(i1 + n, i2):
            if i in x:
                found.append((i, max((j2 if tag == "replace" else j1) - 1, 0), a[i], "", x[i], ""))
        if tag == "insert":
            for j in range(j1, j2):
                if j in y:
                    p = max(i1 - 1, 0)
                    found.append((p, j, a[p : p + 1], b[j], "", y[j]))
    found.sort(key=lambda f: f[0])
    out = {}
    for f in found:
        out.setdefault(f[0], f)
    return [(k, *f) for k, f in enumerate(out.values(), 1)]


def test_mark_differences(spark):
    r = random.Random(6)
    pairs = [(100, "「甲乙，丙。", "甲乙丙！丁。"), (101, "", "，甲，"), (102, "a.", ""), (103, "a,b", "a，b")]
    for k in range(60):
        one = [r.choice("abcdeéü ") + (r.choice(["", "", ",", "。", "!?", " ,"])) for _ in range(r.choice([0, 4, 30, 120]))]
        two = list(one)
        for _ in range(r.randint(0, 8)):
            i = r.randint(0, max(0, len(two) - 1))
            two[i : i + r.choice([0, 1, 1, 3])] = [r.choice("abxe") + r.choice(["", ",", "；"]) for _ in range(r.choice([0, 1, 1, 3]))]
        pairs.append((k, r.choice(["", ",", " 。"]) + "".join(one), "".join(two)))
    df = spark.createDataFrame(pairs, "id_ int, left string, right string").repartition(3)
    got = {}
    for x in mark_alignment.mark_differences(df, "id_", "left", "right", FOLD).orderBy("id_", "id").collect():
        got.setdefault(x.id_, []).append((x.id, x.pos1, x.pos2, x.character1, x.character2, x.x, x.y))
    total = 0
    for k, one, two in pairs:
        want = plain(one, two)
        assert got.get(k, []) == want, (one, two)
        total += len(want)
    assert total > 100
