"""Refined replacements and display blocks against plain scans."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from variorum.operators import align, display

FOLD = ("éü", "eu")
TABLE = str.maketrans(*FOLD)


def parts_of(kind, a, b):
    if kind == "equal":
        return [(a, b, "equal", None)]
    if kind == "delete":
        return [(c, "", "delete", "omission") for c in a]
    if kind == "insert":
        return [("", c, "insert", "addition") for c in b]
    if 2 <= len(a) <= 6 and a != b and sorted(a) == sorted(b):
        return [(a, b, "replace", "error")]
    out = []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, a, b, False).get_opcodes():
        x, y = a[i1:i2], b[j1:j2]
        if tag == "equal":
            out += [(c, c, "equal", None) for c in x]
        elif len(x) == len(y):
            out += [(c, d, "replace", "variant" if c.translate(TABLE) == d.translate(TABLE) else "error") for c, d in zip(x, y)]
        else:
            out += [(c, "", "delete", "omission") for c in x] + [("", c, "insert", "addition") for c in y]
    return out


def plain(segments, length, least):
    done, held, size = [], [], 0

    def flush():
        nonlocal held, size
        if held:
            done.append(["".join(x for _, x, _ in held), "".join(y for *_, y in held), any(k != "equal" for k, *_ in held), [p for s in held for p in parts_of(*s)]])
        held, size = [], 0

    for kind, a, b in segments:
        n = max(len(a), len(b))
        if n > length:
            flush()
            for i in range(0, n, length):
                held = [(kind, a[i : i + length], b[i : i + length])]
                flush()
        else:
            if size + n > length:
                flush()
            held.append((kind, a, b))
            size += n
    flush()
    out = []
    for block in done:
        if out and max(len(block[0]), len(block[1])) < least:
            out[-1] = [out[-1][0] + block[0], out[-1][1] + block[1], out[-1][2] or block[2], out[-1][3] + block[3]]
        else:
            out.append(block)
    return [(k, *b) for k, b in enumerate(out, 1)]


def test_blocks(spark):
    r = random.Random(9)
    pairs = []
    for k in range(40):
        a = "".join(r.choice("abcdefgéüh") for _ in range(r.choice([0, 5, 60, 300, 700])))
        b = list(a)
        for _ in range(r.randint(0, 20)):
            i = r.randint(0, max(0, len(b) - 1))
            b[i : i + r.choice([0, 1, 2, 100])] = [r.choice("abeuxyz") for _ in range(r.choice([0, 1, 2, 3, 120]))]
        pairs.append((k, a, "".join(b)))
    pairs += [(100, "甲乙丙", "甲丙乙"), (101, "ab" * 100, "")]
    rows = align.align(spark.createDataFrame(pairs, "k int, a string, b string").repartition(3), "a", "b", FOLD)
    segments = {x.k: [(s.type, s.text1, s.text2) for s in x.segments] for x in rows.collect()}
    for length, least in ((display.LENGTH, display.LEAST), (10, 4)):
        got = display.blocks(rows, "k", FOLD, length, least)
        found = {}
        for x in got.orderBy("k", "id").collect():
            found.setdefault(x.k, []).append((x.id, x.sentence1, x.sentence2, x.has_diff, [tuple(p) for p in x.parts]))
        for k, a, b in pairs:
            assert found.get(k, []) == plain(segments[k], length, least)
            assert "".join(x[1] for x in found.get(k, [])) == a and "".join(x[2] for x in found.get(k, [])) == b
    assert got.where(F.greatest(F.length("sentence1"), F.length("sentence2")) > 10 + 4).count() <= got.where(F.length("sentence1") + F.length("sentence2") > 10).count()
