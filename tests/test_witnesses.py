"""Readings, variant table, shared readings and axis similarity of aligned witnesses against plain computations."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

from variorum.operators import align
from variorum.operators import witnesses as W

FOLD = {"é": "e", "ü": "u"}


def plain(base, texts):
    """{(pos, inserted, ord): {witness: (base, reading, category)}}"""
    out = defaultdict(dict)
    fold = lambda t: "".join(FOLD.get(c, c) for c in t)
    for w, t in texts.items():
        for kind, i1, i2, j1, j2 in SequenceMatcher(None, fold(base), fold(t), False).get_opcodes():
            x, y = base[i1:i2], t[j1:j2]
            if kind == "equal" and x == y:
                continue
            for k in range(max(len(x), len(y))):
                place = (i1 + min(k, len(x)), k >= len(x), max(0, k - len(x)))
                a, b = (s[k] if k < len(s) else "∅" for s in (x, y))
                if a != b:
                    out[place][w] = (a, b, "addition" if a == "∅" else "omission" if b == "∅" else "variant" if fold(a) == fold(b) else "error")
    return out


def collated():
    r = random.Random(2)
    docs = {}
    for d in range(12):
        base = "".join(r.choice("abcdeéüxyz.") for _ in range(r.choice([0, 3, 40, 90])))
        texts = {}
        for w in "ABCD":
            t = list(base)
            for _ in range(r.randint(0, 6)):
                k = r.randint(0, max(0, len(t) - 1))
                t[k : k + r.randint(0, 2)] = [r.choice("abeux") for _ in range(r.randint(0, 3))]
            texts[w] = "".join(t).replace("é", "e" if w == "C" else "é")
        docs[d] = (base, texts)
    return docs


def test_witnesses(spark):
    docs = collated()
    pairs = spark.createDataFrame([(d, w, base, t) for d, (base, texts) in docs.items() for w, t in texts.items()], "d int, w string, base string, other string").repartition(3)
    entries = spark.createDataFrame([("é", "e"), ("e", "e"), ("ü", "u"), ("u", "u")], "char string, std string")
    aligned = align.align(pairs, "base", "other", ("éü", "eu")).select("d", "w", "base", "segments")
    rows = W.readings(aligned.withColumnRenamed("base", "t"), "d", "w", "segments", entries, "t")
    want = {d: plain(*x) for d, x in docs.items()}
    got = sorted((r.d, r.w, r.pos, r.inserted, r.ord, r.base, r.reading, r.category) for r in rows.collect())
    assert got == sorted((d, w, *place, *v) for d, t in want.items() for place, ws in t.items() for w, v in ws.items()) and len(got) > 100
    table = W.variant_table(rows, "d", "w", list("ABCD")).collect()
    assert len(table) == sum(map(len, want.values()))
    for r in table:
        ws, base = want[r.d][r.position - 1, r.inserted, r.ord], docs[r.d][0]
        n, p = Counter(v[2] for v in ws.values()), r.position - 1
        char = next(iter(ws.values()))[0]
        assert [r.w0, r.w1, r.w2, r.w3] == [ws[w][1] if w in ws else char for w in "ABCD"]
        kind = "omission" if n["omission"] else "addition" if n["addition"] else "variant" if n["variant"] and n["variant"] >= n["error"] else "error"
        after = base[p : p + 5] if r.inserted else base[p + 1 : p + 6]
        assert (r.category, r.context) == (kind, f"...{base[max(0, p - 5) : p]}【{char}】{after}...")
    met = W.meetings(rows, "d", "w")
    shared = {(r.a, r.b): (r.errors, r.variants, r.gaps) for r in W.shared_readings(met).collect()}
    count = Counter((a, b, kind) for t in want.values() for ws in t.values() for a in ws for b in ws if a < b and ws[a] == ws[b] for kind in [ws[a][2]])
    for a, b in {(a, b) for a, b, _ in count}:
        assert shared.pop((a, b)) == (count[a, b, "error"], count[a, b, "variant"], count[a, b, "omission"] + count[a, b, "addition"])
    assert not shared
    lengths = spark.createDataFrame([(d, len(base)) for d, (base, _) in docs.items()], "d int, n int")
    for r in W.axis_similarity(lengths, rows, met, "d", "w", list("ABCD"), "!").collect():
        base, texts = docs[r.d]
        lines = []
        for w in (r.a, r.b):
            line = {(p, False, 0): c for p, c in enumerate(base)}
            for place, ws in want[r.d].items():
                if w in ws:
                    line[place] = ws[w][1]
            lines.append({k: c for k, c in line.items() if c != "∅"})
        same = sum(lines[1].get(k) == c for k, c in lines[0].items())
        size = sum(map(len, lines))
        assert (r.m, r.t, r.sim) == (same, size, 2 * same / size if size else 1.0)
        assert size == sum(len(texts.get(w, base)) for w in (r.a, r.b))
