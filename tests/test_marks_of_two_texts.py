"""Marks of two texts of the same characters against a plain walk; long texts within a time that grows with them."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from variorum.functions.marks import MARKS, SPACES
from variorum.operators import marks


def placed(t):
    """Marks by the number of the character that they follow directly; -1: before the first one, white space between or not."""
    out, n, near = {}, -1, True
    for c in t:
        if c in MARKS:
            if near or n < 0:
                out[n] = out.get(n, "") + c
        elif c in SPACES:
            near = False
        else:
            n, near = n + 1, True
    return out


def gaps(t):
    out = []
    for c in t:
        if c not in MARKS:
            out.append("")
        elif out:
            out[-1] += c
    return out


def texts():
    rng = random.Random(3)
    letters = "ab字𠀀é" + "​"
    for _ in range(300):
        clean = [rng.choice(letters) for _ in range(rng.randrange(0, 9))]
        sides = []
        for _ in range(2):
            t = "".join(rng.choice(("", "", ",", "。」", "‹ ", " ;", "\n", "　：")) + c for c in clean)
            sides.append(t + rng.choice(("", "!", " ?", "…—")))
        yield sides
    yield from ([",", ","], ["", ""], [None, None], [None, "，"], [" , ; a", "a"], ["a,", "a,b"])


def frame(spark):
    return spark.createDataFrame([(k, *pair) for k, pair in enumerate(texts())], "k long, one string, two string")


def test_differences_and_contexts(spark):
    want = []
    for k, (one, two) in enumerate(texts()):
        x, y = placed(one or ""), placed(two or "")
        clean = "".join(c for c in one or "" if c not in MARKS + SPACES)
        want += [(k, p, x.get(p, ""), y.get(p, ""), clean[max(p - 3, 0) : max(p + 3, 0)]) for p in sorted(x.keys() | y.keys()) if x.get(p, "") != y.get(p, "")]
    for width in (3, None):
        got = marks.mark_differences(frame(spark), "k", F.col("one"), F.col("two"), width).orderBy("k", "pos").collect()
        assert [(r.k, r.pos, r.x, r.y, *([r.context] if width else [])) for r in got] == [w if width else w[:4] for w in want]
    assert any(w[1] == -1 for w in want) and len(want) > 300


def test_basic_gaps(spark):
    want = []
    for k, (one, two) in enumerate(texts()):
        x, y = gaps(one or ""), gaps(two or "")
        differ = [i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q]
        if x:
            want.append((k, sum(map(bool, x)), sum(map(bool, y)), len(differ), differ[0] if differ else -1))
    got = marks.basic_gaps(frame(spark), "k", F.col("one"), F.col("two")).orderBy("k").collect()
    assert [tuple(r) for r in got] == want


LONG = "字ab, " * 300_000


def timed(df):
    began = time.monotonic()
    return df.collect()[0], time.monotonic() - began


def test_basic_gaps_of_a_long_text(spark, tmp_path):
    from variorum.plans import variants

    spark.createDataFrame([(1, LONG * 4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, seconds = timed(variants.f15_basic_compare(spark, str(tmp_path)))
    assert tuple(got) == (1, 1_200_000, 1_200_000, 1_200_000, 2) and seconds < 20


def test_contexts_of_a_long_text(spark, tmp_path):
    from variorum.plans import listings

    spark.createDataFrame([(1, LONG)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    all_ = listings.g07_context_slices(spark, str(tmp_path)).agg(F.count(F.lit(1)), F.sum("pos"), F.count_if(F.length("context") == 60), F.max(F.struct("pos", "context")))
    got, seconds = timed(all_)
    assert got[:3] == (300_000, 2 * 300_000 + 3 * sum(range(300_000)), 299_980) and got[3] == (899_999, "b" + "字ab" * 10) and seconds < 20
