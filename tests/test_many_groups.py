"""Many groups clustered at once against a plain loop over each; kinds of places against places one by one."""

from __future__ import annotations

import random
import time

from variorum.operators import align
from variorum.operators import witnesses as W


def plain(sim, base):
    nodes = sorted({n for p in sim for n in p})
    far = lambda a, b: 1 - sim.get((min(a, b), max(a, b)), 1.0)
    active, rows = [(n, [n]) for n in nodes if n != base], []
    while len(active) > 1:
        pairs = [(round(sum(far(a, b) for a in p for b in q) / (len(p) * len(q)), 10), x, y) for x, (_, p) in enumerate(active) for y, (_, q) in enumerate(active) if x < y]
        gap, x, y = min(pairs)
        a, b = sorted((active[x][0], active[y][0]))
        rows.append((len(rows) + 1, a, b, gap))
        active = [v for k, v in enumerate(active) if k not in (x, y)] + [(a, active[x][1] + active[y][1])]
    return rows


def test_groups_of_any_size(spark):
    rng = random.Random(4)
    groups = {}
    for g in range(120):
        nodes = sorted(rng.sample(range(20), rng.randrange(2, 9)))
        groups[g] = {(a, b): rng.randrange(5) / 4 if g % 2 else rng.random() for a in nodes for b in nodes if a < b and rng.random() < 0.95}
    df = spark.createDataFrame([(g, a, b, s) for g, sim in groups.items() for (a, b), s in sim.items()], "grp long, i long, j long, sim double")
    for base in (None, 0):
        want = [(g, *row) for g, sim in groups.items() for row in plain(sim, base)]
        got = align.cluster(df, base).orderBy("grp", "step").collect()
        assert [tuple(r)[:4] for r in got] == [w[:4] for w in want]
        assert all(abs(r.height - w[4]) < 1e-9 for r, w in zip(got, want, strict=True))


def test_time_of_many_groups(spark):
    n = 20_000
    df = spark.range(n).selectExpr("id AS grp", "explode(sequence(0L, 7L)) AS i").selectExpr("grp", "i", "explode(sequence(0L, 7L)) AS j").where("i < j").selectExpr("*", "pmod(hash(grp, i, j), 1000) / 1000 AS sim")
    began = time.monotonic()
    assert align.cluster(df, base=0).count() == 6 * n
    assert time.monotonic() - began < 15


def test_kinds_of_places(spark):
    rng = random.Random(5)
    rows = [(k, w, p, added, 0, rng.choice("𠀀b∅"), rng.choice(W.CATEGORIES)) for k in range(5) for p in range(60) for added in (False, True) for w in "xyz" if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "k long, w string, pos int, inserted boolean, ord int, reading string, category string")
    own, met = W.tallied_places(W.alike_places(df, "k", "w", list("xyz")), "k", "w")
    for got, want in ((own, W.tallied(df, "k", "w", "category")), (met, W.tallied(W.meetings(df, "k", "w"), "k", *W.MET))):
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
