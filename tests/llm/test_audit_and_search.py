"""The filter audit and the search for inner products against brute force, and both against their SQL."""

from __future__ import annotations

import math
import random
from itertools import permutations

import numpy as np
import pytest
from cases import SCHEMA, messy
from compare import rows_of

from variorum.llm import filter_audit as A
from variorum.llm import top_inner_products as S
from variorum.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, oracle, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = oracle.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert len(got) and columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def audited(rows, labels):
    fails = []
    for i, t, _ in rows:
        t = t or ""
        w = [x for x in t.encode().split()]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails.append({k for k, v in f.items() if v})
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {s or "" for *_, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails, strict=True) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_audit(spark, empty, monkeypatch):
    r = random.Random(3)
    some = ["A B C", "# x", "word " * 250, " ".join(f"w{i}" for i in range(260)), "UPPER " * 3, None, ""]
    rows = [(i, t, "a") for i, t, *_ in messy()] + [(r.choice([None, *range(20, 60)]), r.choice(some), r.choice([None, "", "a", "b"])) for _ in range(120)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 60, 2)] + [(20, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, step int, part int").repartition(3)
    said = spark.createDataFrame([(*x, "n") for x in labels], "doc_id long, quality int, toxic int, part string")
    monkeypatch.setattr(A, "PARTS", 1)
    got = A.audit(docs, said).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    assert sorted(map(tuple, got)) == audited(rows, labels)
    assert A.audit(empty.withColumn("source", empty.lang), said).count() == 0


def searched(rows, k, every):
    ints = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for n, (i, q) in enumerate(ints):
        if i is not None and i % every == 0:
            s = [(-sum(x * y for x, y in zip(q, c, strict=True)), j is None, j or 0, j) for m, (j, c) in enumerate(ints) if m != n and len(c) == len(q)]
            out += [(i, rank, j, -score) for rank, (score, _, _, j) in enumerate(sorted(s, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(S.QUERIES, S.BLOCK), (3, 7), (16, 40)])
def test_search(spark, sizes):
    r = np.random.default_rng(5)
    base = [np.float32(x).tolist() for x in r.normal(size=(150, 12)) * r.choice([0.01, 0.3, 2.0], (150, 1)) * np.linspace(2, 0.1, 12)]
    rows = [(int(i), v) for i, v in enumerate(base)]
    rows += [(int(i), base[3]) for i in (*range(200, 240), 200, 200)] + [(0, base[0]), (0, base[1]), (None, base[2]), (None, base[2]), (40, None), (41, [1.0, None]), (60, [float("nan")] * 12), (61, [float("inf")] * 12)]
    rows += [(80, []), (81, []), (100, [3.0]), (101, [-0.001]), (120, [1e6, -1e6, 0.5]), (121, [1e6, 1e5, 0.5]), (140, [0.0] * 12), (-20, base[5])]
    v = spark.createDataFrame([(i, x, 1, "b") for i, x in rows], "vec_id long, embedding array<float>, dim int, block string").repartition(4)
    got = S.top(v, k=20, every=20, sizes=sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == searched(rows, 20, 20)


def test_search_of_nothing(spark):
    assert S.top(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    alone = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert S.top(alone).count() == 0


def test_bounds_prune():
    """Survivors of the partial sums are few where lengths and the spectrum fall, and none is lost."""
    r = np.random.default_rng(6)
    v = np.floor(r.normal(size=(3000, 32)) * np.geomspace(60, 1, 32))
    v = v[np.argsort(-np.linalg.norm(v, axis=1))]
    turn = np.linalg.eigh(v.T @ v)[1][:, ::-1]
    keys = np.arange(3000)
    make = lambda x, n: S.Block(32, n.astype(np.int64).tobytes(), np.ones(len(n), bool).tobytes(), np.ones(len(n), np.int64).tobytes(), "<f8", x.tobytes(), turn)
    q, c = make(v[::100].copy(), keys[::100]), make(v, keys)
    at, to, score, _ = S.best(q, c, 5, np.full(30, S.LOWEST))
    full = (v[::100] @ v.T).astype(np.int64)
    for n in range(30):
        order = np.lexsort((keys, -full[n]))[:5]
        assert to[at == n].tolist() == order.tolist() and score[at == n].tolist() == full[n][order].tolist()
