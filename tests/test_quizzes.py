"""Quizzes of decks of every size."""

from __future__ import annotations

from variorum.operators import quizzes as Q


def test_quiz(spark):
    sizes = {"none": 1, "two": 2, "three": 3, "four": 4, "five": 5, "big": 300}
    cards = [(d, k, f"front {d} {k}", f"back {d} {k}") for d, n in sizes.items() for k in range(n)] + [("same", k, "f", "b") for k in range(6)] + [(None, 1, "f", "b"), ("two", None, "f", "b"), ("null", 1, None, None), ("null", 2, "f", "b")]
    rows = spark.createDataFrame(cards, "deck string, card int, front string, back string")
    got = Q.quiz(rows.repartition(5), 5, "s").collect()
    by = {}
    for r in got:
        by.setdefault(r.deck, []).append(r)
    assert {d: len(x) for d, x in by.items()} == {"two": 2, "three": 3, "four": 4, "five": 5, "big": 5, "same": 5, "null": 2}
    for d, x in by.items():
        assert sorted(r.number for r in x) == list(range(1, len(x) + 1)) and len({r.card for r in x}) == len(x)
        for r in x:
            if d in sizes:
                assert r.question == f"front {d} {r.card}" and r.options[r.correct_index] == f"back {d} {r.card}"
                assert len(set(r.options)) == len(r.options) == min(4, sizes[d])
    assert all(r.options == ["b"] * 4 and r.correct_index == 0 for r in by["same"])
    assert {(r.card, r.options[r.correct_index]) for r in by["null"]} == {(1, ""), (2, "b")}
    assert sorted(map(str, Q.quiz(rows.repartition(2), 5, "s").collect())) == sorted(map(str, got))
    assert sorted(map(str, Q.quiz(rows, 5, "t").collect())) != sorted(map(str, got))
    assert Q.quiz(rows.limit(0), 5, "s").count() == 0
