from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, key long, marks string, lang string"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


def messy():
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    base = words(300, 1)
    near = base[:100] + ["changed"] + base[101:]
    passage = words(60, 2)
    rows = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(words(40, 3) + passage + words(30, 4))),
        (5, " ".join(words(50, 5) + passage + words(20, 6))), (6, ""), (7, None), (8, "  \n\t "), (9, "one two three"), (10, "one two three"),
        (11, " ".join(words(20_000, 7))), (12, "a " * 3000), (13, "x" * 5000), (None, " ".join(words(80, 8))), (14, "É été «naïf» \U00020000字 zwölf"),
        (15, " ".join(w.upper() for w in base)), (16, "\n".join(["same line of words here now"] * 6)), (16, "\n".join(["same line of words here now"] * 6)),
    ]
    return [(i, t, 5, "x", "en") for i, t in rows]
