"""Passages found in documents are those that plain containment finds, of any length and at any border."""

from __future__ import annotations

from variorum.plans.citations import passage_hits

LONG = "one two three four five six seven eight"
TEXTS = [
    LONG, f"(\u201c{LONG}\u201d)", f"x{LONG}y {LONG}", "alpha beta gamma delta.", "prealpha beta gamma delta", "a cat, a cat", "concatenate", "", None,
    "z " * 700 + "border of pieces here " + "z " * 700, "q" * 995 + "shortkeys" + "q" * 2000, "a\tb  c\nd e f", "\U00020000\u5b57 na\u00efve", "two three",
]
PASSAGES = [
    LONG, "alpha beta gamma delta", "two three", "cat", "a", "border of", "shortkeys", "ne two three four five six seven eigh", " two three four five six ",
    "b  c\nd e", "b c d e", "\U00020000", "\u5b57 na\u00ef", " ", "", None, "nowhere at all", LONG + " nine",
]


def test_passage_hits(spark):
    documents = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    passages = spark.createDataFrame(list(enumerate(PASSAGES)), "item_id long, text string")
    got = sorted(map(tuple, passage_hits(documents, passages).collect()))
    assert got == sorted((i, k, t.count(p)) for i, t in enumerate(TEXTS) for k, p in enumerate(PASSAGES) if t and p and p in t)
    assert passage_hits(documents.limit(0), passages).count() == 0
    assert passage_hits(documents, passages.limit(0)).count() == 0
