"""F2: paragraphs are scored by any content word of a notice, long or short."""

from __future__ import annotations

from variorum.llm import license_scan


def test_notices_without_long_words(spark, docs):
    texts = ["under CC BY 4.0", "Texts are here under CC BY-NC 4.0.", "Wir fahren mit dem Zug nach Norden.", "word " * 50]
    more = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanner = license_scan.fit(docs.select("doc_id", "text"))
    got = {r.doc_id: r for r in license_scan.scan(more, scanner).collect()}
    assert [got[i].families for i in range(4)] == ["cc-by", "cc-by-nc", None, None]
    assert [got[i].n_candidates for i in range(4)] == [1, 1, 1, 0]


def test_scoring_without_the_gate_agrees(spark, docs):
    texts = ["Released under the MIT License.\n\nplain words only\nand more", "İ mit\ncc\nΣΑΣ", "", None]
    more = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanner = license_scan.fit(docs.select("doc_id", "text"))
    own = license_scan.scan(more, scanner).drop("n_candidates").collect()
    scanner.bare = True
    assert sorted(map(str, own)) == sorted(map(str, license_scan.scan(more, scanner).drop("n_candidates").collect()))
