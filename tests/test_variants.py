"""Variant dictionaries, decisions, blocks and citations on small hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from variorum.functions import references as R
from variorum.operators import variants as V


def test_dictionary_chains_and_passes_over_what_is_no_pair(spark):
    pairs = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y"), ("z", "z"), ("ab", "c")], "a string, b string")
    assert {tuple(r) for r in V.dictionary(pairs).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_classes_and_note_types(spark):
    entries = V.dictionary(spark.createDataFrame([("é", "e")], "a string, b string"))
    rows = spark.createDataFrame([("e", "e"), ("é", "e"), ("e", "q")], "base string, reading string")
    assert sorted(tuple(r) for r in V.classified(rows, entries).select("base", "reading", "class").collect()) == [("e", "e", "identical"), ("e", "q", "error"), ("é", "e", "variant")]
    cases = [("a", "", "omission"), ("", "a", "addition"), ("ab", "ba", "transposition"), ("a", "b", "variant"), ("ab", "cd", "error")]
    got = spark.createDataFrame(cases, "a string, b string, want string").select(V.note_type(F.col("a"), F.col("b"), F.lit(True)), "want").collect()
    assert all(x == y for x, y in got)


def test_decisions_against_a_plain_loop(spark):
    docs = [(1, "abcdef"), (2, "xyz"), (3, ""), (4, "aébc")]
    cuts = [(1, 0, "A", False), (1, 2, "", False), (1, 5, "FF", False), (1, 3, "?", True), (4, 1, "e", False), (4, 1, "o", False), (9, 0, "n", False)]
    got = V.apply_decisions(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(cuts, "doc_id long, pos long, new string, uncertain boolean"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "AbdeFF", 3), (2, "xyz", 0), (3, "", 0), (4, "aebc", 1)]


def test_lists_of_variants(spark):
    heads = spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "", "c"), (1, 3, "", "cc"), (1, 4, "d", "d"), (1, 5, "", "e")], "part int, ord int, head string, variant string")
    assert {tuple(r) for r in V.headed_pairs(heads).collect()} == {("a", "b"), ("a", "c"), ("d", "e")}
    ids = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "char string, ids string")
    assert {tuple(r) for r in V.decomposed_pairs(ids).collect()} == {("a", "b"), ("a", "c")}
    text = "preface\n[a] 12\nb` one\na` itself\nc` two\n[d]3\nb` again"
    entries = spark.createDataFrame([(text,)], "t string").select(F.inline(V.printed_entries(F.col("t")))).collect()
    assert [tuple(r) for r in entries] == [("a", ["b", "c"]), ("d", ["b"])]


def test_range_citations_leave_out_comments_and_openings(spark):
    text = "論曰：無色法中(至)蘊得等性。\n述曰此下(至)明非色。\n[1]前文(至)後文。\n短（至）也。"
    got = spark.createDataFrame([(text,)], "t string").select(R.range_citations(F.col("t")).alias("c")).first().c
    assert got == ["無色法中...蘊得等性", "前文...後文"]


def test_volumes_and_persons(spark):
    titles = [("論卷第二十五", "論", 25), ("論第3卷", "論", 3), ("論卷一千零二", "論", 1002), ("論", "論", None)]
    got = spark.createDataFrame(titles, "t string, title string, volume int").select(R.volume_of(F.col("t")).alias("v"), "title", "volume").collect()
    assert all((r.v.title, r.v.volume) == (r.title, r.volume) for r in got)
    row = spark.createDataFrame([("尊者世親造　唐 玄奘譯", "")], "a string, b string").select(R.author(F.col("a")), R.translator(F.col("a")), R.author(F.col("b"))).first()
    assert tuple(row) == ("尊者世親", "玄奘", "未知")
