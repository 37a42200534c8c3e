"""Small cases of the operators, among them the published worked examples of the domain."""

from __future__ import annotations

import random
import zipfile
from difflib import SequenceMatcher

import numpy as np
import pytest

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from variorum.functions import text as T
from variorum.functions.marks import MARKS
from variorum.operators import align, graph
from variorum.sources import files, sinks
from variorum.streaming import rates

BASE = "子曰：「学而时习之，不亦说乎？有朋自远方来，不亦乐乎？人不知而不愠，不亦君子乎？」"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_normalisers(spark):
    assert one(spark, "a b\tc\nd\re", T.normalize_collation) == "abcde"
    assert one(spark, "天　地\xa0玄​黄", T.normalize_collation) == "天地玄黄"
    assert one(spark, "a\nb\n\nc", T.normalize_sentence) == "a b c"
    assert one(spark, "", T.normalize_collation) == ""
    assert one(spark, None, T.normalize_collation) is None


def test_gaps(spark):
    assert one(spark, "子曰：学而", T.gaps) == ["", "", "：", "", ""]
    assert one(spark, "", T.gaps) == [""]


def test_sentences(spark):
    assert one(spark, "学而时习之。有朋自远方来。", T.sentences) == ["学而时习之。", "有朋自远方来。"]
    assert one(spark, "不亦说乎？不亦乐乎", T.sentences) == ["不亦说乎？", "不亦乐乎"]


def test_mark_difference(spark):
    cases = [("", "。", "added"), ("。", "", "deleted"), ("，", "。", "replaced"), ("。", "。」", "added"), ("。」", "。", "deleted"), ("。」", "。』", "replaced")]
    df = spark.createDataFrame(cases, "a string, b string, want string")
    assert df.where(T.mark_difference(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_numerals(spark):
    df = spark.range(1, 1000).select("id", T.chinese_numeral(F.col("id")).alias("s"))
    assert df.where(T.parse_chinese_numeral(F.col("s")) != F.col("id")).count() == 0
    assert [r.s for r in df.where("id in (10, 12, 105, 320)").orderBy("id").collect()] == ["十", "十二", "一百零五", "三百二十"]


def test_compare(spark):
    df = spark.createDataFrame([(1, BASE, BASE.replace("说", "悦"))], "k long, a string, b string")
    got = align.align(df, "a", "b", autojunk=True)
    assert round(got.first().similarity, 4) == 0.9756
    d = align.differences(got, "k", "a").collect()
    assert [(x.type, x.i1, x.text1, x.text2) for x in d] == [("replace", 12, "说", "悦")]
    assert d[0].before == "子曰：「学而时习之，不亦" and d[0].after == "乎？有朋自远方来，不亦乐乎？人不知而不愠"


def test_segments_rebuild_texts(spark):
    df = spark.createDataFrame([("abcd efg", "abxd efgh"), ("", "x"), (None, None), ("为学", "為学")], "a string, b string")
    for r in align.align(df, "a", "b", fold=("為", "为")).collect():
        assert "".join(s.text1 for s in r.segments) == (r.a or "")
        assert "".join(s.text2 for s in r.segments) == (r.b or "")


def test_transposition(spark):
    df = spark.createDataFrame([("如切一去", "如一切去")], "a string, b string")
    got = align.align(df, "a", "b").select(F.inline(align.merge_transpositions(F.col("segments")))).collect()
    assert [(x.text1, x.text2) for x in got] == [("切一", "一切")]


def segments_of(parts):
    """Segments from (type, text1, text2), with running offsets."""
    out, i, j = [], 0, 0
    for kind, a, b in parts:
        out.append((kind, a, b, i, i + len(a), j, j + len(b)))
        i, j = i + len(a), j + len(b)
    return out


def test_wide_transpositions(spark):
    """Runs of up to seven segments, compared with a plain scan; runs do not overlap, replaced text breaks them."""
    cases = [
        [("insert", "", "ab"), ("equal", "c", "c"), ("delete", "a", ""), ("equal", "x", "x"), ("delete", "b", "")],
        [("insert", "", "a"), ("equal", "b", "b"), ("delete", "a", ""), ("equal", "b", "b"), ("insert", "", "a")],
        [("insert", "", "a"), ("equal", "b", "b"), ("insert", "", "c"), ("equal", "d", "d"), ("delete", "a", ""), ("equal", "e", "e"), ("delete", "c", "")],
        [("insert", "", "a"), ("replace", "b", "c"), ("delete", "a", "")],
        [("insert", "", "a"), ("equal", "bcdefg", "bcdefg"), ("delete", "a", "")],
        [("equal", "abc", "abc")], [],
        [("delete", "a", ""), ("equal", "b", "b"), ("insert", "", "a"), ("equal", "zz", "zz"), ("insert", "", "d"), ("equal", "c", "c"), ("delete", "d", "")],
    ]

    def plain(parts):
        s, out, i = segments_of(parts), [], 0
        while i < len(s):
            for n in range(2, 8) if s[i][0] in ("insert", "delete") else ():
                w = s[i : i + n]
                one, two = "".join(x[1] for x in w), "".join(x[2] for x in w)
                kinds = {x[0] for x in w}
                if len(w) == n and {"insert", "delete"} <= kinds <= {"insert", "delete", "equal"} and 2 <= len(one) <= 6 and one != two and sorted(one) == sorted(two):
                    out.append((one, two, w[0][3], w[-1][4], w[0][5], w[-1][6]))
                    i += n
                    break
            else:
                i += 1
        return out

    df = spark.createDataFrame([(k, segments_of(c)) for k, c in enumerate(cases)], StructType().add("k", IntegerType()).add("s", ArrayType(align.SEGMENT)))
    got = {k: [] for k in range(len(cases))}
    for r in df.select("k", F.posexplode(align.merge_transpositions(F.col("s"))).alias("n", "x")).orderBy("k", "n").collect():
        got[r.k].append((r.x.text1, r.x.text2, r.x.i1, r.x.i2, r.x.j1, r.x.j2))
    assert got == {k: plain(c) for k, c in enumerate(cases)}
    assert [len(got[k]) for k in range(len(cases))] == [1, 1, 1, 0, 0, 0, 0, 2]


def test_transfer(spark):
    bare = "".join(c for c in BASE if c not in MARKS)
    df = spark.createDataFrame([(BASE, bare)], "a string, b string")
    assert align.transfer_marks(df, "a", "b", MARKS).first().transferred == BASE


def test_cluster(spark):
    df = spark.createDataFrame([(0, 1, 2, 0.9), (0, 1, 3, 0.4), (0, 2, 3, 0.5)], "grp long, i long, j long, sim double")
    got = align.cluster(df).orderBy("step").collect()
    assert [(x.a, x.b, round(x.height, 6)) for x in got] == [(1, 2, 0.1), (1, 3, 0.55)]
    tree = sinks.newick([(x.a, x.b, x.height) for x in got], {1: "A", 2: "B b", 3: "C"})
    assert tree == "((A:0.050000,'B b':0.050000):0.225000,C:0.275000);"
    assert "NTAX=3" in sinks.nexus([], {1: "A", 2: "B", 3: "C"})


def test_cluster_under_a_base(spark):
    """The base is like all and merges with none; of equal distances the first pair merges, and a new cluster comes last."""
    sims = {(0, 1): 0.99, (0, 2): 0.99, (0, 3): 0.99, (0, 4): 0.99, (1, 2): 0.5, (1, 3): 0.75, (1, 4): 0.25, (2, 3): 0.25, (2, 4): 0.75, (3, 4): 0.5}
    df = spark.createDataFrame([(g, i, j, s) for g in (1, 2) for (i, j), s in sims.items()], "grp long, i long, j long, sim double")
    got = align.cluster(df, base=0).orderBy("grp", "step").collect()
    assert [(x.grp, x.a, x.b, round(x.height, 6)) for x in got] == [(g, *m) for g in (1, 2) for m in ((1, 3, 0.25), (2, 4, 0.25), (1, 2, 0.625))]


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (60, 60)], "a long, b long")
    got = {x.node: x.component for x in graph.components(df).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 50: 40, 40: 40, 60: 60}


def test_files(spark, tmp_path):
    (tmp_path / "甲.txt").write_bytes("学而时习之".encode("gbk"))
    (tmp_path / "b.xml").write_text("<TEI><text><body><p>天<note>x</note>地</p></body></text></TEI>")
    (tmp_path / "c.bin").write_bytes(b"\0")
    (tmp_path / "e.docx").write_bytes(b"no zip")
    w = files._WORD[1:-1]
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t> two</w:t></w:r></w:p></w:body></w:document>')
    got = {x.name: (x.text, x.error) for x in files.witnesses(spark, str(tmp_path)).collect()}
    assert got == {"甲": ("学而时习之", None), "b": ("天地", None), "c": (None, "unknown kind"), "d": ("one\ntwo", None), "e": (None, "unreadable")}


def test_sinks(spark):
    notes = spark.createDataFrame([(1, 5, "variant", "A&B", "x|y"), (2, 6, "addition", "", "z")], "index int, position int, note_type string, base_text string, variant_text string")
    assert sinks.markdown(notes).first().line == "| 1 | 5 | variant | A&B | x\\|y |"
    lines = [x.line for x in sinks.latex(notes).orderBy("index").collect()]
    assert "A\\&B" in lines[0] and "om." in lines[1]
    assert "A&amp;B" in sinks.tei(notes).first().line


def test_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    want = rates.over_limit(events, 0).count()
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = rates.over_limit(stream, 0).writeStream.format("memory").queryName("over").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("over").count() == want > 0


@pytest.mark.parametrize("autojunk", [False, True])
def test_kernel_is_the_standard_matcher(autojunk):
    """The same segments as the standard library's matcher, for texts of few and of many letters, whole batches at once."""
    r = random.Random(4)
    left, right = [], []
    for _ in range(500):
        letters = r.choice(["ab", "abc", "abcdefghij ", "字句讀x\U00020000"])
        x = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 30, 120, 400])))
        y = list(x)
        for _ in range(r.randint(0, 8)):
            k = r.randint(0, max(0, len(y) - 1))
            y[k : k + r.randint(0, 4)] = [r.choice(letters) for _ in range(r.randint(0, 4))]
        left.append(x)
        right.append("".join(y) if r.random() < 0.8 else "".join(r.choice(letters) for _ in range(len(x))))
    want = [[tuple(c) for c in SequenceMatcher(None, x, y, autojunk).get_opcodes()] for x, y in zip(left, right, strict=True)]
    assert align.opcodes(left, right, autojunk) == want


def test_kernel_checks_hashes(monkeypatch):
    """Runs that only their hashes make equal are told apart."""
    monkeypatch.setattr(align, "_mix", lambda x: x & np.uint64(0x3 << 60))
    left, right = ["abcabd", "xaxb", "hello world"], ["abdabc", "bxax", "yellow old"]
    assert align.opcodes(left, right)[0][0][0] in ("equal", "replace", "insert", "delete")
    for k, codes in enumerate(align.opcodes(left, right)):
        assert all(left[k][a:b] == right[k][c:d] for kind, a, b, c, d in codes if kind == "equal")
        assert codes[0][1] == codes[0][3] == 0 and codes[-1][2] == len(left[k]) and codes[-1][4] == len(right[k])


def test_long_pairs():
    r = random.Random(1)
    base = "".join(r.choice("the quick brown fox ") for _ in range(60_000))
    other = base[:10_000] + "X" + base[10_001:40_000] + base[40_010:]
    assert align.opcodes([base], [other]) == [[("equal", 0, 10_000, 0, 10_000), ("replace", 10_000, 10_001, 10_000, 10_001), ("equal", 10_001, 40_000, 10_001, 40_000), ("delete", 40_000, 40_010, 40_000, 40_000), ("equal", 40_010, 60_000, 40_000, 59_990)]]
