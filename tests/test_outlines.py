"""Outlined pages against what their markup says, volumes through JSON, and the catalogue of volumes."""

from __future__ import annotations

from variorum.sources import outlines as O

PAGE = """<html><body><div class="juan_text">
<div class="ybhDiv x" id="T1579D08_001"><div class="YBh_head"><span class="n">1</span><span class="head_text" path="1">本 地<b>分</b></span></div>
 <a class="ref" id="p0279a01"></a><p>瑜伽[T30, p0279a03] 師地 &amp;<i> 論 </i>。</p><p> </p><p>次[0279a05]段</p>
 <a class="link2oth" id="X0001D02_003"></a><a class="link2oth" id="bad"></a>
 <div class="ybhDiv" id="T1579D08_002"><div class="YBh_head"> 嗢柁南 <a>x</a></div><div class="lg"><span>偈</span><span>頌</span></div><p>先文</p>
  <a class="ref" id="p0279b01"/><a class="link2oth" id="T1579D08_001"></a>
  <div class="ybhDiv" id="T1579D08_003"><div class="YBh_head"><a>略</a><em>末節</em></div><div><p>不直</p></div><br></div></div></div>
<div class="ybhDiv" id="nothing"><p>lost</p></div>
<div class="ybhDiv" id="T1579D08_004"><p>unclosed <script>var p = 1;</script>end</div>
<p class="normal">outside</p></div></body></html>"""
FLAT = """<p class="normal">before</p><a class="ref" id="r1"></a><div class="juan_text"><p class="normal">一</p><a class="ref" id="r2"></a><p class="normal"> </p><div><p class="normal">二 [12a3] 三</p></div><p>other</p></div><p class="normal">after</p>"""


def test_outline(spark):
    rows = spark.createDataFrame([("a", PAGE), ("f", FLAT), ("n", None), ("e", "")], "name string, html string")
    nodes = O.outline(rows, "name", "html")
    got = {(r.name, r.node_id): (r.number, r.work, r.head, r.path, r.text, r.page, r.ancestors, r.links) for r in nodes.collect()}
    one, two, three = (f"T1579D08_00{k}" for k in (1, 2, 3))
    assert got == {
        ("a", one): (1, "T1579", "本 地分", "1", "瑜伽 師地 &論。 次段", "p0279a01", [], ["X0001D02_003", one]),
        ("a", two): (2, "T1579", "嗢柁南", "", "先文 偈頌", "p0279b01", [one], [one]),
        ("a", three): (3, "T1579", "末節", "", "", "", [one, two], []),
        ("a", "T1579D08_004"): (4, "T1579", "", "", "unclosedend", "", [], []),
        ("f", "f_p1"): (1, "", "", "", "一", "r1", [], []),
        ("f", "f_p2"): (2, "", "", "", "", "r2", [], []),
        ("f", "f_p3"): (3, "", "", "", "二 三", "r2", [], []),
    }
    tree = {tuple(r) for r in O.closure(nodes.where("name = 'a'")).collect()}
    assert tree == {(one, one, 0), (two, two, 0), (three, three, 0), (one, two, 1), (two, three, 1), (one, three, 2), ("T1579D08_004",) * 2 + (0,)}
    assert sorted(tuple(r) for r in O.links(nodes, "T1579").collect()) == [(one, 0, "X0001D02_003", "X0001", False), (one, 1, one, "T1579", True), (two, 0, one, "T1579", True)]


def test_volumes(spark, tmp_path):
    rows = spark.createDataFrame([("a", PAGE), ("f", FLAT)], "name string, html string")
    nodes = O.outline(rows, "name", "html").selectExpr("if(name = 'a', 'T1579', 'F') AS work", "CAST(if(name = 'a', 2, 1) AS long) AS volume", "number", "node_id", "head", "path", "text", "page", "links")
    records = O.volumes(nodes, "work", "volume")
    O.write_volumes(records, str(tmp_path / "json"), "work")
    back = O.read_volumes(spark, str(tmp_path / "json"))
    columns = ["work", "volume", "number", "node_id", "head", "path", "text", "page", "links"]
    assert sorted(map(tuple, back.select(columns).collect()), key=str) == sorted(map(tuple, nodes.where("text <> ''").select(columns).collect()), key=str)
    works = spark.createDataFrame([("T1579", 3), ("F", 1), ("none", 4)], "work string, n_volumes int")
    assert sorted(map(tuple, O.catalogue(records, works).collect())) == [("F", 1, 2, True), ("T1579", 1, 0, False), ("T1579", 2, 3, True), ("T1579", 3, 0, False)]
