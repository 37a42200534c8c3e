"""Short names and worded notes against the domain's worked examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from variorum.functions import notes as N
from variorum.operators import notes

NAMES = {
    "丽藏": "丽", "【中系●高麗再雕增上寺版】": "丽增", "【中系●大正藏佛陀基金會版】": "大正", "【北系●房山石經北京華夏版】": "房山", "【南系●崇寧】": "崇宁",
    "【南系●洪武南藏川佛協版】": "洪武", "【中系●高丽初雕】《順正理論》卷13": "丽初", "【外系●無名氏抄本出版社】": "無名氏抄", "【外系●版】": "版", "新编大正藏卷一": "正", "明": "明",
    "某私家藏本甲": "某私家藏", "抄本": "抄本", "": "丽", "CBETA": "CBET", "【电子●CBETA 2023】": "CBETA",
}


def test_short_names(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", N.short_name(F.col("name")).alias("short"))
    assert {r.name: r.short for r in rows.collect()} == NAMES


FIELDS = "idx int, pos int, old string, new string, given string, selected string, base string, witnesses array<string>, within array<string>, other array<string>, reason array<string>, commentaries array<string>, remark string, uncertain boolean"
CASES = [
    ((22, "住", "往", None, "丽藏", ["single_房山石经"], None, None, None, None, None, None), "讹误", "改", ["丽藏", "房山石经"], "【{}】第23字“住”，丽、房作“往”。"),
    ((44, "云", "∅", "衍文", "大正藏", None, None, None, None, None, None, False), "衍文", "删", ["大正藏"], "【{}】第45字“云”，正无。按：「云」为衍文。"),
    ((44, "云", "", "yanwen", "", None, None, None, None, None, None, False), "yanwen", "删", [], "【{}】第45字“云”删。按：「云」为衍文。"),
    ((3, "∅", "其", None, "丽藏", None, None, None, None, None, None, True), "衍文", "删", ["丽藏"], "【{}】第4字删“其”。按：「其」为衍文。（存疑）"),
    ((66, "何", "何", "脱文", "频伽藏", None, None, None, None, None, None, None), "脱文", "补", ["频伽藏"], "【{}】第67字，频有“何”字。按：文意不完，当补「何」字。"),
    ((66, "何", "何", "tuowen", "", None, None, None, ["context_required"], None, None, None), "tuowen", "补", [], "【{}】第67字补“何”。按：文意不完，当补「何」字。"),
    ((5, "甲", "", None, "乙本", None, None, None, None, None, None, None), "脱文", "补", ["乙本"], "【{}】第6字，乙有“”字。按：此处有脱文。"),
    ((5, "甲", "∅", None, "乙本", None, None, None, None, None, None, None), "脱文", "删", ["乙本"], "【{}】第6字“甲”，乙无。按：此处有脱文。"),
    ((88, "AB", "BA", "倒文", "", None, None, None, None, None, None, None), "倒文", "乙", [], "【{}】第89字“AB”“BA”乙。按：「AB」当作「BA」，文字颠倒。"),
    ((88, "AB", "BA", "daowen", "宋本", None, None, None, None, None, None, None), "daowen", "乙", ["宋本"], "【{}】第89字“AB”，宋作“BA”。按：「AB」当作「BA」，文字颠倒。"),
    ((0, "義", "义", "异体字", "明本", None, None, None, None, None, None, None), "异体字", "不改", ["明本"], "【{}】第1字“義”，明作“义”，异体不改。按：「義」「义」为异体字，义同。"),
    ((0, "義", "义", "variant", "", None, None, None, None, None, None, None), "variant", "不改", [], "【{}】第1字“義”“义”异体，不改。按：「義」「义」为异体字，义同。"),
    ((1, "如", "如", None, "底本", None, None, None, None, None, None, None), "讹误", "不改", ["底本"], "【{}】第2字“如”，不改。"),
    ((1, "己", "已", None, "", ["majority", "early_version", "authoritative"], ["context_consistent", "inner_consistent", "parallel_passage"], ["commentary_match", "other_sutra_match"], ["sound_similar_error", "grammar_correct"], ["疏", "记"], "見前", None),
     "讹误", "改", ["version"], "【{}】第2字“己”，vers作“已”。按：多数版本作「已」，「version」本年代较早，「version」为权威版本，同经前后文一致，与他处对应文句相合，「疏」引作「已」，他经引用同，音近「己」「已」而讹，文法更通顺，見前。"),
    ((1, None, None, None, None, [None, "none"], None, ["commentary_match"], ["no such"], [], None, None), "衍文", "删", [], "【{}】第2字删“”。按：注疏引作「」。"),
]


def test_worded(spark):
    rows = [(k, pos, old, new, given, selected, "底本", *rest) for k, ((pos, old, new, given, selected, *rest), *_) in enumerate(CASES, 1)]
    got = {r.idx: (r.category, r.action, r.sources, r.note) for r in notes.worded(spark.createDataFrame(rows, FIELDS)).collect()}
    for k, (_, category, action, sources, text) in enumerate(CASES, 1):
        assert got[k] == (category, action, sources, text.format(k)), k


def test_each_decision_is_worded_once(spark, monkeypatch):
    """rows that differ in number and place alone share their words, which are broadcast; beyond the bound each row has its own."""
    rows = [(k, pos + n, old, new, given, selected, "底本", *rest) for n in range(3) for k, ((pos, old, new, given, selected, *rest), *_) in enumerate(CASES, 1)]
    decisions = spark.createDataFrame(rows, FIELDS)
    shared = notes.worded(decisions)
    assert "BroadcastHashJoin" in shared._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(notes, "KINDS", 0)
    single = notes.worded(decisions)
    assert "BroadcastHashJoin" not in single._jdf.queryExecution().executedPlan().toString() and shared.columns == single.columns
    assert sorted(map(str, shared.collect())) == sorted(map(str, single.collect()))
