"""Short names of editions, and notes put into words, as expressions of built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short names of editions.
SHORT = {
    "丽藏": "丽", "高丽藏": "丽", "高丽大藏经": "丽", "房山石经": "房", "房山": "房", "磧砂藏": "磧", "碛砂藏": "磧", "普宁藏": "普",
    "南藏": "南", "永乐南藏": "南", "永乐北藏": "北", "北藏": "北", "资福藏": "资", "大正藏": "正", "大正新修大藏经": "正",
    "频伽藏": "频", "频伽精舍校刊大藏经": "频", "嘉兴藏": "嘉", "卍续藏": "卍", "卍正藏": "卍", "龙藏": "龙", "清藏": "清",
    "乾隆大藏经": "龙", "赵城金藏": "金", "金藏": "金", "中华大藏经": "中", "敦煌写本": "敦", "敦煌": "敦", "宋本": "宋",
    "元本": "元", "明本": "明", "宫本": "宫", "圣本": "圣", "甲本": "甲", "乙本": "乙", "丙本": "丙", "丁本": "丁",
}
#: Short names by what stands in a bracket behind the system and a dot, the first that fits; what is cut off else.
BRACKET = "【[^●]*●([^】]+)】"
IN_BRACKET = {
    "高[麗丽]再雕增上寺": "丽增", "高[麗丽]再雕": "丽再", "高[麗丽]初雕": "丽初", "高[麗丽]": "丽", "大正藏": "大正", "大正": "大正",
    "房山石[經经]": "房山", "房山": "房山", "崇[寧宁]": "崇宁", "洪武南藏": "洪武", "洪武": "洪武", "永[樂乐]南藏": "永乐南",
    "永[樂乐]北藏": "永乐北", "嘉[興兴]": "嘉兴", "[磧碛]砂": "碛砂", "普[寧宁]": "普宁", "[頻频]伽": "频伽", "[龍龙]藏": "龙藏",
    "乾隆": "乾隆", "赵城金藏": "赵城", "金藏": "金藏", "敦煌": "敦煌", "资福": "资福", "卍[續续]藏": "卍续", "卍正藏": "卍正",
    "中[華华]": "中华", "CBETA": "CBETA",
}
PUBLISHER = "(?s)(版|出版|基金會|基金会|佛協|佛协|華夏|华夏).*$"
#: Names of classes, the sign for no text, and the words for evidence that needs no more.
VARIANT, ADDED, LOST, TURNED, WRONG, NOTHING = ("异体字", "variant"), ("衍文", "yanwen"), ("脱文", "tuowen"), ("倒文", "daowen"), "讹误", "∅"
WITHIN = {"context_consistent": "同经前后文一致", "style_conform": "符合本经体例", "parallel_passage": "与他处对应文句相合"}
BY_REASON = {"semantic_smooth": "义理更通顺", "grammar_correct": "文法更通顺"}


def _first(cases: list[tuple[Column, Column | str]], last: Column | str | None) -> Column:
    """The value of the first case that holds."""
    end = last if isinstance(last, Column) else F.lit(last)
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(cases), end)


def short_name(name: Column) -> Column:
    """The known short name; by a bracket (system, dot, edition) the rule that fits, else its first four characters without the publisher, or two where nothing else is left; else the first known name that holds this one or is held by it; else four characters."""
    inner = F.regexp_extract(name, BRACKET, 1)
    bare = F.regexp_replace(inner, PUBLISHER, "")
    of_bracket = _first([(F.rlike(inner, F.lit(p)), s) for p, s in IN_BRACKET.items()], F.when(bare != "", F.left(bare, F.lit(4))).otherwise(F.left(inner, F.lit(2))))
    near = _first([(F.contains(name, F.lit(n)) | F.contains(F.lit(n), name), s) for n, s in SHORT.items()], F.left(name, F.lit(4)))
    return _first([(name == n, s) for n, s in SHORT.items()], F.when(inner != "", of_bracket).otherwise(near))


def note_category(given: Column, old: Column, new: Column) -> Column:
    """The class that the variant table gives; else an addition where the base has no text, a loss where the new text is none, else an error."""
    none = lambda c: c.isin("", NOTHING)
    return F.when(F.coalesce(given, F.lit("")) != "", given).when(none(old), ADDED[0]).when(none(new), LOST[0]).otherwise(WRONG)


def note_action(category: Column, old: Column, new: Column, selected: Column, base: Column) -> Column:
    """What is done: nothing (the base is kept, or a variant), taken out, put in, turned round, or changed."""
    kept = (selected == base) & (old == new)
    return (
        F.when(kept | category.isin(*VARIANT), "不改").when(category.isin(*ADDED), "删").when(category.isin(*LOST), F.when(new == NOTHING, "删").otherwise("补")).when(category.isin(*TURNED), "乙").otherwise("改")
    )


def note_sources(selected: Column, base: Column, witnesses: Column) -> Column:
    """The selected edition, unless it is the base, and those that evidence of witnesses names behind its first underline; the base alone where there is nothing else."""
    named = F.transform(F.filter(witnesses, lambda x: F.contains(x, F.lit("_"))), lambda x: F.split(x, "_")[1])
    own = F.when((selected != "") & (selected != base), F.array(selected)).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(own, named))
    return F.when(F.size(found) > 0, found).when(selected != "", F.array(selected)).otherwise(found)


def note_explanation(category: Column, old: Column, new: Column, sources: Column, witnesses: Column, within: Column, other: Column, reason: Column, commentaries: Column, remark: Column) -> Column:
    """The evidence of each kind in words and in its order, and the user's remark; without any what the class says by itself."""
    says = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    starts = lambda x, s: F.startswith(x, F.lit(s))
    named = lambda x: F.when(F.contains(x, F.lit("_")), F.split(x, "_")[1]).otherwise(F.coalesce(F.get(sources, F.lit(0)), F.lit("")))
    table = lambda x, words: _first([(x == k, v) for k, v in words.items()], None)
    quoted = F.when(F.size(commentaries) > 0, says("「", F.get(commentaries, F.lit(0)), "」引作「", new, "」")).otherwise(says("注疏引作「", new, "」"))
    alike = lambda how: says(how, "近「", old, "」「", new, "」而讹")
    parts = [
        F.transform(witnesses, lambda x: F.when(starts(x, "majority"), says("多数版本作「", new, "」")).when(starts(x, "early_version"), says("「", named(x), "」本年代较早")).when(starts(x, "authoritative"), says("「", named(x), "」为权威版本"))),
        F.transform(within, lambda x: table(x, WITHIN)),
        F.transform(other, lambda x: F.when(x == "commentary_match", quoted).when(x == "other_sutra_match", "他经引用同")),
        F.transform(reason, lambda x: F.when(x == "form_similar_error", alike("形")).when(x == "sound_similar_error", alike("音")).when(x == "context_required", says("文意不完，当补「", new, "」字")).otherwise(table(x, BY_REASON))),
        F.array(F.when(remark != "", remark)),
    ]
    said = F.filter(F.concat(*parts), lambda x: x.isNotNull())
    alone = (
        F.when(category.isin(*VARIANT), says("按：「", old, "」「", new, "」为异体字，义同。"))
        .when(category.isin(*ADDED), says("按：「", F.when(old == NOTHING, new).otherwise(old), "」为衍文。"))
        .when(category.isin(*LOST), F.when(new.isin("", NOTHING), "按：此处有脱文。").otherwise(says("按：文意不完，当补「", new, "」字。")))
        .when(category.isin(*TURNED), says("按：「", old, "」当作「", new, "」，文字颠倒。"))
        .otherwise("")
    )
    return F.when(F.size(said) > 0, says("按：", F.array_join(said, "，"), "。")).otherwise(alone)


def note_head(index: Column, pos: Column) -> Column:
    """The number of a note and its place (from 1)."""
    return F.concat(F.lit("【"), index.cast("string"), F.lit("】第"), (pos + 1).cast("string"), F.lit("字"))


def note_tail(category: Column, action: Column, old: Column, new: Column, sources: Column, explanation: Column, uncertain: Column) -> Column:
    """The rest of a note: what stands there, which editions read what, the explanation, and a sign of doubt."""
    says = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    by = F.array_join(F.transform(sources, short_name), "、")
    some, was, now = by != "", says("“", old, "”"), says("“", new, "”")
    reads = says(was, "，", by, "作", now)
    body = (
        F.when(action == "改", F.when(some, says(reads, "。")).otherwise(says(was, "改", now, "。")))
        .when(action == "删", F.when(old.isin("", NOTHING), says("删", now, "。")).when(some, says(was, "，", by, "无。")).otherwise(says(was, "删。")))
        .when(action == "补", F.when(some, says("，", by, "有", now, "字。")).otherwise(says("补", now, "。")))
        .when(action == "乙", F.when(some, says(reads, "。")).otherwise(says(was, now, "乙。")))
        .otherwise(F.when(~category.isin(*VARIANT), says(was, "，不改。")).when(some, says(reads, "，异体不改。")).otherwise(says(was, now, "异体，不改。")))
    )
    return says(body, explanation, F.when(uncertain, "（存疑）").otherwise(""))
