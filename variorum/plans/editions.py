"""Editions of every document: witnesses that depart from it by known rules, so SQL can say what their table must hold.

A witness exchanges single characters of the base (text without layout) for texts of none to three characters; its
alignment is therefore known place by place, and is what the kernel gives for real witnesses. All documents take part,
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.marks import LAYOUT
from ..operators import lineage as L
from ..operators import notes
from ..operators import witnesses as W
from ..operators.graph import cut
from ..query import Registry, table

registry = Registry()
BASE = "大正藏"
#: What each witness writes for characters of the base.
RULES = {
    "开宝藏": {"q": "訛", ".": ".增"},
    "高丽藏再雕": {"q": "訛", "z": "", "é": "e"},
    "赵城金藏": {"q": "訛", ".": ".增補", "ü": "u"},
    "思溪藏": {"é": "e", "j": "i", "x": ""},
    "碛砂藏": {"é": "e", "j": "i", "ß": "ss", "x": ""},
    "嘉兴藏": {"é": "e", "j": "i", ",": "", "x": "k"},
    "房山石经": {"v": "u", "w": "vv", "j": "y"},
}
NAMES = list(RULES)
#: The dictionary of variants: characters that are one.
VARIANTS = {"é": "e", "ü": "u", "v": "u", "j": "i"}


def built(documents: DataFrame) -> DataFrame:
    """All witnesses of all documents, a row a segment: doc_id, base, _chars (the base's characters), witness, type, text1, text2, i1."""
    to: dict[str, list] = {}
    for witness, rule in RULES.items():
        for c, new in rule.items():
            to.setdefault(c, []).append(F.struct(F.lit(witness).alias("witness"), F.lit(new).alias("text2")))
    of = F.create_map(*(x for c, each in to.items() for x in (F.lit(c), F.array(*each))))
    base = documents.select("doc_id", T.normalize_collation(F.coalesce("text", F.lit(""))).alias("base")).withColumn("_chars", F.split("base", ""))
    # a row a character that any witness changes, then one for each witness that does
    hit = base.select("doc_id", "base", "_chars", F.posexplode("_chars").alias("i1", "text1")).where(F.contains(F.lit("".join(to)), F.col("text1")) & (F.col("text1") != ""))
    each = hit.select("doc_id", "base", "_chars", "i1", "text1", F.inline(F.element_at(of, F.col("text1"))))
    return each.withColumn("type", F.lit("replace"))


def dictionary(spark) -> DataFrame:
    return spark.createDataFrame(sorted({*VARIANTS.items(), *((v, v) for v in VARIANTS.values())}), "char string, std string")


def rows(spark, sf_dir: str, context: bool = False, gathered: bool = False) -> DataFrame:
    """The readings of all witnesses. gathered: a document's rows stay in one partition, so whatever is grouped by document and more needs no shuffle of readings, only this one of texts."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return W.departures(built(documents.repartition("doc_id") if gathered else documents), "doc_id", "witness", dictionary(spark), "base" if context else None)


def met(spark, sf_dir: str) -> DataFrame:
    return W.meetings(rows(spark, sf_dir, gathered=True), "doc_id", "witness")


_SQL_RULES = "(VALUES " + ", ".join(f"('{w}', '{c}', '{t}')" for w, r in RULES.items() for c, t in r.items()) + ") r(witness, ch, new)"
_SQL_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in VARIANTS.items())
_READINGS = f"""WITH b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{LAYOUT}', '', 'g') AS base FROM documents),
c AS (SELECT doc_id, base, generate_subscripts(string_split(base, ''), 1) - 1 AS pos, unnest(string_split(base, '')) AS ch FROM b WHERE base <> ''),
h AS (SELECT doc_id, base, pos, ch, witness, new FROM c JOIN {_SQL_RULES} USING (ch)),
e AS (SELECT doc_id, base AS t, witness, pos, false AS inserted, 0 AS ord, ch AS base, CASE WHEN new = '' THEN '∅' ELSE substr(new, 1, 1) END AS reading FROM h
  UNION ALL SELECT doc_id, base, witness, pos + 1, true, k - 2, '∅', substr(new, k, 1) FROM h, (VALUES (2), (3)) n(k) WHERE length(new) >= k),
x AS (SELECT doc_id, t, witness, CAST(pos AS INTEGER) AS pos, inserted, CAST(ord AS INTEGER) AS ord, base, reading, CASE WHEN inserted THEN 'addition' WHEN reading = '∅' THEN 'omission'
  WHEN (base, reading) IN ({_SQL_PAIRS}) THEN 'variant' ELSE 'error' END AS category FROM e WHERE base <> reading)"""


@registry.add(_READINGS + " SELECT doc_id, witness, pos, inserted, ord, base, reading, category FROM x")
def f22_variant_extraction(spark, sf_dir):
    """Every place where a witness departs from the base, by class."""
    return rows(spark, sf_dir).select("doc_id", "witness", *W.PLACE, "base", "reading", "category")


@registry.add(
    _READINGS + " SELECT doc_id, pos + 1 AS position, inserted, ord, '...' || substr(t, greatest(pos - 5, 0) + 1, pos - greatest(pos - 5, 0)) || '【' || base || '】' || substr(t, pos + CASE WHEN inserted THEN 1 ELSE 2 END, 5) || '...' AS context, base AS base_char, "
    + ", ".join(f"coalesce(max(reading) FILTER (WHERE witness = '{w}'), base) AS w{k}" for k, w in enumerate(NAMES))
    + """, CASE WHEN bool_or(category = 'omission') THEN 'omission' WHEN bool_or(category = 'addition') THEN 'addition' WHEN count(*) FILTER (WHERE category = 'variant') > 0
  AND count(*) FILTER (WHERE category = 'variant') >= count(*) FILTER (WHERE category = 'error') THEN 'variant' ELSE 'error' END AS category FROM x GROUP BY doc_id, t, pos, inserted, ord, base"""
)
def f21_witness_table(spark, sf_dir):
    """The variant table of seven witnesses, with omissions and additions."""
    return W.variant_table(rows(spark, sf_dir, context=True, gathered=True), "doc_id", "witness", NAMES)


_MET = _READINGS + """, m AS (SELECT p.doc_id, p.witness AS a, q.witness AS b, p.reading = q.reading AS same, p.category AS category, q.category AS other, p.inserted AS added
  FROM x p JOIN x q ON p.doc_id = q.doc_id AND p.pos = q.pos AND p.inserted = q.inserted AND p.ord = q.ord AND p.witness < q.witness)"""
_SHARED = _MET + """, s AS (SELECT a, b, count(*) FILTER (WHERE same AND category = 'error' AND other = 'error') AS errors, count(*) FILTER (WHERE same AND category = 'variant' AND other = 'variant') AS variants,
  count(*) FILTER (WHERE same AND category = other AND category IN ('omission', 'addition')) AS gaps FROM m GROUP BY a, b)"""


@registry.add(_SHARED + " SELECT a, b, errors, variants, gaps, errors + variants + gaps AS combined FROM s WHERE errors + variants + gaps > 0")
def e07_shared_matrix(spark, sf_dir):
    """Errors, variants, omissions and additions that two witnesses share, over all documents."""
    return W.shared_readings(met(spark, sf_dir))


_NAMES = "(VALUES " + ", ".join(f"('{w}')" for w in NAMES) + ") n(w)"
_AXIS = _SHARED + f""", o AS (SELECT doc_id, witness AS w, count(*) FILTER (WHERE category = 'addition') AS added, count(*) FILTER (WHERE category = 'omission') AS omitted, count(*) FILTER (WHERE category <> 'addition') AS departed FROM x GROUP BY ALL),
f AS (SELECT doc_id, w, length(base) AS n, coalesce(added, 0) AS added, coalesce(omitted, 0) AS omitted, coalesce(departed, 0) AS departed FROM b CROSS JOIN {_NAMES} LEFT JOIN o USING (doc_id, w)),
g AS (SELECT doc_id, a, b, count(*) FILTER (WHERE NOT added) AS both_, count(*) FILTER (WHERE same AND category <> 'omission') AS alike FROM m GROUP BY ALL),
p AS (SELECT doc_id, '{BASE}' AS a, w AS b, n - departed AS m, 2 * n + added - omitted AS t FROM f UNION ALL
  SELECT i.doc_id, i.w, j.w, i.n - i.departed - j.departed + coalesce(both_, 0) + coalesce(alike, 0), i.n + i.added - i.omitted + j.n + j.added - j.omitted
  FROM f i JOIN f j ON i.doc_id = j.doc_id AND i.w < j.w LEFT JOIN g ON g.doc_id = i.doc_id AND g.a = i.w AND g.b = j.w)"""


def similarities(spark, sf_dir: str) -> DataFrame:
    """Likeness of all editions of each document. Readings are found once, and go on as the different kinds of places that a document has."""
    places = cut(W.alike_places(rows(spark, sf_dir, gathered=True), "doc_id", "witness", NAMES))
    lengths = table(spark, sf_dir, "documents").select("doc_id", F.length(T.normalize_collation(F.coalesce("text", F.lit("")))).alias("n"))
    return W.axis_similarity(lengths, *W.tallied_places(places, "doc_id", "witness"), "doc_id", "witness", NAMES, BASE)


@registry.add(_AXIS + " SELECT doc_id, a, b, CAST(m AS BIGINT) AS m, CAST(t AS BIGINT) AS t, round(CASE WHEN t = 0 THEN 1.0 ELSE 2.0 * m / t END, 4) AS sim FROM p")
def f12_axis_similarity(spark, sf_dir):
    """Similarity of all editions of every document, on the common axis."""
    s = similarities(spark, sf_dir)
    return s.select("doc_id", "a", "b", F.col("m").cast("long").alias("m"), F.col("t").cast("long").alias("t"), F.round("sim", 4).alias("sim"))


#: Fixed values, first match wins: the years that names tell, and the systems.
YEARS = [
    ("开宝", 971), ("高丽初", 1011), ("高丽再", 1236), ("高麗", 1236), ("赵城", 1148), ("趙城", 1148), ("金藏", 1148), ("大正", 1924), ("中华", 1994), ("中華", 1994),
    ("崇宁", 1104), ("崇寧", 1104), ("毗卢", 1148), ("毘盧", 1148), ("思溪", 1127), ("碛砂", 1231), ("磧砂", 1231), ("普宁", 1280), ("普寧", 1280), ("洪武", 1372), ("永乐", 1410), ("永樂", 1410),
    ("嘉兴", 1589), ("嘉興", 1589), ("龙藏", 1735), ("龍藏", 1735), ("乾隆", 1735), ("频伽", 1909), ("頻伽", 1909), ("契丹", 1031), ("房山", 605), ("CBETA", 1998), ("缩刻", 1880), ("縮刻", 1880),
]
ANCESTORS = [("开宝藏", 971), ("开宝", 971), ("契丹藏", 1031), ("契丹", 1031), ("崇宁藏", 1104), ("崇寧藏", 1104), ("崇寧", 1104)]
CHAINS = [
    ("开宝藏", "高丽初雕"), ("高丽初雕", "高丽再雕"), ("高丽再雕", "大正藏"), ("开宝藏", "赵城金藏"), ("赵城金藏", "中华藏"),
    ("崇宁藏", "思溪藏"), ("思溪藏", "碛砂藏"), ("碛砂藏", "普宁藏"), ("碛砂藏", "嘉兴藏"), ("嘉兴藏", "龙藏"), ("契丹藏", "房山石经"),
]
SYSTEMS = [("开宝", "中系"), ("高丽", "中系"), ("赵城", "中系"), ("大正", "中系"), ("思溪", "南系"), ("碛砂", "南系"), ("嘉兴", "南系"), ("契丹", "北系"), ("房山", "北系")]


def lineage(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the editions, from evidence of all documents: similarity of their texts laid end to end, and shared errors."""
    # all documents as one text: what is shared and what is long adds up, so only numbers by witness and class are kept
    whole = lambda df: df.withColumn("project", F.lit(1))
    own = cut(whole(W.tallied(rows(spark, sf_dir), "witness", "category")))
    shared = cut(whole(W.tallied(met(spark, sf_dir), *W.MET)))
    lengths = whole(table(spark, sf_dir, "documents")).groupBy("project").agg(F.sum(F.length(T.normalize_collation(F.coalesce("text", F.lit(""))))).alias("n"))
    sim = W.axis_similarity(lengths, own, shared, "project", "witness", NAMES, BASE).select("a", "b", F.when(F.col("t") > 0, F.col("sim")).alias("sim"))
    errors = W.shared_readings(shared).select("a", "b", "errors")
    make = lambda values, schema: spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "ord int, " + schema)
    names = make([(n,) for n in [BASE, *NAMES]], "name string")
    ancestors = make(ANCESTORS, "keyword string, year int")
    located = spark.createDataFrame([("嘉兴藏", 1579)], "name string, year int")
    nodes = L.edition_nodes(names, located, ancestors, make(YEARS, "keyword string, year int"), make(SYSTEMS, "keyword string, system string"))
    return nodes, L.lineage_edges(nodes, sim, errors, make(CHAINS, "src string, dst string"))


_EDITIONS = [BASE, *NAMES]
_values = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in (i, *r)) + ")" for i, r in enumerate(rows))
_LINEAGE = _AXIS + f""", nm(ord, name) AS (VALUES {_values([(n,) for n in _EDITIONS])}), an(o, k, y) AS (VALUES {_values(ANCESTORS)}), yr(o, k, y) AS (VALUES {_values(YEARS)}), sy(o, k, s) AS (VALUES {_values(SYSTEMS)}), ch(o, x, y) AS (VALUES {_values(CHAINS)}),
nd AS (SELECT name, ord, CASE WHEN name = '嘉兴藏' THEN 1579 ELSE coalesce((SELECT arg_min(y, o) FROM an WHERE contains(name, k)), (SELECT arg_min(y, o) FROM yr WHERE contains(name, k)), 2000) END AS year,
  coalesce((SELECT arg_min(s, o) FROM sy WHERE contains(name, k)), '未知') AS system, EXISTS (SELECT 1 FROM an WHERE contains(name, k)) AS is_ancestor FROM nm),
sm AS (SELECT a, b, 2.0 * sum(m) / sum(t) AS sim FROM p GROUP BY a, b),
pr AS (SELECT CASE WHEN i.year <= j.year THEN i.name ELSE j.name END AS source, CASE WHEN i.year <= j.year THEN j.name ELSE i.name END AS target, i.ord AS oi, j.ord AS oj, coalesce(sim, 0) AS sim, coalesce(errors, 0) AS errors, i.system = j.system AND i.system <> '未知' AS alike
  FROM nd i JOIN nd j ON i.ord < j.ord LEFT JOIN sm ON sm.a = least(i.name, j.name) AND sm.b = greatest(i.name, j.name) OR sm.a = greatest(i.name, j.name) AND sm.b = least(i.name, j.name)
  LEFT JOIN s ON s.a = least(i.name, j.name) AND s.b = greatest(i.name, j.name)),
sc AS (SELECT pr.*, is_ancestor, (CASE WHEN sim > 0.95 THEN 30 WHEN sim > 0.9 THEN 20 WHEN sim > 0.85 THEN 10 ELSE 0 END) + (CASE WHEN errors > 10 THEN 40 WHEN errors > 5 THEN 25 WHEN errors > 2 THEN 15 WHEN errors > 0 THEN 5 ELSE 0 END)
  + (CASE WHEN alike THEN 20 ELSE 0 END) + (CASE WHEN is_ancestor THEN 10 ELSE 0 END) AS score, EXISTS (SELECT 1 FROM ch WHERE contains(source, x) AND contains(target, y)) AS is_known FROM pr JOIN nd ON nd.name = source),
ed AS (SELECT source, target, oi, oj, CAST(CASE WHEN is_known THEN greatest(score, 90) ELSE score END AS INTEGER) AS confidence, concat_ws('、', CASE WHEN sim > 0.95 THEN '高度相似(' || printf('%.1f', sim * 100) || '%)' WHEN sim > 0.9 THEN '相似(' || printf('%.1f', sim * 100) || '%)' END,
  CASE WHEN errors > 2 THEN '共同讹误' || errors || '处' END, CASE WHEN alike THEN '同系' END, CASE WHEN is_ancestor THEN '祖本' END, CASE WHEN is_known THEN '已知传承' END) AS evidence, round(sim * 100, 1) AS similarity, errors AS shared_errors, is_known FROM sc WHERE score >= 30),
td AS (SELECT * FROM ed e WHERE (SELECT count(*) FROM ed) <= 2 OR is_known OR confidence >= 80 OR NOT EXISTS (SELECT 1 FROM ed x JOIN ed y ON x.target = y.source WHERE x.source = e.source AND y.target = e.target))"""


@registry.add(_LINEAGE + " SELECT source, target, confidence, evidence, similarity, shared_errors, is_known FROM ed")
def h04_lineage_edges(spark, sf_dir):
    """Edges from older to younger editions, by similarity, shared errors, system, ancestors and known lineages."""
    e = lineage(spark, sf_dir)[1]
    return e.select("source", "target", "confidence", F.array_join("evidence", "、").alias("evidence"), "similarity", "shared_errors", "is_known")


@registry.add(_LINEAGE + " SELECT source, target, confidence FROM td")
def h05_transitive_reduction(spark, sf_dir):
    return L.reduce_transitive(lineage(spark, sf_dir)[1]).select("source", "target", "confidence")


@registry.add(_LINEAGE + " SELECT name AS node, CAST(year AS BIGINT) AS year, system, is_ancestor, count(target) AS n_children FROM nd LEFT JOIN ed ON source = name GROUP BY ALL")
def h06_nodes(spark, sf_dir):
    """The editions, and to how many younger ones an edge leads from each by the evidence of all documents."""
    n, edges = lineage(spark, sf_dir)
    children = edges.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    return n.join(children, "name", "left").select(F.col("name").alias("node"), "year", "system", "is_ancestor", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))


@registry.add(_LINEAGE + """, cn AS (SELECT system, string_agg(name || '(' || year || ')', ' → ' ORDER BY year, ord) AS chain FROM nd GROUP BY system HAVING count(*) >= 2),
le AS (SELECT td.*, a.system AS s, b.system AS d FROM td JOIN nd a ON a.name = source JOIN nd b ON b.name = target)
SELECT '【' || cn.system || '传承链】' || chain AS line FROM cn WHERE EXISTS (SELECT 1 FROM le WHERE s = cn.system AND d = cn.system)
UNION ALL SELECT '  证据：' || arg_min(evidence, (-confidence, oi, oj)) FROM le JOIN cn ON s = cn.system AND d = cn.system GROUP BY s HAVING arg_min(evidence, (-confidence, oi, oj)) <> ''
UNION ALL (SELECT '【跨系关联】' || source || ' (' || s || ') → ' || target || ' (' || d || ')' FROM le WHERE s <> d ORDER BY confidence DESC, oi, oj LIMIT 3)""")
def h07_conclusions(spark, sf_dir):
    nodes, edges = lineage(spark, sf_dir)
    return L.conclusions(nodes, L.reduce_transitive(edges))


@registry.add(_LINEAGE + """ SELECT source, target, confidence FROM td WHERE NOT (source = '思溪藏' AND target = '嘉兴藏') AND NOT (source = '房山石经' AND target = '大正藏') UNION ALL SELECT '房山石经', '大正藏', 99""")
def h08_edge_edits(spark, sf_dir):
    """One edge deleted, and one added by hand, which replaces another of the same ends."""
    e = L.reduce_transitive(lineage(spark, sf_dir)[1]).select("source", "target", "confidence")
    return L.adjusted(e, spark.createDataFrame([("房山石经", "大正藏", 99)], "source string, target string, confidence int"), spark.createDataFrame([("思溪藏", "嘉兴藏")], "source string, target string"))


#: Names of witnesses as a catalogue gives them, for the notes: one of each kind of short name.
TITLES = ["【中系●開寶藏版】", "【中系●高麗再雕增上寺版】", "赵城金藏", "思溪藏", "【南系●磧砂藏川佛協版】", "嘉兴藏", "房山石经本"]
_TITLE = dict(zip(NAMES, TITLES, strict=True))
#: Short names that these must come to.
_SHORT = dict(zip(NAMES, ["開寶藏", "丽增", "金", "思溪藏", "碛砂", "嘉", "房"], strict=True))
_CLASS = {"variant": "variant", "addition": "yanwen", "omission": "tuowen"}


def edited(spark, sf_dir: str) -> DataFrame:
    """An editor's decisions on every departure of a witness; which edition is taken and what speaks for it go by place."""
    r = rows(spark, sf_dir)
    title = F.create_map(*(F.lit(x) for pair in _TITLE.items() for x in pair))[F.col("witness")]
    by = F.pmod("pos", F.lit(7))
    each = lambda n, *words: F.when(by == n, F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>"))
    of = F.create_map(*(F.lit(x) for pair in _CLASS.items() for x in pair))
    base = by == 6
    return r.select(
        "doc_id", "witness", *W.PLACE, F.lit(1).alias("idx"), F.col("base").alias("old"), F.when(base, F.col("base")).otherwise(F.col("reading")).alias("new"), of[F.col("category")].alias("given"),
        F.when(base, BASE).otherwise(title).alias("selected"), each(0, "majority", "authoritative_嘉兴藏").alias("witnesses"), each(1, "context_consistent", "style_conform").alias("within"),
        each(2, "commentary_match", "other_sutra_match").alias("other"), each(3, "form_similar_error", "semantic_smooth").alias("reason"), F.when(F.pmod("pos", F.lit(14)) == 2, F.array(F.lit("疏"))).alias("commentaries"),
        F.when(by == 4, "remark").alias("remark"), F.when(by == 5, F.lit(True)).alias("uncertain"), F.lit(BASE).alias("base"),
    )


_NOTED = _READINGS + f""", n AS (SELECT doc_id, witness, pos, inserted, ord, category, base AS o, pos % 7 AS k, CASE WHEN pos % 7 = 6 THEN base ELSE reading END AS r,
    CASE witness {" ".join(f"WHEN '{w}' THEN '{s}'" for w, s in _SHORT.items())} END AS s FROM x),
a AS (SELECT *, CASE WHEN k = 6 OR category = 'variant' THEN '不改' WHEN category = 'addition' THEN '删' WHEN category = 'omission' THEN '删' ELSE '改' END AS act,
    CASE WHEN k = 6 THEN '正' WHEN k = 0 AND witness <> '嘉兴藏' THEN s || '、嘉' ELSE s END AS v FROM n),
w AS (SELECT *, CASE k WHEN 0 THEN '按：多数版本作「' || r || '」，「嘉兴藏」为权威版本。' WHEN 1 THEN '按：同经前后文一致，符合本经体例。'
    WHEN 2 THEN '按：' || CASE WHEN pos % 14 = 2 THEN '「疏」引作「' ELSE '注疏引作「' END || r || '」，他经引用同。' WHEN 3 THEN '按：形近「' || o || '」「' || r || '」而讹，义理更通顺。' WHEN 4 THEN '按：remark。'
    ELSE CASE category WHEN 'variant' THEN '按：「' || o || '」「' || r || '」为异体字，义同。' WHEN 'addition' THEN '按：「' || r || '」为衍文。'
      WHEN 'omission' THEN CASE WHEN r = '∅' THEN '按：此处有脱文。' ELSE '按：文意不完，当补「' || r || '」字。' END ELSE '' END END AS why FROM a),
t AS (SELECT doc_id, witness, pos, inserted, ord, act, '【1】第' || (pos + 1) || '字' || CASE WHEN act = '改' THEN '“' || o || '”，' || v || '作“' || r || '”。'
    WHEN act = '删' AND o = '∅' THEN '删“' || r || '”。' WHEN act = '删' THEN '“' || o || '”，' || v || '无。'
    WHEN category = 'variant' THEN '“' || o || '”，' || v || '作“' || r || '”，异体不改。' ELSE '“' || o || '”，不改。' END || why || CASE WHEN k = 5 THEN '（存疑）' ELSE '' END AS note FROM w)"""


@registry.add(_NOTED + " SELECT doc_id, witness, pos, inserted, ord, act AS action, note FROM t")
def c32_note_templates(spark, sf_dir):
    """A note in words for each decision of an editor."""
    return notes.worded(edited(spark, sf_dir)).select("doc_id", "witness", *W.PLACE, "action", "note")
