"""Collation with a variant dictionary: classes of readings, notes, decisions, blocks and offsets.

The dictionary is built from a rule, accented Latin letters and their plain forms, as pairs; witnesses are those of `collation`.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import marks
from ..operators import variants as V
from ..query import Registry, table
from .collation import _SQL_READINGS, long_readings, mark_witness, readings

registry = Registry()


def accents(low: int = 0xC0, high: int = 0x24F) -> dict[str, str]:
    """Accented letters of a range of code points and their plain forms."""
    forms = {chr(p): unicodedata.normalize("NFD", chr(p))[0] for p in range(low, high + 1)}
    return {c: plain for c, plain in forms.items() if c != plain}


def accent_dictionary(spark: SparkSession) -> DataFrame:
    return V.dictionary(spark.createDataFrame(list(accents().items()), "a string, b string"))


@registry.add("SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def c12_variant_folding(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(V.folded(F.col("text"), accents())).alias("digest"))


@registry.add("SELECT c AS char, strip_accents(c) AS std, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL")
def e08_variant_join(spark, sf_dir):
    """Every character of the corpus, how often it stands, and its standard form."""
    n = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count(F.lit(1)).alias("n"))
    return V.with_std(n, accent_dictionary(spark), "char", "std").select("char", "std", "n")


_SQL_LONG = f"(SELECT doc_id, pos, 'A' AS witness, base, a AS reading FROM ({_SQL_READINGS}) WHERE a <> base UNION ALL SELECT doc_id, pos, 'B', base, b FROM ({_SQL_READINGS}) WHERE b <> base)"


@registry.add(f"SELECT witness, base, reading, n, CASE WHEN strip_accents(base) = strip_accents(reading) THEN 'variant' ELSE 'error' END AS class FROM (SELECT witness, base, reading, count(*) AS n FROM {_SQL_LONG} GROUP BY ALL)")
def c11_reading_classes(spark, sf_dir):
    """Readings by witness, counted and then classified: the dictionary meets the few that are distinct."""
    n = long_readings(table(spark, sf_dir, "documents")).groupBy("witness", "base", "reading").agg(F.count(F.lit(1)).alias("n"))
    return V.classified(n, accent_dictionary(spark)).select("witness", "base", "reading", "n", "class")


def notes(documents: DataFrame, entries: DataFrame, context: int = 10) -> DataFrame:
    """a note for each reading of witness A: doc_id, idx (from 1), pos, left and right context of the base, type and text. Contexts are cut inside the text's array of characters before readings become rows."""
    t = documents.select("doc_id", F.split("text", "").alias("c"), F.split(F.translate("text", "éèêçüöäóíquv", "eeecuoaoiquu"), "").alias("w"))
    part = lambda i, n: F.array_join(F.slice(F.col("c"), i, n), "")
    note = lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("base"), F.col("w")[i].alias("reading"))
    differ = F.filter(F.transform("c", note), lambda x: x["base"] != x["reading"])
    d = t.select("doc_id", "c", F.size("c").alias("size"), differ.alias("d"))
    left = lambda p: part(F.greatest(p - (context - 1), F.lit(1)).cast("int"), F.least(p, F.lit(context)).cast("int"))
    right = lambda p: part((p + 2).cast("int"), F.lit(context))
    placed = F.transform("d", lambda x, k: F.struct((k + 1).cast("long").alias("idx"), x["pos"].alias("pos"), x["base"].alias("base"), x["reading"].alias("reading"), left(x["pos"]).alias("left"), right(x["pos"]).alias("right")))
    rows = V.with_std(V.with_std(d.select("doc_id", F.inline(placed)), entries, "base", "x"), entries, "reading", "y")
    kind = V.note_type(F.col("base"), F.col("reading"), F.col("x") == F.col("y"))
    return rows.select("doc_id", "idx", "pos", "left", "right", kind.alias("type"), F.concat(F.col("base"), F.lit("→"), F.col("reading")).alias("note"))


_SQL_NOTES = """(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx, pos, substr(text, CAST(greatest(pos - 9, 1) AS BIGINT), CAST(least(pos, 10) AS BIGINT)) AS "left", substr(text, CAST(pos + 2 AS BIGINT), 10) AS "right",
  CASE WHEN strip_accents(base) = strip_accents(a) THEN 'variant' ELSE 'error' END AS type, base || '→' || a AS note
  FROM (SELECT doc_id, text, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS base, unnest(string_split(translate(text, 'éèêçüöäóív', 'eeecuoaoiu'), '')) AS a
    FROM (SELECT doc_id, text, string_split(text, '') AS x FROM documents WHERE text <> '')) WHERE base <> a)"""


@registry.add(f"SELECT doc_id, count(*) AS n_notes, count(*) FILTER (WHERE type = 'variant') AS n_variants, md5(string_agg(idx || ' ' || pos || ' ' || \"left\" || '[' || note || ']' || \"right\", chr(10) ORDER BY idx)) AS digest FROM {_SQL_NOTES} GROUP BY doc_id")
def b08_note_export(spark, sf_dir):
    """The notes of a document as one text."""
    line = F.concat_ws(" ", F.col("idx").cast("string"), F.col("pos").cast("string"), F.concat("left", F.lit("["), "note", F.lit("]"), "right"))
    n = notes(table(spark, sf_dir, "documents"), accent_dictionary(spark)).select("doc_id", "idx", "type", line.alias("line"))
    g = n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_notes"), F.count_if(F.col("type") == "variant").alias("n_variants"), F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("x"))
    return g.select("doc_id", "n_notes", "n_variants", F.md5(F.array_join(F.col("x.line"), "\n")).alias("digest"))


@registry.add(f"SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(pos) AS first_pos FROM {_SQL_NOTES} GROUP BY type")
def f23_note_types(spark, sf_dir):
    n = notes(table(spark, sf_dir, "documents"), accent_dictionary(spark))
    return n.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min("pos").alias("first_pos"))


@registry.add(r"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM c WHERE c <> '' AND NOT regexp_matches(c, '[。，、；：？！“”‘’‚„"''（）《》【】「」『』〈〉〔〕〖〗:;,?!＂＇〝〞〟｢｣‹›«»·…—\s\x{B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))
SELECT doc_id, max(n) AS n_clean, CAST(sum(pos) AS BIGINT) AS sum_raw, CAST(max(CASE WHEN k = n // 2 THEN pos END) AS BIGINT) AS middle_raw FROM k GROUP BY doc_id""")
def c07_clean_offsets(spark, sf_dir):
    """Clean offsets and where they stand in the raw text (C31: that of the middle one)."""
    o = table(spark, sf_dir, "documents").select("doc_id", V.clean_offsets(F.col("text")).alias("o")).where(F.size("o") > 0)
    total = F.aggregate("o", F.lit(0).cast("long"), lambda s, i: s + i)
    return o.select("doc_id", F.size("o").cast("long").alias("n_clean"), total.alias("sum_raw"), F.col("o")[F.floor(F.size("o") / 2).cast("int")].cast("long").alias("middle_raw"))


@registry.add(r"""WITH g AS (SELECT doc_id, string_split_regex(text, '[^。，、；：？！“”‘’‚„"''（）《》【】「」『』〈〉〔〕〖〗:;,?!＂＇〝〞〟｢｣‹›«»·…—]') AS x,
  string_split_regex(regexp_replace(replace(text, ',', '，'), '[:!]', '', 'g'), '[^。，、；：？！“”‘’‚„"''（）《》【】「」『』〈〉〔〕〖〗:;,?!＂＇〝〞〟｢｣‹›«»·…—]') AS y FROM documents),
r AS (SELECT doc_id, unnest(x[2:]) AS a, unnest(y[2:]) AS b, generate_subscripts(x[2:], 1) - 1 AS pos FROM g)
SELECT doc_id, count(*) FILTER (WHERE a <> '') AS n_base, count(*) FILTER (WHERE b <> '') AS n_other, count(*) FILTER (WHERE a <> b) AS n_different, CAST(coalesce(min(pos) FILTER (WHERE a <> b), -1) AS BIGINT) AS first_pos FROM r GROUP BY doc_id""")
def f15_basic_compare(spark, sf_dir):
    """C10 of both texts side by side. Both have the same clean text, so no join is needed."""
    return marks.basic_gaps(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), mark_witness(F.col("text")))


@registry.add(f"""WITH d AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN '' ELSE b END AS new FROM ({_SQL_READINGS}) WHERE b <> base AND pos % 7 <> 0),
c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents)
SELECT c.doc_id, md5(string_agg(coalesce(d.new, c.c), '' ORDER BY c.pos)) AS digest, count(d.doc_id) AS n_applied FROM c LEFT JOIN d ON c.doc_id = d.doc_id AND c.pos = d.pos GROUP BY c.doc_id""")
def f19_all_decisions(spark, sf_dir):
    """The definitive text after all decisions: witness B's readings, of which those at every fifth position delete, and those at every seventh are uncertain."""
    docs = table(spark, sf_dir, "documents")
    d = readings(docs).where("b <> base").select("doc_id", "pos", F.when(F.col("pos") % 5 == 0, "").otherwise(F.col("b")).alias("new"), (F.col("pos") % 7 == 0).alias("uncertain"))
    return V.apply_decisions(docs, d).select("doc_id", F.md5("text").alias("digest"), "n_applied")


def lines(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "t"))


_SQL_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)"


@registry.add(f"""WITH i AS (SELECT doc_id, ord, t, sum(CASE WHEN length(t) >= 20 OR ord = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS block FROM {_SQL_LINES})
SELECT doc_id, CAST(block AS BIGINT) AS block, md5(string_agg(t, '' ORDER BY ord)) AS digest FROM i GROUP BY doc_id, block""")
def f05_orphan_blocks(spark, sf_dir):
    return V.merged_blocks(lines(table(spark, sf_dir, "documents"))).select("doc_id", F.col("block").cast("long").alias("block"), F.md5("t").alias("digest"))


@registry.add(f"""SELECT doc_id, CAST(ord - 1 AS BIGINT) AS ord, md5(context) AS context FROM (SELECT *, last_value(CASE WHEN t LIKE '%?%' THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM {_SQL_LINES})
WHERE regexp_matches(t, '[0-9]')""")
def a14_apparatus_lines(spark, sf_dir):
    """Lines with a number, beside the nearest line with a question before them."""
    c = V.carried(lines(table(spark, sf_dir, "documents")), "[0-9]", r"\?")
    return c.select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5("context").alias("context"))


@registry.add("""WITH s AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS k, unnest(list_transform(w, lambda x: length(x))) AS n FROM (SELECT doc_id, string_split(text, '. ') AS w FROM documents)),
p AS (SELECT doc_id, n, coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s),
o AS (SELECT doc_id, list(CAST(pos AS INTEGER) ORDER BY n DESC, pos) AS p FROM p GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(list_prepend(CAST([] AS INTEGER[]), list_transform(p, lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k - x[1]) < 200)) = 0 THEN list_concat(acc, x) ELSE acc END) AS kept FROM o)
SELECT doc_id, CAST(len(kept) AS BIGINT) AS n_kept, CAST(list_sum(kept) AS BIGINT) AS sum_kept FROM f""")
def i06_proximity(spark, sf_dir):
    """The longest sentences, without any that begins within 200 characters of a longer one that is kept."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", r"\. "), F.length).alias("n"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<n:int,pos:int>>").alias("all"))
    step = lambda acc, n: F.struct((acc["pos"] + n + 2).alias("pos"), F.concat(acc["all"], F.array(F.struct((-n).alias("n"), acc["pos"].alias("pos")))).alias("all"))
    placed = s.select("doc_id", F.array_sort(F.aggregate("n", start, step, lambda acc: acc["all"])).alias("p"))
    kept = placed.select("doc_id", V.suppressed(F.col("p.pos"), 200).alias("kept"))
    return kept.select("doc_id", F.size("kept").cast("long").alias("n_kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_kept"))


@registry.add(f"""SELECT d.doc_id, CAST(length(d.text) AS BIGINT) AS n_chars, count(r.pos) FILTER (WHERE r.a <> r.base) AS differs_a, length(d.text) - count(r.pos) FILTER (WHERE r.a <> r.base) AS same_a,
  count(r.pos) FILTER (WHERE r.b <> r.base) AS differs_b, length(d.text) - count(r.pos) FILTER (WHERE r.b <> r.base) AS same_b FROM documents d LEFT JOIN ({_SQL_READINGS}) r ON d.doc_id = r.doc_id GROUP BY d.doc_id, d.text""")
def e19_full_alignment(spark, sf_dir):
    """Every base position of every witness, counted as same or different (B11) inside the arrays."""
    from .collation import WITNESS_A, WITNESS_B

    chars = lambda t: F.split(t, "")
    t = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), chars(F.col("text")).alias("c"), chars(F.translate("text", *WITNESS_A)).alias("a"), chars(F.translate("text", *WITNESS_B)).alias("b"))
    differs = lambda w: F.size(F.filter(F.zip_with("c", w, lambda x, y: x != y), lambda x: x)).cast("long")
    n = t.select("doc_id", "n_chars", differs("a").alias("differs_a"), differs("b").alias("differs_b"))
    return n.select("*", (F.col("n_chars") - F.col("differs_a")).alias("same_a"), (F.col("n_chars") - F.col("differs_b")).alias("same_b"))


@registry.add(f"""SELECT doc_id, pos + 1 AS position, base, CASE WHEN a = base THEN 'same' ELSE a END AS a, CASE WHEN b = base THEN 'same' ELSE b END AS b FROM ({_SQL_READINGS}) ORDER BY doc_id, position LIMIT 100""")
def b03_wide_table(spark, sf_dir):
    """The head of the report: a hundred readings, a column a witness, and a filler where it has the base's."""
    filler = lambda w: F.when(F.col(w) == F.col("base"), "same").otherwise(F.col(w)).alias(w)
    return readings(table(spark, sf_dir, "documents")).select("doc_id", (F.col("pos") + 1).alias("position"), "base", filler("a"), filler("b")).orderBy("doc_id", "position").limit(100)


@registry.add(f"""WITH n AS (SELECT category, class, count(*) AS n FROM (SELECT witness AS category, CASE WHEN strip_accents(base) = strip_accents(reading) THEN 'variant' ELSE 'error' END AS class FROM {_SQL_LONG}) GROUP BY ALL)
SELECT string_agg(line, chr(10) ORDER BY k) AS report, count(*) AS n_lines FROM (SELECT row_number() OVER (ORDER BY category, class) AS k, row_number() OVER (ORDER BY category, class) || '. ' || category || ': ' || class || ' ' || n AS line FROM n)""")
def b09_errata_report(spark, sf_dir):
    """Numbered lines of witness, class and count. Numbers are given to the few lines of the report, not to readings."""
    n = c11_reading_classes(spark, sf_dir).groupBy("witness", "class").agg(F.sum("n").alias("n"))
    line = F.concat(F.row_number().over(Window.orderBy("witness", "class")).cast("string"), F.lit(". "), "witness", F.lit(": "), "class", F.lit(" "), F.col("n").cast("string"))
    lined = n.select("witness", "class", line.alias("line"))
    g = lined.agg(F.array_sort(F.collect_list(F.struct("witness", "class", "line"))).alias("x"), F.count(F.lit(1)).alias("n_lines"))
    return g.select(F.array_join(F.col("x.line"), "\n").alias("report"), "n_lines")
