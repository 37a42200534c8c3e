"""Queries over single texts: normalisation, marks, sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.marks import BRACKETS, INNER, LAYOUT, MARK, MARKS, NOT_MARK, QUOTES, SENTENCE_END, SPACE, in_class
from ..operators.marks import mark_map, mark_runs
from ..query import Registry, table

registry = Registry()
_SQL_SPACELESS = f"regexp_replace(text, '{SPACE}', '', 'g')"
_SQL_GAPS = f"string_split_regex({_SQL_SPACELESS}, '{NOT_MARK}')"


def _digest(name: str, column, expression: str):
    """A normaliser over documents: length and digest of what it gives."""

    def f(spark, sf_dir):
        out = table(spark, sf_dir, "documents").select("doc_id", column(F.col("text")).alias("t"))
        return out.select("doc_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))

    f.__name__ = name
    registry.add(f"SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS digest FROM (SELECT doc_id, {expression} AS t FROM documents)")(f)


_digest("c01_normalize_collation", T.normalize_collation, f"regexp_replace(text, '{LAYOUT}', '', 'g')")
_digest("c02_normalize_layout", T.normalize_layout, r"trim(regexp_replace(regexp_replace(text, '[\r\n\t\x{3000}]', '', 'g'), ' +', ' ', 'g'))")
_digest("c03_normalize_sentence", T.normalize_sentence, rf"trim(regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '{SPACE}+', ' ', 'g'))")
_digest("c04_remove_empty_lines", T.remove_empty_lines, r"trim(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\n\t \x{3000}]+', ' ', 'g'))")
_digest("c05_strip_punct", T.strip_marks, f"regexp_replace({_SQL_SPACELESS}, '{MARK}', '', 'g')")
_digest("c06_strip_unicode_np", T.strip_numbers_and_punctuation, r"regexp_replace(text, '[\p{N}\p{P}\x{3000}\x{A0}]', '', 'g')")
_digest("c29_latex_escape", T.latex_escape, r"""list_aggregate(list_transform(string_split(text, ''), lambda c:
  CASE c WHEN '\' THEN '\textbackslash{}' WHEN '&' THEN '\&' WHEN '%' THEN '\%' WHEN '$' THEN '\$' WHEN '#' THEN '\#' WHEN '_' THEN '\_' WHEN '{' THEN '\{' WHEN '}' THEN '\}' WHEN '~' THEN '\textasciitilde{}' WHEN '^' THEN '\textasciicircum{}' ELSE c END), 'string_agg', '')""")
_digest("c35_highlight", lambda t: F.replace(t, F.lit("the"), F.lit("<mark>the</mark>")), "replace(text, 'the', '<mark>the</mark>')")
_digest("c37_line_layout", lambda t: F.array_join(T.wrap(t, 80), "\n"), "coalesce(list_aggregate(list_transform(range(1, length(text) + 1, 80), lambda i: substr(text, i, 80)), 'string_agg', chr(10)), '')")


@registry.add(f"""SELECT doc_id, CAST(len(g) - 1 AS BIGINT) AS n_chars, CAST(len(list_filter(g, lambda x: x <> '')) AS BIGINT) AS n_filled,
  CAST(list_max(list_transform(g, lambda x: length(x))) AS BIGINT) AS longest FROM (SELECT doc_id, {_SQL_GAPS} AS g FROM documents)""")
def c08_gap_profile(spark, sf_dir):
    g = table(spark, sf_dir, "documents").select("doc_id", T.gaps(F.col("text")).alias("g"))
    return g.select("doc_id", (F.size("g") - 1).cast("long").alias("n_chars"), F.size(F.filter("g", lambda x: x != "")).cast("long").alias("n_filled"), F.array_max(F.transform("g", F.length)).cast("long").alias("longest"))


_SQL_CHARS = f"""SELECT doc_id, i, ch, regexp_matches(ch, '{MARK}') AS mark, regexp_matches(ch, '{SPACE}') AS space FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> '')"""
#: C9 for a table of characters: a mark belongs to what stands before it unless that is white space.
SQL_MAP = """SELECT doc_id, pos, string_agg(ch, '' ORDER BY i) AS marks FROM (SELECT doc_id, i, ch, mark,
  CAST(coalesce(sum(CASE WHEN mark OR space THEN 0 ELSE 1 END) OVER w, 0) - 1 AS BIGINT) AS pos, last_value(CASE WHEN mark THEN NULL ELSE space END IGNORE NULLS) OVER w AS spaced
  FROM ({}) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE mark AND (pos = -1 OR NOT spaced) GROUP BY doc_id, pos"""


@registry.add(SQL_MAP.format(_SQL_CHARS))
def c09_punct_map(spark, sf_dir):
    """The marks directly after each character, counted without marks and white space; -1: before the first."""
    return mark_map(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("pos").cast("long").alias("pos"), "marks")


@registry.add(f"""SELECT doc_id, CAST(sum(length(marks)) AS BIGINT) AS n_marks, count(*) AS n_runs, CAST(min(pos - 1) AS BIGINT) AS first_offset, CAST(max(pos - 1) AS BIGINT) AS last_offset
  FROM (SELECT doc_id, unnest(g) AS marks, generate_subscripts(g, 1) AS pos FROM (SELECT doc_id, {_SQL_GAPS} AS g FROM documents)) WHERE marks <> '' GROUP BY doc_id""")
def l03_mark_offsets(spark, sf_dir):
    """Runs of marks by the clean offset that they stand before."""
    m = mark_runs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return m.groupBy("doc_id").agg(F.sum(F.length("marks")).alias("n_marks"), F.countDistinct("before").alias("n_runs"), F.min("before").alias("first_offset"), F.max("before").alias("last_offset"))


@registry.add(r"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[^\p{L}]+')) AS w FROM documents)
SELECT list_aggregate(list_sort(string_split(w, '')), 'string_agg', '') AS letters, count(*) AS n_words, count(*) * (count(*) - 1) // 2 AS n_pairs, min(w) AS first_word, max(w) AS last_word
FROM w WHERE length(w) BETWEEN 2 AND 6 GROUP BY 1 HAVING count(*) > 1""")
def c13_transposed_words(spark, sf_dir):
    """Words that are transpositions of each other, by their sorted letters; pairs are counted, not listed."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("w")).where(F.length("w").between(2, 6)).distinct()
    n = F.count(F.lit(1))
    g = w.groupBy(F.array_join(F.array_sort(F.split("w", "")), "").alias("letters"))
    return g.agg(n.alias("n_words"), F.floor(n * (n - 1) / 2).alias("n_pairs"), F.min("w").alias("first_word"), F.max("w").alias("last_word")).where("n_words > 1")


_SQL_SENTENCE = T.SENTENCE.replace("'", "''")


@registry.add(f"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest, md5(coalesce(list_aggregate(s, 'string_agg', '|'), '')) AS digest
  FROM (SELECT doc_id, regexp_extract_all(text, '{_SQL_SENTENCE}') AS s FROM documents)""")
def c18_sentences(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"), F.md5(F.array_join("s", "|")).alias("digest"))


def _frequency(name: str, characters: str):
    pattern = f"[{in_class(characters)}]"

    def f(spark, sf_dir):
        found = F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        return table(spark, sf_dir, "documents").select(found.alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))

    f.__name__ = name
    registry.add(f"SELECT mark, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{pattern}')) AS mark FROM documents) GROUP BY mark")(f)


_frequency("c19_quote_inventory", QUOTES)
_frequency("g03_mark_frequency", MARKS)


@registry.add(r"SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\p{L}\p{N}\x{4E00}-\x{9FFF}" + in_class(MARKS) + r"\x{0}-\x{20}\x{A0}\x{3000}]')) AS ch FROM documents) GROUP BY ch")
def c19_unknown_marks(spark, sf_dir):
    """Characters that are no letters, digits, white space or known marks."""
    pattern = r"[^\p{L}\p{N}\x{4E00}-\x{9FFF}" + in_class(MARKS) + r"\x{0}-\x{20}\x{A0}\x{3000}]"
    return table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


@registry.add(f"""SELECT doc_id, n_marks, n_clean, CASE WHEN n_clean > 0 THEN 10000 * n_marks // n_clean ELSE 0 END AS density_bp FROM (
  SELECT doc_id, CAST(len(regexp_extract_all(text, '{MARK}')) AS BIGINT) AS n_marks, CAST(length(regexp_replace({_SQL_SPACELESS}, '{MARK}', '', 'g')) AS BIGINT) AS n_clean FROM documents)""")
def g04_style_report(spark, sf_dir):
    """Marks, clean characters and marks per 10,000 clean characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") - F.length(F.translate("text", MARKS, ""))).cast("long").alias("n_marks"), F.length(T.strip_marks(F.col("text"))).cast("long").alias("n_clean"))
    return d.withColumn("density_bp", F.when(F.col("n_clean") > 0, F.expr("10000 * n_marks div n_clean")).otherwise(0).cast("long"))


@registry.add(f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[{in_class(SENTENCE_END)}]')) AS BIGINT) AS n_end, CAST(len(regexp_extract_all(text, '[{in_class(INNER)}]')) AS BIGINT) AS n_inner,
  CAST(len(regexp_extract_all(text, '[{in_class(QUOTES + BRACKETS)}]')) AS BIGINT) AS n_other FROM documents""")
def g06_research_stats(spark, sf_dir):
    n = lambda marks: F.regexp_count("text", F.lit(f"[{in_class(marks)}]")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n(SENTENCE_END).alias("n_end"), n(INNER).alias("n_inner"), n(QUOTES + BRACKETS).alias("n_other"))


@registry.add("SELECT p_partkey, CAST(p_partkey % 999 + 1 AS BIGINT) AS back FROM part")
def c21_chinese_numerals(spark, sf_dir):
    """1 to 999 to numerals and back."""
    n = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 999 + 1).alias("n"))
    return n.select("p_partkey", T.parse_chinese_numeral(T.chinese_numeral(F.col("n"))).cast("long").alias("back"))


@registry.add(r"SELECT doc_id, CAST(length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g')) AS BIGINT) AS han, CAST(length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS BIGINT) AS letters FROM documents")
def c30_character_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.regexp_replace("text", r"[^\x{4E00}-\x{9FFF}]", "")).cast("long").alias("han"), F.length(F.regexp_replace("text", r"[^\p{L}]", "")).cast("long").alias("letters"))


_HTML = [(r"(?is)<(?:script|style|title)\b[^>]*>.*?</(?:script|style|title)>", " "), (r"(?is)<(?:meta|link)\b[^>]*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", "\n"), ("[ \t]+\n", "\n"), ("\n[ \t]+", "\n"), ("\n{3,}", "\n\n")]


def html_text(h):
    """A3: the text of a page without scripts, styles and tags; runs of blank lines are one."""
    for pattern, by in _HTML:
        h = F.regexp_replace(h, pattern, by)
    return F.trim(h)


def _sql_html() -> str:
    h = "html"
    for pattern, by in _HTML:
        h = f"regexp_replace({h}, '{pattern}', '{by}', 'g')"
    return h


@registry.add(f"SELECT page_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS digest FROM (SELECT page_id, trim({_sql_html()}) AS t FROM pages)")
def a03_html_text(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))
