"""Collation of witnesses that keep their base's length: readings by position, and everything that is computed from them.

Witness A writes plain for accented letters (variants), witness B exchanges letters (errors), and a third witness has
other punctuation. Positions are compared inside arrays, so only readings that differ become rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.marks import MARK, SPACE
from ..operators import marks
from ..query import Registry, table
from .texts import SQL_MAP

registry = Registry()
#: Letters that a witness exchanges: from, to.
WITNESS_A = ("éèêçüöäóí", "eeecuoaoi")
WITNESS_B = ("éaoe", "eoae")


def readings(documents: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), base, a, b of every position where a witness departs from the base. A text is cut behind each such character; lengths add up to positions."""
    changed = "".join(dict.fromkeys(x for w in (WITNESS_A, WITNESS_B) for x, y in zip(*w, strict=True) if x != y))
    cut = documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"[^{changed}]*+(?:[{changed}]|\z)"), F.lit(0))).alias("k", "piece"))
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    hit = cut.select("doc_id", "k", F.length("piece").alias("n"), F.right("piece", F.lit(1)).alias("base")).withColumn("pos", F.sum("n").over(w) - 1)
    return hit.select("doc_id", F.col("pos").cast("long").alias("pos"), "base", F.translate("base", *WITNESS_A).alias("a"), F.translate("base", *WITNESS_B).alias("b")).where("a <> base OR b <> base")


def long_readings(documents: DataFrame) -> DataFrame:
    """A row a witness: doc_id, pos, witness, base, reading, category."""
    both = F.array(F.struct(F.lit("A").alias("witness"), F.col("a").alias("reading"), F.lit("variant").alias("category")), F.struct(F.lit("B").alias("witness"), F.col("b").alias("reading"), F.lit("error").alias("category")))
    r = readings(documents).select("doc_id", "pos", "base", F.inline(both))
    return r.where("reading <> base")


_SQL_READINGS = f"""SELECT doc_id, pos - 1 AS pos, base, a, b FROM (
  SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS base, unnest(string_split(translate(text, '{WITNESS_A[0]}', '{WITNESS_A[1]}'), '')) AS a, unnest(string_split(translate(text, '{WITNESS_B[0]}', '{WITNESS_B[1]}'), '')) AS b
  FROM (SELECT doc_id, text, string_split(text, '') AS x FROM documents WHERE text <> '')) WHERE base <> a OR base <> b"""
_SQL_LONG = f"""WITH r AS ({_SQL_READINGS}), l AS (SELECT doc_id, pos, 'A' AS witness, base, a AS reading, 'variant' AS category FROM r WHERE a <> base
  UNION ALL SELECT doc_id, pos, 'B', base, b, 'error' FROM r WHERE b <> base)"""


@registry.add(f"SELECT doc_id, pos + 1 AS position, base AS base_char, CASE WHEN a = base THEN base ELSE a END AS a_char, b AS b_char, CASE WHEN a <> base THEN 'variant' ELSE 'error' END AS category FROM ({_SQL_READINGS})")
def f21_variant_table(spark, sf_dir):
    """The table of readings: a row a position, a column a witness; a variant outranks an error."""
    r = readings(table(spark, sf_dir, "documents"))
    return r.select("doc_id", (F.col("pos") + 1).alias("position"), F.col("base").alias("base_char"), F.col("a").alias("a_char"), F.col("b").alias("b_char"), F.when(F.col("a") != F.col("base"), "variant").otherwise("error").alias("category"))


@registry.add(f"SELECT doc_id, count(*) AS n_shared, min(pos) AS first_pos, max(pos) AS last_pos FROM ({_SQL_READINGS}) WHERE a = b GROUP BY doc_id")
def e07_shared_readings(spark, sf_dir):
    """Readings that both witnesses share against the base."""
    r = readings(table(spark, sf_dir, "documents")).where("a = b")
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_shared"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@registry.add(_SQL_LONG + " SELECT witness, category, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM l GROUP BY witness, category")
def g17_reading_totals(spark, sf_dir):
    r = long_readings(table(spark, sf_dir, "documents"))
    return r.groupBy("witness", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@registry.add(_SQL_LONG + " SELECT category, count(*) FILTER (WHERE witness = 'A') AS a, count(*) FILTER (WHERE witness = 'B') AS b, count(*) AS total FROM l GROUP BY category")
def g08_summary_pivot(spark, sf_dir):
    r = long_readings(table(spark, sf_dir, "documents"))
    n = lambda w: F.count_if(F.col("witness") == w)
    return r.groupBy("category").agg(n("A").alias("a"), n("B").alias("b"), F.count(F.lit(1)).alias("total"))


@registry.add(_SQL_LONG + " SELECT category, base, reading, count(*) AS n FROM l GROUP BY ALL")
def g01_replacement_frequency(spark, sf_dir):
    return long_readings(table(spark, sf_dir, "documents")).groupBy("category", "base", "reading").agg(F.count(F.lit(1)).alias("n"))


@registry.add(_SQL_LONG + " SELECT coalesce(category, 'all') AS category, coalesce(witness, 'all') AS witness, count(*) AS n FROM l GROUP BY ROLLUP (category, witness)")
def g24_reading_rollup(spark, sf_dir):
    r = long_readings(table(spark, sf_dir, "documents")).rollup("category", "witness").agg(F.count(F.lit(1)).alias("n"))
    return r.select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("witness", F.lit("all")).alias("witness"), "n")


@registry.add(_SQL_LONG + " SELECT category, reading, n, CAST(rank AS BIGINT) AS rank FROM (SELECT category, reading, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, reading) AS rank FROM l GROUP BY category, reading) WHERE rank <= 5")
def j02_top_readings(spark, sf_dir):
    """The five most frequent readings of a category."""
    n = long_readings(table(spark, sf_dir, "documents")).groupBy("category", "reading").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category").orderBy(F.desc("n"), "reading")
    return n.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")


def mark_witness(t):
    """Another mark for each comma, and no colons and exclamation marks."""
    return F.regexp_replace(F.translate(t, ",", "，"), "[:!]", "")


def mark_differences(documents: DataFrame, context: int | None = None) -> DataFrame:
    """doc_id, pos, marks of both texts and the type of the difference; with a width also its context."""
    d = marks.mark_differences(documents, "doc_id", F.col("text"), mark_witness(F.col("text")), context)
    return d.select("doc_id", "pos", "x", "y", "kind", *(["context"] if context is not None else []))


_SQL_SPACELESS = f"regexp_replace(text, '{SPACE}', '', 'g')"
_sql_side = lambda t: SQL_MAP.format(f"SELECT doc_id, i, ch, regexp_matches(ch, '{MARK}') AS mark, regexp_matches(ch, '{SPACE}') AS space FROM (SELECT doc_id, unnest(string_split({t}, '')) AS ch, generate_subscripts(string_split({t}, ''), 1) AS i FROM documents WHERE {t} <> '')")
_SQL_MARKS = f"""SELECT doc_id, pos, x, y, CASE WHEN x = '' THEN 'added' WHEN y = '' THEN 'deleted' WHEN starts_with(y, x) THEN 'added' WHEN starts_with(x, y) THEN 'deleted' ELSE 'replaced' END AS kind FROM (
  SELECT doc_id, pos, coalesce(p.marks, '') AS x, coalesce(q.marks, '') AS y FROM ({_sql_side("text")}) p FULL JOIN ({_sql_side("regexp_replace(translate(text, ',', '，'), '[:!]', '', 'g')")}) q USING (doc_id, pos)) WHERE x <> y"""


@registry.add(_SQL_MARKS)
def f13_punct_differences(spark, sf_dir):
    return mark_differences(table(spark, sf_dir, "documents"))


@registry.add(f"SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({_SQL_MARKS}) GROUP BY kind")
def c14_difference_types(spark, sf_dir):
    return mark_differences(table(spark, sf_dir, "documents")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@registry.add(f"SELECT substr(CASE WHEN x = '' THEN y ELSE x END, 1, 1) AS mark, count(*) AS n FROM ({_SQL_MARKS}) GROUP BY 1")
def g05_difference_groups(spark, sf_dir):
    m = F.when(F.col("x") == "", F.col("y")).otherwise(F.col("x"))
    return mark_differences(table(spark, sf_dir, "documents")).groupBy(F.substring(m, 1, 1).alias("mark")).agg(F.count(F.lit(1)).alias("n"))


@registry.add(f"SELECT doc_id, {_SQL_SPACELESS} = regexp_replace(translate({_SQL_SPACELESS}, 'z', 'y'), ' ', '', 'g') AS same_text FROM documents")
def d09_mode_dispatch(spark, sf_dir):
    """Whether a witness (z written y) has the base's pure text; if so its punctuation is compared, else it is collated."""
    pure = T.strip_marks(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", (pure == T.strip_marks(F.translate("text", "z", "y"))).alias("same_text"))


@registry.add(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM ({_SQL_READINGS}))
SELECT t.doc_id, md5(CASE WHEN d.doc_id IS NULL THEN t.text ELSE substr(t.text, 1, CAST(d.pos AS BIGINT)) || d.b || substr(t.text, CAST(d.pos + 2 AS BIGINT)) END) AS digest, d.doc_id IS NOT NULL AS changed
FROM documents t LEFT JOIN (SELECT * FROM d WHERE k = 1) d ON t.doc_id = d.doc_id""")
def f19_definitive_text(spark, sf_dir):
    """The definitive text after one decision a document: the first reading of witness B is taken."""
    docs = table(spark, sf_dir, "documents")
    first = readings(docs).groupBy("doc_id").agg(F.min_by(F.struct("pos", "b"), "pos").alias("d"))
    new = F.concat(F.substring("text", F.lit(1), F.col("d.pos").cast("int")), F.col("d.b"), F.substring("text", (F.col("d.pos") + 2).cast("int"), F.length("text")))
    return docs.join(first, "doc_id", "left").select("doc_id", F.md5(F.when(F.col("d").isNull(), F.col("text")).otherwise(new)).alias("digest"), F.col("d").isNotNull().alias("changed"))
