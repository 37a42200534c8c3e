"""Listings over editions, marks and passages: filters by class, tags and matches, statistics, context, merged classes, custom systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.marks import MARK
from ..operators import lineage as L
from ..operators import quizzes
from ..query import Registry, table
from . import editions
from .citations import _HITS, passage_hits
from .collation import _SQL_MARKS, _SQL_SPACELESS, mark_differences
from .editions import _MET, _READINGS

registry = Registry()


@registry.add(_READINGS + " SELECT doc_id, witness FROM x GROUP BY doc_id, witness HAVING bool_or(category = 'omission')")
def d07_category_filter(spark, sf_dir):
    """Witnesses of documents that omit anything: kept when any of their departures is of the class."""
    return editions.rows(spark, sf_dir).where("category = 'omission'").select("doc_id", "witness").distinct()


_BY_CLASS = ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c}s" for c in ("variant", "error", "omission", "addition"))


@registry.add(_READINGS + f" SELECT doc_id, witness, {_BY_CLASS}, count(DISTINCT pos) AS places FROM x GROUP BY doc_id, witness")
def g02_difference_statistics(spark, sf_dir):
    """Departures of each witness of each document by class."""
    n = lambda c: F.count_if(F.col("category") == c).alias(f"{c}s")
    return editions.rows(spark, sf_dir, gathered=True).groupBy("doc_id", "witness").agg(*map(n, ("variant", "error", "omission", "addition")), F.countDistinct("pos").alias("places"))


@registry.add(_READINGS + " SELECT doc_id, count(*) AS total FROM x GROUP BY doc_id")
def g22_difference_total(spark, sf_dir):
    """All departures of all witnesses of a document."""
    return editions.rows(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))


@registry.add(f"""SELECT doc_id, pos, kind, substr(c, CAST(greatest(pos - 30, 0) AS BIGINT) + 1, CAST(pos + 30 - greatest(pos - 30, 0) AS BIGINT)) AS context FROM ({_SQL_MARKS})
JOIN (SELECT doc_id, regexp_replace({_SQL_SPACELESS}, '{MARK}', '', 'g') AS c FROM documents) USING (doc_id)""")
def g07_context_slices(spark, sf_dir):
    """Thirty clean characters on either side of each difference of marks."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    return mark_differences(docs, context=30).select("doc_id", "pos", "kind", "context")


@registry.add(_MET + """, s AS (SELECT a, b, category, count(*) AS n FROM m WHERE same AND category = other GROUP BY ALL)
SELECT a, b, string_agg(category || ':' || n, ' ' ORDER BY category) AS merged, CAST(sum(n) AS BIGINT) AS total FROM s GROUP BY a, b""")
def k06_class_merge(spark, sf_dir):
    """What two witnesses share, all classes in one list."""
    met = editions.met(spark, sf_dir).where("same AND category = other")
    n = met.groupBy("a", "b", "category").agg(F.count(F.lit(1)).alias("n"))
    each = F.array_sort(F.collect_list(F.struct("category", F.concat_ws(":", "category", F.col("n").cast("string")).alias("said"))))
    return n.groupBy("a", "b").agg(F.array_join(F.transform(each, lambda x: x["said"]), " ").alias("merged"), F.sum("n").alias("total"))


@registry.add(f"SELECT b.item_id, coalesce(n, 0) AS n_documents, coalesce(places, 0) AS n_places, n IS NOT NULL AS matched FROM benchmark b LEFT JOIN (SELECT item_id, count(*) AS n, CAST(sum(hits) AS BIGINT) AS places FROM ({_HITS}) GROUP BY item_id) USING (item_id)")
def d12_citation_listing(spark, sf_dir):
    """All passages with the documents and places that they are matched to; matched tells the unmatched ones."""
    b = table(spark, sf_dir, "benchmark")
    h = passage_hits(table(spark, sf_dir, "documents"), b).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("hits").alias("places"))
    return b.join(h, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"), F.coalesce("places", F.lit(0)).alias("n_places"), F.col("n").isNotNull().alias("matched"))


@registry.add("SELECT doc_id FROM documents WHERE list_contains([lang, source], 'fr') AND contains(lower(text), 'quelle')")
def d04_tag_and_text(spark, sf_dir):
    """Documents that bear a tag and hold a text, case aside."""
    d = table(spark, sf_dir, "documents")
    return d.where(F.array_contains(F.array("lang", "source"), "fr") & F.contains(F.lower("text"), F.lit("quelle"))).select("doc_id")


_CUSTOM = [("IRAN", "near east"), ("INDIA", "south asia")]
_KNOWN = [("INDIA", "asia"), ("IN", "asia"), ("CHIN", "asia"), ("FRANCE", "europe"), ("GERMANY", "europe"), ("UNITED", "west"), ("AR", "south")]


@registry.add("SELECT n_name AS name, coalesce((SELECT arg_min(s, o) FROM (VALUES " + ", ".join(f"({i}, '{k}', '{s}')" for i, (k, s) in enumerate(_CUSTOM + _KNOWN)) + ") t(o, k, s) WHERE contains(n_name, k)), '未知') AS system FROM nation")
def n04_custom_systems(spark, sf_dir):
    """The systems of names, a user's keywords before the known ones: rows of one query, not a change of the table."""
    words = spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate(_CUSTOM + _KNOWN)], "ord int, keyword string, system string")
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    found = names.join(L.few(words), F.contains("name", F.col("keyword"))).groupBy("name").agg(F.min_by("system", "ord").alias("system"))
    return names.join(found, "name", "left").select("name", F.coalesce("system", F.lit(L.UNKNOWN)).alias("system"))


@registry.add("""WITH c AS (SELECT 'deck ' || (item_id % 4) AS deck, item_id AS card, md5(text) AS question, text AS back FROM benchmark),
q AS (SELECT *, row_number() OVER (PARTITION BY deck ORDER BY md5('quizq:' || card), card) AS number FROM c), w AS (SELECT deck, card, back, row_number() OVER (PARTITION BY deck ORDER BY md5('quizw:' || card), card) - 1 AS place FROM c),
p AS (SELECT deck, card, back, place, count(*) OVER (PARTITION BY deck) AS size FROM w WHERE place < 40),
o AS (SELECT q.deck, q.number, q.card, q.question, q.back AS answer, p.card AS other, p.back, k, row_number() OVER (PARTITION BY q.deck, q.card ORDER BY k) AS nth
  FROM q JOIN (SELECT DISTINCT deck, size FROM p WHERE size > 1) USING (deck) CROSS JOIN range(4) r(k) JOIN p ON p.deck = q.deck AND p.place = ((q.number - 1) * 4 + k) % p.size WHERE q.number <= 10 AND k < p.size AND p.card <> q.card),
e AS (SELECT deck, number, card, question, answer, other, back FROM o WHERE nth <= 3 UNION ALL SELECT DISTINCT deck, number, card, question, answer, card, answer FROM o),
l AS (SELECT deck, number, card, question, answer, list(back ORDER BY md5('quizo:' || card || ':' || other), other) AS options FROM e GROUP BY ALL)
SELECT deck, CAST(number AS INTEGER) AS number, card, question, md5(array_to_string(options, '|')) AS digest, CAST(list_position(options, answer) - 1 AS INTEGER) AS correct_index FROM l""")
def j06_quiz(spark, sf_dir):
    """Ten questions of each of four decks of passages, with three wrong answers each."""
    b = table(spark, sf_dir, "benchmark")
    cards = b.select(F.concat(F.lit("deck "), (F.col("item_id") % 4).cast("string")).alias("deck"), F.col("item_id").alias("card"), F.md5("text").alias("front"), F.col("text").alias("back"))
    return quizzes.quiz(cards, 10, "quiz").select("deck", "number", "card", "question", F.md5(F.array_join("options", "|")).alias("digest"), "correct_index")
