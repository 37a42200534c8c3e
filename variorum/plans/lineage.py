"""Queries over editions, edges and positions, with nations as editions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage as L
from ..query import Registry, table
from . import stemma
from .citations import _HITS, _LINK, a10_outline_links, passage_hits

registry = Registry()
_WORDS = ["A", "AN", "IN", "IA", "UNITED", "RUSS", "CHIN", "JAPAN", "EGY"]


def _words(spark):
    return spark.createDataFrame([(i, w, 1000 + 100 * i) for i, w in enumerate(_WORDS)], "ord int, keyword string, year int")


_SQL_WORDS = "(VALUES " + ", ".join(f"({i}, '{w}', {1000 + 100 * i})" for i, w in enumerate(_WORDS)) + ") k(ord, keyword, year)"


@registry.add(f"SELECT n_name AS name, arg_min(keyword, (-length(keyword), keyword)) AS key FROM nation JOIN {_SQL_WORDS} ON contains(n_name, keyword) GROUP BY n_name")
def c26_canon_names(spark, sf_dir):
    return L.longest_key(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), _words(spark).select(F.col("keyword").alias("key")))


@registry.add(f"""SELECT n_name AS name, CAST(coalesce(CASE WHEN n_nationkey % 4 = 0 THEN 1500 + n_nationkey END, (SELECT min_by(year, ord) FROM {_SQL_WORDS} WHERE contains(n_name, keyword)), 2000) AS BIGINT) AS year FROM nation""")
def c25_edition_years(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    located = n.where("n_nationkey % 4 = 0").select("name", (F.col("n_nationkey") + 1500).alias("year"))
    return L.years(n.select("name"), located, _words(spark))


@registry.add("""SELECT k AS place, CASE WHEN k % 3 = 0 OR k >= 25 THEN 'user' ELSE n_name END AS label, CAST(CASE WHEN k % 6 = 0 OR k >= 25 THEN k * 2 ELSE n_regionkey END AS BIGINT) AS region
FROM (SELECT range AS k FROM range(30)) LEFT JOIN nation ON n_nationkey = k WHERE n_nationkey IS NOT NULL OR k % 3 = 0""")
def e17_locations(spark, sf_dir):
    """Derived places, and places that a user has set: some columns of some rows, and some places that are not derived."""
    derived = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("place"), F.col("n_name").alias("label"), F.col("n_regionkey").cast("long").alias("region"))
    k = spark.range(0, 30, 3).withColumnRenamed("id", "place")
    overrides = k.select("place", F.lit("user").alias("label"), F.when((F.col("place") % 6 == 0) | (F.col("place") >= 25), F.col("place") * 2).alias("region"))
    return L.enriched(derived, overrides, "place")


@registry.add(stemma._SIM + """ SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, sim, a.n_regionkey = b.n_regionkey AS same_region FROM sim JOIN nation a ON a.n_nationkey = i JOIN nation b ON b.n_nationkey = j WHERE sim >= 0""")
def e18_near_pairs(spark, sf_dir):
    """Pairs of editions that are similar, and whether they are of one place."""
    place = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    s = stemma.similarity(table(spark, sf_dir, "embeddings")).where("sim >= 0")
    both = s.join(place.toDF("i", "r"), "i").join(place.toDF("j", "q"), "j")
    return both.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "sim", (F.col("r") == F.col("q")).alias("same_region"))


@registry.add(stemma._SIM + " SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, dot FROM s WHERE j >= 7")
def k03_added_witnesses(spark, sf_dir):
    """Editions 7 and later are new: only their pairs are computed."""
    e = table(spark, sf_dir, "embeddings")
    cells = e.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.sum(F.floor(F.col("x").cast("double") * 1000).cast("long")).alias("x"))
    ids = e.select("label").distinct()
    out = L.new_pairs(cells, ids.where("label < 7"), ids.where("label >= 7"))
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "dot")


@registry.add("""WITH h AS (SELECT d.doc_id, b.item_id, string_split(d.text, b.text) AS s, length(b.text) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
o AS (SELECT doc_id, item_id, n, unnest(list_transform(range(1, len(s)), lambda i: CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * n)) AS pos FROM h)
SELECT doc_id, item_id, CAST(pos AS BIGINT) AS pos, CAST(doc_id % 1000 AS BIGINT) AS p FROM o WHERE doc_id % 1000 BETWEEN pos AND pos + n + 50""")
def e21_matches_at(spark, sf_dir):
    """The passages that stand at, or at most 50 characters before, a position of each document: each of their places."""
    docs, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hit = passage_hits(docs, b).select("doc_id", "item_id").join(b.toDF("item_id", "passage"), "item_id").join(docs.select("doc_id", "text"), "doc_id")
    spans = hit.select("doc_id", "item_id", F.explode(L.places(F.col("text"), F.col("passage"))).alias("pos"), F.length("passage").alias("size"))
    found = L.matches_at(spans, docs.select("doc_id", (F.col("doc_id") % 1000).alias("p")), 50)
    return found.select("doc_id", "item_id", F.col("pos").cast("long").alias("pos"), "p")


@registry.add(f"SELECT item_id, doc_id, hits, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM ({_HITS})) WHERE rank <= 5")
def j03_best_matches(spark, sf_dir):
    """The five documents in which a passage stands most often."""
    h = passage_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return L.best(h, "item_id", 5, F.desc("hits"), F.col("doc_id")).select("item_id", "doc_id", "hits", "rank")


@registry.add(f"""WITH l AS (SELECT page_id, page_id % 3 AS work, unnest(h) AS node, generate_subscripts(h, 1) AS k FROM (SELECT page_id, regexp_extract_all(html, '{_LINK}', 1) AS h FROM pages)),
m AS (SELECT node, work, arg_max(page_id || ':' || k, page_id * 1000 + k) AS link FROM l GROUP BY ALL)
SELECT node, {", ".join(f"coalesce(max(link) FILTER (WHERE work = {w}), '') AS work_{w}" for w in range(3))} FROM m GROUP BY node""")
def e09_outline_mapping(spark, sf_dir):
    """For each link target the last place that refers to it, by work."""
    k = a10_outline_links(spark, sf_dir)
    links = k.select(F.col("href").alias("node"), (F.col("page_id") % 3).alias("work"), F.concat_ws(":", F.col("page_id").cast("string"), F.col("ord").cast("string")).alias("link"), F.struct("page_id", "ord").alias("ord"))
    return L.mapped(links.select("node").distinct(), links, [0, 1, 2])
