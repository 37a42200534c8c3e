"""Stemmatics: similarity, clusters and geography of editions.

Stand-ins: the ten labels of embeddings are editions, their centroids texts; nations with coordinates from their keys
are places. Similarities are exact integers (millionths), so both engines agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import haversine_km
from ..operators.graph import components
from ..query import Registry, table

registry = Registry()


def similarity(embeddings: DataFrame) -> DataFrame:
    """i < j, sim: cosine of the editions' summed vectors, in millionths. One row an edition and dimension is all that is joined."""
    cells = embeddings.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.sum(F.floor(F.col("x").cast("double") * 1000).cast("long")).alias("x"))
    norm = cells.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("n"))
    dot = cells.toDF("i", "d", "x").join(cells.toDF("j", "d", "y"), "d").where("i < j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    both = dot.join(norm.toDF("i", "ni"), "i").join(norm.toDF("j", "nj"), "j")
    return both.select("i", "j", F.floor(1e6 * F.col("dot") / (F.sqrt("ni") * F.sqrt("nj"))).cast("long").alias("sim"))


_SIM = """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding) AS x FROM embeddings),
c AS (SELECT label, d, CAST(sum(CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS BIGINT) AS x FROM e GROUP BY label, d),
n AS (SELECT label, CAST(sum(x * x) AS BIGINT) AS n FROM c GROUP BY label),
s AS (SELECT a.label AS i, b.label AS j, CAST(sum(a.x * b.x) AS BIGINT) AS dot FROM c a JOIN c b ON a.d = b.d AND a.label < b.label GROUP BY ALL),
sim AS (SELECT i, j, CAST(floor(1e6 * dot / (sqrt(p.n) * sqrt(q.n))) AS BIGINT) AS sim FROM s JOIN n p ON p.label = i JOIN n q ON q.label = j)"""


@registry.add(_SIM + " SELECT i, j, sim FROM sim UNION ALL SELECT j, i, sim FROM sim UNION ALL SELECT label, label, 1000000 FROM n")
def e06_similarity_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    s = similarity(e)
    one = e.select("label").distinct().select(F.col("label").alias("i"), F.col("label").alias("j"), F.lit(1_000_000).cast("long").alias("sim"))
    return s.union(s.select("j", "i", "sim")).union(one)


@registry.add(_SIM + " SELECT i, j, sim FROM sim ORDER BY sim DESC, i, j LIMIT 1")
def h03_closest_pair(spark, sf_dir):
    s = similarity(table(spark, sf_dir, "embeddings"))
    return s.orderBy(F.desc("sim"), "i", "j").limit(1)


@registry.add(_SIM + ", m AS (SELECT i, sim FROM sim UNION ALL SELECT j, sim FROM sim) SELECT i % 3 AS place, count(DISTINCT i) AS n_editions, CAST(sum(sim) AS BIGINT) AS total FROM m GROUP BY 1")
def g18_place_clusters(spark, sf_dir):
    s = similarity(table(spark, sf_dir, "embeddings"))
    m = s.select("i", "sim").union(s.select("j", "sim"))
    return m.groupBy((F.col("i") % 3).alias("place")).agg(F.countDistinct("i").alias("n_editions"), F.sum("sim").alias("total"))


@registry.add(_SIM + " SELECT min(sim) AS lo, max(sim) AS hi FROM sim")
def g19_similarity_range(spark, sf_dir):
    return similarity(table(spark, sf_dir, "embeddings")).agg(F.min("sim").alias("lo"), F.max("sim").alias("hi"))


@registry.add("""WITH p AS (SELECT n_nationkey AS k, CAST(n_nationkey * 7 % 90 AS DOUBLE) AS lat, CAST(n_nationkey * 31 % 180 AS DOUBLE) AS lng, n_regionkey AS r FROM nation)
SELECT a.k AS i, b.k AS j, a.r = b.r AS same_region, CAST(round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h))) AS BIGINT) AS km FROM (SELECT *, 0 AS z FROM p) a JOIN p b ON a.k < b.k,
LATERAL (SELECT pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2) AS h)""")
def c28_geo_pairs(spark, sf_dir):
    """Distances of places; a few dozen rows on either side."""
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 7 % 90).cast("double").alias("lat"), (F.col("n_nationkey") * 31 % 180).cast("double").alias("lng"), F.col("n_regionkey").alias("r"))
    q = p.toDF("k2", "lat2", "lng2", "r2")
    km = F.round(haversine_km(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))).cast("long")
    return p.join(q, F.col("k") < F.col("k2")).select(F.col("k").alias("i"), F.col("k2").alias("j"), (F.col("r") == F.col("r2")).alias("same_region"), km.alias("km"))


@registry.add("""SELECT s_suppkey AS node, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS component FROM supplier
WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1)""")
def h09_components(spark, sf_dir):
    """Variant groups: suppliers of a nation are chained pair by pair, and the chains merged."""
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    pairs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.lag("s_suppkey").over(w).alias("b")).where("b IS NOT NULL")
    return components(pairs)


_SYSTEMS = [("asia", "ASIA"), ("asia", "INDIA"), ("europe", "FRANCE"), ("europe", "GERMANY"), ("america", "CANADA"), ("america", "BRAZIL"), ("america", "UNITED")]


@registry.add("SELECT n_nationkey, coalesce((SELECT min_by(s, o) FROM (VALUES " + ", ".join(f"({i}, '{s}', '{k}')" for i, (s, k) in enumerate(_SYSTEMS)) + ") t(o, s, k) WHERE contains(n_name, k)), 'other') AS system FROM nation")
def c24_edition_system(spark, sf_dir):
    """The first keyword that a name contains decides its system."""
    name = F.lit("other")
    for system, key in reversed(_SYSTEMS):
        name = F.when(F.contains("n_name", F.lit(key)), system).otherwise(name)
    return table(spark, sf_dir, "nation").select("n_nationkey", name.alias("system"))
