"""Citations: passages found in documents, markers and ranges extracted from them, and outlines read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..query import Registry, table

registry = Registry()
#: Words of a passage's key, or characters where it has too few words inside; characters of a document that are cut up together.
KEY_WORDS, KEY_CHARS, PIECE = 4, 8, 1000
#: Passages that may be broadcast.
BROADCAST_ROWS = 100_000


def passage_hits(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id, hits. Words that lie wholly inside a passage (without its first and last, which may be parts of words of a document) are an equi-join key against the words of documents; passages with too few of them have their first characters as key, against the character n-grams of documents. Where a key holds, the whole is compared in place."""
    parts = F.split("text", r"\s+")
    inside = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    long = F.size(inside) >= KEY_WORDS
    key = F.when(long, F.array_join(F.slice(inside, 1, KEY_WORDS), " ")).otherwise(F.substring("text", 1, KEY_CHARS))
    kind = F.when(long, 0).otherwise(F.least(F.length("text"), F.lit(KEY_CHARS)))
    p = passages.where("length(text) > 0").select("item_id", F.col("text").alias("passage"), kind.alias("kind"), key.alias("key"))
    sizes = sorted(r.kind for r in p.where("kind > 0").select("kind").distinct().collect())  # KEY_CHARS rows at most
    keys = p.select("kind", "key").distinct()
    small = passages.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    p, keys = (F.broadcast(p), F.broadcast(keys)) if small else (p, keys)
    none = F.array().cast("array<int>")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    d = documents.select("doc_id", words.alias("w"))
    starts = F.when(F.size("w") >= KEY_WORDS, F.sequence(F.lit(1), F.size("w") - (KEY_WORDS - 1))).otherwise(none)
    grams = F.transform(starts, lambda i: F.array_join(F.slice("w", i, KEY_WORDS), " "))
    held = d.select("doc_id", F.lit(0).alias("kind"), F.explode(F.array_distinct(grams)).alias("key"))
    if sizes:
        # pieces that overlap, since a character is found by counting from the first
        at = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(PIECE))
        pieces = documents.select("doc_id", F.explode(F.transform(at, lambda i: F.substring(F.col("text"), i, F.lit(PIECE + KEY_CHARS - 1)))).alias("piece"))
        for size in sizes:
            last = F.least(F.length("piece") - (size - 1), F.lit(PIECE))
            cut = F.transform(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(none), lambda i: F.substring(F.col("piece"), i, F.lit(size)))  # noqa: B023
            held = held.union(pieces.select("doc_id", F.lit(size), F.explode(F.array_distinct(cut))))
    near = held.join(keys, ["kind", "key"]).select("doc_id", "kind", "key").distinct()
    found = documents.select("doc_id", "text").join(near, "doc_id").join(p, ["kind", "key"]).where(F.contains("text", F.col("passage")))
    n = (F.length("text") - F.length(F.replace(F.col("text"), F.col("passage"), F.lit("")))) / F.length("passage")
    return found.select("doc_id", "item_id", n.cast("long").alias("hits")).distinct()


_HITS = "SELECT doc_id, item_id, CAST((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) AS BIGINT) AS hits FROM documents d JOIN benchmark b ON contains(d.text, b.text)"


@registry.add(_HITS)
def e15_passage_hits(spark, sf_dir):
    return passage_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registry.add(f"SELECT count(*) AS total, count(h.item_id) AS matched FROM benchmark b LEFT JOIN (SELECT DISTINCT item_id FROM ({_HITS})) h USING (item_id)")
def g16_match_rate(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    h = passage_hits(table(spark, sf_dir, "documents"), b).select("item_id", F.lit(1).alias("hit")).distinct()
    return b.join(h, "item_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("matched"))


#: Words that open a citation in the driver's languages, and the longest span of one.
MARKERS = r"(?:From|To|De|La|Der|Die)\s"
_CITED = MARKERS + r"[^.!?]{5,200}"


@registry.add(f"SELECT doc_id, CAST(len(c) AS BIGINT) AS n, md5(coalesce(list_aggregate(c, 'string_agg', '|'), '')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '{_CITED}') AS c FROM documents)")
def l01_marker_citations(spark, sf_dir):
    """Spans from a marker to the end of the sentence, 200 characters at most."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(_CITED), F.lit(0)).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("digest"))


_LINK = 'href="([^"]*)"'


@registry.add(f"SELECT page_id, ord, href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS ord FROM (SELECT page_id, regexp_extract_all(html, '{_LINK}', 1) AS h FROM pages))")
def a10_outline_links(spark, sf_dir):
    """The links of a page in order."""
    h = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("ord", "href"))
    return h.select("page_id", (F.col("ord") + 1).cast("long").alias("ord"), "href")


@registry.add(f"SELECT href, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS href FROM pages) GROUP BY href")
def e10_reverse_index(spark, sf_dir):
    """Where each link target is referred to."""
    return a10_outline_links(spark, sf_dir).groupBy("href").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@registry.add("""SELECT c.conv_id, c.turn, coalesce(d.doc_id, -1) AS doc_id, coalesce(max(CASE WHEN d.doc_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.role, c.text ROWS UNBOUNDED PRECEDING), 0) = 0 AS preface
FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 10 + c.turn""")
def e11_parallel_reading(spark, sf_dir):
    """Commentary segments beside the base segment that they refer to; those before the first hit are preface."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("ref", F.col("conv_id") * 10 + F.col("turn"))
    d = table(spark, sf_dir, "documents").select("doc_id")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    j = c.join(d, c.ref == d.doc_id, "left")
    return j.select("conv_id", "turn", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), (F.max(F.when(F.col("doc_id").isNotNull(), 1).otherwise(0)).over(w) == 0).alias("preface"))
