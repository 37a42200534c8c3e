"""Queries over ids, titles, by-lines and citations. Their inputs are built from keys, so what must come out is known without parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import references as R
from ..functions.text import chinese_numeral
from ..query import Registry, table

registry = Registry()


@registry.add("""SELECT p_partkey, canon, volume, number, letter, part, CAST(CASE WHEN canon IS NULL THEN 0 WHEN volume <> '' THEN 1 WHEN canon = 'T' THEN 55 ELSE 99 END AS BIGINT) AS n_volumes FROM (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'X' WHEN 2 THEN 'K' END AS canon,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'X' || lpad(CAST(p_partkey % 30 + 1 AS VARCHAR), 2, '0') WHEN 2 THEN '' END AS volume,
  CASE WHEN p_partkey % 4 < 2 THEN lpad(CAST(p_partkey % 3000 AS VARCHAR), 4, '0') WHEN p_partkey % 4 = 2 THEN lpad(CAST(p_partkey % 90000 AS VARCHAR), 5, '0') END AS number,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN '' END AS letter,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN lpad(CAST(p_partkey % 200 AS VARCHAR), 3, '0') WHEN 2 THEN '' END AS part FROM part)""")
def c20_scripture_ids(spark, sf_dir):
    """Ids of three forms, and one that is none."""
    p = F.col("p_partkey")
    digits = lambda n, width: F.lpad(n.cast("string"), width, "0")
    ids = (
        F.when(p % 4 == 0, F.concat(F.lit(" T"), digits(p % 3000, 4)))
        .when(p % 4 == 1, F.concat(F.lit("x"), digits(p % 30 + 1, 2), F.lit("n"), digits(p % 3000, 4), F.lit("a_"), digits(p % 200, 3)))
        .when(p % 4 == 2, F.concat(F.lit("K"), digits(p % 90000, 5)))
        .otherwise(F.concat(F.lit("T1_"), p.cast("string")))
    )
    found = table(spark, sf_dir, "part").select("p_partkey", R.scripture_id(ids).alias("s")).select("p_partkey", "s.*")
    return found.withColumn("n_volumes", F.when(F.col("canon").isNotNull(), F.size(R.volume_candidates(F.col("canon"), F.col("volume")))).otherwise(0).cast("long"))


@registry.add("""SELECT p_partkey, 'work' AS title, CAST(CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 999 + 1 ELSE 0 END AS BIGINT) AS volume,
  CAST(CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 300 + 1 ELSE 0 END AS BIGINT) AS other FROM part""")
def c22_volume_edits(spark, sf_dir):
    """The volume of a title in each form, and after it is exchanged for another; 0: none."""
    p = F.col("p_partkey")
    n = chinese_numeral(p % 999 + 1)
    title = (
        F.when(p % 4 == 0, F.concat(F.lit("work 卷第"), n))
        .when(p % 4 == 1, F.concat(F.lit("work第"), n, F.lit("卷")))
        .when(p % 4 == 2, F.concat(F.lit("work卷"), (p % 999 + 1).cast("string")))
        .otherwise(F.lit("work"))
    )
    t = table(spark, sf_dir, "part").select("p_partkey", title.alias("t")).select("p_partkey", R.volume_of(F.col("t")).alias("v"), R.volume_of(R.with_volume(F.col("t"), p % 300 + 1)).alias("w"))
    return t.select("p_partkey", "v.title", F.coalesce("v.volume", F.lit(0)).cast("long").alias("volume"), F.coalesce("w.volume", F.lit(0)).cast("long").alias("other"))


@registry.add("""WITH n AS (SELECT p_partkey, translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij') AS name FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN name ELSE '未知' END AS translator, CASE WHEN p_partkey % 3 = 1 THEN '尊者' || name ELSE '未知' END AS author FROM n""")
def c23_by_lines(spark, sf_dir):
    p = F.col("p_partkey")
    name = F.translate(p.cast("string"), "0123456789", "abcdefghij")
    line = F.when(p % 3 == 0, F.concat(F.lit("唐 某譯 "), name, F.lit("譯"))).when(p % 3 == 1, F.concat(F.lit("尊者"), name, F.lit("造 唐 "), name, F.lit("译")))
    return table(spark, sf_dir, "part").select("p_partkey", R.translator(line).alias("translator"), R.author(line).alias("author"))


@registry.add("""SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '.,;!?', '。，；！？'),
  '([。！？])', '\\1<break time=''500ms''/>', 'g'), '，', '，<break time=''300ms''/>', 'g'), '；', '；<break time=''400ms''/>', 'g'), 'que', '<phoneme alphabet=''sapi'' ph=''ke''>que</phoneme>', 'g') AS t FROM documents)""")
def c34_speech_markup(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", R.speech(F.translate("text", ".,;!?", "。，；！？"), {"que": "ke"}).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


_SQL_RANGE = r"([^\n\[\]]{2,30})[(（]至[)）]([^\n。\[\]]{2,40})[。]"


@registry.add(f"""WITH t AS (SELECT doc_id, translate(replace(replace(text, ' en ', '(至)'), ' the ', '（至）'), '.', '。') AS t FROM documents),
g AS (SELECT doc_id, regexp_extract_all(t, '{_SQL_RANGE}', 1) AS a, regexp_extract_all(t, '{_SQL_RANGE}', 2) AS b FROM t),
c AS (SELECT doc_id, trim(unnest(a)) AS h, trim(unnest(b)) AS x, generate_subscripts(a, 1) AS k FROM g)
SELECT doc_id, count(*) AS n, md5(string_agg(h || '...' || x, '|' ORDER BY k)) AS digest FROM c WHERE length(h) >= 2 AND length(x) >= 2 GROUP BY doc_id""")
def l02_range_citations(spark, sf_dir):
    """Passages cited by head and tail; two words of the documents stand for the mark between them."""
    t = F.translate(F.replace(F.replace("text", F.lit(" en "), F.lit("(至)")), F.lit(" the "), F.lit("（至）")), ".", "。")
    c = table(spark, sf_dir, "documents").select("doc_id", R.range_citations(t).alias("c")).where(F.size("c") > 0)
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("digest"))
