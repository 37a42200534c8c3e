"""The project layer: filters, joins, pages, upserts, histories and statistics over relational tables.

Stand-ins: customers are users, nations their groups, orders are projects, labels are decisions, conversations are
comment threads, events are edits and reviews. Most of it is the same SQL for Spark and for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from ..query import Registry, table
from ..streaming import reviews

registry = Registry()
R = registry.relational

R("d01_conjunctive_filter", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
R("d02_access_predicate", "SELECT o_orderkey FROM {orders} WHERE o_custkey % 10 = 1 OR o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_suppkey = 7)")
R("d03_search_three_columns", "SELECT c_custkey FROM {customer} WHERE lower(c_name) LIKE '%00001%' OR lower(c_mktsegment) LIKE '%auto%' OR CAST(c_nationkey AS STRING) LIKE '%1%'".replace("STRING", "VARCHAR(20)"))
R("d05_phrase_scan", "SELECT doc_id, CAST(length(text) - length(replace(text, 'tion', '')) AS BIGINT) / 4 AS dummy FROM {documents} WHERE text LIKE '%tion on%'".replace(" / 4 AS dummy", " AS hit_chars"))
R("d08_decided_search", "SELECT conv_id, turn FROM {conversations} WHERE lower(concat_ws(' ', role, text)) LIKE '%user%the%'")
R("d10_without_location", "SELECT n_nationkey, n_name FROM {nation} WHERE NOT EXISTS (SELECT 1 FROM {supplier} WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
R("d11_role_rank", "SELECT conv_id, max(CASE role WHEN 'system' THEN 3 WHEN 'assistant' THEN 2 WHEN 'user' THEN 1 ELSE 0 END) AS top_role FROM {conversations} GROUP BY conv_id")
R("e01_members", "SELECT c_custkey, c_name, n_name, r_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey")
R("e02_comments", "SELECT c.conv_id, c.turn, l.quality FROM {conversations} c JOIN {labels} l ON c.conv_id = l.doc_id WHERE c.role = 'user'")
R("e03_history", "SELECT event_id, user_id, c_name FROM {events} JOIN {customer} ON user_id = c_custkey WHERE event_type = 'purchase'")
R("e04_shared_with", "SELECT o_orderkey, c_name, c_nationkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_returnflag = 'R') AND c_nationkey <> 3")
R("e05_membership_semi", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)")
R("e16_decisions_of_rows", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
R("e22_effective_role", "SELECT o_orderkey, CASE WHEN o_custkey = 1 THEN 'owner' WHEN l.n > 3 THEN 'editor' WHEN o_orderpriority = '5-LOW' THEN 'viewer' ELSE 'none' END AS role FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) l ON l_orderkey = o_orderkey")
R("g09_note_statistics", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type")
R("g10_system_stats", "SELECT count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_final, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_open, count(DISTINCT o_custkey) AS n_users FROM {orders}")
R("g11_list_total", "SELECT count(*) AS total FROM {orders} WHERE o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM'")
R("g12_notebook_statistics", "SELECT count(*) AS n, count(DISTINCT tag) AS n_tags FROM (SELECT lang AS tag FROM {documents} UNION ALL SELECT source FROM {documents})")
R("g13_learning_statistics", "SELECT user_id % 10 AS deck, count(CASE WHEN value >= 40 THEN 1 END) AS mastered, count(CASE WHEN value < 40 AND value >= 10 THEN 1 END) AS learning, count(CASE WHEN value < 10 THEN 1 END) AS fresh FROM {events} GROUP BY user_id % 10")
R("g14_quiz_score", "SELECT user_id, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) AS BIGINT) AS right_answers, count(*) AS answers FROM {events} GROUP BY user_id")
R("g15_decision_stats", "SELECT count(*) AS total, count(CASE WHEN quality = 1 THEN 1 END) AS decided, count(CASE WHEN toxic = 1 THEN 1 END) AS uncertain FROM {labels}")
R("g20_category_tally", "SELECT lang, source, count(*) AS n FROM {documents} GROUP BY GROUPING SETS ((lang), (source), ())")
R("g21_dictionary_stats", "SELECT count(*) AS n, count(DISTINCT p_brand) AS n_groups, count(DISTINCT p_type) AS n_types FROM {part}")
R("g23_year_levels", "SELECT n_nationkey, CAST(0 AS BIGINT) + dense_rank() OVER (ORDER BY n_regionkey) - 1 AS level FROM {nation}")
R("i01_running_offset", "SELECT conv_id, turn, CAST(coalesce(sum(CAST(length(text) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM {conversations}")
R("i02_renumber", "SELECT l_orderkey, l_linenumber, CAST(0 AS BIGINT) + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM {lineitem} WHERE l_returnflag <> 'N'")
R("i03_first_per_key", "SELECT user_id, event_id FROM (SELECT user_id, event_id, CAST(0 AS BIGINT) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM {events}) WHERE k = 1")
R("i08_version_history", "SELECT user_id, event_id, CAST(0 AS BIGINT) + row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS version FROM {events}")
R("j01_page", "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
@registry.add("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem")
def j04_composite_order(spark, sf_dir):
    """Numbers all rows by a composite key."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return numbered(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "k").select("l_orderkey", "l_linenumber", "k")


R("j05_study_queue", "SELECT user_id, n FROM (SELECT user_id, count(*) AS n, max(ts) AS last_seen FROM {events} GROUP BY user_id) ORDER BY n, last_seen, user_id LIMIT 25")
R("j07_display_order", "SELECT n_name, CAST(0 AS BIGINT) + row_number() OVER (ORDER BY CASE WHEN n_regionkey = 2 THEN 0 WHEN n_regionkey = 3 THEN 1 ELSE 2 END, n_nationkey) AS k FROM {nation}")
R("j08_page_of_record", "SELECT page_id, (CAST(0 AS BIGINT) + row_number() OVER (ORDER BY page_id) - 1) // 20 + 1 AS page FROM {pages}".replace("(CAST(0 AS BIGINT) + row_number() OVER (ORDER BY page_id) - 1) // 20 + 1", "CAST(floor((page_id) / 20.0) AS BIGINT) + 1"))
R("k01_union_sources", "SELECT 'd' AS kind, doc_id AS id FROM {documents} UNION ALL SELECT 'b', item_id FROM {benchmark}")
R("k02_dedup_by_span", "SELECT text, min(doc_id) AS doc_id, count(*) AS n FROM {documents} GROUP BY text".replace("SELECT text,", "SELECT md5(text) AS digest,"))
R("k04_remove_witnesses", "SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
R("k05_decision_upsert", "SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.q, o.q) AS q, n.q IS NOT NULL AS fresh FROM (SELECT doc_id, CAST(n_chars AS BIGINT) AS q FROM {documents}) o FULL JOIN (SELECT doc_id, CAST(quality AS BIGINT) AS q FROM {labels}) n ON o.doc_id = n.doc_id")
R("k07_intersect_except", "(SELECT doc_id FROM {documents} INTERSECT SELECT doc_id FROM {labels}) EXCEPT SELECT doc_id FROM {labels} WHERE toxic = 1")
R("k08_cascade_delete", "SELECT l_orderkey, l_linenumber FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'P')")
R("k09_delete_and_renumber", "SELECT conv_id, turn, CAST(0 AS BIGINT) + row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS new_turn FROM {conversations} WHERE role <> 'system'")
R("k10_latest_wins", "SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, CAST(0 AS BIGINT) + row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM {events}) WHERE k = 1")
R("m03_history_append", "SELECT event_id, user_id FROM {events} WHERE event_type <> 'view' UNION ALL SELECT -1, 0")


@registry.add("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS question FROM conversations")
def e20_carry_forward(spark, sf_dir):
    """The nearest question before each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.md5("text")), ignorenulls=True).over(w).alias("question"))


@registry.add("SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, count(*) > 3 AS limited FROM events GROUP BY 1, 2")
def m05_rate_windows(spark, sf_dir):
    """Requests of a user in each hour, against a limit of three."""
    w = F.window("ts", "1 hour")
    n = table(spark, sf_dir, "events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "n", (F.col("n") > 3).alias("limited"))


def mastery(reviews: DataFrame) -> DataFrame:
    """user_id, mastery after all reviews in order: one up or down a review, kept between 0 and 5."""
    step = F.when(F.col("event_type").isin("click", "purchase", "view"), 1).otherwise(-1)
    ordered = reviews.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", step.alias("step")))).alias("r"))
    return ordered.select("user_id", F.aggregate("r", F.lit(0), lambda acc, x: F.greatest(F.lit(0), F.least(F.lit(5), acc + x["step"]))).cast("long").alias("mastery"))


@registry.add("""SELECT user_id, CAST(list_reduce(list_prepend(0, list(CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 1 ELSE -1 END ORDER BY ts, event_id)),
  lambda acc, x: greatest(0, least(5, acc + x))) AS BIGINT) AS mastery FROM events GROUP BY user_id""")
def m02_mastery_fold(spark, sf_dir):
    return mastery(table(spark, sf_dir, "events"))


_ANSWERS = "event_type IN ('click', 'purchase', 'view')"


@registry.add(f"""WITH s AS (SELECT user_id, ts, event_id, {_ANSWERS} AS right_, CASE WHEN NOT ({_ANSWERS}) OR event_id % 5 + 1 <= 2 THEN -1 WHEN event_id % 5 + 1 >= 4 THEN 1 ELSE 0 END AS step FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT user_id AS card, CAST(list_reduce(list_prepend(0, list(step ORDER BY ts, event_id)), lambda acc, x: greatest(0, least(5, acc + x))) AS BIGINT) AS mastery,
  count(*) AS times_reviewed, count(*) FILTER (WHERE right_) AS times_correct FROM s GROUP BY user_id""")
def m02_review_progress(spark, sf_dir):
    """Progress by the right answers and how hard they were; put together in parts, so no user's reviews meet in one task."""
    e = table(spark, sf_dir, "events")
    r = e.select(F.col("user_id").alias("card"), "ts", F.col("event_id").alias("id"), F.expr(_ANSWERS).alias("correct"), (F.col("event_id") % 5 + 1).alias("difficulty"))
    return reviews.progress(r).select("card", "mastery", "times_reviewed", "times_correct")
