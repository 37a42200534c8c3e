"""Editions in time and place, edges between them, and passages that are looked up by position. Inputs are tables, so names and keywords are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The year and the system of an edition of which nothing is known; what evidence adds: bounds that similarity
#: and shared errors must exceed and their points, points of one system and of an ancestor as source; the least score of an
#: edge, that of a known lineage, and what keeps an edge beside a path of two.
NO_YEAR, UNKNOWN = 2000, "未知"
SIMILAR = [(0.95, 30), (0.90, 20), (0.85, 10)]
ERRORS = [(10, 40), (5, 25), (2, 15), (0, 5)]
SAME_SYSTEM, ANCESTOR, LEAST, KNOWN, SURE = 20, 10, 30, 90, 80


def few(words: DataFrame, rows: int = 10_000) -> DataFrame:
    """A table of words, broadcast if it is as small as such tables are (counted); Spark chooses otherwise."""
    return F.broadcast(words) if words.limit(rows + 1).count() <= rows else words


def longest_key(names: DataFrame, keys: DataFrame) -> DataFrame:
    """Name and the longest key (ties: the least) that it contains; names without one are left out."""
    found = names.join(few(keys), F.contains("name", F.col("key")))
    return found.groupBy("name").agg(F.min_by("key", F.struct(-F.length("key"), F.col("key"))).alias("key"))


def years(editions: DataFrame, located: DataFrame, keywords: DataFrame) -> DataFrame:
    """Name and year: that of its place, else of the first keyword (ord) that it contains, else NO_YEAR."""
    first = editions.select("name").distinct().join(few(keywords), F.contains("name", F.col("keyword"))).groupBy("name").agg(F.min_by("year", "ord").alias("by_word"))
    both = editions.join(located.select("name", F.col("year").alias("by_place")), "name", "left").join(first, "name", "left")
    return both.select("name", F.coalesce("by_place", "by_word", F.lit(NO_YEAR)).cast("long").alias("year"))


def enriched(derived: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """All rows of either table; what a user has set wins, column by column."""
    other = overrides.select(key, *(F.col(c).alias(f"_{c}") for c in overrides.columns if c != key))
    both = derived.join(other, key, "full")
    return both.select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in derived.columns if c != key))


def adjusted(edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """H8: edges without the removed ones (source, target), and the added ones, which replace others of the same ends."""
    ends = ["source", "target"]
    gone = removed.select(*ends).union(added.select(*ends))
    return edges.join(gone, ends, "left_anti").select(*edges.columns).union(added.select(*edges.columns))


def edition_nodes(names: DataFrame, located: DataFrame, ancestors: DataFrame, keywords: DataFrame, systems: DataFrame) -> DataFrame:
    """Ord, name, year (of its place, else of the first ancestor or keyword in the name, else NO_YEAR), system (of the first keyword, else unknown) and is_ancestor. names: ord, name; the tables of words: ord, keyword and a value. Names are those of one project, a few dozen."""

    def first(words: DataFrame, value: str, out: str) -> DataFrame:
        return names.join(words.select(F.col("ord").alias("o"), "keyword", value), F.contains("name", F.col("keyword"))).groupBy("name").agg(F.min_by(value, "o").alias(out))

    told = names.join(located.select("name", F.col("year").alias("placed")), "name", "left")
    for words, value, out in ((ancestors, "year", "of_ancestor"), (keywords, "year", "of_word"), (systems, "system", "of_system")):
        told = told.join(first(words, value, out), "name", "left")
    year = F.coalesce("placed", "of_ancestor", "of_word", F.lit(NO_YEAR)).cast("long")
    return told.select("ord", "name", year.alias("year"), F.coalesce("of_system", F.lit(UNKNOWN)).alias("system"), F.col("of_ancestor").isNotNull().alias("is_ancestor"))


def scored(value: Column, bands: list[tuple[float, int]]) -> Column:
    """The points of the first bound that the value exceeds."""
    out = F.lit(0)
    for bound, points in reversed(bands):
        out = F.when(value > bound, points).otherwise(out)
    return out


def lineage_edges(nodes: DataFrame, similarity: DataFrame, errors: DataFrame, chains: DataFrame) -> DataFrame:
    """H4: source (the older one; of one year the first), target, confidence, evidence, similarity in percent, shared_errors, is_known, and the places of both in the project. similarity (a, b, sim) and errors (a, b, errors) have a row a pair, in either direction."""
    pair = lambda a, b: F.array_sort(F.array(a, b))
    i = nodes.select(*(F.col(c).alias(f"i_{c}") for c in nodes.columns))
    j = nodes.select(*(F.col(c).alias(f"j_{c}") for c in nodes.columns))
    two = i.join(j, F.col("i_ord") < F.col("j_ord")).withColumn("pair", pair("i_name", "j_name"))
    two = two.join(similarity.select(pair("a", "b").alias("pair"), "sim"), "pair", "left").join(errors.select(pair("a", "b").alias("pair"), "errors"), "pair", "left")
    older = F.col("i_year") <= F.col("j_year")
    side = lambda c, first: F.when(older == first, F.col(f"i_{c}")).otherwise(F.col(f"j_{c}"))
    known = chains.select(F.col("src"), F.col("dst"))
    told = two.select(
        side("name", F.lit(True)).alias("source"), side("name", F.lit(False)).alias("target"), "i_ord", "j_ord", F.coalesce("sim", F.lit(0.0)).alias("sim"), F.coalesce("errors", F.lit(0)).alias("n"),
        ((F.col("i_system") == F.col("j_system")) & (F.col("i_system") != UNKNOWN)).alias("alike"), side("is_ancestor", F.lit(True)).alias("from_ancestor"),
    )
    chained = told.join(known, F.contains("source", F.col("src")) & F.contains("target", F.col("dst"))).select("source", "target", F.lit(True).alias("chained")).distinct()
    told = told.join(chained, ["source", "target"], "left").withColumn("is_known", F.coalesce("chained", F.lit(False)))
    score = scored(F.col("sim"), SIMILAR) + scored(F.col("n"), ERRORS) + F.when(F.col("alike"), SAME_SYSTEM).otherwise(0) + F.when(F.col("from_ancestor"), ANCESTOR).otherwise(0)
    percent = F.format_string("%.1f", F.col("sim") * 100)
    evidence = F.array_compact(F.array(
        F.when(F.col("sim") > 0.95, F.concat(F.lit("高度相似("), percent, F.lit("%)"))).when(F.col("sim") > 0.9, F.concat(F.lit("相似("), percent, F.lit("%)"))),
        F.when(F.col("n") > 2, F.concat(F.lit("共同讹误"), F.col("n").cast("string"), F.lit("处"))),
        F.when(F.col("alike"), F.lit("同系")), F.when(F.col("from_ancestor"), F.lit("祖本")), F.when(F.col("is_known"), F.lit("已知传承")),
    ))
    sure = F.when(F.col("is_known"), F.greatest(score, F.lit(KNOWN))).otherwise(score)
    return told.where(score >= LEAST).select(
        "source", "target", sure.alias("confidence"), evidence.alias("evidence"), F.round(F.col("sim") * 100, 1).alias("similarity"), F.col("n").alias("shared_errors"), "is_known", "i_ord", "j_ord"
    )


def reduce_transitive(edges: DataFrame) -> DataFrame:
    """H5: without edges that a path of two edges makes needless, unless known or of SURE confidence; two edges at most stay as they are."""
    two = edges.select("source", F.col("target").alias("mid")).join(edges.select(F.col("source").alias("mid"), "target"), "mid").where("mid <> target").select("source", "target").distinct()
    few = edges.agg((F.count(F.lit(1)) <= 2).alias("few"))
    told = edges.join(two.withColumn("again", F.lit(True)), ["source", "target"], "left").join(F.broadcast(few), F.lit(True))  # one row
    return told.where(F.col("again").isNull() | F.col("few") | F.col("is_known") | (F.col("confidence") >= SURE)).select(*edges.columns)


def conclusions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """H7: lines: of each system of two editions or more with an edge within, the chain by year and the evidence of its best edge; and the three best edges between systems."""
    system = nodes.select("name", "system")
    ends = edges.join(system.toDF("source", "s"), "source").join(system.toDF("target", "d"), "target")
    rank = F.struct(-F.col("confidence"), "i_ord", "j_ord")
    best = ends.where("s = d").groupBy(F.col("s").alias("system")).agg(F.min_by(F.array_join("evidence", "、"), rank).alias("evidence"))
    link = F.concat("name", F.lit("("), F.col("year").cast("string"), F.lit(")"))
    chain = nodes.groupBy("system").agg(F.array_sort(F.collect_list(F.struct("year", "ord", link.alias("link")))).alias("x")).where(F.size("x") >= 2).join(best, "system")
    first = chain.select(F.concat(F.lit("【"), "system", F.lit("传承链】"), F.array_join(F.col("x.link"), " → ")).alias("line"))
    second = chain.where("evidence <> ''").select(F.concat(F.lit("  证据："), "evidence").alias("line"))
    across = ends.where("s <> d").orderBy(rank).limit(3).select(F.concat(F.lit("【跨系关联】"), "source", F.lit(" ("), "s", F.lit(") → "), "target", F.lit(" ("), "d", F.lit(")")).alias("line"))
    return first.union(second).union(across)


def new_pairs(cells: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """K3: pairs (i < j) of items (label, d, x) of which one at least is new, with their dot product; pairs of old items are not computed again."""
    part = lambda ids: cells.join(ids, "label", "left_semi")
    a, b = part(new), part(old.union(new))
    both = a.toDF("p", "d", "x").join(b.toDF("q", "d", "y"), "d").where("p <> q")
    both = both.join(new.toDF("q").withColumn("again", F.lit(True)), "q", "left").where("again IS NULL OR p < q")  # two new items meet twice
    return both.groupBy(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


def places(text: Column, passage: Column) -> Column:
    """Where a passage stands in a text (from 0), places that overlap an earlier one left out: the texts between them add up. Grows with the square of their number, which is small."""
    parts = F.split(text, F.concat(F.lit("\\Q"), F.replace(passage, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    before = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, x: n + F.length(x)) + (i - 1) * F.length(passage)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), before)).otherwise(F.array().cast("array<int>"))


def matches_at(matches: DataFrame, positions: DataFrame, width: int) -> DataFrame:
    """Matches (doc_id, item_id, pos, size) whose span, with `width` more behind it, holds the position p of their document."""
    return matches.join(positions, "doc_id").where(F.col("p").between(F.col("pos"), F.col("pos") + F.col("size") + width))


def best(matches: DataFrame, key: str, k: int, *order) -> DataFrame:
    """The k best rows of each key."""
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def mapped(base: DataFrame, links: DataFrame, works: list) -> DataFrame:
    """A row for each base node, a column for each work: the last link (ord) of that work to the node, '' where there is none."""
    n = links.groupBy("node").agg(*(F.max_by(F.when(F.col("work") == w, F.col("link")), F.when(F.col("work") == w, F.col("ord"))).alias(f"work_{w}") for w in works))
    return base.join(n, "node", "left").select("node", *(F.coalesce(f"work_{w}", F.lit("")).alias(f"work_{w}") for w in works))
