"""Variant dictionaries and what they decide; decisions, notes and alignments by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.marks import MARKS, SPACES
from .graph import components

#: Rows of a dictionary that may be broadcast.
DICTIONARY_ROWS = 100_000


def dictionary(pairs: DataFrame) -> DataFrame:
    """Char and std (the least of its group by code point) of pairs (a, b) of variants. Pairs chain: whoever shares a variant is in one group. Only single characters count, and no pair of a character with itself."""
    single = pairs.where((F.length("a") == 1) & (F.length("b") == 1) & (F.col("a") != F.col("b")))
    points = single.select(F.ascii("a").cast("long").alias("a"), F.ascii("b").cast("long").alias("b"), F.col("a").alias("x"), F.col("b").alias("y"))
    name = points.select(F.col("a").alias("p"), F.col("x").alias("char")).union(points.select("b", "y")).distinct()
    found = components(points.select("a", "b"))
    own = found.join(name.toDF("node", "char"), "node").join(name.toDF("component", "std"), "component")
    return own.select("char", "std")


def with_std(rows: DataFrame, entries: DataFrame, column: str, out: str) -> DataFrame:
    """Rows with the standard form of a column of characters; a character without an entry is its own."""
    d = entries.toDF(column, "_std")
    d = F.broadcast(d) if entries.limit(DICTIONARY_ROWS + 1).count() <= DICTIONARY_ROWS else d
    return rows.join(d, column, "left").withColumn(out, F.coalesce("_std", column)).drop("_std")


def classified(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """C11: rows (base, reading, ...) with class: identical, variant (of one group) or error."""
    both = with_std(with_std(rows, entries, "base", "_x"), entries, "reading", "_y")
    kind = F.when(F.col("base") == F.col("reading"), "identical").when(F.col("_x") == F.col("_y"), "variant").otherwise("error")
    return both.withColumn("class", kind).drop("_x", "_y")


def folded(t: Column, entries: dict[str, str]) -> Column:
    """The text in standard forms, all at once, so that pairs that swap do swap."""
    one = {k: v for k, v in entries.items() if len(k) == 1 and len(v) == 1}
    return F.translate(t, "".join(one), "".join(one.values()))


def note_type(a: Column, b: Column, variant: Column) -> Column:
    """Omission, addition, transposition, variant or error, for base a and reading b."""
    return F.when(b == "", "omission").when(a == "", "addition").when(T.is_transposition(a, b), "transposition").when((F.length(a) == 1) & (F.length(b) == 1) & variant, "variant").otherwise("error")


def clean_offsets(t: Column) -> Column:
    """Where the characters that are neither marks nor white space stand in the raw text, in order (from 0)."""
    placed = F.transform(F.split(t, ""), lambda c, i: F.when((c == "") | F.contains(F.lit(MARKS + SPACES), c), -1).otherwise(i))
    return F.filter(placed, lambda i: i >= 0)


def apply_decisions(documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """doc_id, text and n_applied: the characters at pos (from 0) give way to new ('' deletes); decisions (doc_id, pos, new, uncertain) that are uncertain are passed over. Of several at one position the least text counts. Characters between two decisions are copied as slices, so work grows with the text."""
    sure = decisions.where(~F.col("uncertain")).groupBy("doc_id", "pos").agg(F.min("new").alias("new"))
    own = sure.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "new"))).alias("d"))
    both = documents.select("doc_id", "text", F.split("text", "").alias("c")).join(own, "doc_id", "left")
    n = F.size("d")
    start = lambda k: F.when(k > 0, F.col("d")[F.greatest(k - 1, F.lit(0))]["pos"] + 1).otherwise(0)
    piece = lambda x, k: F.concat(F.array_join(F.slice("c", start(k) + 1, F.greatest(x["pos"] - start(k), F.lit(0))), ""), x["new"])
    last = F.col("d")[n - 1]["pos"] + 1
    tail = F.array_join(F.slice("c", last + 1, F.greatest(F.size("c") - last, F.lit(0))), "")
    new = F.concat(F.array_join(F.transform("d", piece), ""), tail)
    return both.select("doc_id", F.when(F.col("d").isNull(), F.col("text")).otherwise(new).alias("text"), F.when(F.col("d").isNull(), 0).otherwise(n).cast("long").alias("n_applied"))


def merged_blocks(blocks: DataFrame, least: int = 20) -> DataFrame:
    """blocks (doc_id, ord, t) shorter than `least` are appended to the one before, and all are numbered anew from 0."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    head = (F.length("t") >= least) | (F.row_number().over(w) == 1)
    island = blocks.withColumn("head", head.cast("int")).withColumn("block", F.sum("head").over(w) - 1)
    g = island.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("x"))
    return g.select("doc_id", "block", F.array_join(F.col("x.t"), "").alias("t"))


def suppressed(positions: Column, width: int) -> Column:
    """Positions, best first, without those within width of any that is kept."""
    far = lambda kept, p: ~F.exists(kept, lambda k: F.abs(k - p) < width)
    return F.aggregate(positions, F.array().cast("array<int>"), lambda kept, p: F.when(far(kept, p), F.concat(kept, F.array(p))).otherwise(kept))


def carried(lines: DataFrame, entry: str, quotation: str) -> DataFrame:
    """The lines (doc_id, ord, t) that hold an entry, with the nearest quotation before them in the document (null: none)."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    context = F.last(F.when(F.col("t").rlike(quotation), F.col("t")), ignorenulls=True).over(w)
    return lines.withColumn("context", context).where(F.col("t").rlike(entry))


def headed_pairs(lines: DataFrame) -> DataFrame:
    """Pairs (a, b) of a list (part, ord, head, variant) whose head stands only in the first of its lines. Parts are files or the like, each read in order."""
    w = Window.partitionBy("part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("head") != "", F.col("head")), ignorenulls=True).over(w)
    return lines.select(head.alias("a"), F.col("variant").alias("b")).where("a <> b AND length(a) = 1 AND length(b) = 1").distinct()


def decomposed_pairs(lines: DataFrame) -> DataFrame:
    """Pairs of characters with the same decomposition (char, ids). Each is paired with the least of its group, from which groups are the same as from all pairs."""
    least = lines.groupBy("ids").agg(F.min("char").alias("a"))
    return lines.join(least, "ids").select("a", F.col("char").alias("b")).where("a <> b").distinct()


def printed_entries(t: Column) -> Column:
    """Head and variants of each entry of a printed dictionary: [head] and a number open it, a variant is one character before ` at the begin of a line; the head itself is none."""
    bodies = F.slice(F.split(t, r"(?=\[.\]\s*\d+)"), 1, 1_000_000)
    entry = lambda b: F.struct(F.regexp_extract(b, r"^\[(.)\]\s*\d+", 1).alias("head"), F.array_distinct(F.regexp_extract_all(b, F.lit("(?m)^(.)`"), F.lit(1))).alias("variants"))
    found = F.filter(F.transform(bodies, entry), lambda e: e["head"] != "")
    return F.transform(found, lambda e: F.struct(e["head"].alias("head"), F.array_remove(e["variants"], e["head"]).alias("variants")))
