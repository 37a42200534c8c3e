"""Quality rules: a threshold table compiled into one Spark projection.

The measures of a text (lengths, symbols, stop words, lines, repeats) are expressions of built-in functions, and a
table of rules (measure, least, most) becomes one Boolean expression over them; no user function runs and nothing is
shuffled. Repeats: words are hashed to 64 bits, every five neighbours to one 64-bit key, and equal keys stand next to
each other once the keys are sorted; only texts that have any go on to find out which words those windows cover.

Nulls and edge cases: a null or empty text has no words, all its measures are 0, and it fails; ratios of a text without
words or lines are 0; texts of any length count whole; repeated rows are judged each; an empty
table gives no rows; extra columns pass through whatever their names, but those named as a measure are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, table

WINDOW = 5
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the and of to that is in for with a on as by it be was he this are from "
    "le la les de des et un une en du que qui est pour dans par sur au il avec "
    "der die das und den von ist ein eine mit auf für nicht dem zu des im sich als auch "
    "el los las y del para por con se su lo una es no al como más esta"
).split()

#: Measure, least and most that a kept text may have; None: no bound. Shares are of 1.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 10, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.10),
    ("bang_share", None, 0.30),
    ("upper_share", None, 0.50),
    ("stop_share", 0.04, None),
    ("dup_line_share", None, 0.30),
    ("repeat_word_share", None, 0.20),
    ("ellipsis_line_share", None, 0.30),
    ("bullet_line_share", None, 0.90),
]


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", *(name for name, *_ in RULES if name != "n_words")]


def measures(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and the shares that RULES uses."""
    # the user's row travels in one struct, so its names meet no other
    row = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns if c not in MEASURES)).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    cut = row.withColumn("_words", F.array_remove(F.split("_t", GAP, -1), ""))
    n = F.size("_words")
    # a key for each window: the words' hashes, hashed in order
    h = cut.withColumns({"_n": n, "_h": F.transform("_words", lambda w: F.xxhash64(w)), "_chars": F.length(F.array_join("_words", ""))})
    keys = F.when(
        F.col("_n") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    k = h.withColumn("_keys", keys)
    k = k.withColumn("_repeats", F.size("_keys") > F.size(F.array_distinct("_keys")))
    # only where a window repeats: (key, position) sorted, those with an equal neighbour, and the positions they cover
    placed = F.sort_array(F.transform("_keys", lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
    k = k.withColumn("_placed", F.when(F.col("_repeats"), placed))
    twice = F.filter(
        "_placed",
        lambda x, j: ((j > 0) & (F.get("_placed", j - 1)["k"] == x["k"])) | F.coalesce(F.get("_placed", j + 1)["k"] == x["k"], F.lit(False)),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.sequence(x["i"], x["i"] + (WINDOW - 1))))))
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = k.withColumns({"_lines": lines, "n_repeat_words": F.when(F.col("_repeats"), covered).otherwise(0).cast("long")})
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    stop = "|".join(sorted(STOP_WORDS))
    m = m.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.col("_chars").cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_bangs": F.regexp_count("_t", F.lit(r"!!+")),
        "_upper": F.regexp_count("_t", F.lit(r"(?<![^\x20\x09-\x0D])\p{Lu}{2,}(?!\p{Ll})")),
        "_stops": F.regexp_count("_t", F.lit(rf"(?i)(?<![^\x20\x09-\x0D])(?:{stop})(?=[.,;:!?]?(?:[\x20\x09-\x0D]|$))")),
        "_ellipses": F.size(F.filter("_lines", lambda x: x.rlike(r"(?:\.\.\.|…)\s*$"))),
        "_bullets": F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•] "))),
    })
    n_words, n_lines = F.col("n_words"), F.col("n_lines")
    shares = m.withColumns({
        "mean_word_chars": share(F.col("word_chars"), n_words),
        "symbols_per_word": share(F.col("n_symbols"), n_words),
        "bang_share": share(F.col("_bangs"), n_words),
        "upper_share": share(F.col("_upper"), n_words),
        "stop_share": share(F.col("_stops"), n_words),
        "dup_line_share": share(F.col("n_dup_lines"), n_lines),
        "repeat_word_share": share(F.col("n_repeat_words"), n_words),
        "ellipsis_line_share": share(F.col("_ellipses"), n_lines),
        "bullet_line_share": share(F.col("_bullets"), n_lines),
    })
    return shares.select("row.*", *MEASURES)


def verdict(rules=RULES) -> Column:
    """One expression of the whole table: true if every rule holds."""
    ok = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            ok = ok & (F.col(name) >= least)
        if most is not None:
            ok = ok & (F.col(name) <= most)
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return measures(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict()).alias("kept"),
    )
