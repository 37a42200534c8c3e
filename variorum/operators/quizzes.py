"""Quizzes drawn from decks of cards, by the order of hashes, so that a seed gives the same quiz on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Wrong answers of a question.
WRONG = 3


def quiz(cards: DataFrame, questions: int, seed: str) -> DataFrame:
    """deck, number (from 1), card, question, options and correct_index (from 0, the first option that reads like the answer) of cards (deck, card, front, back).

    A deck gives as many questions as are asked for, or all its cards, each once; a deck of one card gives none. The wrong
    answers are those of three other cards (all others, if fewer), taken in turns from a second order of the deck, and options
    are put in a third. Ranks are limited before the shuffle, so a deck of any size sends a few rows a partition. Cards
    without deck or card take no part; a null answer is empty. Cards of a deck have different ids.
    """
    hashed = lambda salt, *c: F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), *(F.col(x).cast("string") for x in c)))
    own = cards.where("deck IS NOT NULL AND card IS NOT NULL").select("deck", "card", F.col("front").alias("question"), F.coalesce("back", F.lit("")).alias("back"))
    rank = lambda salt: F.row_number().over(Window.partitionBy("deck").orderBy(hashed(salt, "card"), "card"))
    asked = own.withColumn("number", rank("q")).where(F.col("number") <= questions)
    pool = own.select("deck", "card", "back").withColumn("at", rank("w") - 1).where(F.col("at") < (WRONG + 1) * questions)
    pools = pool.groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("at", "card", "back"))).alias("pool")).where(F.size("pool") > 1)
    size = F.size("pool")
    turn = F.sequence(F.lit(0), F.least(size, F.lit(WRONG + 1)) - 1)
    near = F.transform(turn, lambda k: F.get("pool", F.pmod((F.col("number") - 1) * (WRONG + 1) + k, size).cast("int")))
    wrong = F.slice(F.filter(near, lambda x: x["card"] != F.col("card")), 1, WRONG)
    mixed = lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(f"{seed}o"), F.col("card").cast("string"), x["card"].cast("string"))).alias("h"), x["card"].alias("card"), x["back"].alias("back"))
    every = F.concat(F.array(F.struct(F.lit(0).alias("at"), "card", "back")), wrong)
    found = asked.join(pools, "deck").withColumn("options", F.array_sort(F.transform(every, mixed))["back"])
    return found.select("deck", "number", "card", "question", "options", (F.array_position("options", F.col("back")) - 1).cast("int").alias("correct_index"))
