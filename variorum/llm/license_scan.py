"""Licence scans: a trained paragraph classifier.

A multinomial logistic regression over the word 1- to 3-grams of a paragraph (present or absent) tells licence families
from ordinary text. It is trained by Spark ML on noisy variants of the families' notices, and on the paragraphs of a
bounded sample of documents for the class of unknown text; a temperature and the least probability that counts are set
on variants and paragraphs that training has not seen. A predicted family stands only if one of its notices confirms it:
a given share of the notice's word trigrams must be in the paragraph.

Paragraphs end at blank lines, so a notice may run over any number of lines. Each line is a candidate beside its
paragraph, for texts without blank lines and for notices of several families that follow each other.

Only n-grams with a content word of a notice are features, so every paragraph without one gets the intercepts alone. What
the model says of these is computed once; as long as it is unknown text or too unsure, such paragraphs need no scoring,
else they are scored like all others. Scoring is one projection of built-in functions, the model being two constants of
it: no user function, no shuffle.

Nulls and edge cases: a null or empty text has no paragraphs; a paragraph of any length is scored whole; repeated rows are scanned each; documents without a notice are rows with zero counts and a null family; where the
sample has no text, notices alone train the model; ties go to the family first in the alphabet.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Notices by family. Wording of public licence notices.
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1 or later."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal."],
}
#: Function words: no evidence of their own.
FUNCTION_WORDS = set("a all also an and any are as be been by can following for form found free from in is it may not of or other person possible provided that the this to under use used v version were which with without work you your file on later law met extent author copy deal terms code conditions general public source 0 1 2 3 4".split())
VARIANTS, SAMPLE, MAX_GRAM = 24, 200, 3
#: Share of a notice's trigrams that confirms a prediction, and the share of unknown paragraphs that may pass the probability.
CONFIRMED, FALSE_RATE = 0.5, 0.001
OTHER = "unknown"


def words(p: Column) -> Column:
    return F.array_remove(F.split(F.lower(p), r"[^\p{L}\p{N}]+", -1), "")


def paragraphs(text: Column) -> Column:
    """What stands between blank lines and has any word."""
    return F.filter(F.split(text, r"\n[\x20\x09-\x0D]*\n", -1), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))


CANDIDATES = "array<struct<paragraph:int,line:boolean,p:string>>"


def candidates(paragraphs: Column) -> Column:
    """Each line of a paragraph, and the paragraph itself where it has several."""

    def of(p: Column, i: Column) -> Column:
        def both(lines: Column) -> Column:
            each = F.transform(lines, lambda x: F.struct(i.alias("paragraph"), F.lit(True).alias("line"), x.alias("p")))
            whole = F.array(F.struct(i.alias("paragraph"), F.lit(False).alias("line"), p.alias("p")))
            return F.concat(each.cast(CANDIDATES), F.when(F.size(lines) > 1, whole.cast(CANDIDATES)).otherwise(F.array().cast(CANDIDATES)))

        return bound(F.filter(F.split(p, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), both)

    return F.flatten(F.transform(paragraphs, of))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once, however often f and its inner functions use it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def grams(w: Column, most: int = MAX_GRAM, least: int = 1) -> Column:
    """The distinct n-grams of an array of words, joined by spaces."""

    def of(v: Column, n: int) -> Column:
        at = F.when(F.size(v) >= n, F.sequence(F.lit(1), F.size(v) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(v, i, n), " "))

    return bound(w, lambda v: F.array_distinct(F.flatten(F.array(*[of(v, n) for n in range(least, most + 1)]))))


def py_grams(text: str, least: int, most: int) -> list[str]:
    w = re.findall(r"[^\W_]+", text.lower())
    return [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


class Scanner:
    """Weights by n-gram, intercepts and what calibration found; families in alphabetical order, unknown text last."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, intercepts: np.ndarray, temperature: float, least: float):
        self.families = [*sorted(NOTICES), OTHER]
        self.temperature, self.least = temperature, least
        self.intercepts = [round(float(x), 6) for x in intercepts]
        self.weights = {g: [round(float(x), 6) for x in weights[:, i]] for i, g in enumerate(vocabulary)}
        self.content = content_words()
        self.bare = self.of_bare()

    def of_bare(self) -> bool:
        """Whether a paragraph without any feature would be told as a notice, before it is confirmed."""
        z = np.array(self.intercepts)
        k = int(z.argmax())
        return self.families[k] != OTHER and float(1 / np.exp((z - z[k]) / self.temperature).sum()) >= self.least

    def measured(self, c: Column) -> Column:
        """struct(paragraph, line, words, logits) of a candidate."""
        keys = ", ".join(f"'{g}'" for g in self.weights)
        values = ", ".join("array(" + ", ".join(f"{x}D" for x in row) + ")" for row in self.weights.values())
        model = F.expr(f"map_from_arrays(array({keys}), array({values}))")  # a constant
        zero = F.array(*[F.lit(x) for x in self.intercepts])

        def logits(w: Column) -> Column:
            seen = F.array_intersect(grams(w), F.map_keys(model))
            return F.aggregate(seen, zero, lambda acc, g: F.zip_with(acc, F.element_at(model, g), lambda x, y: x + y))

        return bound(words(c["p"]), lambda w: F.struct(c["paragraph"].alias("paragraph"), c["line"].alias("line"), w.alias("words"), logits(w).alias("logits")))

    def judged(self, x: Column) -> Column:
        """struct(paragraph, line, words, family, probability) of what measured() gives."""
        top = F.array_max(x["logits"])
        total = F.aggregate(x["logits"], F.lit(0.0), lambda s, y: s + F.exp((y - top) / F.lit(self.temperature)))
        names = F.array(*map(F.lit, self.families))
        family = F.element_at(names, F.array_position(x["logits"], top).cast("int"))
        return F.struct(x["paragraph"].alias("paragraph"), x["line"].alias("line"), x["words"].alias("words"), family.alias("family"), (1 / total).alias("probability"))

    def confirmed(self, x: Column) -> Column:
        ok = F.lit(False)
        for family, notices in NOTICES.items():
            for t in notices:
                own = sorted(set(py_grams(t, 3, 3)))
                share = F.size(F.array_intersect(grams(x["words"], 3, 3), F.array(*map(F.lit, own)))) / len(own)
                ok = ok | ((x["family"] == family) & (share >= CONFIRMED))
        return ok


def content_words() -> list[str]:
    return sorted({w for ts in NOTICES.values() for t in ts for w in py_grams(t, 1, 1)} - FUNCTION_WORDS)


def vocabulary() -> list[str]:
    content = set(content_words())
    return sorted({g for ts in NOTICES.values() for t in ts for g in py_grams(t, 1, MAX_GRAM) if content & set(g.split())})


def training_rows(documents: DataFrame) -> DataFrame:
    """p (words), family and fold (0: training, 1: calibration)."""
    spark = documents.sparkSession
    rows = spark.createDataFrame([(f, t) for f, ts in sorted(NOTICES.items()) for t in ts], "family string, t string")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    noisy = F.filter(words(F.col("t")), lambda x, k: (F.col("i") < 2) | (F.pmod(F.xxhash64(x, F.col("i"), k), F.lit(10)) != 0))
    chosen = documents.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    lines = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.explode(candidates(paragraphs(F.col("text")))["p"]).alias("t"))
    lines = lines.select("doc_id", words(F.col("t")).alias("w")).withColumn("trigrams", grams(F.col("w"), 3, 3))
    first = F.concat(F.array_repeat(F.lit("x"), F.pmod(F.col("i"), F.lit(3))), noisy)
    known = rows.select(first.alias("p"), "family", F.pmod(F.col("i"), F.lit(2)).alias("fold"))
    gate = F.size(F.array_intersect("w", F.array(*map(F.lit, content_words()))))
    # ordinary text that does not look like any notice
    like = F.lit(False)
    for g in [sorted(set(py_grams(t, 3, 3))) for ts in NOTICES.values() for t in ts]:
        like = like | (F.size(F.array_intersect("trigrams", F.array(*map(F.lit, g)))) >= 0.3 * len(g))
    other = lines.where((gate < 2) | ~like).select(F.col("w").alias("p"), F.lit(OTHER).alias("family"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"))
    return known.unionByName(other)


def fit(documents: DataFrame) -> Scanner:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    vocab = vocabulary()
    families = [*sorted(NOTICES), OTHER]
    rows = training_rows(documents).select(F.array_intersect(grams(F.col("p")), F.array(*map(F.lit, vocab))).alias("g"), F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double").alias("n"), "fold")
    vector = CountVectorizerModel.from_vocabulary(vocab, inputCol="g", outputCol="features", minTF=0.0)
    rows = vector.transform(rows).select("features", (F.col("n") - 1).alias("label"), "fold").repartition(4).cache()
    model = LogisticRegression(maxIter=60, regParam=1e-3, elasticNetParam=0.0, family="multinomial").fit(rows.where("fold = 0"))
    held = model.transform(rows.where("fold = 1")).select("rawPrediction", "label").collect()  # bounded: variants and a sample
    rows.unpersist()
    z = np.array([r.rawPrediction.toArray() for r in held])
    y = np.array([int(r.label) for r in held])

    def probability(t: float) -> np.ndarray:
        e = np.exp(z / t - (z / t).max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(probability(t)[np.arange(len(y)), y] + 1e-12).mean())
    p = probability(temperature)
    unknown = np.sort(p[y == len(families) - 1][:, :-1].max(1))
    least = max(0.5, float(unknown[int(len(unknown) * (1 - FALSE_RATE))]) if len(unknown) else 0.5)
    return Scanner(vocab, model.coefficientMatrix.toArray(), model.interceptVector.toArray(), float(temperature), min(least, 0.9))


def scan(documents: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id, n_paragraphs, n_candidates (lines and paragraphs with a content word), n_notices (confirmed lines, and paragraphs confirmed for a family that none of their lines has), families (sorted, joined by commas; null: none) and probability (the surest)."""
    content = F.array(*map(F.lit, scanner.content))
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", paragraphs(text).alias("paragraphs"), F.lower(text).alias("low"))
    # the same as a word of content in words(), for a whole text
    possible = F.col("low").rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(scanner.content) + r")(?![\p{L}\p{N}])")
    every = candidates(F.col("paragraphs"))
    none = F.array().cast(CANDIDATES)
    near = every if scanner.bare else F.when(possible, F.filter(every, lambda c: F.arrays_overlap(words(c["p"]), content))).otherwise(none)
    rows = rows.select("doc_id", F.size("paragraphs").cast("long").alias("n_paragraphs"), near.alias("near"))
    rows = rows.withColumn("judged", F.transform(F.transform("near", scanner.measured), scanner.judged))
    sure = F.filter("judged", lambda x: (x["family"] != OTHER) & (x["probability"] >= scanner.least) & scanner.confirmed(x))
    rows = rows.select("doc_id", "n_paragraphs", F.size("near").cast("long").alias("n_candidates"), F.when(F.size("near") > 0, sure).otherwise(F.array().cast(rows.schema["judged"].dataType)).alias("found"))

    def named(lines: bool) -> Column:
        of = F.filter("found", lambda x: x["line"] == lines)
        return F.transform(of, lambda x: F.concat_ws(" ", x["paragraph"].cast("string"), x["family"]))

    notices = F.size(named(True)) + F.size(F.array_except(named(False), named(True)))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    return rows.select(
        "doc_id", "n_paragraphs", "n_candidates", notices.cast("long").alias("n_notices"),
        F.when(F.size("found") > 0, F.array_join(families, ",")).alias("families"),
        F.array_max(F.transform("found", lambda x: x["probability"])).alias("probability"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(documents, fit(documents))
