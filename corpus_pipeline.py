"""A corpus from raw documents to token ids: quality, near duplicates, repeated passages, benchmark leaks, encoding.

Every stage takes all that the one before it kept, as a Parquet table, and applies one operator of variorum.llm. An
executor's JVM and Python workers live through all stages, so each stage keeps the session's Arrow batches small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm import byte_bpe, common, decontamination, jaccard_join, quality_classifier, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; labels are those of the corpus, the texts those of docs. Rows are scored in place: nothing is shuffled."""
    docs = common.bounded(docs)
    model = quality_classifier.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality_classifier.filter_rows(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: that of the smallest doc_id, or any one where none has a doc_id. A row linked with nothing stays, with or without a doc_id."""
    return jaccard_join.representatives(common.bounded(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeated windows cover; a text that loses all its words goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substring_dedup.dedup(common.bounded(docs), carry=others)
    stay = cut.where("n_removed < n_words OR n_words = 0")
    own = {c: F.col("rest")[c] for c in others}
    own["doc_id"], own["text"] = F.col("doc_id"), F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    own["n_chars"] = F.length(own["text"]).cast("long")
    return stay.select(*(own[c].alias(c) for c in docs.columns))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; those without a doc_id are told apart by their texts. Texts of any length are read whole, and extra columns may have any names."""
    name = "_key"
    while name in docs.columns:
        name += "_"
    keyed = common.bounded(docs).withColumn(name, common.row_key())
    found = decontamination.find_leaks(keyed, common.table(spark, sf_dir, "benchmark"), name)
    bad = common.small(common.written(found.select(f"{name}.*").distinct(), "leaks"), 1_000_000)
    mine = [keyed[name]["stand_in"] == bad["stand_in"], keyed[name]["key"] == bad["key"]]
    return keyed.join(bad, mine, "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number."""
    ids = byte_bpe.encode(common.bounded(docs).select("doc_id", "text"), *byte_bpe.vocabulary(), block=1 << 20)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("benchmark decontamination", leaks),
    ("byte-level BPE", tokens),
]

#: SQL cannot express a trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
